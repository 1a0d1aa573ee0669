import random

import numpy as np

from quillgrid.llm import mixing


def test_words_of_the_good_domain_and_at_twice_the_frequency_count(spark):
    r = random.Random(12)
    docs, labels = [], []
    for i in range(1200):
        kind = i % 3
        words = [f"w{r.randrange(30)}" for _ in range(40)]
        words += ["fine"] * (r.random() < (0.9, 0.2, 0.2)[kind]) + ["so"] * (r.random() < (0.2, 0.6, 0.2)[kind])
        words += ["both"] * (r.random() < (0.02, 0.5, 0.02)[kind]) + ["vile"] * (kind == 2)
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    docs += [(5000, "fine w1 w2"), (5001, "w1 w2")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mixing.fit_classifier(docs, labels)
    assert "fine" in model["words"][0] and {"so", "both"} <= set(model["words"][1]) and "vile" in model["words"][2]
    rows = {x["doc_id"]: x["p"] for x in mixing._judged(docs, [docs["doc_id"]], model).collect()}
    assert rows[5000][0] > rows[5001][0] + 0.2
    # a plain version, with words that tell for more than one domain counted for each
    model["words"][2]["so"] = [-1.0, -0.5, -0.25]
    got = {x["doc_id"]: x["p"] for x in mixing._judged(docs, [docs["doc_id"]], model).collect()}
    for doc_id, text in docs.collect():
        words = text.split()
        share = len(set(words)) / len(words)
        z = np.array(model["prior"]) + model["variety"][next((i for i, top in enumerate(mixing.VARIETY) if share < top), len(mixing.VARIETY))]
        for k in range(3):
            hits = [np.array(model["words"][k][w]) - model["any"][k, True] for w in set(words) if w in model["words"][k]]
            z = z + model["any"][k, bool(hits)] + (np.mean(hits, axis=0) if hits else 0)
        p = np.exp(z - z.max())
        assert np.allclose(got[doc_id], p / p.sum())
