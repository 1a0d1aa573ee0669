import random

import numpy as np
import pytest

from quillgrid.llm import mixing


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        kind = r.choices([0, 1, 2], [0.7, 0.2, 0.1])[0]
        words = [f"w{r.randrange(40)}" for _ in range(r.randint(20, 80))] + [["fine"], ["junk!!", "junk##"], ["vile"]][kind] * 2
        r.shuffle(words)
        docs.append((i, " ".join(words), "en", "s", 1, "c"))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2), kind))
    docs += [(5000, None, None, None, None, "c"), (5001, "", "en", "s", 0, "c"), (None, "fine w1", "en", "s", 1, "c"), docs[3]]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, rate string"), spark.createDataFrame([x[:3] for x in labels] + [(None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")


def test_targets_are_met_and_posteriors_right(tables):
    docs, labels = tables
    rows = mixing.rates(docs, labels).collect()
    assert len(rows) == docs.count()
    tokens, p, rate = (np.array(x, dtype=float) for x in ([r["tokens"] for r in rows], [[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows], [r["rate"] for r in rows]))
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all() and (rate <= mixing.MOST).all()
    got, wanted = (rate * tokens) @ p, np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert np.abs(got / got.sum() - wanted).max() < 0.005
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    right = [("vile" in (text[r["doc_id"]] or "")) == (r["p_toxic"] > 0.5) for r in rows if r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean(right) > 0.98


def test_stage_drops_toxic_and_keeps_clean(tables):
    docs, labels = tables
    kept = mixing.mix(docs, labels)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sum("vile" in t for t in texts) <= 0.15 * docs.where("text like '%vile%'").count()
    assert sum("fine" in t for t in texts) >= 0.97 * docs.where("text like '%fine%'").count()


def test_each_row_is_taken_as_often_as_its_rate_says(tables):
    docs, labels = tables
    rated = {r["doc_id"]: r for r in mixing.rates(docs, labels).collect()}
    times = {i: 0 for i in rated}
    for r in mixing.mix(docs, labels).collect():
        times[r["doc_id"]] += 1
    single = [r for i, r in rated.items() if i not in (3, None)]
    assert all(np.floor(r["rate"]) <= times[r["doc_id"]] <= np.ceil(r["rate"]) for r in single)
    p, tokens = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in single]), np.array([r["tokens"] for r in single], dtype=float)
    got = (np.array([times[r["doc_id"]] for r in single]) * tokens) @ p
    assert np.abs(got / got.sum() - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 0.025


def test_each_domain_is_held_against_its_own_target(tables):
    """Wanted and reached tokens come with every row; 1 % of a small target is not 1 % of all tokens."""
    docs, labels = tables
    for targets, met in (({"good": 0.9, "poor": 0.06, "toxic": 0.04}, True), ({"good": 0.9899, "poor": 0.01, "toxic": 0.0001}, False)):
        rows = mixing.rates(docs, labels, targets).collect()
        reached = [sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS]
        assert [rows[0][f"reached_{d}"] for d in mixing.DOMAINS] == pytest.approx(reached)
        wanted = np.array([rows[0][f"wanted_{d}"] for d in mixing.DOMAINS])
        assert wanted / wanted.sum() == pytest.approx([targets[d] for d in mixing.DOMAINS])
        assert rows[0]["met"] == met == bool((np.abs(np.array(reached) - wanted) <= mixing.CLOSE * wanted).all())


def plain_rates(p, tokens, wanted, most, rounds=200_000):
    """The same least squares by small steps of plain projected gradient."""
    total, r = tokens.sum(), np.ones(len(p))
    for _ in range(rounds):
        slope = p @ ((r * tokens) @ p - wanted) / total + (r - 1) / mixing.STIFF
        after = np.clip(r - 0.9 * slope, 0, most)
        if np.abs(after - r).max() < 1e-12:
            break
        r = after
    return r


@pytest.mark.parametrize("good", [0.9, 0.6, 0.98, 0.999])
def test_fit_is_the_plain_least_squares(spark, good):
    r = np.random.default_rng(4)
    p = r.dirichlet([0.6, 0.4, 0.3], 400) * 0.98 + [0.01, 0.006, 0.004]
    tokens = r.integers(1, 400, 400).astype(float)
    members = spark.createDataFrame([(float(t), *map(float, x)) for t, x in zip(tokens, p)], "tokens double, p_good double, p_poor double, p_toxic double")
    targets = mixing.TARGETS if good == 0.98 else {"good": good, "poor": (1 - good) * 0.7, "toxic": (1 - good) * 0.3}
    fit = mixing.fit_rates(members, targets, most=4.0)
    plain = plain_rates(p, tokens, fit.wanted, 4.0)
    mine = np.clip(1 - p @ fit.steps, 0, 4.0)
    reached = (plain * tokens) @ p
    assert fit.met == bool((np.abs(reached - fit.wanted) <= mixing.CLOSE * fit.wanted).all())
    if fit.met:
        assert np.abs((mine * tokens) @ p - reached).max() < 2e-3 * tokens.sum()
    else:
        assert np.linalg.norm(fit.reached - fit.wanted) <= 1.1 * np.linalg.norm(reached - fit.wanted)


def test_out_of_reach_is_said(spark, tables):
    docs, labels = tables
    assert not mixing.rates(docs, labels, {"good": 0.0005, "poor": 0.0005, "toxic": 0.999}, most=1.0).first()["met"]


def test_very_long_texts_ties_and_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "x"), (2, "a b", "x"), (2, "a b", "x"), (3, None, None)], "doc_id long, text string, tokens string").withColumn("p_good", docs_name())
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["tokens"] for r in mixing.rates(docs, labels).collect()} == {1: 300_000, 2: 2, 3: 0}
    assert mixing.mix(docs, labels).columns == docs.columns
    assert mixing.mix(docs.limit(0), labels).count() == 0


def docs_name():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_bare_tables(spark, tables):
    docs, labels = tables
    assert mixing.rates(docs.limit(0), labels).count() == 0
    assert mixing.rates(docs, labels.limit(0)).count() == docs.count()
