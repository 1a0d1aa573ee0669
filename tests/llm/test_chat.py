import hashlib
from collections import defaultdict

from quillgrid.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a <|next|> & &lt;|end|>"), (1, 2, "assistant", ""), (1, 3, "user", None), (1, 3, "user", "tie"),
    (2, 1, "assistant", "<|start|>assistant<|text|>x<|end|>\n"), (2, 0, None, "no role"), (2, None, "a|b<|text|>", "\\<|"),
    (None, 0, "user", "no conv"), (3, 5, "assistant", "é😀<"), (3, 6, "assistant", "|>"), (4, 0, "user", "x" * 100_000), (5, 1, "user", "twice"), (5, 1, "user", "twice"),
    (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(df).cache()
    for r in formatted.collect():
        assert all("<|" not in r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["mask"])
    want = defaultdict(list)
    for c, t, role, text in ROWS:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns = [(role, text) for _, role, text in sorted(turns)]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["trained"] == "".join(x for role, x in turns if role == "assistant")
    merged = next(r["formatted"] for r in formatted.collect() if r["conv_id"] == 3)
    assert merged.count("<|start|>") == 1 and merged.count("<|next|>") == 1


def test_rows_without_a_conversation_are_apart(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "b"), (1, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    got = [(r["conv_id"], [t["text"] for t in r["turns"]]) for r in chat.read_back(chat.format_conversations(df)).collect()]
    assert sorted(got, key=str) == sorted([(None, ["a"]), (None, ["b"]), (1, ["c"])], key=str)


def test_many_turns_take_linear_time(spark):
    import time

    rows = [(c, i, "user" if c == 1 or i % 2 else "assistant", f"text {i} <| & {'y' * (i % 7)}") for c in (1, 2, 3) for i in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert time.time() - began < 60
    for c in (1, 2, 3):
        assert [t["text"] for t in got[c]["turns"]] == [x for k, _, _, x in rows if k == c]
        assert got[c]["trained"] == "".join(x for k, _, r, x in rows if k == c and r == "assistant")


def test_query(spark, sf_dir):
    from quillgrid.llm.queries import op2_chat_formatting

    r = op2_chat_formatting(spark, sf_dir).where("conv_id = -7").first()
    t = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(t)) and r["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


def test_empty(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
