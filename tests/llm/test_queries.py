"""Every query over its whole tables at the smallest size: columns, types, and what the contract fixes of the rows."""

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgrid.llm import queries

COLUMNS = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op3_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_credential_linking": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_soft_membership_mixing": {"doc_id": "bigint", "tokens": "bigint", "rate": "double", "met": "boolean"},
    "op6_cross_polytope_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_ngram_jaccard_join": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op8_compression_bands": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_label_propagation_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10_maximum_entropy_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op11_block_max_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_kneser_ney_languages": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op13_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
}
#: One row for each document.
BY_DOCUMENT = ("op3", "op4", "op5", "op7", "op8", "op9", "op10", "op12", "op13")


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return {name: (dict(df.dtypes), df.collect()) for name in COLUMNS for df in [queries.QUERIES[name](spark, sf_dir)]}


def test_all_are_registered():
    assert list(queries.QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, sf_dir, results, name):
    types, rows = results[name]
    assert {k: types.get(k) for k in COLUMNS[name]} == COLUMNS[name]
    if name.split("_")[0] in BY_DOCUMENT:
        docs = [r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)


def test_packing_holds_every_token_once(spark, sf_dir, results):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    held, sequences = defaultdict(list), defaultdict(list)
    for r in results["op1_best_fit_packing"][1]:
        held[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for i, r in enumerate(sorted(held[d["doc_id"]], key=lambda r: r["piece"])):
            part = ids[2048 * i : 2048 * (i + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (i, 2048 * i, len(part), zlib.crc32(part.tobytes()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    # first fit of pieces by size, which is close to the best there is
    bins: list[int] = []
    for n in sorted((r["length"] for r in results["op1_best_fit_packing"][1]), reverse=True):
        k = next((k for k, free in enumerate(bins) if free >= n), None)
        bins += [2048] if k is None else []
        bins[k if k is not None else -1] -= n
    assert len(sequences) <= 1.05 * len(bins) + 2


def test_rates_meet_targets_or_say_so(results):
    from quillgrid.llm import mixing

    rows = results["op5_soft_membership_mixing"][1]
    p, tokens, rate = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows]), np.array([r["tokens"] for r in rows], dtype=float), np.array([r["rate"] for r in rows])
    got = (rate * tokens) @ p
    near = np.abs(got / got.sum() - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 2e-3
    assert len({r["met"] for r in rows}) == 1 and (near or not rows[0]["met"])


def test_neighbours_are_exact_distances(spark, sf_dir, results):
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    found = defaultdict(list)
    for r in results["op6_cross_polytope_search"][1]:
        assert r["score"] == float(np.sqrt(((x[r["query_id"]] - x[r["vec_id"]]) ** 2).sum()))
        found[r["query_id"]].append((r["rank"], r["vec_id"]))
    hits = 0
    for q, near in found.items():
        best = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
        hits += len({i for _, i in best} & {i for _, i in near})
    assert set(found) == {i for i in x if i % 100 == 0} and hits >= 0.9 * 10 * len(found)


def test_scores_are_finite_and_beat_single_words(results):
    rows = results["op10_maximum_entropy_scores"][1]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
