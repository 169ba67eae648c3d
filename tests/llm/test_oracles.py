"""Registered queries against DuckDB on the smallest tables, and the pipeline against its stages done by brute force."""

import collections

import pytest
from conftest import SF, duck, same

from dcbspark.llm import oracles, queries


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_query(spark, name, tmp_path):
    assert same(queries.queries()[name](spark, SF), duck(), oracles.oracle_sql()[name], tmp_path)


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op2_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(rows[i]["predicted"], y) for i, y in labels.items() if rows[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.97


def test_pipeline_returns_n_best(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", "s")], "doc_id long, text string, lang string, source string")
    (row,) = c.tokens(spark, docs, SF).collect()
    assert len(row["nbest_scores"]) == len(set(row["nbest_crc32"])) == c.pieces.N_BEST and row["nbest_scores"][0] == row["score"]


def test_pipeline_keeps_one_near_duplicate_whatever_the_ids(spark):
    import corpus_pipeline as c

    a, b, d = (" ".join(f"{x}{k}" for k in range(90)) for x in "abd")
    rows = [(7, a), (7, f"{a} x"), (7, f"{a} y"), (7, b), (7, f"{b} x"), (None, d), (None, f"{d} x"), (None, "e f g"), (None, "h i j"), (None, f"{b} z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["text"].split()[0] for r in c.unlike(spark, docs, SF).collect()]
    assert sorted(got) == ["a0", "b0", "d0", "e", "h"]


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in c.STAGES:
        out = c.materialise(stage(spark, docs, SF), "test")
        before, after = docs.collect(), out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(texts[r["doc_id"]] == r["text"] for r in after)
        if name == "exact_dedup":
            assert len(after) == len({(r["text"] or "").encode().lower() for r in before})
        if name == "near_dedup":
            sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((r["text"] or "").encode().lower().split() for r in after) if w]
            assert not any(5 * len(a & b) >= 4 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
        if name == "mixing":
            assert set(collections.Counter(r["doc_id"] for r in after)) == {r["doc_id"] for r in before}
        if name == "sentencepiece":
            assert len(after) == len(before) and all(r["round_trip"] for r in after)
        docs = out
