"""Every operator and the pipeline over odd and empty tables."""

import hashlib
import math

import pytest

from graphloom.llm import registry

PER_DOCUMENT = ("op1_near_dedup", "op2_token_records", "op3_source_mix", "op4_mil_classifier", "op5_license_scan", "op7_lm_scoring", "op9_quality_rules", "op10_bpe", "op11_merkle_manifest", "op12_language_id", "op13_periodic_runs")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == (1 if name == "op8_chat_format" else 0)


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_document(spark, odd, name):
    rows = registry.queries()[name](spark, odd).collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i in ids)


def test_classes(spark, odd):
    got = {r["doc_id"]: r["class_id"] for r in registry.queries()["op1_near_dedup"](spark, odd).collect() if r["doc_id"] is not None}
    assert got[5] == got[6] == got[7] == 5
    assert got[0] == got[1] == 0  # null equals empty
    assert len({got[k] for k in (0, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 14, 50)}) == 13


def test_records(spark, odd):
    rows = sorted(registry.queries()["op2_token_records"](spark, odd).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    assert [r["doc_id"] for r in rows] == sorted([r["doc_id"] for r in rows], key=lambda i: (i is not None, i or 0))
    assert min(r["n_tokens"] for r in rows) == 1


def test_mix(spark, odd):
    rows = registry.queries()["op3_source_mix"](spark, odd).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 64


def test_scores(spark, odd):
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in registry.queries()["op4_mil_classifier"](spark, odd).collect())
    rows = registry.queries()["op7_lm_scoring"](spark, odd).collect()
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) and r["n_tokens"] >= 1 for r in rows)


def test_licences(spark, odd):
    got = {r["doc_id"]: r["license"] for r in registry.queries()["op5_license_scan"](spark, odd).collect()}
    assert got[11] == "Apache-2.0"
    assert got[3] == "Apache-2.0"  # of the same directory
    assert got[4] is None


def test_search(spark, odd):
    rows = registry.queries()["op6_topk_search"](spark, odd).collect()
    assert {r["query_id"] for r in rows} == {0, 100}
    best = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 0)
    assert [k for k, _ in best] == list(range(1, 11))
    assert not any(r["query_id"] == r["vec_id"] for r in rows)


def test_chat(spark, odd):
    got = {r["conv_id"]: r for r in registry.queries()["op8_chat_format"](spark, odd).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "user\nhi\nassistant\n\nassistant\n\nassistant\n</s>[INST] <\\s> [\\/INST]\n"
    assert got[1]["turns_sha256"] == digest(said)
    assert got[1]["loss_sha256"] == digest("</s>[INST] <\\s> [\\/INST]")
    assert got[3]["loss_chars"] == 0
    assert got[3]["n_turns"] == 1
    assert got[2]["turns_sha256"] == digest("\nx\n")
    assert got[-1]["loss_sha256"] == digest("</s>[INST] ok [/INST]")


def test_pipeline(spark, odd, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    corpus_pipeline.run(spark, odd).count()
    columns = spark.read.parquet(f"{odd}/documents.parquet").columns
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd).columns == columns


def test_stages_with_clashing_names(spark, odd):
    """Columns named like the operators' own, and names that need quoting."""
    from pyspark.sql import functions as F

    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    names = ("text_id__", "class_id__", "row__", "rest__", "part__", "n_words__stat", "a.b", "c0", "n_words", "text_id", "mark", "a`b")
    docs = docs.select("*", *(F.struct(F.lit(k).alias("x")).alias(n) for k, n in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns
        out.collect()
