import pytest
from pyspark.sql import functions as F

from bookwright.llm import mixing, queries
from bookwright.llm.queries import VOCABULARY

TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(n, source, "one two three four five six seven eight") for n, source in enumerate(["big"] * 300 + ["mid"] * 60 + ["small"] * 10)]
    rows += [(1000, "big", None), (1001, "big", ""), (1002, None, "text"), (1003, "other", "text"), (None, "big", "text"), (0, "big", "one two three four five six seven eight")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slice", F.lit(1)).withColumn("tokens", F.lit(1))


def test_shares_are_met(spark, documents):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("none", 0.05, 4)], TARGETS)
    mixed, report = mixing.mix(documents, targets, VOCABULARY)
    found = {r["source"]: r for r in report.collect()}
    total = 40 * 8 / 0.15
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert share * total - 8 <= found[source]["mixed_tokens"] <= share * total
        assert abs(found[source]["actual_share"] - share / 0.95) < 0.01
    assert found["none"]["mixed_tokens"] == 0
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("epoch").alias("e")).collect()
    assert all(r["n"] == r["e"] <= {"big": 1, "mid": 2, "small": 4}[r["source"]] for r in uses)
    assert {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()} == {s: r["mixed_tokens"] for s, r in found.items() if r["mixed_tokens"]}


def test_a_large_total_reports_what_is_missing(spark, documents):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 2), (None, 0.1, 1)], TARGETS)
    report = {r["source"]: r for r in mixing.mix(documents, targets, VOCABULARY, total=10_000)[1].collect()}
    assert report["mid"]["mixed_tokens"] == 60 * 8 * 2
    assert report["big"]["mixed_tokens"] == 300 * 8
    assert abs(report["big"]["actual_share"] - 2400 / 3360) < 1e-9


def test_a_tiny_source_does_not_shrink_the_corpus(spark, tmp_path):
    rows = [(n, source, "one two three four five six seven eight") for n, source in enumerate(["big"] * 300 + ["mid"] * 60 + ["tiny"])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 4), ("none", 0.05, 4)], TARGETS).write.parquet(f"{tmp_path}/source_targets.parquet")
    whole = 361 * 8
    report = {r["source"]: r for r in queries.p7_shares(spark, str(tmp_path)).collect()}
    assert 0.5 * whole - 8 < report["big"]["mixed_tokens"] <= 0.5 * whole
    assert 0.3 * whole - 8 < report["mid"]["mixed_tokens"] <= 0.3 * whole
    assert report["mid"]["mixed_documents"] > 60
    assert (report["tiny"]["mixed_tokens"], report["none"]["mixed_tokens"]) == (4 * 8, 0)
    assert queries.p7_mix(spark, str(tmp_path)).where("source = 'tiny'").count() == 4


def test_slices_give_one_order(spark, documents, monkeypatch):
    targets = spark.createDataFrame([("big", 0.7, 1), ("mid", 0.3, 1)], TARGETS)
    whole = sorted(map(tuple, mixing.mix(documents, targets, VOCABULARY)[0].collect()))
    monkeypatch.setattr(mixing, "SLICE", 50)
    assert sorted(map(tuple, mixing.mix(documents, targets, VOCABULARY)[0].collect())) == whole


def test_nothing_to_mix(spark, documents):
    targets = spark.createDataFrame([("none", 1.0, 1)], TARGETS)
    mixed, report = mixing.mix(documents, targets, VOCABULARY)
    assert mixed.count() == 0
    assert [tuple(r) for r in report.select("source", "mixed_tokens", "actual_share").collect()] == [("none", 0, None)]
    assert mixing.mix(documents.limit(0), targets, VOCABULARY)[0].count() == 0
    assert mixing.mix(documents, targets.limit(0), VOCABULARY)[1].count() == 0
