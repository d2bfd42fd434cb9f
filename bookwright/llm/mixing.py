"""A mix of documents in which each source has its target share of all tokens.

Sizes are tokens of a public tokenizer. In every source documents stand in the
order of a hash of a seed and their id; prefix sums of tokens in that order,
taken in two steps (sums of slices of the order, then within a slice), cut each
source at its exact budget. A source whose budget is larger than itself starts
again, up to its cap, in the same order.

The default total is the largest at which every source that has documents
reaches its share without passing its cap, so real shares differ from targets
only by the share of sources without documents and by less than one document.
With a larger total, sources that cannot follow give all they may, and the
report says what share each one really got. The total ``CORPUS`` is all tokens
of the target sources: a tiny source then doesn't shrink the mix to its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookwright.llm.encoding import count_tokens
from bookwright.plans.lineage import cut, small

#: Tokens of a slice of the order, on average; a slice is summed by one task.
SLICE = 1 << 22
#: As a total: all tokens of the target sources.
CORPUS = "corpus"


def plan(available: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """For each target source: what it has, what it may give and its ``budget`` in tokens.

    ``available`` has ``source``, ``documents`` and ``tokens``. A target without
    documents has budget 0; null shares count as 0 and null repeats as 1; of
    targets named twice the shares are added and the least cap holds.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    known = wanted.join(available, "source", "left").na.fill(0, ["documents", "tokens"]).withColumn("most", F.col("tokens") * F.col("max_repeats"))
    if total is None:
        reach = known.where("most > 0 and target_share > 0").agg(F.coalesce(F.min(F.col("most") / F.col("target_share")), F.lit(0.0)).alias("total"))
    elif total == CORPUS:
        reach = known.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("total"))
    else:
        reach = known.agg(F.lit(float(total)).alias("total"))
    return known.crossJoin(F.broadcast(reach)).withColumn("budget", F.least(F.floor(F.col("target_share") * F.col("total") + 1e-6).cast("bigint"), F.col("most")))


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str, seed: int = 42) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` and ``key`` of documents of target sources that hold any token."""
    wanted = targets.where("source is not null").select("source").distinct()
    kept = documents.select("doc_id", "source", "text").where("doc_id is not null and text is not null").join(small(wanted), "source", "left_semi")
    counted = count_tokens(kept.select("doc_id", "source", "text"), vocabulary).where("n_tokens > 0")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("key"))


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str, total: int | str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix, one row for each use of a document, and the report of shares.

    The mix has ``source``, ``doc_id``, ``epoch`` (from 1) and ``n_tokens``; the
    report has a row for each target: ``target_share``, ``max_repeats``,
    ``documents``, ``available_tokens``, ``mixed_documents``, ``mixed_tokens``,
    ``actual_share`` (null if the mix is empty).

    Sources that aren't targets, null sources, ids and texts and texts without a
    token are left out; a row repeated under its id counts once. ``targets`` are
    counted, and broadcast to documents while they are few.
    """
    docs = cut(sized(documents, targets, vocabulary, seed))
    sums = docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    planned = cut(plan(sums, targets, total))
    slices = F.greatest(F.lit(1), F.ceil(F.col("tokens") / SLICE))
    # The slice by the upper bits of the key: rows of a slice are neighbours in the order.
    place = F.floor((F.shiftrightunsigned("key", 33) / F.lit(float(1 << 31))) * slices).cast("bigint")
    ordered = F.shiftrightunsigned("key", 1)
    keyed = docs.join(small(planned.where("budget > 0").select("source", "tokens", "budget")), "source").withColumn("slice", place).withColumn("order", ordered)
    by_slice = keyed.groupBy("source", "slice").agg(F.sum("n_tokens").alias("in_slice"))
    before = by_slice.withColumn("base", F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice")) - F.col("in_slice")).drop("in_slice")
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "slice").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    summed = keyed.withColumn("inside", upto).join(before, ["source", "slice"]).withColumn("upto", F.col("base") + F.col("inside"))
    # Epoch e takes a document if the tokens up to its end, e - 1 whole epochs before it, fit the budget.
    uses = F.greatest(F.lit(0), F.floor((F.col("budget") - F.col("upto")) / F.col("tokens")) + 1).cast("int")
    used = summed.withColumn("uses", uses).where("uses > 0")
    mixed = used.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("epoch"), "n_tokens")
    got = used.groupBy("source").agg(F.sum("uses").alias("mixed_documents"), F.sum(F.col("uses") * F.col("n_tokens")).alias("mixed_tokens"))
    everything = got.agg(F.sum("mixed_tokens").alias("all"))
    report = (
        planned.select("source", "target_share", "max_repeats", "documents", F.col("tokens").alias("available_tokens"))
        .join(got, "source", "left")
        .na.fill(0, ["mixed_documents", "mixed_tokens"])
        .crossJoin(F.broadcast(everything))
        .withColumn("actual_share", F.col("mixed_tokens") / F.col("all"))
        .drop("all")
    )
    return mixed, report
