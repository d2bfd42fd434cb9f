"""What an ingest would change: by comparing hashes with what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["collection", "source_path"]


def kept_tags(new: Column, old: Column) -> Column:
    """New tags if there are any, else those a document has."""
    return F.when(F.size(F.coalesce(new, F.array().cast("array<string>"))) > 0, new).otherwise(F.coalesce(old, F.array().cast("array<string>")))


def status(new_hash: Column, old_hash: Column, known: Column, new_tags: Column, old_tags: Column, force: bool = False) -> Column:
    """added, updated, retagged or unchanged."""
    same = known & new_hash.eqNullSafe(old_hash) & F.lit(not force)
    tagged = (F.size(F.coalesce(new_tags, F.array().cast("array<string>"))) > 0) & ~F.array_sort(new_tags).eqNullSafe(F.array_sort(old_tags))
    return F.when(same & tagged, "retagged").when(same, "unchanged").when(known, "updated").otherwise("added")


def decide(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """``incoming`` (key, ``source_hash``, ``tags``) with ``status``, ``tags`` as they will be, and ``old_chunks``.

    Keys are unique in ``stored``. A null key is never known.
    """
    old = stored.select(*KEY, F.col("source_hash").alias("__hash"), F.col("tags").alias("__tags"), F.col("total_chunks").alias("old_chunks"), F.lit(True).alias("__known"))
    known = F.coalesce("__known", F.lit(False))
    joined = incoming.join(old, KEY, "left")
    return joined.withColumn("status", status(F.col("source_hash"), F.col("__hash"), known, F.col("tags"), F.col("__tags"), force)).withColumn("tags", kept_tags(F.col("tags"), F.col("__tags"))).drop("__hash", "__tags", "__known")


def removed(incoming: DataFrame, stored: DataFrame, prefix: str) -> DataFrame:
    """Stored documents under ``prefix`` that no incoming row names, failed ones included."""
    return stored.where(F.startswith("source_path", F.lit(prefix))).join(incoming.select(*KEY).distinct(), KEY, "left_anti")


def outside(incoming: DataFrame, prefix: str) -> DataFrame:
    """Incoming rows that a sync of ``prefix`` must not hold."""
    return incoming.where(~F.startswith("source_path", F.lit(prefix)))


def histogram(outcomes: DataFrame) -> DataFrame:
    """``status`` and ``n``."""
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))
