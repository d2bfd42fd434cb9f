"""Texts that share most of their word runs, by tensored banding.

Minhashes are computed for small collections in groups, each with left ones of
single hashes and right ones of pairs; every table key combines one of the left
with one of the right of its group. One large group would let all its tables miss
together: 6 x 12 bands find 0.953 of the pairs of similarity 0.5, 12 groups of
2 x 3, which are 72 tables as well, 0.9989 (the sketch loses some 0.001 more).
A row of a table is a key and a sketch of 128 bits, which stands for the class, so
pairs that meet are filtered where they meet; what is left is joined to the ids
that have the sketches and verified on the words themselves.

The number of tasks that compare follows the number of keys. A key that many
texts share is compared whole all the same: its texts get block numbers, and each
block meets each under a key of its own. Which keys these are is estimated from
one class in ``PROBE``; that decides how the work is spread, not what is compared.

Texts of the same word sequence are one class from the start: copies fill no
bucket and are verified once; pairs are expanded to all members of both classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright.llm.copies import leaf, record_form
from bookwright.plans.lineage import FEW, cut, small

#: Words of a run, least share of common runs, groups of bands, left bands of a group (of one minhash), right bands (of two), bits of the sketch, seed.
RUN, SIMILARITY, GROUPS, LEFT, RIGHT, BITS, SEED = 3, 0.5, 12, 2, 3, 128, 5
#: Keys of a task, least number of tasks, texts of a key from which it is compared in blocks of so many, part of the classes that are asked which keys these are.
TASK, TASKS, CROWD, PROBE = 1 << 19, 64, 1 << 13, 64
WORDS = re.compile(r"[^\W_]+")
_BLOCK = 1 << 19


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, case ignored."""
    return WORDS.findall(text.casefold())


def runs(text: str, run: int = RUN) -> set[tuple[str, ...]]:
    """The distinct runs of ``run`` consecutive words."""
    w = words(text)
    return set(zip(*(w[i:] for i in range(run)), strict=False))


def similarity(a: set, b: set) -> float:
    """Shared runs as a part of all runs of either; 0 if there is none."""
    common = len(a & b)
    return common / (len(a) + len(b) - common) if common else 0.0


def _mix(x: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (n + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signatures(hashes: np.ndarray, starts: np.ndarray, left: int = GROUPS * LEFT, right: int = GROUPS * RIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left bands, right bands and the two words of the sketch of texts whose run hashes begin at ``starts``.

    Every text has at least one run.
    """
    number = left + 2 * right
    low = np.stack([np.minimum.reduceat(_mix(hashes, SEED + n), starts) for n in range(number)], axis=1)
    with np.errstate(over="ignore"):
        pairs = _mix(low[:, left::2] * np.uint64(3) + low[:, left + 1 :: 2], 1)
    bits = np.empty((len(starts), BITS), np.uint8)
    for n in range(0, BITS, 2):  # two bits of each of 64 further minhashes
        value = np.minimum.reduceat(_mix(hashes, 1000 + n), starts)
        fold = _mix(value, 2)
        bits[:, n], bits[:, n + 1] = fold & np.uint64(1), (fold >> np.uint64(1)) & np.uint64(1)
    half = np.uint64(32)
    return (low[:, :left] >> half).astype(np.uint32).view(np.int32), (pairs >> half).astype(np.uint32).view(np.int32), np.packbits(bits, axis=1).view(np.int64)


def _signed(rows: DataFrame, run: int) -> DataFrame:
    """``id``, ``w1``, ``w2`` (digest of the words), ``s1``, ``s2``, ``left``, ``right`` of texts with at least ``run`` words."""
    whole = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("record", "w1", "w2", "s1", "s2")), T.StructField("left", whole), T.StructField("right", whole)])

    def lists(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def signed(ids: list[int], records: list[int], texts: list[str], known: dict[str, int]) -> pa.RecordBatch | None:
        kept, hashes, starts, digests, size = [], [], [], [], 0
        for n, text in enumerate(texts):
            w = words(text)
            if len(w) < run:
                continue
            codes = np.empty(len(w), np.uint64)
            for k, x in enumerate(w):
                code = known.get(x)
                if code is None:
                    code = known[x] = xxhash.xxh64_intdigest(x)
                codes[k] = code
            mixed = codes[: len(w) - run + 1]
            for k in range(1, run):
                mixed = _mix(mixed, k) + codes[k : len(w) - run + 1 + k]
            kept.append(n)
            hashes.append(_mix(mixed, 0))
            starts.append(size)
            size += len(mixed)
            d = xxhash.xxh3_128_digest(" ".join(w))
            digests.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
        if not kept:
            return None
        left, right, sketch = signatures(np.concatenate(hashes), np.array(starts))
        w1, w2 = zip(*digests, strict=True)
        columns = [pa.array([ids[n] for n in kept]), pa.array([records[n] for n in kept]), pa.array(w1), pa.array(w2), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), lists(left), lists(right)]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, records, texts = (batch.column(n).to_pylist() for n in range(3))
                at = 0
                while at < len(ids):  # blocks of so many characters, at least one text
                    upto, size = at, 0
                    while upto < len(ids) and (size == 0 or size + len(texts[upto]) <= 8 * _BLOCK):
                        size += len(texts[upto]) + 1
                        upto += 1
                    if (part := signed(ids[at:upto], records[at:upto], texts[at:upto], known)) is not None:
                        yield part
                    at = upto
                if len(known) > 1 << 20:
                    known = {}

    return rows.select("id", F.coalesce(F.xxhash64(record_form(F.col("text"))), F.lit(0)).alias("record"), "text").mapInArrow(go, schema)


def _least_common_bits(least: float) -> int:
    """Bits in which sketches of texts as similar as ``least`` agree, but for one pair in some hundred.

    Of the two bits of a minhash both agree if it does, and each with even chance if not.
    """
    mean = 1 + least
    spread = 4 * least + 1.5 * (1 - least) - mean**2
    return int(BITS / 2 * mean - 3 * (BITS / 2 * spread) ** 0.5)


def _verified(pairs: DataFrame, rows: DataFrame, least: float, run: int) -> DataFrame:
    """``a``, ``b``, ``similarity`` of pairs that are similar enough and no copies, from their words."""
    needed = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    number = needed.count()
    rows = rows.join(small(needed, number), "id", "left_semi") if number <= FEW else rows
    a = rows.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = rows.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("ta", T.StringType()), T.StructField("tb", T.StringType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [similarity(runs(x, run), runs(y, run)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array([s >= least for s in score], pa.bool_())
            table = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), batch.column(2), batch.column(3)], names=[f.name for f in schema])
            yield table.filter(keep)

    near = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(go, schema)
    same = (leaf(F.col("ta")) == leaf(F.col("tb"))) | F.coalesce(record_form(F.col("ta")) == record_form(F.col("tb")), F.lit(False))
    return near.where(~same).select("a", "b", "similarity")


def _keys(heads: DataFrame) -> DataFrame:
    """``key``, ``s1``, ``s2``: every table key of every class, with its sketch."""
    bands = heads.select("s1", "s2", "left", F.posexplode("right").alias("j", "r"))
    tables = bands.select("s1", "s2", "j", "r", F.posexplode(F.slice("left", F.floor(F.col("j") / RIGHT).cast("int") * LEFT + 1, LEFT)).alias("i", "l"))
    return tables.select(F.xxhash64("i", "j", "l", "r").alias("key"), "s1", "s2")


def _met(heads: DataFrame, most_apart: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of classes that share a key and whose sketches are near."""
    keyed = _keys(heads)
    apart = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    before = (F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2")))

    def meet(rows: DataFrame, *key: str) -> DataFrame:
        own = [c for c in rows.columns if c == "own"]
        a = rows.select(*key, *own, F.col("s1").alias("a1"), F.col("s2").alias("a2"))
        b = rows.select(*key, *[F.col(c).alias("other") for c in own], F.col("s1").alias("b1"), F.col("s2").alias("b2"))
        once = (F.col("own") != F.col("other")) | (F.col("i") == F.col("j")) if own else F.lit(True)
        return a.join(b, list(key)).where(before & once & (apart <= most_apart)).select("a1", "a2", "b1", "b2")

    asked = _keys(heads.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(PROBE)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
    hot = cut(asked.where((F.col("n") * PROBE > CROWD) & (F.col("n") > 1)).select("key", F.ceil(F.col("n") * PROBE / CROWD).alias("blocks")))
    number, tasks = hot.count(), max(TASKS, -(-heads.count() * GROUPS * LEFT * RIGHT // TASK))
    calm = keyed if not number else keyed.join(small(hot.select("key"), number), "key", "left_anti")
    found = meet(calm.repartition(tasks, "key"), "key")
    if number:
        own = keyed.join(small(hot, number), "key").withColumn("own", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        spread = own.select("key", F.least("own", "block").alias("i"), F.greatest("own", "block").alias("j"), "own", "s1", "s2")
        found = found.unionByName(meet(spread, "key", "i", "j"))
    x, y = heads.select(F.col("id").alias("x"), F.col("s1").alias("a1"), F.col("s2").alias("a2")), heads.select(F.col("id").alias("y"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    pairs = found.distinct().join(x, ["a1", "a2"]).join(y, ["b1", "b2"]).select("x", "y")
    # Classes of one sketch are near whatever key they share.
    same = x.join(y, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y"))).select("x", "y")
    return pairs.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def class_pairs(chunks: DataFrame, least: float = SIMILARITY, run: int = RUN, id_column: str = "id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (``a`` < ``b``, ``similarity``) and membership (``id``, ``rep``).

    A class is all texts of one word sequence, ``rep`` its least id. Null ids and
    texts and texts of fewer than ``run`` words take no part; a repeated row
    counts once, and an id with several texts is similar if one of them is.
    """
    rows = chunks.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null and text is not null")
    signed = cut(_signed(rows, run))
    word = ["w1", "w2", "record"]
    kinds = signed.groupBy(*word).agg(F.min("id").alias("rep"))
    named = cut(signed.select("id", *word).distinct().join(kinds, word))
    members = named.select("id", "rep").distinct()
    heads = signed.join(small(named.where("id <> rep").select("id", *word)), ["id", *word], "left_anti").select("id", "s1", "s2", "left", "right")
    met = cut(_met(heads, BITS - _least_common_bits(least)))
    verified = _verified(met, rows, least, run).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return cut(verified), members


def similar_pairs(chunks: DataFrame, least: float = SIMILARITY, run: int = RUN) -> DataFrame:
    """Pairs ``id_a`` < ``id_b`` of similar texts that are no copies, for all members of their classes."""
    pairs, members = class_pairs(chunks, least, run)
    x, y = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    return pairs.join(x, "a").join(y, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(chunks: DataFrame, least: float = SIMILARITY, run: int = RUN) -> DataFrame:
    """One row for each text: ``id``, ``group_id`` (least id of its connected versions) and ``links``.

    ``links`` counts the classes of other words its own class is similar to.
    Texts too short for a run are a group of their own. Labels travel along
    pairs and then along themselves until none changes.
    """
    pairs, members = class_pairs(chunks, least, run)
    edges = cut(pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("w"))))
    label = cut(edges.groupBy("v").agg(F.least(F.min("w"), F.min("v")).alias("low")))
    while True:
        near = edges.join(label.select(F.col("v").alias("w"), "low"), "w").groupBy("v").agg(F.min("low").alias("near"))
        step = label.join(near, "v").select("v", F.least("low", "near").alias("low"))
        jumped = step.join(label.select(F.col("v").alias("low"), F.col("low").alias("lower")), "low", "left").select("v", F.least("low", F.coalesce("lower", "low")).alias("low"))
        new = cut(jumped)
        if new.join(label.withColumnRenamed("low", "before"), "v").where("low <> before").isEmpty():
            break
        label = new
    links = edges.groupBy(F.col("v").alias("rep")).agg(F.count("*").alias("links"))
    ids = chunks.select(F.col("id").cast("bigint").alias("id")).where("id is not null").distinct()
    placed = ids.join(members, "id", "left").withColumn("rep", F.coalesce("rep", "id")).join(new.select(F.col("v").alias("rep"), "low"), "rep", "left").join(links, "rep", "left")
    return placed.select("id", F.coalesce("low", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
