"""The most similar vectors of every vector, by multiprobe p-stable hashing.

A hash is ``floor((a·v + b) / w)`` with Gaussian ``a``; a table's bucket joins
several of them. Every vector is stored in its own bucket of each table and
looks into that bucket and into those it would have fallen into had it been a
little different, in the order of estimated success: the squared distance to
the border that would have to be crossed. Candidates of all tables are merged,
pre-filtered by the distance of 128-bit sign sketches that travel with the
postings, and ranked by exact cosine.

Equal vectors are one class from the start and are expanded at the end, so
copies fill no bucket. A bucket with more than ``crowd`` classes is compared
whole all the same: its members and those who look into it get block numbers,
and each block of the one meets each block of the other under a key of its own.

Hashing finds neighbours above a floor. Without a floor, classes that have fewer
than ``k`` above it are compared with all classes of their space: blocks of
vectors meet blocks by matrix products, and each keeps its ``k`` best. That work
grows with the square of the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright.plans.lineage import cut, small

#: Tables, hashes of a bucket, single perturbations visited, width of a hash for unit vectors, seed.
TABLES, HASHES, PROBES, WIDTH, SEED = 10, 24, 3, 3.0, 20240229
#: Classes of a bucket from which it is compared in blocks of so many.
CROWD = 4096
#: Look-ups of a task, and least number of tasks, when buckets are compared.
TASK, TASKS = 1 << 19, 64
#: Signs of a sketch, and copies up to which their ids are broadcast (8 MB); more are joined by a shuffle.
BITS, FEW = 128, 1 << 20
#: Similarity down to which hashing finds neighbours.
FLOOR = 0.9
#: Vectors of a block that asks and of one that is asked, blocks asked by one task, vectors multiplied at once on either side.
ASKING, ASKED, SLAB, TILE = 1 << 13, 1 << 14, 32, (1 << 10, 1 << 12)


@lru_cache(maxsize=16)
def _functions(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and mixers of the hashes, and the directions of the sketch."""
    rng = np.random.default_rng([SEED, dim, 0])
    a = rng.standard_normal((dim, TABLES * HASHES), np.float32)
    b = rng.random(TABLES * HASHES, np.float32)
    mixers = rng.integers(-(2**62), 2**62, (TABLES, HASHES), np.int64) | 1
    return a, b, mixers, np.random.default_rng([SEED, dim]).standard_normal((dim, BITS), np.float32)


def sketches(x: np.ndarray) -> np.ndarray:
    """The signs of each row as two integers."""
    return np.packbits(x @ _functions(x.shape[1])[3] > 0, axis=1).view(np.int64)


def buckets(x: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own buckets (rows, tables) and the buckets looked into (rows, tables, 2 + probes) of unit vectors."""
    a, b, mixers, _ = _functions(x.shape[1])
    place = ((x @ a) / np.float32(WIDTH) + b).reshape(len(x), TABLES, HASHES)
    cell = np.floor(place)
    inside = place - cell
    with np.errstate(over="ignore"):
        home = (cell.astype(np.int64) * mixers).sum(2) + space[:, None] * np.int64(0x5851F42D4C957F2D) + np.arange(TABLES) * np.int64(0x14057B7EF767814F)
        steps = np.concatenate([-mixers, mixers], axis=1)
        cost = np.concatenate([inside**2, (1 - inside) ** 2], axis=2)
        order = np.argsort(cost, axis=2, kind="stable")[:, :, : max(PROBES, 2)]
        step = np.take_along_axis(np.broadcast_to(steps, cost.shape), order, axis=2)
        looks = [home[:, :, None], home[:, :, None] + step[:, :, :PROBES], (home + step[:, :, 0] + step[:, :, 1])[:, :, None]]
    return home, np.concatenate(looks, axis=2)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of ``counts`` values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of a list column, and the start and length of each list."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False), offsets[:-1], np.diff(offsets)


def _hashed(rows: DataFrame) -> DataFrame:
    """``rep``, ``s1``, ``s2`` (the sketch), ``home`` and ``looks`` of rows ``rep``, ``space``, ``vector``."""
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("home", T.ArrayType(T.LongType())), T.StructField("looks", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, space = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(2))
            flat, start, size = _flat(batch.column(2))
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = flat[start[at][:, None] + np.arange(dim)].astype(np.float32)
                home, looks = buckets(x, space[at])
                sketch = sketches(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[at]), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), _lists(home.ravel(), np.full(len(at), TABLES)), _lists(looks.ravel(), np.full(len(at), looks[0].size))],
                    names=["rep", "s1", "s2", "home", "looks"],
                )

    return rows.select("rep", "space", "vector").mapInArrow(run, schema)


def candidates(classes: DataFrame, min_similarity: float, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a`` < ``b`` of classes that may be as similar as ``min_similarity``."""
    share = math.acos(min(1.0, min_similarity)) / math.pi
    near = math.ceil(BITS * share + 3 * math.sqrt(BITS * share * (1 - share)))
    hashed = _hashed(classes)  # cheaper to compute again than to keep
    stored = hashed.select("rep", "s1", "s2", F.explode("home").alias("bucket"))
    looking = hashed.select(F.col("rep").alias("from"), F.col("s1").alias("f1"), F.col("s2").alias("f2"), F.explode("looks").alias("bucket"))
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("f1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("f2")))

    def meet(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
        met = left.join(right, list(key)).where((F.col("rep") != F.col("from")) & (apart <= near))
        return met.select(F.least("rep", "from").alias("a"), F.greatest("rep", "from").alias("b"))

    # As many tasks as there are look-ups for; without a crowded bucket none of them is large.
    tasks = max(TASKS, -(-classes.count() * TABLES * (2 + PROBES) // TASK))

    def spread(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "bucket")

    crowded = cut(stored.groupBy("bucket").agg(F.ceil(F.count("*") / crowd).alias("blocks")).where("blocks > 1"))
    if crowded.isEmpty():
        return meet(spread(stored), spread(looking), "bucket").distinct()

    visits = looking.join(small(crowded), "bucket").groupBy("bucket", "blocks").agg(F.ceil(F.count("*") / crowd).alias("visits"))
    hot = small(cut(visits))

    def blocks(many: str, upto: str, row: str, own: str, other: str) -> list[Column]:
        """Block numbers of a row: its own, and each of the other side."""
        return [F.pmod(F.xxhash64(row), F.col(upto)).alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(many) - 1)).alias(other)]

    members = stored.join(hot, "bucket").select("rep", "s1", "s2", "bucket", *blocks("visits", "blocks", "rep", "m", "v"))
    visitors = looking.join(hot, "bucket").select("from", "f1", "f2", "bucket", *blocks("blocks", "visits", "from", "v", "m"))
    few = small(crowded.select("bucket"))
    calm = meet(spread(stored.join(few, "bucket", "left_anti")), spread(looking.join(few, "bucket", "left_anti")), "bucket")
    return calm.unionByName(meet(members, visitors, "bucket", "m", "v")).distinct()


def _packed(classes: DataFrame, size: int) -> DataFrame:
    """``space``, ``block``, ``dim``, ``reps`` and ``vectors`` (bytes) of blocks of about ``size`` classes, one partition for each block."""
    counts = {r["space"]: r["n"] for r in classes.groupBy("space").agg(F.count("*").alias("n")).collect()}  # a row for each embedder
    blocks = {space: -(-n // size) for space, n in counts.items()}
    number = F.lit(1)
    for space, n in blocks.items():
        number = F.when(F.col("space") == space, n).otherwise(number)
    schema = T.StructType([T.StructField("space", T.LongType()), T.StructField("block", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("reps", T.BinaryType()), T.StructField("vectors", T.BinaryType())])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_flat(chunk) for chunk in table.column("vector").chunks]
        dim = int(parts[0][2][0])
        x = np.concatenate([flat[start[:, None] + np.arange(dim)] for flat, start, _ in parts])
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([dim], pa.int32()), pa.array([table.column("rep").to_numpy().astype(np.int64).tobytes()]), pa.array([x.astype(np.float32).tobytes()])], names=[f.name for f in schema])

    rows = classes.select("rep", "space", "vector", F.pmod(F.xxhash64("rep"), number).alias("block"))
    return cut(rows.groupBy("space", "block").applyInArrow(pack, schema).repartitionByRange(max(1, sum(blocks.values())), "space", "block"))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows in double precision, added up from the first element as Spark's ``aggregate`` does."""
    out = np.zeros(len(x))
    for n in range(x.shape[1]):
        out += x[:, n].astype(np.float64) * y[:, n]
    return np.minimum(1.0, out)


def _improve(best: np.ndarray, who: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, others: np.ndarray) -> None:
    """Bring the rows of ``y`` into ``best`` (similarities) and ``who`` (ids) of the rows of ``x``; of equals the lower id stays."""
    k = best.shape[1]
    score = x @ y.T
    least = best[:, -1]
    if np.isneginf(least).any() and len(others) > k + 1:  # one more than k: a row may meet itself
        least = np.maximum(least, np.partition(score[:, : max(k + 2, TILE[0])], -(k + 1), axis=1)[:, -(k + 1)])
    row, col = np.nonzero(score >= (least - 1e-5)[:, None])  # more than single precision can err by
    apart = own[row] != others[col]
    row, col = row[apart], col[apart]
    for at in range(0, len(row), 1 << 18):
        r, c = row[at : at + (1 << 18)], col[at : at + (1 << 18)]
        touched, place = np.unique(r, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
        found = np.concatenate([best[touched].ravel(), _dots(x[r], y[c])])
        ids = np.concatenate([who[touched].ravel(), others[c]])
        order = np.lexsort((ids, -found, place))
        order = order[np.searchsorted(place[order], np.arange(len(touched)))[:, None] + np.arange(k)]
        best[touched], who[touched] = found[order], ids[order]


def scanned(asking: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``rep``, ``other``, ``similarity``: the ``k`` most similar other classes of every class in ``asking``, exactly.

    Both have ``rep``, ``space`` and ``vector``. A task holds one block that
    asks and streams a slab of blocks past it, so what leaves it is ``k`` rows
    for each vector and slab.
    """
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("other", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            kept = np.isfinite(best)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, kept.sum(1))), pa.array(who[kept]), pa.array(best[kept])], names=[f.name for f in schema])

        key = None
        for batch in batches:
            for n in range(batch.num_rows):
                space, block, dim = (batch.column(c)[n].as_py() for c in range(3))
                if key != (space, block):
                    if key is not None:
                        yield told()
                    key = space, block
                    own, x = np.frombuffer(batch.column(3)[n].as_buffer(), np.int64).copy(), np.frombuffer(batch.column(4)[n].as_buffer(), np.float32).reshape(-1, dim).copy()
                    best, who = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64)
                others, y = np.frombuffer(batch.column(5)[n].as_buffer(), np.int64), np.frombuffer(batch.column(6)[n].as_buffer(), np.float32).reshape(-1, dim)
                for b in range(0, len(others), TILE[1]):
                    for a in range(0, len(own), TILE[0]):
                        part, tile = slice(a, a + TILE[0]), slice(b, b + TILE[1])
                        _improve(best[part], who[part], x[part], own[part], y[tile], others[tile])
        if key is not None:
            yield told()

    left = _packed(asking, ASKING)
    right = _packed(classes, ASKED).select(F.col("space").alias("of"), F.col("reps").alias("others"), F.col("vectors").alias("given"))
    right = right.coalesce(max(1, -(-right.rdd.getNumPartitions() // SLAB)))
    met = left.join(right.hint("shuffle_replicate_nl"), F.col("space") == F.col("of")).select("space", "block", "dim", "reps", "vectors", "others", "given")
    nearest = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    return met.mapInArrow(run, schema).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n")


def vectors(chunks: DataFrame, documents: DataFrame, collections: DataFrame) -> DataFrame:
    """``id``, ``space`` (one for each embedder and length) and the unit ``vector`` of every usable embedding.

    Null, all-zero and non-finite vectors, vectors with null elements, of
    another length than their collection says, of unknown documents or
    collections, and rows without id are left out. Repeated rows stay.
    """
    pinned = collections.select(F.col("name").alias("collection"), "embedder", "dim").where("name is not null and embedder is not null").dropDuplicates(["collection"])
    homes = documents.select(F.col("doc_id").alias("document_id"), "collection").join(small(pinned), "collection").dropDuplicates(["document_id"])
    given = chunks.select(F.col("id").cast("bigint").alias("id"), "document_id", F.col("embedding").cast("array<float>").alias("embedding")).where("id is not null and embedding is not null")
    usable = given.join(homes, "document_id").where(F.size("embedding") == F.col("dim")).select("id", F.xxhash64("embedder", "dim").alias("space"), "embedding")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("space", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spaces, (flat, start, size) = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _flat(batch.column(2))
            for dim in np.unique(size[size > 0]):
                at = np.flatnonzero(size == dim)
                x = flat[start[at][:, None] + np.arange(dim)].astype(np.float64)  # null elements are NaN here
                norm = np.sqrt((x * x).sum(1))
                good = np.isfinite(norm) & (norm > 0)
                unit = (x[good] / norm[good, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][good]), pa.array(spaces[at][good]), _lists(unit.ravel(), np.full(len(unit), dim))], names=[f.name for f in schema])

    return usable.mapInArrow(run, schema)


def neighbours(vectors: DataFrame, k: int = 10, min_similarity: float | None = None, crowd: int = CROWD) -> DataFrame:
    """``id``, ``neighbour``, ``rank`` (1 to ``k``) and ``similarity`` of the most similar others of every vector.

    Every vector gets its ``k``, or all others of its space if there are fewer:
    hashing serves those that have ``k`` above ``FLOOR``, the rest are compared
    with all. With ``min_similarity`` only neighbours at least so similar, by
    hashing alone, which is tuned for 0.9: of pairs at 0.90 to 0.92 it finds
    some 95 in 100, of those above 0.95 over 99, and below 0.9 ever fewer.
    Of equally similar ones the lower id comes first. Rows are ``id``, ``space``
    and unit ``vector``, as ``vectors`` gives them; spaces are never compared. A
    repeated row counts once; an id with several vectors has the neighbours of each.
    """
    keyed = cut(vectors.select("id", "space", F.xxhash64("space", "vector").alias("h1"), F.xxhash64(F.lit(SEED), "vector", "space").alias("h2"), "vector"))
    first = Window.partitionBy("h1", "h2").orderBy("id")
    named = keyed.select("h1", "h2", "id").distinct()
    heads = named.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    lists = cut(heads.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    # Members that stand for no class; where they are few, no vector is shuffled to leave them out.
    copies = cut(named.join(lists.where(F.size("ids") > 1).select("h1", "h2", "rep"), ["h1", "h2"]).where("id <> rep").select("id"))
    few = copies.count() <= FEW
    classes = keyed.join(F.broadcast(copies) if few else copies, "id", "left_anti").select(F.col("id").alias("rep"), "space", "vector")
    floor = FLOOR if min_similarity is None else min_similarity
    pairs = cut(candidates(classes, floor, crowd))
    a = classes.select(F.col("rep").alias("a"), F.col("vector").alias("va"), F.col("space").alias("sa"))
    b = classes.select(F.col("rep").alias("b"), F.col("vector").alias("vb"), F.col("space").alias("sb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = cut(pairs.join(a, "a").join(b, "b").select("a", "b", F.when(F.col("sa") == F.col("sb"), F.least(F.lit(1.0), dot)).alias("similarity")).where(F.col("similarity") >= floor).distinct())
    both = near.select(F.col("a").alias("rep"), F.col("b").alias("other"), "similarity").unionByName(near.select(F.col("b").alias("rep"), F.col("a").alias("other"), "similarity"))
    several = lists.where(F.size("ids") > 1).select(F.col("rep").alias("other"), "ids")
    several = F.broadcast(several) if few else several

    def spread(found: DataFrame) -> DataFrame:
        return found.join(several, "other", "left").select("rep", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour"), "similarity")

    others = spread(both)
    if min_similarity is None:
        met = others.groupBy("rep").agg(F.count("*").alias("met"))
        # Ids of a class are in lists up to k + 1, itself among them.
        served = cut(lists.join(met, "rep", "left").where(F.size("ids") - 1 + F.coalesce("met", F.lit(0)) >= k).select("rep"))
        asking = classes.join(served, "rep", "left_anti")
        others = others.join(served, "rep", "left_semi").unionByName(spread(cut(scanned(asking, classes, k))))
    own = lists.where(F.size("ids") > 1).select("rep", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "neighbour")
    ranked = others.unionByName(own).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    top = ranked.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "neighbour", "similarity"))).alias("top"))
    members = named.join(lists.select("h1", "h2", "rep"), ["h1", "h2"]).join(top, "rep")
    chosen = F.slice(F.filter("top", lambda t: t["neighbour"] != F.col("id")), 1, k)
    return members.select("id", F.posexplode(chosen).alias("p", "t")).select("id", F.col("t.neighbour").alias("neighbour"), (F.col("p") + 1).alias("rank"), F.col("t.similarity").alias("similarity"))


def similar_pairs(vectors: DataFrame, k: int = 10, min_similarity: float = 0.9) -> DataFrame:
    """Pairs ``id_a`` < ``id_b`` of which one is among the ``k`` most similar of the other, and similar enough."""
    found = neighbours(vectors, k, min_similarity)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
