"""Records that differ only in white space, case, punctuation or field order.

A text is a tree: a record of ``name: value`` fields is an unordered node whose
children are the fields, each an ordered node of a name and a value; any other
text is one leaf. Leaves are normalised (letters and digits alone, case folded)
and hashed, the digests of an unordered node are sorted before they are hashed,
and equal roots are the same record. Digests of 64 bits are made in the scan and
are all that is shuffled; texts are fetched only for roots that occur twice, and
these groups are confirmed on the whole normalised content, which is part of the
grouping key. Everything is built from Spark's own functions.

White space after a colon, or its lack, is one of the differences that don't
matter: a part is a field if it has a colon and a letter or digit before it.

Null ids and null texts take no part; texts without any letter or digit are
no copies of anything. A row repeated under its id counts once; of several texts
under one id the one of the least digest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright.plans.lineage import cut

#: What separates the fields of a record.
FIELD_BREAK = r"[\r\n\x{85}\x{2028}\x{2029}]+| \| |; "
#: Ids up to which they are broadcast (8 MB) to fetch their texts from the scan; more are joined by a shuffle.
FEW = 1 << 20


def leaf(text: Column) -> Column:
    """Letters and digits of a text, in order, without regard to case."""
    lower = F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9\p{L}\p{N}]++", ""))
    return F.replace(F.replace(lower, F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))


def fields(text: Column) -> Column:
    """The fields of a record, null for a text with any part that is no field, or with fewer than two."""
    parts = F.when(F.contains(text, F.lit(":")), F.filter(F.split(text, FIELD_BREAK), lambda p: F.length(F.trim(p)) > 0))
    named = F.forall(parts, lambda p: F.contains(p, F.lit(":")) & F.substring_index(p, ":", 1).rlike(r"[\p{L}\p{N}]"))
    return F.when((F.size(parts) > 1) & named, parts)


def _child(part: Column) -> tuple[Column, Column]:
    """Name and value of a field, normalised."""
    at = F.instr(part, ":")
    return leaf(F.substring(part, F.lit(1), at - 1)), leaf(F.substring(part, at + 1, F.length(part)))


def record_form(text: Column) -> Column:
    """The normalised record: one line for each field, sorted; null if the text is no record."""
    return F.array_join(F.array_sort(F.transform(fields(text), lambda p: F.concat_ws(":", *_child(p)))), "\n")


def record_root(parts: Column) -> Column:
    """The Merkle root of the fields of a record: their digests, sorted and hashed; null for null."""
    return F.when(parts.isNotNull(), F.xxhash64(F.array_sort(F.transform(parts, lambda p: F.xxhash64(*_child(p))))))


def _digests(rows: DataFrame) -> DataFrame:
    """``id``, ``leaf`` and ``record`` (null for no record): the roots of every text that has a letter or digit."""
    parts = rows.select("id", leaf(F.col("text")).alias("plain"), fields(F.col("text")).alias("parts")).where("plain <> ''")
    return parts.select("id", F.xxhash64("plain").alias("leaf"), record_root(F.col("parts")).alias("record"))


def _confirmed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id``, ``kind``, ``root`` and ``first``, the least id of its group, in groups of two or more whose whole forms are equal.

    ``nodes`` has ``id``, ``kind`` (0 leaf, 1 record) and ``root``. Counting is
    partial before its shuffle, so a root shared by a third of all rows is a few
    rows there. A root of several forms (a collision of 64 bits) is told apart by
    its forms; all others take their group from the root.
    """
    twice = nodes.groupBy("kind", "root").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("kind", "root")
    members = cut(nodes.join(twice, ["kind", "root"], "left_semi"))
    ids = members.select("id").distinct()
    kept = rows.join(F.broadcast(ids), "id", "left_semi") if members.count() <= FEW else rows
    form = F.when(F.col("kind") == 0, leaf(F.col("text"))).otherwise(record_form(F.col("text")))
    own = F.when(F.col("kind") == 0, F.xxhash64(leaf(F.col("text")))).otherwise(record_root(fields(F.col("text"))))
    formed = kept.join(members, "id").where(own == F.col("root")).select("id", "kind", "root", form.alias("form"))
    whole = formed.groupBy("kind", "root", "form").agg(F.min("id").alias("first"), F.max("id").alias("last")).select("kind", "root", F.sha2("form", 256).alias("form"), "first", "last")
    classes = cut(whole)
    roots = classes.groupBy("kind", "root").agg(F.count("*").alias("forms"), F.min("first").alias("first"), F.max("last").alias("last"))
    single = roots.where("forms = 1 and first <> last").select("kind", "root", "first")
    found = members.join(single, ["kind", "root"])
    collided = roots.where("forms > 1").select("kind", "root")
    if collided.isEmpty():
        return found
    apart = formed.join(collided, ["kind", "root"], "left_semi").withColumn("form", F.sha2("form", 256))
    several = apart.join(classes.where("first <> last"), ["kind", "root", "form"]).select("kind", F.xxhash64("root", "form").alias("root"), "id", "first").distinct()
    return found.unionByName(several)


def text_copies(chunks: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """``id`` and ``first_id`` of every text that has a copy; ``first_id`` is the least id of its group.

    Two texts are copies by their leaf, or by the root of their record. A group
    can hold both kinds (a record whose fields were reordered, and a copy of it
    that lost its colons), so the least id is passed on along both until nothing
    changes: twice as a rule, since leaf groups meet in one record group.
    """
    rows = chunks.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null and text is not null")
    keyed = cut(_digests(rows).groupBy("id").agg(F.min(F.struct("leaf", "record")).alias("k")).select("id", "k.leaf", "k.record"))
    nodes = keyed.select("id", F.lit(0).alias("kind"), F.col("leaf").alias("root")).unionByName(keyed.where("record is not null").select("id", F.lit(1).alias("kind"), F.col("record").alias("root")))
    links = cut(_confirmed(rows, nodes).select("id", "kind", "first"))
    label = cut(links.groupBy("id").agg(F.min("first").alias("first_id")))
    while True:
        best = links.join(label, "id").groupBy("kind", "first").agg(F.min("first_id").alias("best"))
        new = cut(links.join(best, ["kind", "first"]).groupBy("id").agg(F.min("best").alias("first_id")))
        if not new.join(label.withColumnRenamed("first_id", "before"), "id").where("first_id <> before").limit(1).count():
            return new
        label = new


def hash_key(value: Column) -> Column:
    """The 64 hexadecimal digits of a written hash, null if it doesn't give them."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^\s*sha[-_ ]?256\s*[:= ]?\s*", "")
    digits = F.regexp_replace(bare, r"[^0-9a-z]", "")
    return F.when(digits.rlike("^[0-9a-f]{64}$"), digits)


def hash_copies(documents: DataFrame, id_column: str = "doc_id", hash_column: str = "source_hash") -> DataFrame:
    """``id`` and ``first_id`` of every document whose hash, however written, another document has."""
    keyed = documents.select(F.col(id_column).cast("bigint").alias("id"), hash_key(F.col(hash_column)).alias("key")).where("id is not null and key is not null")
    firsts = keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.max("id").alias("last")).where("first_id <> last").select("key", "first_id")
    return keyed.join(firsts, "key").select("id", "first_id").distinct()


def found(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each copy of chunks and of documents: ``rec``, ``first_id``, ``copy_id``."""
    parts = [copies.where("id <> first_id").select(F.lit(rec).alias("rec"), "first_id", F.col("id").alias("copy_id")) for rec, copies in (("chunks", text_copies(chunks)), ("documents", hash_copies(documents)))]
    return parts[0].unionByName(parts[1])


def records(chunks: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """One row for each record: ``first_id``, ``copies`` (1 for a text without copy).

    Null texts are one record each. Rows repeated under one id are one row.
    """
    ids = chunks.select(F.col(id_column).cast("bigint").alias("id")).where("id is not null").distinct()
    groups = text_copies(chunks, id_column, text_column)
    return ids.join(groups, "id", "left").groupBy(F.coalesce("first_id", "id").alias("first_id")).agg(F.count("*").alias("copies"))


def all_records(chunks: DataFrame, documents: DataFrame, id_column: str = "doc_id", hash_column: str = "source_hash") -> DataFrame:
    """One row for each record of chunks and of documents: ``rec``, ``first_id``, ``copies``.

    Documents are one record by their hash, however written; one without a
    usable hash is a record of its own. A row repeated under its id counts once;
    of several hashes under one id the least counts.
    """
    keyed = documents.select(F.col(id_column).cast("bigint").alias("id"), hash_key(F.col(hash_column)).alias("key")).where("id is not null").groupBy("id").agg(F.min("key").alias("key"))
    alone = F.when(F.col("key").isNull(), F.col("id"))
    stored = keyed.groupBy("key", alone.alias("alone")).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return records(chunks).select(F.lit("chunks").alias("rec"), "first_id", "copies").unionByName(stored.select(F.lit("documents").alias("rec"), "first_id", "copies"))
