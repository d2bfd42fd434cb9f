from pyspark.sql import functions as F

from bookwright.llm import copies, queries

HASH = "ab12" * 16


def test_hash_forms(spark):
    forms = [f"sha256:{HASH}", HASH.upper(), f"sha-256={HASH}", f"sha256: {HASH}", "SHA-256 " + " ".join(HASH[i : i + 8] for i in range(0, 64, 8)), f" sha256:{HASH}\n", "SHA256:" + ":".join(HASH[i : i + 2] for i in range(0, 64, 2)), "SHA256-" + "-".join(HASH[i : i + 16] for i in range(0, 64, 16))]
    bad = [None, "", "sha256:", HASH[:-1], HASH + "0", HASH[:-1] + "x", "md5:" + HASH[:32]]
    df = spark.createDataFrame([(v,) for v in forms + bad], "v string")
    assert [r[0] for r in df.select(copies.hash_key(F.col("v"))).collect()] == [HASH] * len(forms) + [None] * len(bad)


def test_text_copies(spark):
    rows = [
        (5, "Hello,  World 1!"), (3, "hello world\n1"), (9, "HELLO WORLD 2"), (4, "name: A\nsize: 2"), (7, "SIZE:  2. | Name: a"), (8, "name 'a' size 2"), (10, "name: 2\nsize: a"), (11, "straße"), (12, "STRASSE"),
        (13, None), (14, ""), (15, " .!"), (16, "?"), (17, "a: b; c: d"), (18, "c: d; a: b"), (19, "a: b; c: d; no field"), (20, "c: d; a: b; no field"), (3, "hello world\n1"), (21, "x: 1; x: 1; y: 2"), (22, "y: 2; x: 1"), (23, "y: 2; x: 1; x: 1"),
    ]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("first", F.lit(0)).withColumn("root", F.lit("x"))
    groups = {}
    for r in copies.text_copies(df).collect():
        groups.setdefault(r["first_id"], set()).add(r["id"])
    assert groups == {3: {3, 5}, 4: {4, 7, 8}, 11: {11, 12}, 17: {17, 18}, 21: {21, 23}}


def test_fields_without_a_blank_after_the_colon(spark):
    rows = [
        (1, "asset: Pump 7\nstate: open\nticket: zx-513"), (2, "TICKET:ZX-513; ASSET:  pump 7; STATE:open."), (3, "asset: open\nstate: Pump 7\nticket: zx-513"),
        (4, "asset Pump 7 state open ticket zx-513"), (5, "12:30 start | 13:40 end"), (6, "13:40 end | 12:30 start"), (7, ": x\ny: 1"), (8, "y: 1\n: x"), (9, "a:\nb: 1"), (10, "b:1; a:"),
    ]
    found = {r["id"]: r["first_id"] for r in copies.text_copies(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 4: 1, 5: 5, 6: 5, 9: 9, 10: 9}


def test_an_id_with_several_texts_has_one(spark):
    rows = [(1, "one text"), (1, "another"), (2, "ONE TEXT"), (3, "An other"), (4, None)]
    found = copies.text_copies(spark.createDataFrame(rows, "id long, text string")).collect()
    assert len(found) == 2 and {r["first_id"] for r in found} == {1}


def test_roots_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(copies, "record_root", lambda parts: F.when(parts.isNotNull(), F.lit(1).cast("bigint")))
    rows = [(1, "a: 1; b: 2"), (2, "b: 2; a: 1"), (3, "c: 3; d: 4"), (4, "d: 4; c: 3"), (5, "e: 5; f: 6")]
    found = {r["id"]: r["first_id"] for r in copies.text_copies(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3}


def test_found_and_records(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "A-B"), (3, "c"), (4, None), (None, "a b")], "id long, text string")
    docs = spark.createDataFrame([(7, HASH), (8, f"sha256:{HASH.upper()}"), (9, None), (None, HASH)], "doc_id long, source_hash string")
    assert sorted(map(tuple, copies.found(chunks, docs).collect())) == [("chunks", 1, 2), ("documents", 7, 8)]
    assert sorted(map(tuple, copies.records(chunks).collect())) == [(1, 2), (3, 1), (4, 1)]
    assert copies.found(chunks.limit(0), docs.limit(0)).count() == 0
    assert copies.records(chunks.limit(0)).count() == 0


def test_records_of_documents(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "A-B"), (3, "c")], "id long, text string")
    docs = spark.createDataFrame([(7, HASH), (8, f"sha256:{HASH.upper()}"), (8, HASH), (9, None), (10, "bad"), (11, HASH[::-1]), (None, HASH)], "doc_id long, source_hash string")
    assert sorted(map(tuple, copies.all_records(chunks, docs).collect())) == [("chunks", 1, 2), ("chunks", 3, 1), ("documents", 7, 2), ("documents", 9, 1), ("documents", 10, 1), ("documents", 11, 1)]
    assert "p4_all_records" in queries.queries()
    assert copies.all_records(chunks.limit(0), docs.limit(0)).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "Same, text").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    found = copies.text_copies(df)
    assert found.count() == 1000
    assert [r[0] for r in found.select("first_id").distinct().collect()] == [0]
