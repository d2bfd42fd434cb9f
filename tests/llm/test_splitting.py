import random

from pyspark.sql import functions as F

from bookwright.llm import splitting


def size(text):
    words = len(text.split())
    return max(1, len(text) // 4, int(words * 1.3)) if words else 0


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    out = [None, "", "  \n ", " " * 3000, "short", "x" * 5000, "漢" * 3000, " " * 4000 + "a", "a b\x1cc d " * 400]
    for _ in range(6):
        text = ""
        for _ in range(rng.randint(100, 900)):
            text += word() + rng.choice([" "] * 12 + [". ", "! ", "\n", "\n\n", "\n\n## Part\n\n"])
        out.append(text)
    return out


def test_sizes_in_ranges(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id long, text string").withColumn("size", F.lit(0))
    expected = {i: size(t or "") for i, t in rows}
    for width in (64, 1000, splitting.RANGE):
        assert {r["id"]: r["size"] for r in splitting.sizes(df, width=width).collect()} == expected
    for limit, width in ((512, splitting.RANGE), (128, splitting.HALO), (16, 1 << 16)):
        assert {r["id"] for r in splitting.oversized(df.unionByName(df), limit, 8, width=width).collect()} == {i for i, s in expected.items() if s > limit}
    blank = spark.createDataFrame([(1, " " * 200_000), (2, " " * 200_000 + "a")], "id long, text string")
    assert [r["id"] for r in splitting.oversized(blank).collect()] == [2]


def check(own, text, limit, overlap):
    upto = 0
    assert [r["seq"] for r in own] == list(range(len(own)))
    for n, r in enumerate(own):
        assert text[r["start"] : r["end"]] == r["text"]
        assert r["token_count"] == size(r["text"]) <= limit
        assert r["start"] <= upto <= r["end"]
        assert n == 0 or size(text[r["start"] : upto]) <= overlap + 1
        upto = r["end"]
    assert upto == len(text)
    assert (len(own) > 1) == (size(text) > limit)


def test_pieces(spark):
    rows = [(n, t, ["H"]) for n, t in enumerate(texts())]
    rows += [(0, None, ["H"]), (4, "short", ["H"])]
    df = spark.createDataFrame(rows, "id long, text string, heading_path array<string>").withColumn("seq", F.lit("x"))
    results = []
    for width in (splitting.HALO, splitting.RANGE, 1 << 16):
        found = {}
        for r in splitting.pieces(df, 128, 16, width=width).orderBy("id", "seq").collect():
            found.setdefault(r["id"], []).append(r)
        for i, text, _ in rows:
            check(found[i], text or "", 128, 16)
        results.append(found)
    assert results[0] == results[1] == results[2]


def long_text(chars, seed=7):
    rng = random.Random(seed)
    parts, n = ["# Book\n\n", "## Opening\n\n"], 0
    while sum(map(len, parts[-400:])) + n < chars:
        parts.append(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(5, 30))) + rng.choice([". "] * 8 + ["\n", "\n\n"]))
        if rng.random() < 0.004:
            parts.append(f"\n\n{'#' * rng.randint(2, 4)} Section {len(parts)}\n\n")
        n = sum(map(len, parts[:-400])) if len(parts) % 400 == 0 else n
    return "".join(parts)[:chars]


def open_headings(text, at):
    stack = []
    for m in splitting._HEAD.finditer(text):
        if m.start() <= at:
            stack = [*(h for h in stack if h[0] < len(m[1])), (len(m[1]), m[2])]
    return [t for _, t in stack]


def test_a_giant_text_is_the_same_in_many_ranges_and_in_one(spark):
    text = long_text(220_000)
    df = spark.createDataFrame([(1, text, ["Doc"])], "id long, text string, heading_path array<string>")
    many = splitting.pieces(df, 512, 64, width=splitting.RANGE).orderBy("seq").collect()
    one = splitting.pieces(df, 512, 64, width=1 << 18).orderBy("seq").collect()
    check(many, text, 512, 64)
    assert len(text) // splitting.RANGE >= 50 and len(many) > 100
    assert many == one
    assert all(r["heading_path"] == ["Doc", *open_headings(text, r["start"])] for r in many)
    assert all(len(r["heading_path"]) > 2 for r in many[1:])
    rows = splitting._given(df, "id", "text", "heading_path")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so small a text together again
    work = splitting._ranges(rows, splitting.RANGE, splitting.HALO).select("part", F.spark_partition_id().alias("task")).distinct().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["task"] for r in work}) > 1


def test_ranges_count_words_and_headings_over_slices(spark, monkeypatch):
    text = long_text(60_000, 11)
    df = spark.createDataFrame([(1, text, None)], "id long, text string, heading_path array<string>")
    whole = splitting.pieces(df, 128, 16).orderBy("seq").collect()
    monkeypatch.setattr(splitting, "SLICE", 3)
    assert splitting.pieces(df, 128, 16, width=splitting.HALO).orderBy("seq").collect() == whole


def test_files_are_read_by_ranges(spark, tmp_path):
    texts = {"a.txt": long_text(30_000, 3).replace("a", "ä").replace("b", "漢"), "b.txt": "short", "c.txt": "x" * 9000}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    found = {}
    for r in splitting.file_pieces(spark, [str(tmp_path)], 128, 16, width=10_001).orderBy("source_path", "seq").collect():
        found.setdefault(r["source_path"].rsplit("/")[-1], []).append(r)
    assert found.keys() == texts.keys()
    for name, text in texts.items():
        check(found[name], text, 128, 16)


def test_paths_go_on_with_all_open_levels(spark):
    body = "Words of a sentence here. " * 40
    text = f"# A\n\n## B\n\n{body}\n\n### C\n\n{body}\n\n## D\n\n{body}"
    df = spark.createDataFrame([(1, text, ["Doc"]), (2, text, ["Doc", "A"])], "id long, text string, heading_path array<string>")
    for key in (1, 2):
        paths = [r["heading_path"] for r in splitting.pieces(df, 128, 0).where(F.col("id") == key).orderBy("seq").collect()]
        assert paths[0] == ["Doc", "A"]
        assert ["Doc", "A", "B", "C"] in paths and paths[-1] == ["Doc", "A", "D"]


def test_boundaries_are_natural(spark):
    text = "\n\n".join(f"## Part {n}\n\n" + "Words of a sentence here. " * 12 for n in range(8))
    df = spark.createDataFrame([(1, text, None)], "id long, text string, heading_path array<string>")
    found = splitting.pieces(df, 128, 0).orderBy("seq").collect()
    assert all(r["text"].startswith("## Part") for r in found)
    assert found[1]["heading_path"][0].startswith("Part")


def test_no_rows(spark):
    df = spark.createDataFrame([(None, "x", None)], "id long, text string, heading_path array<string>")
    assert splitting.pieces(df).count() == 0
    assert splitting.pieces(df.limit(0)).count() == 0
    assert splitting.oversized(df.limit(0)).count() == 0
    assert splitting.pieces(spark.createDataFrame([(1, "x")], "id long, text string")).collect()[0]["heading_path"] == []
