"""Every registered query against its SQL, over the smallest tables."""

import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from bookwright.plans import queries as core
from tests.conftest import DATA

FOLDER = f"{DATA}/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(FOLDER):
        db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return db


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", core.queries())
def test_query_and_sql_agree(spark, duck, name):
    df = core.queries()[name](spark, FOLDER)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in core.oracle_sql():
        assert df.columns
        return
    found = duck.execute(core.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(rows, key=repr) == sorted((tuple(plain(r[n]) for n in order) for r in found.fetchall()), key=repr)


def test_entry_gives_cited_hits(spark):
    df = entry.entry(spark)
    assert {"rank", "chunk_id", "score"} <= set(df.columns)
    assert df.count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    code = "import sys; sys.modules['bookwright.llm'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(n.startswith('p1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
    core_files = [p for p in (ROOT / "bookwright").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in core_files if re.search(r"bookwright\.llm|from bookwright import llm", p.read_text())]


def test_top_k_is_not_a_full_sort(spark):
    plan = core.queries()["vector_topk"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scans_read_only_what_they_need(spark):
    plan = core.queries()["token_estimate"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,text:string>" in plan
