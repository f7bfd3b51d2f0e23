"""Every registered query of the library proper against its SQL, on the smallest tables."""

from __future__ import annotations

import decimal
import hashlib

import duckdb
import pytest

from corpusloom.jobs import registry, validation
from corpusloom.operators.chunking import LIMIT, spans
from tests.conftest import DATA

TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else float(value) if isinstance(value, decimal.Decimal) else value


#: Queries that SQL can't express; they are held against brute force.
BRUTE_FORCE = {"recursive_chunks"}


def test_every_query_has_sql():
    assert set(registry.QUERIES) - BRUTE_FORCE == set(registry.ORACLE_SQL)


def test_recursive_chunks(spark):
    got = {(r["doc_id"], r["pos"]): (r["start"], r["n_chars"], r["chunk_md5"]) for r in registry.QUERIES["recursive_chunks"](spark, DATA).collect()}
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        for pos, (a, b) in enumerate(spans(r["text"] or "")):
            want[r["doc_id"], pos] = (a, b - a, hashlib.md5(r["text"][a:b].encode()).hexdigest())
    assert got == want and all(n <= LIMIT for _, n, _ in got.values())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in sorted(names)) for row in df.collect()), key=repr)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(plain(row[i]) for i in order) for row in want.fetchall()), key=repr)


def test_stats_are_of_all_requests(spark):
    """stats_endpoint counts every request; those of one path have a query of their own."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    every, some = (registry.QUERIES[name](spark, DATA).first()["requests"] for name in ("stats_endpoint", "analyze_stats"))
    assert every == events.count() and some == events.where("event_type <> 'view'").count() < every


def test_source_payloads_move_no_text(spark):
    """Length and digest are taken where the text is read: nothing above the first exchange has it."""
    plan = registry.QUERIES["source_payloads"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Join" in line or "Window" in line or "Sort " in line]
    assert moved and not any("raw_chunk" in line or "text#" in line for line in moved)
    projected = [line for line in plan.splitlines() if "md5(" in line]
    assert projected and plan.splitlines().index(projected[0]) > plan.splitlines().index(moved[-1])


def _reads_texts(df) -> bool:
    """Whether the plan reads the documents' texts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any("documents.parquet" in line and "text:string" in line for line in plan.splitlines())


def test_cases_make_tokens_of_wanted_chunks_alone(spark):
    """The wanted chunks are picked first, so that no other text is cut into words."""
    assert not _reads_texts(validation.cases(spark, DATA))
    ids = validation._items(spark, DATA).selectExpr("target as doc_id")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 0 < validation._picked(spark, DATA, ids).count() == docs.join(ids.distinct(), "doc_id").count() < docs.count()


def test_answers_are_made_of_picked_chunks(spark):
    """Found chunks, wanted ones and others are picked in one pass; no join moves the documents' texts."""
    assert not _reads_texts(validation._answer(spark, DATA))


def test_seconds_of_cases_alone_are_moved(spark):
    """Events of no case are dropped where they are read."""
    plan = validation._measured(spark, DATA)._jdf.queryExecution().executedPlan().toString().splitlines()
    events = next(i for i, line in enumerate(plan) if "events.parquet" in line)
    above = [line for line in plan[:events] if "Exchange hashpartitioning" in line or "LeftSemi" in line]
    assert "LeftSemi" in above[-1]
