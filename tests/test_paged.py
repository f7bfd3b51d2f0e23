"""A source that is read page by page, with its columns and filters handed on."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import paged
from tests.conftest import DATA


@pytest.fixture(scope="module")
def points(tmp_path_factory):
    """A folder of files with several row groups, one of no rows, and nulls."""
    folder = tmp_path_factory.mktemp("points")
    draw = random.Random(5)
    rows = [{"id": i, "text": draw.choice(["", "one", "two", None]), "source": draw.choice(["a", "b", "", None]), "score": draw.choice([1.5, float("nan"), None])} for i in range(1_037)]
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("score", pa.float64())])
    for n, (a, b) in enumerate([(0, 500), (500, 500), (500, 1_037)]):
        pq.write_table(pa.Table.from_pylist(rows[a:b], schema), folder / f"{n}.parquet", row_group_size=230)
    return str(folder), rows


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("source", [None, "", "a", "none"])
def test_sources(spark, points, source):
    """Of no or an empty source come all rows, else its own."""
    path, rows = points
    got = [tuple(r) for r in paged.read_points(spark, path, ["id", "text"], source).collect()]
    assert same(got, [(r["id"], r["text"]) for r in rows if not source or r["source"] == source])


def test_the_same_rows_as_parquet(spark):
    path = f"{DATA}/documents.parquet"
    name = spark.read.parquet(path).where("source is not null").first()["source"]
    for source in (None, name):
        want = spark.read.parquet(path) if source is None else spark.read.parquet(path).where(F.col("source") == source)
        got = paged.read_points(spark, path, source=source)
        assert got.columns == want.columns and same(got.collect(), want.collect())


def test_columns(spark, points, capsys):
    """No column is read that isn't asked for."""
    paged.read_points(spark, points[0], ["id"], "a").explain("formatted")
    plan = capsys.readouterr().out
    assert "source#" in plan and "text#" not in plan and "score#" not in plan


def test_conditions(spark, points):
    path, rows = points
    for conditions, meets in (
        ([("id", ">=", 17), ("id", "<", 600), ("source", "in", ["a", "b"])], lambda r: 17 <= r["id"] < 600 and r["source"] in ("a", "b")),
        ([("text", "known", None), ("id", ">", 3), ("id", "<=", 231)], lambda r: r["text"] is not None and 3 < r["id"] <= 231),
        ([("source", "in", [])], lambda r: False),
        ([("source", "=", "")], lambda r: r["source"] == ""),
    ):
        assert same([tuple(r) for r in paged.read_points(spark, path, ["id"], conditions=conditions).collect()], [(r["id"],) for r in rows if meets(r)]), conditions
    for bad in (("score", "=", 1.5), ("id", "~", 3)):
        with pytest.raises(ValueError):
            paged.read_points(spark, path, conditions=[bad])


def test_a_frame_that_is_used_again(spark, points):
    """Filters of one use aren't kept for another."""
    path, rows = points
    read = paged.read_points(spark, path, ["id", "source"])
    for condition in ("source = 'a'", "source is null or id = 5", "true", "source = 'b'"):
        assert read.where(condition).count() == {"source = 'a'": sum(r["source"] == "a" for r in rows), "true": len(rows), "source = 'b'": sum(r["source"] == "b" for r in rows)}.get(condition, sum(r["source"] is None or r["id"] == 5 for r in rows))
    both = paged.read_points(spark, path, ["id"], "a").unionByName(paged.read_points(spark, path, ["id"], "b"))
    assert both.count() == sum(r["source"] in ("a", "b") for r in rows)


@pytest.mark.parametrize("page", [1, 7, 230, 5_000])
def test_pages_of_a_collection(points, page):
    """Every page but the last of a part is full, offsets lead through it, and an offset can be asked for again."""
    path, rows = points
    of = paged.ParquetCollection(path)
    met, seen = [("source", "=", "a")], []
    for part in of.parts():
        offset, pages = None, []
        while True:
            batch, after = of.scroll(part, offset, page, ["id"], met)
            pages.append((offset, batch))
            if after is None:
                break
            assert batch.num_rows == page
            offset = after
        for offset, batch in reversed(pages):
            assert of.scroll(part, offset, page, ["id"], met)[0].equals(batch)
        seen += [i for _, batch in pages for i in batch.column("id").to_pylist()]
    assert sorted(seen) == [r["id"] for r in rows if r["source"] == "a"]
    with pytest.raises(ValueError):
        of.scroll(of.parts()[0], 10_000, page, ["id"], met)


class Service:
    """A service of cursors by id: numbers from 0 in three ranges, a cursor being the next id; path is how many there are, with ! if it must be asked for less than all."""

    def __init__(self, path: str):
        self.n, self.less = int(path.rstrip("!")), path.endswith("!")

    def schema(self):
        return pa.schema([("id", pa.int64()), ("source", pa.string())])

    def parts(self):
        return [(a, min(a + 40, self.n)) for a in range(0, self.n, 40)]

    def scroll(self, part, offset, limit, columns, conditions):
        first, last = part
        at = first if offset is None else offset
        if not first <= at < last or limit != 9 or (self.less and not conditions):
            raise ValueError("no cursor of this service")
        ids = list(range(at, min(at + limit, last)))
        page = pa.table({"id": ids, "source": [f"s{i % 3}" for i in ids]}, self.schema())
        for column, kind, value in conditions:
            assert kind == "="
            page = page.filter(pc.equal(page[column], value))
        page = page.select(columns).combine_chunks()
        return (page.to_batches() or [pa.RecordBatch.from_pylist([], page.schema)])[0], at + limit if at + limit < last else None


@pytest.mark.parametrize("n", [0, 1, 40, 101])
def test_a_service(spark, n):
    rows = lambda source: paged.read_points(spark, f"{n}!" if source else str(n), ["id"], source, page=9, collection="tests.test_paged:Service")
    assert sorted(r["id"] for r in rows(None).collect()) == list(range(n))
    assert sorted(r["id"] for r in rows("s1").collect()) == list(range(1, n, 3))
    assert rows(None).rdd.getNumPartitions() == max(1, -(-n // 40))
