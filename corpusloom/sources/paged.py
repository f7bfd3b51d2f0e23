"""A source of points that a collection hands out page by page, for `spark.read.format("paged")`.

A collection says into which parts it falls and scrolls each of them: a page of rows, and the
offset of the next page until there is none. A part is a partition, so parts are scrolled side by
side and a task holds a page. Only the columns of the schema are asked for. Conditions go to the
collection as an option of the reader, and Spark applies them again. Filters that the optimizer
would push aren't taken: Spark 4.1 keeps them in the frame, and one that is used again, with other
filters or none, would lose rows.
"""

from __future__ import annotations

import importlib
import json
import operator
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a page.
PAGE = 100
#: What a collection is asked for: a column, one of the names below, `in` or `known`, and a value (a list for `in`, None for `known`); strings, integers and booleans, as Spark's order of floats is its own.
Condition = tuple[str, str, object]
_COMPARED = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


class Collection(Protocol):
    """What a class named by the option `collection` must do. It is made from the option `path`."""

    def schema(self) -> pa.Schema: ...

    def parts(self) -> list[object]:
        """What can be scrolled by itself: picklable, and small."""

    def scroll(self, part: object, offset: object, limit: int, columns: list[str], conditions: list[Condition]) -> tuple[pa.RecordBatch, object]:
        """Up to `limit` rows of a part from an offset on (None: its first) that meet all conditions, and the next offset, None after the last page."""


class ParquetCollection:
    """A Parquet file or folder as a collection: a part is a row group, an offset a number of rows within what meets the conditions.

    The pages of a part are read one after another in one scan. An offset that isn't the next one starts a new scan.
    """

    def __init__(self, path: str):
        self.data = ds.dataset(path, format="parquet")
        self.at: tuple | None = None

    def schema(self) -> pa.Schema:
        return self.data.schema

    def parts(self) -> list[tuple[str, int]]:
        return [(f.path, f.row_groups[0].id) for whole in self.data.get_fragments() for f in whole.split_by_row_group()]

    def _batches(self, part: tuple[str, int], limit: int, columns: list[str], conditions: list[Condition]) -> Iterator[pa.RecordBatch]:
        path, group = part
        meets = [self._expression(c) for c in conditions]
        fragment = self.data.format.make_fragment(path, self.data.filesystem, row_groups=[group])
        scan = fragment.scanner(schema=self.data.schema, columns=columns, filter=reduce(operator.and_, meets) if meets else None, batch_size=limit, batch_readahead=1)
        held = pa.table({c: pa.array([], self.data.schema.field(c).type) for c in columns})
        for batch in scan.to_batches():
            held = pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows > limit:
                yield _one(held.slice(0, limit))
                held = held.slice(limit)
        yield _one(held)

    @staticmethod
    def _expression(condition: Condition) -> ds.Expression:
        column, kind, value = condition
        field = ds.field(column)
        if kind == "known":
            return field.is_valid()
        return field.isin(list(value)) if kind == "in" else _COMPARED[kind](field, value)

    def scroll(self, part: tuple[str, int], offset: int | None, limit: int, columns: list[str], conditions: list[Condition]) -> tuple[pa.RecordBatch, int | None]:
        offset = offset or 0
        asked = (part, limit, columns, conditions)
        if self.at is None or self.at[:2] != (asked, offset):
            pages = self._batches(*asked)
            seen, page = 0, next(pages)
            while seen < offset and page is not None:
                seen += page.num_rows
                page = next(pages, None)
            if page is None or seen != offset:
                raise ValueError(f"{offset} is no offset of a page of {limit} rows")
        else:
            _, _, page, pages = self.at
        after = next(pages, None)
        self.at = None if after is None else (asked, offset + page.num_rows, after, pages)
        return page, None if after is None else offset + page.num_rows


def _one(rows: pa.Table) -> pa.RecordBatch:
    whole = rows.combine_chunks().to_batches()
    return whole[0] if whole else pa.RecordBatch.from_pylist([], rows.schema)


class PagedSource(D.DataSource):
    """Options: path; pageSize; collection, `module:Class`, Parquet if there is none; conditions, as JSON."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def collection(self) -> Collection:
        module, _, name = self.options.get("collection", f"{__name__}:ParquetCollection").partition(":")
        return getattr(importlib.import_module(module), name)(self.options["path"])

    def schema(self) -> StructType:
        return from_arrow_schema(self.collection().schema())

    def reader(self, schema: StructType) -> D.DataSourceReader:
        size = int(self.options.get("pageSize", PAGE))
        if size < 1:
            raise ValueError("pageSize must be 1 or more")
        return PagedReader(self, schema.names, size, [tuple(c) for c in json.loads(self.options.get("conditions", "[]"))])


class PagedReader(D.DataSourceReader):
    def __init__(self, source: PagedSource, columns: list[str], size: int, conditions: list[Condition]):
        self.source, self.columns, self.size, self.conditions = source, columns, size, conditions

    def partitions(self) -> list[D.InputPartition]:
        return [D.InputPartition(part) for part in self.source.collection().parts()]

    def read(self, partition: D.InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return  # a collection of no parts
        collection = self.source.collection()
        offset, more = None, True
        while more:
            page, offset = collection.scroll(partition.value, offset, self.size, self.columns, self.conditions)
            more = offset is not None
            if page.num_rows:
                yield page


def _meets(condition: Condition) -> F.Column:
    """A condition as Spark has it."""
    column, kind, value = condition
    if not (kind == "known" or kind == "in" or kind in _COMPARED):
        raise ValueError(f"no condition: {kind}")
    if kind != "known" and not all(isinstance(v, str | int) for v in (value if kind == "in" else [value])):
        raise ValueError("values of conditions are strings, integers and booleans")
    if kind == "known":
        return F.col(column).isNotNull()
    return F.col(column).isin(list(value)) if kind == "in" else _COMPARED[kind](F.col(column), F.lit(value))


def read_points(spark: SparkSession, path: str, columns: list[str] | None = None, source: str | None = None, conditions: list[Condition] | None = None, source_col: str = "source", page: int = PAGE, collection: str | None = None) -> DataFrame:
    """(columns) of a collection's points, all columns if none are named: those that meet all conditions, and only those of one source if it is given, neither null nor empty.

    A null meets no condition. No rows, repeated rows and columns of any name are as in the collection.
    """
    asked = [*(conditions or []), *([(source_col, "=", source)] if source else [])]
    spark.dataSource.register(PagedSource)
    options = {"path": path, "pageSize": str(page), "conditions": json.dumps(asked)} | ({"collection": collection} if collection else {})
    reader = spark.read.format("paged").options(**options)
    whole = reader.load().schema
    needed = {c for c, _, _ in asked} | set(whole.names if columns is None else columns)
    rows = reader.schema(StructType([f for f in whole if f.name in needed])).load()
    for condition in asked:
        rows = rows.where(_meets(condition))
    return rows.select(*(columns or whole.names))
