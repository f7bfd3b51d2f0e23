"""Chunks of texts by separators from coarse to fine, with overlap, and what of a table has changed since it was last processed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: From paragraphs to words; where none is left, a text is cut anywhere.
SEPARATORS = ("\n\n", "\n", ". ", " ")
LIMIT, OVERLAP = 512, 50
Batches = Iterator[pa.RecordBatch]


def pieces(text: str, limit: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[tuple[int, int]]:
    """Spans that follow each other and none of which is longer than the limit; a separator ends its piece, and only pieces that are too long are split by finer ones."""
    rest = [(0, len(text), 0, False)]
    while rest:
        start, end, level, going_on = rest.pop()  # going_on: what stands before was cut off at this level
        if end - start <= limit and not going_on:
            if end > start:
                yield start, end
        elif level == len(separators):
            yield start, start + limit
            rest.append((start + limit, end, level, False))
        else:
            mark = separators[level]
            at = text.find(mark, start, end)
            cut = at + len(mark) if at >= 0 else end
            if cut < end:
                rest.append((cut, end, level, True))
            rest.append((start, cut, level + 1, False))


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Iterator[tuple[int, int]]:
    """Chunks of whole pieces, each as long as the limit allows; one begins with the last pieces of the one before, as many as the overlap and its own first piece allow."""
    held: list[tuple[int, int]] = []
    for piece in pieces(text, limit, separators):
        if held and piece[1] - held[0][0] > limit:
            yield held[0][0], held[-1][1]
            while held and (held[-1][1] - held[0][0] > overlap or piece[1] - held[0][0] > limit):
                held.pop(0)
        held.append(piece)
    if held:
        yield held[0][0], held[-1][1]


def _chunked(limit: int, overlap: int, separators: tuple[str, ...], rows: int = 4_096) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            at, place, start, chunk = [], [], [], []

            def made() -> pa.RecordBatch:
                taken = batch.column("id").take(pa.array(at, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([taken, pa.array(place, pa.int32()), pa.array(start, pa.int32()), pa.array(chunk, pa.string())], ["id", "pos", "start", "chunk"])  # noqa: B023

            for i, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                for k, (a, b) in enumerate(spans(text, limit, overlap, separators)):
                    at.append(i)
                    place.append(k)
                    start.append(a)
                    chunk.append(text[a:b])
                    if len(at) == rows:
                        yield made()
                        at, place, start, chunk = [], [], [], []
            if at:
                yield made()

    return run


def recursive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_chunk", limit: int = LIMIT, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(id_col, pos, start, chunk) of every text: its chunks in order and where they start, in code points. Null and empty texts have none."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_chunked(limit, overlap, separators), f"id {kind}, pos int, start int, chunk string").withColumnRenamed("id", id_col)


def state_of_runs(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(id, hash, run): the latest state of every document that was ever processed; hash is null if it was gone then. Runs are appended, so the state of a run never replaces another's."""
    schema = f"id {kind}, hash string, run long"
    try:
        log = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return log.groupBy("id").agg(F.max_by("hash", "run").alias("hash"), F.max("run").alias("run"))


def changes(docs: DataFrame, state: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, status) of every document of either: `new`, `changed`, `same` or `gone`. Documents without an id are left out; of those that share one, the largest hash counts."""
    now = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.md5(F.coalesce(text_col, F.lit("")))).alias("hash"))
    both = now.join(state.where("hash is not null").select("id", F.col("hash").alias("before")), "id", "full")
    status = F.when(F.col("hash").isNull(), "gone").when(F.col("before").isNull(), "new").when(F.col("hash") == F.col("before"), "same").otherwise("changed")
    return both.select("id", "hash", status.alias("status"))


def process(docs: DataFrame, path: str, work: Callable[[DataFrame], None], run: int, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Hands `work` the documents that are new or have changed since the runs under a path, and then adds this run to them; returns how many documents it handed on.

    The run is written after the work, so a run that fails is done again by the next one; the same
    run again replaces its own partition.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    found = changes(docs, state_of_runs(spark, path, kind), id_col, text_col).where("status <> 'same'")
    todo = docs.join(found.where("status <> 'gone'").select(F.col("id").alias(id_col)), id_col, "left_semi")
    count = todo.count()
    if count:
        work(todo)
    found.select("id", "hash").write.mode("overwrite").parquet(f"{path}/run={run}")
    return count
