"""Where intermediate tables go, how inputs of few parts are dealt out, and tables that are made once from the same files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Made = TypeVar("Made")
#: Bytes of a batch that goes to Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: What was made from files, by application, name and the files' state.
_MADE: dict[tuple, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a session that names none gets a temporary one if it runs on this machine alone."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; a lost executor loses none of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def through_json(df: DataFrame, name: str) -> DataFrame:
    """df, written as JSON lines under a new name in the shared folder, and read again by its own schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.json(path)
    return spark.read.schema(df.schema).json(path)


def written(df: DataFrame, name: str) -> str:
    """The path of df, written as Parquet under a new name in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: planners know its size then, so few rows are sent to those they are joined with, which stay where they are."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python in bytes, if the session allows larger ones: a number of rows is no bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match("[0-9]+", spark.conf.get(name, str(64 << 20)))[0]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def state_of(*tables: DataFrame) -> tuple:
    """The files of tables as they are now: how many, and a sum of the hashes of their paths, sizes and times. No column is read."""
    names = ["file_path", "file_size", "file_modification_time"]
    each = [df.select(F.lit(i).alias("of"), *(F.col(f"_metadata.{c}").alias(c) for c in names)) for i, df in enumerate(tables)]
    files = reduce(DataFrame.union, each).distinct()
    return tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first())


def made_once(spark: SparkSession, name: str, files: list[DataFrame], make: Callable[[], Made]) -> Made:
    """What `make` gives: made once in an application for the present state of these files. It must lie in the shared folder, not in a session's memory."""
    key = (spark.sparkContext.applicationId, name, state_of(*files))
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all cores, if it comes from one file, whose parts are fewer than twice their number; inputs of several files stay as they are. by: what it is joined by next, so that it isn't moved again."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) > 1 or df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(*by) if by else df.repartition(cores)
