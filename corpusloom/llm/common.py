"""What the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: a word is a longest run of other characters.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of a text that are hashed at once, and bytes of a word that are summed by place; longer words are hashed whole.
SLICE, SHORT = 1 << 20, 64

#: Bytes of a batch that goes to Python; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows of a part of a small table.
PART_ROWS = 100_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NEXT_BLANK = re.compile(b"[\x20\x09-\x0d]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, small: bool = False) -> DataFrame:
    """df, written to the shared checkpoint folder; a lost executor loses none of it.

    small: df has a few columns of few bytes, and many parts for its rows. It is counted first, held
    on Spark's own disks, and written in parts of PART_ROWS rows, as each part is a file.

    The folder is the session's spark.checkpoint.dir. A session that names none gets a temporary
    one if it runs on this machine alone, as in tests; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    if not small:
        return df.checkpoint(eager=True)
    held = df.persist(StorageLevel.DISK_ONLY)
    out = held.coalesce(held.count() // PART_ROWS + 1).checkpoint(eager=True)
    held.unpersist()
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python in bytes, if the session allows larger ones: texts are of any length, so a number of rows is no bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match("[0-9]+", spark.conf.get(name, str(64 << 20)))[0]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def lookup(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """left with the row of right that has its keys, which are never null and which right has once; how: also `left`; weight: how many rows of left that is.

    Keys of more than a thousandth of all rows, so a thousand at most, are broadcast; the others are dealt out.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * 1_000 > total
    hot = right.where(heavy).drop(weight)
    marked = left.join(F.broadcast(hot.select(*on, F.lit(True).alias("_hot"))), on, "left")
    rest = marked.where("_hot is null").drop("_hot").join(right.where(~heavy).drop(weight), on, how)
    return marked.where("_hot").drop("_hot").join(F.broadcast(hot), on).unionByName(rest)


def row_key(*columns: str) -> F.Column:
    """A 64-bit key of a row's content: rows that are equal in these columns share it."""
    return F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in columns))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each place of a word, and for each place of a window.
_BYTE_AT = mixed(np.arange(1, SHORT * 256 + 1, dtype=np.uint64) * _GOLDEN)
_PLACES = mixed(np.arange(1, 65, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANK)] = True


def _slices(data: bytes) -> Iterator[bytes]:
    """data in parts that end between words; a word that is longer than a part is one."""
    start = 0
    while start < len(data):
        end = start + SLICE
        if end < len(data):
            cut = _NEXT_BLANK.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def _hashed(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = ~_IS_BLANK[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    long = np.flatnonzero(size > SHORT)
    chars = raw[inside]
    first = np.cumsum(size) - size
    place = np.arange(len(chars), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    if len(long):
        place &= SHORT - 1
    out = mixed(np.add.reduceat(_BYTE_AT[(place << 8) | chars], first) + size.astype(np.uint64))
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in bytes, whatever its length, in memory of some times a slice and 8 bytes a word."""
    if len(data) <= SLICE:
        return _hashed(data)
    found = []
    for part in _slices(data):
        if len(part) > 2 * SLICE:  # what goes on beyond the slice is one word
            start = 1 + max(part.rfind(c) for c in BLANK)
            found.append(_hashed(part[:start]))
            found.append(np.array([xxhash.xxh64_intdigest(part[start:])], np.uint64))
        else:
            found.append(_hashed(part))
    return np.concatenate(found)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` consecutive words (64 at most); one of all of them if there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = hashes[: n - width + 1] * _PLACES[0]
    for i in range(1, width):
        out += hashes[i : n - width + 1 + i] * _PLACES[i]
    return mixed(out + np.uint64(width))


def made(**columns: tuple[list | np.ndarray, pa.DataType | None]) -> pa.RecordBatch:
    """A batch of these columns."""
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], list(columns))
