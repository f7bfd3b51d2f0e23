"""A search index, written once: documents as hashed words with their vectors, and postings by word with block maxima.

Documents get their vectors first and then stand in blocks of bounded size, in the order in which they
come, and within a block by ordinal: a block lies in one file. A posting row is a word in a block: the
places of its documents, their weights, and the largest of them, by which blocks that can't reach a score
are passed over before their postings are decoded. Postings are partitioned by word; searches that scan
the documents need none, so they may be left out and written later. No query reads a text again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.bm25 import EPSILON, K1, B
from corpusloom.sources.storage import new_path, small_batches, spread

#: Documents of a block, and characters of their texts after which it ends earlier.
BLOCK_DOCS, BLOCK_CHARS = 1_024, 8 << 20
#: Posting rows of a bucket of words, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 4_096
Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Figures:
    """Of the corpus: documents, words, mean of all words' idf, blocks, buckets of postings; parameters of the weights."""

    n_docs: int
    n_tokens: int
    mean_idf: float
    n_blocks: int
    n_buckets: int
    k1: float = K1
    b: float = B
    epsilon: float = EPSILON

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


@dataclass(frozen=True)
class TextIndex:
    """docs (doc_id, data_source_type, ordinal, block, slot, dl, terms, counts, vector), postings (h, block, size, n, most, slots, weights; by bucket; None if they aren't written), terms (h, df, raw_idf)."""

    path: str
    figures: Figures
    docs: DataFrame = field(repr=False)
    postings: DataFrame | None = field(repr=False)
    terms: DataFrame = field(repr=False)

    def idf(self, hashes: list[int]) -> dict[int, float]:
        """Of the asked words that any document has; a negative one becomes epsilon times the mean of all."""
        if not hashes:
            return {}
        wanted = F.broadcast(self.terms.sparkSession.createDataFrame([(h,) for h in hashes], "h long"))
        found = self.terms.join(wanted, "h").select("h", "raw_idf").collect()
        return {r["h"]: r["raw_idf"] if r["raw_idf"] >= 0 else self.figures.epsilon * self.figures.mean_idf for r in found}

    def asked(self, hashes: list[int]) -> DataFrame:
        """The postings of these words: other buckets aren't read."""
        if self.postings is None:
            raise ValueError("the index has no postings: with_postings writes them")
        wanted = F.broadcast(self.postings.sparkSession.createDataFrame([(h,) for h in hashes], "h long"))
        buckets = sorted({h % self.figures.n_buckets for h in hashes})
        inside = self.postings.where(F.col("bucket").isin(buckets)) if len(buckets) < self.figures.n_buckets else self.postings
        return inside.join(wanted, "h", "left_semi")


def word_hash(word: str) -> int:
    """A word's signed 64-bit hash, by which the index knows it."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class _Hashes(dict):
    """Hashes of the words of a batch, as word_hash has them but without a sign."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _hashed(block_docs: int) -> Callable[[Batches], Batches]:
    """Documents in blocks, with the hashes and counts of their words."""

    def run(batches: Batches) -> Batches:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        names = ["doc_id", "data_source_type", "ordinal", "vector"]
        parts: list[pa.RecordBatch] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        chars = 0

        def block() -> pa.RecordBatch:
            rows, n = pa.Table.from_batches(parts), len(counted)
            ordinals = rows.column("ordinal").to_pylist()
            order = sorted(range(n), key=lambda i: (ordinals[i] is not None, ordinals[i]))
            rows = rows.take(pa.array(order, pa.int64())).combine_chunks()
            terms, counts = ([counted[i][at] for i in order] for at in (0, 1))
            offsets = pa.array(np.cumsum([0, *map(len, terms)]).astype(np.int32))
            columns = {
                "block": pa.array([number] * n, pa.int64()),
                "size": pa.array([n] * n, pa.int32()),
                "slot": pa.array(range(n), pa.int32()),
                "dl": pa.array([int(x.sum()) for x in counts], pa.int32()),
                "terms": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms))),
                "counts": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts))),
            }
            return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in names), *columns.values()], [*names, *columns])

        for batch in batches:
            hashes, start = _Hashes(), 0
            whole = pa.RecordBatch.from_arrays([batch.column(c) for c in names], names)
            for i, text in enumerate(batch.column("raw_chunk")):
                words = words_of(known := text.as_py())
                h, times = np.unique(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)).view(np.int64), return_counts=True)
                counted.append((h, times.astype(np.int32)))
                chars += len(known or "")
                if len(counted) == block_docs or chars > BLOCK_CHARS:
                    parts.append(whole.slice(start, i + 1 - start))
                    yield block()
                    number, parts, counted, chars, start = number + 1, [], [], 0, i + 1
            if start < batch.num_rows:
                parts.append(whole.slice(start))
        if counted:
            yield block()

    return run


def _inverted(k1: float, b: float, avgdl: float, buckets: int) -> Callable[[Batches], Batches]:
    """Posting rows of documents, block by block; those of a block whose documents don't come one after the other are several rows."""

    def blocks(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(numbers)) + 1):
                if not len(part):
                    continue
                if held and held[0].column("block")[0].as_py() != numbers[part[0]]:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held.append(batch.slice(part[0], len(part)))
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Batches) -> Batches:
        for batch in blocks(batches):
            held = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h, tf = batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(float)
            if not len(h):
                continue
            each = lambda c: np.repeat(batch.column(c).to_numpy(), held)  # noqa: B023, E731
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * each("dl") / avgdl))
            block, slot, size = each("block"), each("slot"), each("size")
            order = np.lexsort((slot, h, block))
            block, slot, size, h, weight = (x[order] for x in (block, slot, size, h, weight))
            first = np.flatnonzero(np.r_[True, (np.diff(h) != 0) | (np.diff(block) != 0)])
            offsets = pa.array(np.r_[first, len(h)].astype(np.int32))
            columns = {
                "bucket": pa.array((h[first] % buckets).astype(np.int32)),
                "h": pa.array(h[first]),
                "block": pa.array(block[first]),
                "size": pa.array(size[first].astype(np.int32)),
                "n": pa.array(np.diff(np.r_[first, len(h)]).astype(np.int32)),
                "most": pa.array(np.maximum.reduceat(weight, first)),
                "slots": pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int32))),
                "weights": pa.ListArray.from_arrays(offsets, pa.array(weight)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


_POSTINGS = "h long, block long, size int, n int, most double, slots array<int>, weights array<double>, bucket int"


def build_index(chunks: DataFrame, vectors: DataFrame | None = None, path: str | None = None, k1: float = K1, b: float = B, epsilon: float = EPSILON, block_docs: int = BLOCK_DOCS, postings: bool = True) -> TextIndex:
    """The index of all chunks (doc_id, raw_chunk, data_source_type, ordinal) and their vectors (doc_id, vector), written under a path, a new one in the shared folder if none is given.

    Null text is an empty chunk that counts. Texts are read once, and moved once at most: to their
    vectors, if these are too many to be sent to every task. Searches that scan need no postings
    (postings=False). An index may be opened again, by other sessions too.
    """
    spark = chunks.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "index")
    rows = chunks.select("raw_chunk", "doc_id", "data_source_type", "ordinal")
    if vectors is not None:
        rows = spread(rows, "doc_id").join(vectors.select("doc_id", "vector"), "doc_id", "left")
    else:
        rows = spread(rows).withColumn("vector", F.lit(None).cast("array<double>"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    hashed = rows.mapInArrow(_hashed(block_docs), f"doc_id {kind['doc_id']}, data_source_type string, ordinal {kind['ordinal']}, vector {kind['vector']}, block long, size int, slot int, dl int, terms array<long>, counts array<int>")
    hashed.write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    sizes = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.count_distinct("block").alias("blocks"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("entries")).first()
    buckets = int(min(MOST_BUCKETS, max(1, -(-sizes["entries"] // BUCKET_ROWS))))
    n = F.lit(sizes["n"])
    df = docs.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    df.select("h", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf")).write.parquet(f"{path}/terms")
    mean = spark.read.parquet(f"{path}/terms").agg(F.avg("raw_idf")).first()[0]
    figures = Figures(sizes["n"], sizes["total"], mean or 0.0, sizes["blocks"], buckets, k1, b, epsilon)
    spark.createDataFrame([(json.dumps(asdict(figures)),)], "value string").coalesce(1).write.text(f"{path}/figures")
    index = open_index(spark, path)
    return with_postings(index) if postings else index


def with_postings(index: TextIndex) -> TextIndex:
    """The index with its postings, which are written beside its documents if they aren't yet."""
    if index.postings is not None:
        return index
    spark, f = index.docs.sparkSession, index.figures
    small_batches(spark)
    made = index.docs.select("block", "size", "slot", "dl", "terms", "counts").mapInArrow(_inverted(f.k1, f.b, f.avgdl or 1.0, f.n_buckets), "bucket int, h long, block long, size int, n int, most double, slots array<int>, weights array<double>")
    made.repartition(F.col("bucket"), F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "h", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings")
    spark.createDataFrame([("whole",)], "value string").coalesce(1).write.mode("overwrite").text(f"{index.path}/inverted")
    return open_index(spark, index.path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    """An index that was written before, with its postings if all of them are."""
    figures = Figures(**json.loads(spark.read.text(f"{path}/figures").first()[0]))
    try:
        spark.read.text(f"{path}/inverted")
        postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    except AnalysisException:
        postings = None
    return TextIndex(path, figures, spark.read.parquet(f"{path}/docs"), postings, spark.read.parquet(f"{path}/terms"))
