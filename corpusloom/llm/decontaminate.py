"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are sets of word shingles. Shingles are ordered by how rare they are
in the documents; as all of a window's shingles must be in a document, the rarest one
is a long enough prefix. Where a document has it, place and length are bounded and the
window's words are compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import checkpointed, small_batches, table, windows, word_hashes

WINDOW, SHINGLE = 10, 3
#: The windows go to every task if they take no more than this; else they are joined by their rarest shingle.
BROADCAST_BYTES = 32 << 20
#: Beyond it, bits of the filter of wanted shingles that goes to every task (16 MB, whatever the benchmark), and parts of each shingle in the join.
FILTER_BITS, PARTS = 1 << 27, 8

#: A-Z to lower case; what isn't a letter of a-z, a digit or beyond ASCII, to a space.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def folded(text: str | None) -> bytes:
    """The text's words with single or more spaces between them."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""


def words_of(text: str | None) -> list[bytes]:
    return folded(text).split()


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Signed hashes of all runs of width words."""
    return windows(hashes, width).view(np.int64) if len(hashes) >= width else np.zeros(0, np.int64)


class Sought:
    """Sorted hashes that are looked for, behind a table of bits that holds back most others."""

    def __init__(self, hashes: Iterable[int]):
        self.known = np.array(sorted(hashes), np.int64)
        self.shift = np.uint64(64 - max(16, min(24, len(self.known).bit_length() + 5)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.known.view(np.uint64) >> self.shift] = True

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in found, the same in known) of those that are known."""
        here = np.flatnonzero(self.bits[found.view(np.uint64) >> self.shift])
        at = np.searchsorted(self.known, found[here])
        true = self.known[np.minimum(at, len(self.known) - 1)] == found[here]
        return here[true], at[true]


def _windowed(size: int, shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = min(size, len(words))
                found = _shingles(word_hashes(folded(text)), min(shingle, n)) if n else ()
                for i in range(len(words) - n + 1 if n else 0):
                    rows.append((item, b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass"), n, found[i : i + n - min(shingle, n) + 1].tolist()))
            kinds = (("item", pa.string()), ("window", pa.string()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    return run


def windows_of(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(window, n, shingles, items): each distinct window once, with the sorted items that have it."""
    rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    placed = rows.mapInArrow(_windowed(size, shingle), "item string, window string, n int, shingles array<bigint>")
    return placed.groupBy("window", "n").agg(F.first("shingles").alias("shingles"), F.array_sort(F.collect_set("item")).alias("items"))


def _rarest(shingles: list[int], counts: dict[int, int]) -> int:
    """The place in the window of its rarest shingle; equal ones by hash."""
    return min(range(len(shingles)), key=lambda i: (counts.get(shingles[i], 0), shingles[i]))


def _verdict(words: list[bytes], found: list[tuple[int, list[bytes], list[str]]]) -> tuple[list[dict], list[str]]:
    """(merged spans of hit words, sorted items) of candidates (start, window's words, items), each compared word by word."""
    spans: list[dict] = []
    items: set[str] = set()
    for start, window, named in sorted(found):
        if start >= 0 and start + len(window) <= len(words) and words[start : start + len(window)] == window:
            items.update(named)
            if spans and start <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], start + len(window))
            else:
                spans.append({"start": start, "end": start + len(window)})
    return spans, sorted(items)


def _judged(batch: pa.RecordBatch, rows: list[tuple[int, list[dict], list[str]]], keep_text: bool) -> pa.RecordBatch:
    made = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _SPANS), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
    text = ["text"] if keep_text else []
    return pa.RecordBatch.from_arrays([batch.column("id"), *made, *map(batch.column, text)], ["id", "n_words", "spans", "items", *text])


def _counted(wanted: dict[int, Sought]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often a part of the documents has each wanted shingle; wanted by width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {width: np.zeros(len(sought.known), np.int64) for width, sought in wanted.items()}
        for batch in batches:
            for text in batch.column("text"):
                hashes = word_hashes(folded(text.as_py()))
                for width, sought in wanted.items():
                    np.add.at(counts[width], sought.places(_shingles(hashes, width))[1], 1)
        for width, sought in wanted.items():
            some = counts[width] > 0
            yield pa.RecordBatch.from_arrays([pa.array(sought.known[some]), pa.array(counts[width][some])], ["shingle", "n"])

    return run


def _probed(prefix: dict[int, dict[int, list]], wanted: dict[int, Sought], keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The verdicts of a part of the documents; prefix: by width and shingle, (offset, window's words, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = folded(text.as_py())
                hashes = word_hashes(data)
                found = []
                for width, sought in wanted.items():
                    places, at = sought.places(_shingles(hashes, width))
                    for place, shingle in zip(places.tolist(), sought.known[at].tolist(), strict=True):
                        found += [(place - offset, window, items) for offset, window, items in prefix[width][shingle]]
                rows.append((len(hashes), *_verdict(data.split() if found else [], found)))
            yield _judged(batch, rows, keep_text)

    return run


def _filter(hashes: DataFrame) -> bytes:
    """The bits of a filter of hashes (h), of FILTER_BITS / 8 bytes: a bit is told by the first digits of a hash."""
    bit = F.shiftrightunsigned("h", 64 - (FILTER_BITS.bit_length() - 1))
    words = hashes.select((bit.bitwiseAND(F.lit(63))).cast("int").alias("b"), F.shiftright(bit, 6).alias("w")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.toLocalIterator(prefetchPartitions=True):
        table[r["w"]] = r["v"]
    return table.tobytes()


def _occurring(widths: list[int], filtered: Broadcast, sizes: dict[int, list[int]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, place, shingle, n, around) of the shingles that may be wanted; with sizes (window sizes by width), around has the hashes of the windows of n words that may hold it, by offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shift = np.frombuffer(filtered.value, np.uint64), np.uint64(64 - (FILTER_BITS.bit_length() - 1))
        kinds = (("key", pa.int64()), ("place", pa.int64()), ("shingle", pa.int64()), ("n", pa.int32()), ("around", pa.list_(pa.int64())))
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                hashes = word_hashes(folded(text.as_py()))
                for width in widths:
                    found = _shingles(hashes, width)
                    bit = found.view(np.uint64) >> shift
                    for place in np.flatnonzero(known[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).tolist():
                        for n in sizes[width] if sizes else (0,):
                            begin = place - (n - width)
                            near = _shingles(hashes[max(begin, 0) : place + n], n) if n else ()
                            around = [int(near[place - o - max(begin, 0)]) if 0 <= place - o - max(begin, 0) < len(near) and place >= o else None for o in range(n - width + 1)] if n else None
                            rows.append((key, place, int(found[place]), n, around))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    return run


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([int(windows(word_hashes(w.as_py().encode("utf-8", "surrogatepass")), n.as_py()).view(np.int64)[0]) for w, n in zip(batch.column("window"), batch.column("n"), strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "hash"])


def _compared(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column("text"), batch.column("found").to_pylist(), strict=True):
            words = words_of(text.as_py())
            rows.append((len(words), *_verdict(words, [(x["start"], x["window"].encode("utf-8", "surrogatepass").split(b" "), x["items"]) for x in found or ()])))
        yield _judged(batch, rows, keep_text)


def find_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES, keep_text: bool = False) -> DataFrame:
    """(id_col, n_words, spans array<struct<start, end>>, items array<string>) of every row of docs; with keep_text also `text`, as a string.

    spans are the hit words, merged, as places of words; items the sorted ids whose windows occur.
    A null text has no words and no item's window; an item of fewer than `size` words is one window,
    one of none has none; an item with a null id hits but isn't named. Equal windows of several
    items, repeated rows and null ids of docs are all kept; other columns don't matter. An id may be
    of any type, a struct of a row's other columns too.

    Shingles are counted over all documents. If the windows take up to broadcast_bytes, both passes
    over the documents need no shuffle but that of the counts. Beyond it a filter of fixed size goes
    to every task, so that only shingles that may be wanted are shuffled; where a document has a
    window's rarest one, and the hash of the window around it fits, the place goes back to the
    document, where words are compared: a document gathers as many places as it has hits.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sought = windows_of(bench, item_col, item_text_col, size, shingle)
    span = T.StructType().add("start", "long").add("end", "long")
    out = T.StructType().add("id", rows.schema["id"].dataType).add("n_words", "long").add("spans", T.ArrayType(span)).add("items", T.ArrayType(T.StringType()))
    out = out.add("text", "string") if keep_text else out
    weight = sought.agg(F.sum(F.octet_length("window") + 16 * F.size("shingles") + F.octet_length(F.array_join("items", ",")))).first()[0] or 0
    width = lambda n: min(shingle, n)
    if weight <= broadcast_bytes:
        listed = sought.collect()
        by_width = defaultdict(set)
        for w in listed:
            by_width[width(w["n"])].update(w["shingles"])
        wanted = {k: Sought(v) for k, v in sorted(by_width.items())}
        counts = {r["shingle"]: r["n"] for r in rows.mapInArrow(_counted(wanted), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).collect()} if wanted else {}
        prefix: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for w in listed:
            offset = _rarest(w["shingles"], counts)
            prefix[width(w["n"])][w["shingles"][offset]].append((offset, w["window"].encode("utf-8", "surrogatepass").split(b" "), w["items"]))
        plain = {k: dict(v) for k, v in prefix.items()}
        found = rows.mapInArrow(_probed(plain, {k: Sought(v) for k, v in plain.items()}, keep_text), out)
    else:
        by_width = defaultdict(list)
        for n in sorted(r["n"] for r in sought.select("n").distinct().collect()):  # size of them at most
            by_width[width(n)].append(n)
        context = docs.sparkSession.sparkContext
        shared = lambda hashes: context.broadcast(_filter(hashes))
        sought = checkpointed(sought)
        keyed = rows.withColumn("key", F.xxhash64(F.to_json(F.struct("id")), "text"))  # an id may hold what has no hash, as maps
        texts = keyed.select("key", "text")
        kinds = "key bigint, place bigint, shingle bigint, n int, around array<bigint>"
        each = sought.select("window", "n", F.posexplode("shingles").alias("offset", "shingle"))
        there = texts.mapInArrow(_occurring(sorted(by_width), shared(each.select(F.col("shingle").alias("h")).distinct()), None), kinds)
        counts = there.groupBy("shingle").count()
        rank = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset")
        rarest = checkpointed(each.join(counts, "shingle", "left").groupBy("window", "n").agg(F.min(rank).alias("r")).select("window", "n", "r.shingle", "r.offset"))
        near = texts.mapInArrow(_occurring(sorted(by_width), shared(rarest.select(F.col("shingle").alias("h")).distinct()), dict(by_width)), kinds).withColumn("part", F.pmod(F.xxhash64("key", "place"), F.lit(PARTS)))
        hashed = rarest.mapInArrow(_window_hashes, "window string, n int, shingle bigint, offset int, hash bigint").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        start = F.col("place") - F.col("offset")
        hits = near.join(hashed, ["shingle", "n", "part"]).where(F.get("around", "offset") == F.col("hash")).select("key", start.alias("start"), "window").distinct()
        named = hits.join(sought.select("window", "items"), "window").select("key", F.struct("start", "window", "items").alias("c"))
        gathered = named.groupBy("key").agg(F.collect_list("c").alias("found"))
        found = keyed.join(gathered, "key", "left").select("id", "text", "found").mapInArrow(lambda batches: _compared(batches, keep_text), out)
    return found.withColumnRenamed("id", id_col)


def op10_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
with fold as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as words from documents
), items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as words from benchmark
), windows as (
  select item, least(10, len(words)) as n, unnest(list_transform(range(1, len(words) - least(10, len(words)) + 2), lambda i: list_aggregate(words[i:i + least(10, len(words)) - 1], 'string_agg', ' '))) as content
  from items where len(words) > 0
), sizes as (select distinct n from windows), sought as (select distinct n, content from windows),
runs as (
  select doc_id, n, unnest(range(1, len(words) - n + 2)) as place, unnest(list_transform(range(1, len(words) - n + 2), lambda i: list_aggregate(words[i:i + n - 1], 'string_agg', ' '))) as content
  from fold, sizes where len(words) >= n
), found as (select r.* from runs r join sought s on r.n = s.n and r.content = s.content),
hits as (select doc_id, count(distinct place + k) as n_hit from (select doc_id, place, unnest(range(n)) as k from found) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct f.doc_id, w.item from found f join windows w on f.n = w.n and f.content = w.content) group by doc_id
)
select d.doc_id, coalesce(len(d.words), 0) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(n.n_items, 0) as n_items,
       sha256(coalesce(n.listed, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from fold d left join hits h on d.doc_id = h.doc_id left join named n on d.doc_id = n.doc_id
"""

QUERIES = {"op10_benchmark_overlap": op10_benchmark_overlap}
ORACLE_SQL = {"op10_benchmark_overlap": ORACLE}
