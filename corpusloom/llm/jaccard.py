"""N-gram Jaccard join by universe-partition pigeonhole.

Two sets of sizes k <= l with Jaccard 0.8 differ in at most (k + l) / 9 <= k / 4 tokens.
For each size band of the smaller set tokens are hashed into `need` segments, one more than
that bound, and some to spare: linked sets have at least spare + 1 segments in common.

Allocation by cost: a segment held by g sets costs each of them g / 2 candidates if it is
paired; a set's one-deletion neighbourhoods cost about 4.5 index rows for each segment of the
plain index, and such a row, which carries a component and a sketch, about 3.5 times as much as
a candidate. So segments of more than COMMON = 32 sets are passed over (and give only a star
around one set), as are empty ones, which all sets share. If one of two linked sets passes over
no more segments than it has to spare, then of their common segments one at least is paired, and
being common is the segment's own trait, so it is paired for both. Only if both pass over more
("heavy" sets) can they miss, and these are allotted one-deletion neighbourhoods of half as many,
larger segments: with need differences at most, one of those has one difference or none, so that
two heavy sets share a whole segment or a neighbourhood. Every candidate is verified exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, mixed, small_batches, table, windows, word_hashes
from corpusloom.llm.graph import components

SHINGLE = 5
#: Where the costs meet: a segment in more sets than this is passed over, but for a star around one of them.
COMMON = 32
#: Segments to spare, as a share of those that the bound needs.
SPARE = 0.08
#: Index rows that are grouped at once before the shuffle, and keys of sets that a task remembers; rows of a neighbourhood that are compared at once.
FLUSH, REMEMBERED, BLOCK = 250_000, 50_000, 2_000
#: Ids that are broadcast to fetch their texts, sketches of heavy sets, and keys of neighbourhoods; more are joined.
BROADCAST_IDS, BROADCAST_SKETCHES, BROADCAST_KEYS = 1_000_000, 100_000, 200_000
#: Parts of each key of a neighbourhood in the join that takes more keys than are broadcast.
PARTS = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bands() -> np.ndarray:
    """The largest size of each band; a set's links are in its own band and those beside it."""
    ends = [3]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 5 // 4))
    return np.array(ends)


BANDS = _bands()


def shingles_of(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles: words are split at white space, A-Z lower-cased."""
    return np.unique(windows(word_hashes(text.encode("utf-8", "surrogatepass").lower()), size)) if text else np.zeros(0, np.uint64)


def _set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit key of a set of tokens."""
    return int(mixed(np.array([mixed(tokens + _ODD).sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _sketch(tokens: np.ndarray) -> bytes:
    """The parity of tokens in each of some bits: two sets differ in as many tokens as their bits, at least."""
    bits = 512
    while bits < len(tokens) and bits < 1 << 20:
        bits *= 2
    return np.packbits((np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch in `size` bytes; numbers of bits being powers of two, parts add up."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


def _segments(tokens: np.ndarray, band: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each token, its share of the segment's sum, sums of all segments)."""
    salt = np.uint64(seed * 1_000_003 + band)
    spread = mixed(tokens ^ mixed(np.array([salt + _ODD], np.uint64)))
    at = (spread % np.uint64(count)).astype(np.int64)
    share = mixed(spread + _ODD)
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    sums = np.zeros(count, np.uint64)
    sums[at[order][starts]] = np.add.reduceat(share[order], starts)
    return at, share, sums


def _keys(sums: np.ndarray, at: np.ndarray, band: int, seed: int) -> np.ndarray:
    return mixed(mixed(sums + np.uint64(seed * 7919 + band + 1)) + at.astype(np.uint64) * _ODD).view(np.int64)


def _bands_of(size: int) -> list[int]:
    """The bands in which a set of this size meets its links: its own as the smaller or equal, the one below as the larger.

    Sets of up to three tokens are linked with equal ones only, and those share a key.
    """
    own = int(np.searchsorted(BANDS, size))
    return [band for band in (own - 1, own) if band >= 1]


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            tokens = shingles_of(text.as_py())
            rows.append((len(tokens), _set_key(tokens), _sketch(tokens)) if len(tokens) else (0, None, None))
        kinds = (("n", pa.int64()), ("a", pa.int64()), ("sketch", pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds))], ["id", *(name for name, _ in kinds)])


#: Index rows are (key, a, code): a segment's key, the set, and a code, which is band + CODES * (common segments that make
#: the set heavy in that band, at least 1). Rows of a segment that is common in a part of the input have a key of their own
#: with SALTED in the code, and one row with MARK stays under the segment's key. A code below CODES is that of a set which
#: has too many empty segments: it is heavy as it is.
CODES, MARK, SALTED = 1 << len(BANDS).bit_length(), -1, 1 << 62


def _flushed(keys: list[np.ndarray], sets: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
    """The rows so far. A segment that is common among them goes elsewhere under a salt, and leaves a mark."""
    key, of, code = (np.concatenate(x) for x in (keys, sets, codes))
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    common = (count > COMMON)[inverse]
    if common.any():
        marks = first[count > COMMON]
        marked, one = key[marks], of[marks]
        pivot = of[first][inverse][common].view(np.uint64)
        key[common] = mixed(key[common].view(np.uint64) ^ mixed(pivot + _ODD)).view(np.int64)
        code[common] += SALTED
        key, of, code = np.r_[key, marked], np.r_[of, one], np.r_[code, np.full(len(marks), MARK)]
    keys.clear(), sets.clear(), codes.clear()
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, of, code)], ["key", "a", "code"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    keys: list[np.ndarray] = []
    sets: list[np.ndarray] = []
    codes: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        for text in batch.column("text"):
            tokens = shingles_of(text.as_py())
            if not len(tokens) or (a := _set_key(tokens)) in seen:
                continue  # copies are one set
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.add(a)
            for band in _bands_of(len(tokens)):
                need = int(BANDS[band]) // 4 + 1
                spare = math.ceil(SPARE * need) + 1
                _, _, sums = _segments(tokens, band, need + spare, 0)
                at = np.flatnonzero(sums)
                left = spare - (need + spare - len(at))
                keys.append(_keys(sums[at], at, band, 0))
                codes.append(np.full(len(at), band + CODES * (max(left, 0) + 1), np.int64))
                if left < 0:
                    keys.append(np.array([a], np.int64))
                    codes.append(np.array([band], np.int64))
                sets.append(np.full(len(at) + (left < 0), a, np.int64))
                rows += len(at)
            if rows >= FLUSH:
                yield _flushed(keys, sets, codes)
                rows = 0
    if keys:
        yield _flushed(keys, sets, codes)


def _pairs(x: np.ndarray, y: np.ndarray | None, code: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(x), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), none if y is None else pa.array(y, pa.int64()), none if code is None else pa.array(code, pa.int64())], ["x", "y", "code"])


def _grouped(key: np.ndarray, of: np.ndarray, code: np.ndarray, done: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What whole groups of a key give, or a part of a common one. Rows are in order of key, those that are done before others, set."""
    fresh = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    another = fresh | np.r_[True, of[1:] != of[:-1]]
    size = np.bincount(group[another])
    hot = size > COMMON
    hot[group[(code == MARK) | (code >= SALTED)]] = True
    in_hot = hot[group] & ~done
    counted = in_hot & (code != MARK) & (another | np.r_[True, code[1:] != code[:-1]])
    yield _pairs(of[counted], None, code[counted] % SALTED)
    # A star for each first byte of a set's key, and one of their centres, so that no set has most of a large group at its side.
    begins = fresh | np.r_[True, (of[1:] >> 56) != (of[:-1] >> 56)]
    centre = of[np.flatnonzero(begins)][np.cumsum(begins) - 1]
    pivot = np.where(begins, of[first][group], centre)
    star = in_hot & another & (pivot != of)
    yield _pairs(pivot[star], of[star], None)
    cold = np.flatnonzero(another & ~hot[group] & (size > 1)[group])
    of, group = of[cold], group[cold]
    pairs = []
    for step in range(1, COMMON):
        near = np.flatnonzero(group[step:] == group[:-step]) if len(group) > step else ()
        if not len(near):
            break
        pairs.append(np.stack([of[near], of[near + step]]))
    if pairs:
        x, y = np.concatenate(pairs, axis=1)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        yield _pairs(x[new], y[new], None)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, code): pairs of sets that share a segment, code null, and (set, null, code) for each common segment of a set.

    Index rows come in order of their key. The last group of a batch is held until its end is seen,
    up to COMMON sets; of a larger one so many rows stay, which are done, as it is common by them.
    """
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    held_done = np.zeros(0, bool)
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            key, of, code, done = *held, held_done
        else:
            new = [batch.column(name).to_numpy() for name in ("key", "a", "code")]
            empty = (new[2] >= 0) & (new[2] < CODES)
            if empty.any():
                yield _pairs(new[1][empty], None, new[2][empty])
                new = [x[~empty] for x in new]
            key, of, code = (np.concatenate(x) for x in zip(held, new, strict=True))
            done = np.r_[held_done, np.zeros(len(new[0]), bool)]
        if not len(key):
            continue
        order = np.lexsort((code, of, ~done, key))
        key, of, code, done = key[order], of[order], code[order], done[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (code[1:] != code[:-1])]
        key, of, code, done = key[once], of[once], code[once], done[once]
        # In signed order, as the keys come; the last group may go on.
        cut = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
        if cut:
            yield from _grouped(key[:cut], of[:cut], code[:cut], done[:cut])
        key, of, code, done = key[cut:], of[cut:], code[cut:], done[cut:]
        places = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])[: COMMON + 1] if len(of) else ()
        if len(places) > COMMON:
            yield from _grouped(key, of, code, done)
            key, of, code, done = key[places], of[places], code[places], np.ones(len(places), bool)
        held, held_done = (key, of, code), done


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (x, y) that their sizes and sketches allow."""
    for batch in batches:
        n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
        fits = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
        for i in np.flatnonzero(fits).tolist():
            s, t = batch.column("s")[i].as_py(), batch.column("t")[i].as_py()
            size = min(len(s), len(t))
            fits[i] = 9 * int(np.bitwise_count(_folded(s, size) ^ _folded(t, size)).sum()) <= n[i] + m[i]
        chosen = batch.filter(pa.array(fits))
        yield pa.RecordBatch.from_arrays([chosen.column("x"), chosen.column("y")], ["x", "y"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(_set_key(tokens), tokens.tobytes()) for text in batch.column("text") if len(tokens := shingles_of(text.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["a", "tokens"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fits = []
        for s, t in zip(batch.column("s"), batch.column("t"), strict=True):
            s, t = (np.frombuffer(x.as_buffer(), np.uint64) for x in (s, t))
            both = len(np.intersect1d(s, t, assume_unique=True))
            fits.append(100 * both >= 80 * (len(s) + len(t) - both))
        chosen = batch.filter(pa.array(fits, pa.bool_()))
        yield pa.RecordBatch.from_arrays([chosen.column("x"), chosen.column("y")], ["x", "y"])


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text) of a document of each wanted set (a)."""
    ids = reps.join(wanted, "a", "left_semi").select(F.col("rep").alias("id"))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi").select("text")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The linked ones of pairs (x, y) of sets."""
    sides = [reps.select(F.col("a").alias(end), F.col("n").alias(n), F.col("sketch").alias(s)) for end, n, s in (("x", "n", "s"), ("y", "m", "t"))]
    possible = checkpointed(pairs.distinct().join(sides[0], "x").join(sides[1], "y").select("x", "y", "n", "s", "m", "t").mapInArrow(_possible, "x bigint, y bigint"), small=True)
    wanted = possible.select(F.explode(F.array("x", "y")).alias("a")).distinct()
    sets = _texts(docs, reps, wanted).mapInArrow(_listed, "a bigint, tokens binary").dropDuplicates(["a"])
    first, second = (sets.select(F.col("a").alias(end), F.col("tokens").alias(s)) for end, s in (("x", "s"), ("y", "t")))
    return checkpointed(possible.join(first, "x").join(second, "y").select("s", "t", "x", "y").mapInArrow(_linked, "x bigint, y bigint"), small=True)


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, whole, own, a, root), by about FLUSH / 4 rows: segments and their one-deletion neighbourhoods of each set in its bands.

    A pair is found in the band of its smaller set, so one of two sets must be in its own band (own).
    """
    rows: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        for text, a, root, bands in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("a", "root", "bands")), strict=True):
            tokens = shingles_of(text.as_py())
            if not len(tokens) or _set_key(tokens) != a:
                continue  # another text with the same id
            own = int(np.searchsorted(BANDS, len(tokens)))
            for band in bands:
                count = int(BANDS[band]) // 4 // 2 + 1
                at, share, sums = _segments(tokens, band, count, 1)
                key = np.r_[_keys(sums, np.arange(count), band, 1), _keys(sums[at] - share, at, band, 1)]
                n = len(key)
                rows.append((key, np.arange(n) < count, np.full(n, band == own), np.full(n, a), np.full(n, root)))
                size += n
            if size >= FLUSH // 4:
                yield tuple(np.concatenate(x) for x in zip(*rows, strict=True))
                rows, size = [], 0
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def _rows(columns: tuple[np.ndarray, ...], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _listed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _neighbourhoods(batches):
        yield _rows(part, ["key", "whole", "own", "a", "root"])


def _counted_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, root, n, any, own, h, pick): the rows of a key and component in a part of the input, whether one is a whole segment and one in its own band, and the set that comes first in an order of the key's own, told by h."""
    for key, whole, own, a, root in _neighbourhoods(batches):
        h = mixed(key.view(np.uint64) ^ mixed(a.view(np.uint64) + _ODD)).view(np.int64)
        order = np.lexsort((h, root, key))
        key, whole, own, a, root, h = (x[order] for x in (key, whole, own, a, root, h))
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (root[1:] != root[:-1])])
        n = np.diff(np.r_[first, len(key)])
        some = lambda x: np.logical_or.reduceat(x, first)  # noqa: B023, E731
        yield _rows((key[first], root[first], n, some(whole), some(own), h[first], a[first]), ["key", "root", "n", "any", "own", "h", "pick"])


def _apart(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a set on the minor side and another of whole groups of (key, i, j), if they aren't connected yet and sizes and sketches allow them."""
    t = t.take(pa.array(np.lexsort([t.column(c).to_numpy() for c in ("j", "i", "key")])))
    key, i, j, a, root, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "a", "root", "n"))
    whole, minor, own = (t.column(c).to_numpy(zero_copy_only=False) for c in ("whole", "minor", "own"))
    bits = np.frombuffer(b"".join(s.as_py() for s in t.column("sketch")), np.uint64).reshape(len(key), -1)
    starts = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
        side = minor[start:end]
        every = start + np.flatnonzero(~side)
        for at in (start + np.flatnonzero(side)).tolist():
            others = every[(root[every] != root[at]) & (whole[every] | whole[at]) & (own[every] | own[at])]
            others = others[5 * np.minimum(n[others], n[at]) >= 4 * np.maximum(n[others], n[at])]
            apart = np.bitwise_count(bits[others] ^ bits[at]).sum(axis=1, dtype=np.int64)
            found = np.unique(a[others[9 * apart <= n[others] + n[at]]])
            if len(found):
                yield np.minimum(found, a[at]), np.maximum(found, a[at])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each group of (key, i, j). Rows come in this order; those of the last group are held until its end is seen."""
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        t = held
        if batch is not None:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if t is None or not t.num_rows:
            continue
        cut = t.num_rows
        if batch is not None:
            last = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            goes_on = (last == last[:, -1:]).all(axis=0)
            cut = len(goes_on) - int(np.argmin(goes_on[::-1])) if not goes_on.all() else 0
        held = t.slice(cut).combine_chunks()
        x: list[np.ndarray] = []
        y: list[np.ndarray] = []
        for least, most in _apart(t.slice(0, cut)) if cut else ():
            x.append(least), y.append(most)
            if len(x) > BLOCK:
                yield _pairs(np.concatenate(x), np.concatenate(y), None).select(["x", "y"])
                x, y = [], []
        if x:
            yield _pairs(np.concatenate(x), np.concatenate(y), None).select(["x", "y"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches in 64 bytes."""
    for batch in batches:
        short = pa.array([_folded(s.as_py(), 64).tobytes() for s in batch.column("sketch")], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], short], batch.schema.names)


class Heavy:
    """Heavy sets (a, band): the text of a document of each, held on Spark's disks while it is read several times, and what they are joined with."""

    def __init__(self, heavy: DataFrame, docs: DataFrame, reps: DataFrame):
        named = reps.join(heavy.groupBy("a").agg(F.collect_set("band").alias("bands")), "a").select(F.col("rep").alias("id"), "a", "n", "sketch", "bands")
        self.named = checkpointed(named, small=True)
        self.few = self.named.count() <= BROADCAST_SKETCHES
        self.held = docs.join(self._side(self.named.select("id", "a", "bands")), "id").select("text", "a", "bands").persist(StorageLevel.DISK_ONLY)

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def texts(self, roots: DataFrame) -> DataFrame:
        """(text, a, root, bands), with the sets' components."""
        of = self.named.select("a").join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("a", F.coalesce("root", "a").alias("root"))
        return self.held.join(self._side(of), "a").select("text", "a", "root", "bands")

    def sketched(self, rows: DataFrame) -> DataFrame:
        """rows with n and a short sketch of their sets."""
        return rows.join(self._side(self.named.select("a", "n", "sketch").mapInArrow(_short, "a bigint, n bigint, sketch binary")), "a")


def _shared_keys(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, root, n, any, own, pick), (key, most, most_pick, blocks, minor_blocks) of keys of several components), counted with sums before the shuffle."""
    counted = texts.mapInArrow(_counted_keys, "key bigint, root bigint, n bigint, any boolean, own boolean, h bigint, pick bigint")
    by_root = counted.groupBy("key", "root").agg(F.sum("n").alias("n"), F.max("any").alias("any"), F.max("own").alias("own"), F.min_by("pick", "h").alias("pick"))
    of_key = by_root.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root", "pick")).alias("most"), F.max("any").alias("any"), F.max("own").alias("own")).where("any and own and most.n < size")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    columns = (F.col("most.root").alias("most"), F.col("most.pick").alias("most_pick"), blocks(F.col("size")).alias("blocks"), blocks(F.col("size") - F.col("most.n")).alias("minor_blocks"))
    return by_root, checkpointed(of_key.select("key", *columns), small=True)


def _at_keys(rows: DataFrame, keys: DataFrame, part: str) -> DataFrame:
    """rows joined with their keys: few keys go to every task, more are joined by parts of a key."""
    if keys.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), "key")
    each = keys.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64(part), F.lit(PARTS)).cast("int")).join(each, ["key", "part"]).drop("part")


def _star_pairs(heavy: Heavy, roots: DataFrame) -> DataFrame:
    """Candidate pairs (x, y) that may connect components cheaply: at each key that several share, a set of each with one of the largest."""
    by_root, keys = _shared_keys(heavy.texts(roots))
    return _at_keys(by_root, keys, "root").where("root != most").select(F.least("pick", "most_pick").alias("x"), F.greatest("pick", "most_pick").alias("y"))


def _heavy_pairs(heavy: Heavy, roots: DataFrame) -> DataFrame:
    """Candidate pairs of heavy sets that aren't connected, by one-deletion neighbourhoods.

    Only keys of several components are listed by set. What isn't of a key's largest component (the
    minor side) is compared with all. A key of many sets is dealt out by blocks of both sides, so no
    task gets more than a block of each, and where few are on the minor side rows grow with the
    sets, not their square.
    """
    texts = heavy.texts(roots)
    _, keys = _shared_keys(texts)
    shared = _at_keys(texts.mapInArrow(_listed_keys, "key bigint, whole boolean, own boolean, a bigint, root bigint"), keys, "a")
    known = heavy.sketched(shared)
    i, j = (F.pmod(F.xxhash64(F.lit(end), "a", "whole"), n).cast("int") for end, n in (("i", "minor_blocks"), ("j", "blocks")))
    place = lambda i, j, minor: F.struct(i.alias("i"), j.alias("j"), F.lit(minor).alias("minor"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    there = F.transform(upto("minor_blocks"), lambda x: place(x, j, False))
    asking = F.when(F.col("root") != F.col("most"), F.transform(upto("blocks"), lambda x: place(i, x, True)))
    places = F.concat(there, F.coalesce(asking, F.array().cast("array<struct<i: int, j: int, minor: boolean>>")))
    dealt = known.select("key", "whole", "own", "a", "root", "n", "sketch", F.explode(places).alias("p")).select("key", "p.*", "whole", "own", "a", "root", "n", "sketch")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compared, "x bigint, y bigint")


def _merged(links: DataFrame, more: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots with more links, given the roots without them: links between components, with a component's root for each end, are added, which makes components of components."""
    of = lambda end: F.coalesce(F.col(f"{end}_root"), F.col(end))
    ends = [roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in ("x", "y")]
    between = more.join(ends[0], "x", "left").join(ends[1], "y", "left").select(of("x").alias("x"), of("y").alias("y"))
    return checkpointed(components(links.union(more).union(between)), small=True)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of docs; ids are integers.

    A row's set is that of its distinct 5-word shingles; with fewer words, all of them are one
    shingle; a null text, or one without words, has none and is linked with nothing. Sets are
    linked from a Jaccard similarity of 0.8 on, exactly, but for collisions of 64-bit hashes.
    component_id is the smallest id reachable. Rows with equal sets are one set and connected;
    rows with equal ids and other texts are documents of their own. A row without an id is
    not linked and has no component. Other columns don't matter; an empty table gives no rows.

    Copies are one set before anything is paired. Segments held by many sets are split before the
    shuffle and give no pairs but a star; all other groups have COMMON sets at most. Neighbourhoods
    of heavy sets are compared in blocks, and only pairs that aren't connected yet and that may be
    linked by sizes and sketches leave a task.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer: components are named by the smallest id")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = checkpointed(rows.mapInArrow(_profiled, "id bigint, n bigint, a bigint, sketch binary"))
    known = rows.where("id is not null")
    reps = checkpointed(profile.where("id is not null and n > 0").groupBy("a").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), small=True)
    index = known.select("text").mapInArrow(_indexed, "key bigint, a bigint, code bigint")
    met = checkpointed(index.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "x bigint, y bigint, code bigint"))
    links = _verified(met.where("code is null").select("x", "y"), known, reps)
    roots = checkpointed(components(links), small=True)
    heavy = checkpointed(met.where("code is not null").groupBy(F.col("x").alias("a"), "code").count().where(F.col("count") >= F.floor(F.col("code") / CODES)).select("a", (F.col("code") % CODES).alias("band")).distinct(), small=True)
    if not heavy.isEmpty():
        sets = Heavy(heavy, known, reps)
        for candidates in (_star_pairs, _heavy_pairs):  # cheap ones first, as what is connected needs no comparing
            more = _verified(candidates(sets, roots), known, reps)
            if not more.isEmpty():
                roots = _merged(links, more, roots)
                links = checkpointed(links.union(more), small=True)
        sets.held.unpersist()
    class_of = reps.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("a", "rep", F.coalesce("root", "a").alias("root"))
    smallest = class_of.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = class_of.join(smallest, "root").select("a", "component_id")
    out = profile.select("id", "n", F.when(F.col("id").isNotNull(), F.col("a")).alias("a")).join(labels, "a", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLE_SQL: dict[str, str] = {}
