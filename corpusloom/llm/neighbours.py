"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves, each half has its own codebook, and a cell is a pair of centres. A
vector visits cells in order of distance until another one at the threshold would have been met with
the target recall; what it meets there is verified by the cosine itself. Members and visitors of a
cell meet in blocks of bounded size, from which only counts of links and one edge a vector leave.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, lookup, made, small_batches, table
from corpusloom.llm.graph import components

THRESHOLD, TARGET = 0.98, 0.995
#: Rows of the sample that codebooks are fitted on, and its bytes at most; vectors of it from which the reach is measured, and how often each is turned.
SAMPLE, SAMPLE_BYTES, TURNED, TURNS = 65_536, 32 << 20, 2_048, 16
#: Vectors that a cell should hold, centres of a codebook at most, steps of the fit.
PER_CELL, MOST_CENTRES, STEPS = 256, 4_096, 12
#: Rows of a block; large cells that are broadcast at most; parts into which the rows of one are dealt if there are more.
BLOCK, BROADCAST, SALTS = 2_048, 100_000, 128
#: A cosine this near to the threshold is taken again, by itself.
CLOSE = 1e-9
Batches = Iterator[pa.RecordBatch]


def unit_rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors (no nulls, no zero vectors) as rows of length one, with zeros up to the width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = column.flatten().to_numpy(zero_copy_only=False)
    if out.size:
        out /= np.abs(out).max(1, keepdims=True)
        out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1), 0.0)


def codebook(rows: np.ndarray, k: int, steps: int = STEPS, seed: int = 0) -> np.ndarray:
    """k centres of the rows by Lloyd's steps; a centre without rows stays."""
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(steps):
        nearest = distances(rows, centres).argmin(1)
        counts = np.bincount(nearest, minlength=k)
        order = np.argsort(nearest, kind="stable")
        some = np.flatnonzero(counts)
        if rows.shape[1]:
            sums = np.add.reduceat(rows[order], (np.cumsum(counts) - counts)[some], axis=0)
            centres[some] = sums / counts[some, None]
    return centres


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves, the width of vectors, and the reach: how much further than its nearest cell a vector looks."""

    first: np.ndarray
    second: np.ndarray
    width: int
    reach: float

    @property
    def half(self) -> int:
        return (self.width + 1) // 2

    def excess(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By half, the squared distance to each centre less that to the nearest."""
        found = distances(rows[:, : self.half], self.first), distances(rows[:, self.half :], self.second)
        return tuple(d - d.min(1, keepdims=True) for d in found)

    def visited(self, rows: np.ndarray) -> Iterator[list[int]]:
        """For each row the cells it visits, the nearest first (first centre times the second codebook's size, plus second centre)."""
        for one, two in zip(*self.excess(rows), strict=True):
            yield traverse(one, two, self.reach)


def traverse(one: np.ndarray, two: np.ndarray, reach: float) -> list[int]:
    """Cells of the product grid by the sum of both halves' excess, in that order, up to the reach: a heap holds the border of what was visited."""
    a, b = (np.flatnonzero(x <= reach) for x in (one, two))
    a, b = a[np.argsort(one[a], kind="stable")], b[np.argsort(two[b], kind="stable")]
    heap, seen, out = [(float(one[a[0]] + two[b[0]]), 0, 0)], {(0, 0)}, []
    while heap and heap[0][0] <= reach:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * len(two) + int(b[j]))
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (float(one[a[i2]] + two[b[j2]]), i2, j2))
    return out


def fit(rows: np.ndarray, centres: int, threshold: float = THRESHOLD, target: float = TARGET, seed: int = 0) -> MultiIndex:
    """An index of unit rows. Its reach: vectors turned in random directions until their cosine is the threshold must fall into a visited cell with the target rate; nearer ones do so more often."""
    width = rows.shape[1]
    half, k = (width + 1) // 2, min(centres, len(rows))
    index = MultiIndex(codebook(rows[:, :half], k, seed=seed), codebook(rows[:, half:], k, seed=seed + 1), width, 0.0)
    rng = np.random.default_rng(seed + 2)
    start = rows[rng.choice(len(rows), min(TURNED, len(rows)), replace=False)]
    one, two = index.excess(start)
    found = []
    for _ in range(TURNS):
        away = rng.normal(size=start.shape)
        away -= np.einsum("ij,ij->i", away, start)[:, None] * start
        away /= np.maximum(np.sqrt(np.einsum("ij,ij->i", away, away)), 1e-300)[:, None]
        turned = threshold * start + np.sqrt(1 - threshold**2) * away
        at = [distances(turned[:, cut], book).argmin(1) for cut, book in ((slice(0, half), index.first), (slice(half, None), index.second))]
        line = np.arange(len(start))
        found.append(one[line, at[0]] + two[line, at[1]])
    return MultiIndex(index.first, index.second, width, float(np.quantile(np.concatenate(found), target, method="higher")))


def _entries(index: MultiIndex) -> Callable[[Batches], Batches]:
    """A row for each vector in its own cell (member), and one in each cell with a larger number that it visits: a pair of vectors meets once at most."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            at, cells, member = [], [], []
            for i, visited in enumerate(index.visited(unit_rows(batch.column("v"), index.width))):
                own = visited[0]
                keep = [own, *(c for c in visited[1:] if c > own)]
                at += [i] * len(keep)
                cells += keep
                member += [True] + [False] * (len(keep) - 1)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int64()), pa.array(member, pa.bool_())], [*taken.schema.names, "cell", "member"])

    return run


def _met(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """(node, links, root) of a unit's vectors that are linked there: their links, weighted by copies, and the smallest node that they reach within it."""

    def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cosine = x @ y.T
        mask = cosine >= threshold
        for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < CLOSE), strict=True):
            mask[i, j] = x[i] @ y[j] / np.sqrt((x[i] @ x[i]) * (y[j] @ y[j])) >= threshold
        return mask

    def run(unit: pa.Table) -> pa.Table:
        node, copies, member, block = (unit.column(c).to_numpy() for c in ("node", "copies", "member", "block"))
        u, v = unit.column("u")[0].as_py(), unit.column("w")[0].as_py()
        rows = unit_rows(unit.column("v"), unit.column("size")[0].as_py())
        left = np.flatnonzero(member & (block == u))
        right = np.flatnonzero(~(member & (block == u)))
        pairs = []
        if u == v:
            mask = linked(rows[left], rows[left])
            np.fill_diagonal(mask, False)
            pairs.append((left, left, mask))
        if len(right):
            pairs.append((left, right, linked(rows[left], rows[right])))
        links, root = np.zeros(len(node), np.int64), node.copy()
        for x, y, mask in pairs:
            links[x] += mask @ copies[y]
            if x is not y:
                links[y] += mask.T @ copies[x]
        pairs = [(x, y, mask) for x, y, mask in pairs if mask.any()]
        most, before = np.iinfo(np.int64).max, None
        while pairs and (before is None or (before != root).any()):
            before = root.copy()
            for x, y, mask in pairs:
                root[x] = np.minimum(root[x], np.where(mask, root[y], most).min(1))
                root[y] = np.minimum(root[y], np.where(mask.T, root[x], most).min(1))
        some = links > 0
        return pa.table(made(node=(node[some], pa.int64()), links=(links[some], pa.int64()), root=(root[some], pa.int64())).to_pydict(), schema=pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    return run


def _units(entries: DataFrame) -> DataFrame:
    """The entries of each cell in units (u, w) of two blocks at most: members are blocks 0 on, visitors the blocks behind them. Cells of up to BLOCK rows are one unit."""
    cell = ["label", "size", "cell"]
    counts = entries.groupBy(*cell).agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("p")).where(F.col("m") + F.col("p") > BLOCK)
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    large = checkpointed(counts.select(*cell, blocks("m").alias("mb"), blocks("p").alias("pb")), small=True)
    n = large.count()
    if n <= BROADCAST:
        known = entries.join(F.broadcast(large), cell, "left") if n else entries.withColumns({"mb": F.lit(None).cast("int"), "pb": F.lit(None).cast("int")})
    else:
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, [*cell, "salt"], "left").drop("salt")
    dealt = F.xxhash64("node", F.lit("block"))
    block = F.when(F.col("mb").isNull(), 0).when(F.col("member"), F.pmod(dealt, F.col("mb"))).otherwise(F.col("mb") + F.pmod(dealt, F.col("pb"))).cast("int")
    pair = lambda u, w: F.struct(u.cast("int").alias("u"), w.cast("int").alias("w"))
    here = F.col("block")
    upto = lambda last: F.transform(F.sequence(F.lit(0), last), lambda u: pair(u, here))
    last = F.col("mb") + F.col("pb") - 1
    beyond = F.when(here < last, F.transform(F.sequence(here + 1, last), lambda w: pair(here, w))).otherwise(F.array().cast("array<struct<u:int,w:int>>"))
    units = F.when(F.col("mb").isNull(), F.array(pair(F.lit(0), F.lit(0)))).when(F.col("member"), F.concat(upto(here), beyond)).otherwise(upto(F.col("mb") - 1))
    return known.withColumn("block", block).withColumn("unit", F.explode(units)).select("node", "copies", "v", *cell, "member", "block", "unit.u", "unit.w")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, target: float = TARGET, per_cell: int = PER_CELL) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Rows of equal labels, neither null, whose vectors have equal lengths are linked if their cosine
    is at least the threshold; near ones are met with a rate of `target` at the threshold itself. A
    vector that is null, empty, zero, or holds null or non-finite components, and one without a
    label, has no links. Equal rows of one label are one vector to the index (by a 128-bit key), and
    linked with each other always; rows that share an id are different rows. component_id is the
    smallest id that is reached, the row's own included; null ids count for nothing there, so it is
    null, and kept false, if there is no other. An empty table gives an empty result; other columns
    are left alone.
    """
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("label").isNotNull() & F.coalesce(F.forall("v", sound) & F.exists("v", lambda x: x != 0), F.lit(False))
    keys = [F.xxhash64(F.lit(i), "label", "v").alias(f"k{i}") for i in (1, 2)]
    usable = rows.where(valid).select("id", *keys, "label", "v")
    grouped = usable.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = checkpointed(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("v")))
    figures = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("width")).first()
    alone = rows.where(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not figures["n"]:
        return _named(alone, id_col)
    width = max(2, figures["width"])
    sample = nodes.orderBy("k1", "k2").limit(min(SAMPLE, max(1, SAMPLE_BYTES // (8 * width)))).select("v").toArrow()
    centres = max(1, min(MOST_CENTRES, round((figures["n"] / per_cell) ** 0.5)))
    index = fit(unit_rows(sample.column("v"), width), centres, threshold, target)
    kind = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    entries = nodes.select("node", "copies", "label", "size", "v").mapInArrow(_entries(index), f"node long, copies long, label {kind['label']}, size int, v {kind['v']}, cell long, member boolean")
    met = _units(entries).groupBy("label", "size", "cell", "u", "w").applyInArrow(_met(threshold), "node long, links long, root long")
    met = checkpointed(met, small=True)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    reached = checkpointed(components(met.select(F.col("node").alias("x"), F.col("root").alias("y"))))
    found = nodes.select("node", "k1", "k2", "least", "copies").join(links, "node", "left").join(reached, "node", "left")
    found = checkpointed(found.select("k1", "k2", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), small=True)
    least = found.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    known = lookup(found, checkpointed(least, small=True), ["root"], "size").select("k1", "k2", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = lookup(usable.select("id", "k1", "k2"), checkpointed(known, small=True), ["k1", "k2"], "copies").select("id", "n_links", "component_id")
    return _named(joined.unionByName(alone), id_col)


def _named(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive sound as (
  select row_number() over () as r, vec_id, label, cast(embedding as double[]) as v,
         label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as valid
  from embeddings
), pairs as materialized (
  select a.r as x, b.r as y from sound a join sound b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where a.valid and b.valid and list_cosine_similarity(a.v, b.v) >= 0.98
), reached(r, other) as (
  select r, r from sound union select c.r, p.y from reached c join pairs p on p.x = c.other
), smallest as (
  select c.r, min(s.vec_id) as component_id from reached c join sound s on s.r = c.other group by c.r
), counted as (
  select x as r, count(*) as n_links from pairs group by x
)
select s.vec_id, coalesce(n_links, 0) as n_links, component_id, coalesce(s.vec_id = component_id, false) as kept
from sound s join smallest using (r) left join counted using (r)
"""

QUERIES = {"op11_embedding_near_dedup": op11_embedding_near_dedup}
ORACLE_SQL = {"op11_embedding_near_dedup": ORACLE}
