"""Hybrid retrieval: lexical and vector scores fused, top-k by query and source, then a pool, a rerank and its sources.

Searches read an index (operators.index), never a text. Queries, the stated set, go to every task in
blocks bounded in bytes. Lexical top-k comes from postings: by block maxima only blocks that can reach
the best scores are decoded. An exact fused search costs documents times queries, and shuffles no
document: tasks, whose number is that of the cores, scan the index for the extremes of all scores,
then for the best. Scores are matrix products for frequent words and vectors and sparse ones for the
rest; rows that can't reach the best a task holds aren't scored, and only its best leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import scores as S
from corpusloom.operators.index import TextIndex, word_hash, words_of
from corpusloom.sources.storage import checkpointed, small_batches

TOP_K, POOL, RERANKED = 20, 50, 20
#: Bytes of a block of queries and queries of it at most, numbers of a matrix of scores, and scores by query and source that go to every task.
BLOCK_BYTES, BLOCK, CELLS, BOUNDS = 16 << 20, 16_384, 1_000_000, 1_000_000
#: Candidates that a task takes up at least before it drops all but the best.
HELD = 20_000
#: Tasks of a scan for each core: what leaves a scan grows with queries and tasks, so tasks don't grow with the index.
SCANS = 2
#: Words of a matrix product at most, numbers of its weights, and the share of pairs of a row and a query that have a word from which it is worth it.
FREQUENT, WEIGHTS, WORTH = 256, 4_000_000, 0.0005
#: A lexical score this much below a bound may still reach it, as sums are rounded.
SLACK = 1e-6
Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Block:
    """Queries as tasks need them: unit vectors (zero if there is none), and of each asked word, in order of hashes, the queries that have it and its weight there."""

    ids: list
    vectors: np.ndarray
    given: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    queries: np.ndarray
    weights: np.ndarray
    avgdl: float
    k1: float
    b: float

    def only(self, wanted: np.ndarray) -> Block:
        """With the words of some queries; numbers of queries stay."""
        inside = wanted[self.queries]
        return replace(self, starts=np.r_[0, np.cumsum(inside)][self.starts], queries=self.queries[inside], weights=self.weights[inside])

    def picked(self, q: np.ndarray) -> Block:
        """Of some queries alone, numbered anew in this order."""
        number = np.full(len(self.ids), -1)
        number[q] = np.arange(len(q))
        inside = number[self.queries] >= 0
        return replace(self, ids=[self.ids[i] for i in q], starts=np.r_[0, np.cumsum(inside)][self.starts], queries=number[self.queries[inside]], weights=self.weights[inside])

    def found(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those that nobody asks for."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def scores(self, rows: np.ndarray, words: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """(n, queries): the sum of value times weight, over entries (row, word, value), in bounded memory."""
        width = len(self.ids)
        out = np.zeros(n * width)
        count = np.diff(self.starts)[words]
        ends = np.cumsum(count)
        start = 0
        while start < len(words):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + CELLS, "right")))
            part = slice(start, end)
            at = np.repeat(self.starts[words[part]] - (ends[part] - count[part] - before), count[part]) + np.arange(ends[end - 1] - before)
            cell = np.repeat(rows[part].astype(np.int64) * width, count[part]) + self.queries[at]
            out += np.bincount(cell, np.repeat(values[part], count[part]) * self.weights[at], n * width)
            start = end
        return out.reshape(n, width)


class Scorer:
    """Lexical scores of rows of documents; words that many rows and queries share go by a matrix product, known from the first rows."""

    def __init__(self, block: Block) -> None:
        self.block, self.place = block, None

    def entries(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, weight) of the asked words in rows."""
        block, terms = self.block, rows.column("terms")
        held = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        word = block.found(terms.flatten().to_numpy())
        asked = word >= 0
        line = np.repeat(np.arange(len(held)), held)[asked]
        tf = rows.column("counts").flatten().to_numpy()[asked].astype(float)
        dl = rows.column("dl").to_numpy()[line]
        return line, word[asked], tf * (block.k1 + 1) / (tf + block.k1 * (1 - block.b + block.b * dl / block.avgdl))

    def _choose(self, word: np.ndarray, n: int) -> None:
        block, width = self.block, len(self.block.ids)
        asking = np.diff(block.starts)
        share = np.bincount(word, minlength=len(asking)) * asking / (n * width)
        most = min(FREQUENT, WEIGHTS // width)
        chosen = np.sort(np.argsort(-share, kind="stable")[:most])
        chosen = chosen[share[chosen] > WORTH]
        self.place = np.full(len(asking), -1)
        self.place[chosen] = np.arange(len(chosen))
        self.weights = np.zeros((len(chosen), width))
        for i, w in enumerate(chosen):
            part = slice(block.starts[w], block.starts[w + 1])
            self.weights[i, block.queries[part]] = block.weights[part]

    def scores(self, entries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """(rows, queries), of the wanted rows if any are named."""
        line, word, value = entries
        if self.place is None and n:
            self._choose(word, n)
        if wanted is not None:
            number = np.full(n, -1)
            number[wanted] = np.arange(len(wanted))
            inside = number[line] >= 0
            line, word, value, n = number[line[inside]], word[inside], value[inside], len(wanted)
        at = self.place[word] if n else np.zeros(0, int)
        often = at >= 0
        left = np.zeros((n, len(self.weights) if n else 0))
        left[line[often], at[often]] = value[often]
        out = left @ self.weights if n else np.zeros((0, len(self.block.ids)))
        rare = ~often
        return out + self.block.scores(line[rare], word[rare], value[rare], n) if rare.any() else out


def _unit(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one, which are given): null elements are 0, and so are those that a shorter vector lacks."""
    out, given = np.zeros((len(vectors), size)), np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None:
            full = np.array([0.0 if x is None else x for x in v], float)
            length = np.sqrt(full @ full)
            given[i] = True
            if length > 0:
                out[i, : len(full)] = full[:size] / length
    return out, given


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """_unit of a column, at once if all its vectors have the size and no null elements."""
    given = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if flat.null_count or len(flat) != size * given.sum() or any(x != size for x in column.value_lengths().drop_null().unique().to_pylist()):
        return _unit(column.to_pylist(), size)
    out = np.zeros((len(column), size))
    rows = flat.to_numpy().astype(float).reshape(int(given.sum()), size)
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    out[given] = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    return out, given


def blocks_of(queries: DataFrame, index: TextIndex, size: int | None = None) -> Iterator[Block]:
    """The queries (query_id, query, vector) in blocks, in the order in which they come. A word counts as often as a query has it."""
    size = min(size or BLOCK, BLOCK)
    rows: list = []
    held = 0

    def made() -> Block:
        asked: dict[int, dict[int, int]] = {}
        for i, words in enumerate(words for _, words, _ in rows):
            for t in words:
                times = asked.setdefault(t, {})
                times[i] = times.get(i, 0) + 1
        idf = index.idf(sorted(asked))
        hashes = sorted(idf)
        entries = [(i, times * idf[h]) for h in hashes for i, times in asked[h].items()]
        starts = np.cumsum([0, *(len(asked[h]) for h in hashes)])
        width = max((len(v) for *_, v in rows if v is not None), default=0)
        vectors, given = _unit([v for *_, v in rows], width)
        f = index.figures
        return Block([q for q, *_ in rows], vectors, given, np.array(hashes, np.int64), starts, np.array([i for i, _ in entries], np.int64), np.array([w for _, w in entries], float), f.avgdl or 1.0, f.k1, f.b)

    for r in queries.select("query_id", "query", "vector").toLocalIterator(prefetchPartitions=True):
        words = list(map(word_hash, words_of(r["query"])))
        rows.append((r["query_id"], words, r["vector"]))
        held += 24 * len(words) + 8 * len(r["vector"] or [])
        if len(rows) == size or held > BLOCK_BYTES:
            yield made()
            rows, held = [], 0
    if rows:
        yield made()


def _bounds(block: Block) -> Callable[[pa.Table], pa.Table]:
    """(q, block, bound, cover): for each query with a word in a block, what its lexical score there can't exceed, and the share of documents that its words can reach."""

    def run(rows: pa.Table) -> pa.Table:
        word = block.found(rows.column("h").to_numpy())
        bound = _bound(block, word, rows.column("most").to_numpy())
        plain = replace(block, weights=np.ones(len(block.weights)))
        cover = plain.scores(np.zeros(len(word)), word, rows.column("n").to_numpy().astype(float), 1)[0] / rows.column("size")[0].as_py()
        q = np.flatnonzero(cover > 0)
        return pa.table({"q": pa.array(q.astype(np.int32)), "block": pa.array([rows.column("block")[0].as_py()] * len(q), pa.int64()), "bound": pa.array(bound[q]), "cover": pa.array(cover[q])})

    return run


def _bound(block: Block, word: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A document has a word with the largest weight, or not at all."""
    return replace(block, weights=np.maximum(block.weights, 0.0)).scores(np.zeros(len(word)), word, most, 1)[0]


_BEST = "q int, block long, slot int, bm25 double, least double"


def _decoded(block: Block, rows: pa.Table, wanted: np.ndarray, k: int) -> pa.Table:
    """(q, block, slot, bm25, least): the k best matching documents of a block for some queries, with the least score of any document in it. A query whose documents there all score 0 has one row without a slot."""
    word, size = block.found(rows.column("h").to_numpy()), rows.column("size")[0].as_py()
    slots = rows.column("slots").combine_chunks()
    held = slots.value_lengths().to_numpy().astype(np.int64)
    at, words, weights = slots.flatten().to_numpy(), np.repeat(word, held), rows.column("weights").combine_chunks().flatten().to_numpy()
    asking, step, parts = np.flatnonzero(wanted), max(1, CELLS // size), []
    for start in range(0, max(1, len(asking)), step):  # so many that no matrix is larger than CELLS
        q = asking[start : start + step]
        scores = block.picked(q).scores(at, words, weights, size)
        order = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[:k]
        taken = np.take_along_axis(scores, order, 0)
        place, column = np.nonzero(np.round(taken, 9))
        none = np.setdiff1d(np.arange(len(q)), column)
        all_of = np.r_[column, none]
        columns = {
            "q": pa.array(q[all_of].astype(np.int32)),
            "block": pa.array([rows.column("block")[0].as_py()] * len(all_of), pa.int64()),
            "slot": pa.array([*order[place, column].tolist(), *[None] * len(none)], pa.int32()),
            "bm25": pa.array(np.r_[taken[place, column], np.zeros(len(none))]),
            "least": pa.array(scores.min(0)[all_of]),
        }
        parts.append(pa.table(columns))
    return pa.concat_tables(parts)


@dataclass(frozen=True)
class Lexical:
    """best (q, block, slot, bm25, least): the best matching documents of every block that can hold one of the k best, written; the extremes of each query's scores over all documents; posting rows of the asked words, and those of them that were decoded for it."""

    best: DataFrame
    least: np.ndarray
    most: np.ndarray
    listed: DataFrame
    decoded: DataFrame


def lexical(index: TextIndex, block: Block, k: int = 1) -> Lexical:
    """Of each query one block is decoded first, that with the largest bound: blocks whose bound is below its k-th score can't hold one of the k best.

    Another one, which the query's words reach least, shows a document without any of them, which
    scores 0. If there is none, or words have negative weights, all blocks of the query's words are
    decoded, as the least score could be anywhere.
    """
    spark, n = index.docs.sparkSession, len(block.ids)
    light = index.asked(block.hashes.tolist())
    bounds = light.select("h", "block", "size", "n", "most").groupBy("block").applyInArrow(_bounds(block), "q int, block long, bound double, cover double")
    chosen = bounds.groupBy("q").agg(F.max_by("block", "bound").alias("top"), F.min_by("block", "cover").alias("bare"), F.count(F.lit(1)).alias("blocks")).collect()
    least, most, limit = np.zeros(n), np.zeros(n), np.full(n, -np.inf)
    first: dict[int, list[int]] = {}
    for r in chosen:
        for at in {r["top"], r["bare"]}:
            first.setdefault(at, []).append(r["q"])
    if first:

        def seeds(rows: pa.Table) -> pa.Table:
            wanted = np.zeros(n, bool)
            wanted[first[rows.column("block")[0].as_py()]] = True
            found = _decoded(block, rows, wanted, k)
            q, score, low = (found.column(c).to_numpy() for c in ("q", "bm25", "least"))
            some = found.column("slot").is_valid().to_numpy()
            each = np.unique(q)
            own = [q == x for x in each]
            kth = [np.sort(score[m & some])[0] if (m & some).sum() == k else -np.inf for m in own]
            return pa.table({"q": pa.array(each.astype(np.int32)), "kth": pa.array(kth, pa.float64()), "least": pa.array([low[m][0] for m in own], pa.float64())})

        heads = spark.createDataFrame([(x,) for x in first], "block long")
        found = light.join(F.broadcast(heads), "block", "left_semi").groupBy("block").applyInArrow(seeds, "q int, kth double, least double")
        for r in found.groupBy("q").agg(F.max("kth").alias("kth"), F.min("least").alias("least")).collect():
            limit[r["q"]], least[r["q"]] = r["kth"], r["least"]
    negative = np.zeros(n, bool)
    negative[block.queries[block.weights < 0]] = True
    everywhere = {r["q"] for r in chosen if r["blocks"] == index.figures.n_blocks}
    sure = np.array([not negative[q] and (least[q] <= 0 or q not in everywhere) for q in range(n)], bool) if n else np.zeros(0, bool)
    limit[~sure] = -np.inf

    def kept(rows: pa.Table) -> pa.Table:
        word = block.found(rows.column("h").to_numpy())
        reached = replace(block, weights=np.ones(len(block.weights))).scores(np.zeros(len(word)), word, np.ones(len(word)), 1)[0] > 0
        q = np.flatnonzero(reached & (_bound(block, word, rows.column("most").to_numpy()) >= limit - SLACK))
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()] * min(1, len(q)), pa.int64()), "qs": pa.array([q.tolist()] * min(1, len(q)), pa.list_(pa.int32()))})

    survivors = checkpointed(light.select("h", "block", "most").groupBy("block").applyInArrow(kept, "block long, qs array<int>"))
    heavy = light.join(survivors.select("block"), "block", "left_semi")

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.zeros(n, bool)
        wanted[right.column("qs")[0].as_py()] = True
        return _decoded(block, left, wanted, k)

    best = checkpointed(heavy.groupBy("block").cogroup(survivors.groupBy("block")).applyInArrow(exact, _BEST))
    over = {r["q"]: r for r in best.groupBy("q").agg(F.max("bm25").alias("most"), F.min("bm25").alias("low"), F.min("least").alias("least")).collect()}
    for r in chosen:
        q = r["q"]
        bare = r["blocks"] < index.figures.n_blocks  # a block without any of the words
        low = 0.0 if sure[q] else over[q]["least"]
        least[q] = min(low, 0.0) if bare else low
        most[q] = max(over[q]["most"], 0.0) if bare or least[q] <= 0 <= over[q]["least"] else over[q]["most"]
    return Lexical(best, least, most, light, heavy)


def lexical_topk(index: TextIndex, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, doc_id, bm25, rank): the k best of the documents with a word of the query and a score, ties by ordinal."""
    spark = index.docs.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    whole = None
    for block in blocks_of(queries, index):
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"q int, query_id {kind}")
        found = lexical(index, block, k).best.where("slot is not null").join(index.docs.select("block", "slot", "doc_id", "ordinal"), ["block", "slot"])
        found = found.join(F.broadcast(ids), "q").select("query_id", "doc_id", "ordinal", "bm25")
        whole = found if whole is None else whole.union(found)
    if whole is None:
        whole = index.docs.limit(0).select(F.lit(None).cast(kind).alias("query_id"), "doc_id", "ordinal", F.lit(0.0).alias("bm25"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "ordinal"))
    return whole.withColumn("rank", rank).where(F.col("rank") <= k).drop("ordinal")


def keyword_bounds(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(query_id, least, most) of the lexical scores of all chunks: those without a word of the query score 0."""
    spark, kind = index.docs.sparkSession, queries.schema["query_id"].dataType.simpleString()
    whole = spark.createDataFrame([], f"query_id {kind}, least double, most double")
    for block in blocks_of(queries, index) if index.figures.n_docs else ():
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"q int, query_id {kind}")
        found = _scan(index, ["terms", "counts", "dl"]).mapInArrow(_extremes(block, tops=False), _EXTREMES)
        found = found.groupBy("q").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        whole = whole.union(found.join(F.broadcast(ids), "q").select("query_id", "least", "most"))
    return whole


def _scan(index: TextIndex, columns: list[str]) -> DataFrame:
    small_batches(index.docs.sparkSession)
    return index.docs.select(*columns).coalesce(SCANS * index.docs.sparkSession.sparkContext.defaultParallelism)


def _parts(batch: pa.RecordBatch, block: Block) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so small that no matrix of scores is larger than CELLS."""
    step = max(1, CELLS // max(1, len(block.ids)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _inside(rows: pa.RecordBatch, sources: list[str] | None) -> np.ndarray:
    """Which rows are of the sources; no sources or empty ones are no filter."""
    if not sources or not any(sources):
        return np.ones(rows.num_rows, bool)
    return pc.is_in(rows.column("data_source_type"), value_set=pa.array(sources, pa.string())).to_numpy(zero_copy_only=False)


def _of_sources(rows: pa.RecordBatch, each_source: bool) -> list[tuple[str | None, np.ndarray]]:
    """(source, places) of the rows; all in one if sources don't matter."""
    if not each_source:
        return [(None, np.arange(rows.num_rows))]
    coded = rows.column("data_source_type").dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy()
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    names = coded.dictionary.to_pylist()
    return [(None if codes[at[0]] < 0 else names[codes[at[0]]], at) for at in np.split(order, cuts) if len(at)]


_EXTREMES = "q int, source string, least double, most double, top double"


def _extremes(block: Block, sources: list[str] | None = None, each_source: bool = False, tops: bool = True) -> Callable[[Batches], Batches]:
    """(q, source, least, most, top): of a part of the chunks the extremes of lexical scores, in rows without a top, and by source the largest cosine over those of the filter."""

    def run(batches: Batches) -> Batches:
        n = len(block.ids)
        found: dict[str | None, np.ndarray] = {}
        least, most, scorer, some = np.full(n, np.inf), np.full(n, -np.inf), Scorer(block), False
        q, none = pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, pa.float64())
        for batch in batches:
            for rows in _parts(batch, block):
                some = True
                scores = scorer.scores(scorer.entries(rows), rows.num_rows)
                np.minimum(least, scores.min(0), out=least)
                np.maximum(most, scores.max(0), out=most)
                if not tops:
                    continue
                unit, given = _matrix(rows.column("vector"), block.vectors.shape[1])
                usable = given & _inside(rows, sources)
                for source, places in _of_sources(rows, each_source):
                    top = found.setdefault(source, np.full(n, -np.inf))
                    here = places[usable[places]]
                    if len(here):
                        np.maximum(top, np.where(block.given, (unit[here] @ block.vectors.T).max(0), -np.inf), out=top)
        names = ["q", "source", "least", "most", "top"]
        if some:
            yield pa.RecordBatch.from_arrays([q, pa.nulls(n, pa.string()), pa.array(least), pa.array(most), none], names)
        for source, top in found.items():
            yield pa.RecordBatch.from_arrays([q, pa.array([source] * n, pa.string()), none, none, pa.array(top)], names)

    return run


@dataclass(frozen=True)
class Bounds:
    """By query: the least and most lexical score, and by source the largest cosine, 1 if there is none."""

    least: np.ndarray
    most: np.ndarray
    top: dict[str | None, np.ndarray]


def bounds_of(index: TextIndex, block: Block, sources: list[str] | None = None, each_source: bool = False) -> Bounds:
    """Extremes of each task are put together first."""
    n = len(block.ids)
    found = _scan(index, ["data_source_type", "terms", "counts", "dl", "vector"]).mapInArrow(_extremes(block, sources, each_source), _EXTREMES)
    least, most, top = np.zeros(n), np.zeros(n), {}
    for r in found.groupBy("q", "source", F.col("top").isNull().alias("lexical")).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("top").alias("top")).toLocalIterator():
        if r["lexical"]:
            least[r["q"]], most[r["q"]] = r["least"], r["most"]
        else:
            top.setdefault(r["source"], np.full(n, -np.inf))[r["q"]] = r["top"]
    return Bounds(least, most, {source: np.where(np.isinf(x), 1.0, x) for source, x in top.items()})


def _best(t: pa.Table, k: int, each_source: bool) -> pa.Table:
    """The k best rows of each query, and source."""
    score, ordinal, q = (t.column(c).to_numpy() for c in ("rank_score", "ordinal", "q"))
    source = t.column("data_source_type").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() if each_source else np.zeros(len(q), np.int32)
    order = np.lexsort((ordinal, -score, source, q))
    new = np.flatnonzero(np.r_[True, (np.diff(q[order]) != 0) | (np.diff(source[order]) != 0)])
    place = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
    return t.take(pa.array(order[place < k]))


_FIGURES = ("bm25", "cosine", "keyword", "semantic", "final_score")


def _found(block: Block, bounds: Bounds, k: int, by: str, sources: list[str] | None, each_source: bool, alpha: float) -> Callable[[Batches], Batches]:
    """The k best of a part of the chunks for each query, and source. What can't reach the k-th best so far, whatever its lexical score, isn't scored."""
    spread_of = np.where(bounds.most == bounds.least, 1.0, bounds.most - bounds.least)

    def reach(cosine: np.ndarray, known: np.ndarray, semantic: np.ndarray) -> np.ndarray | None:
        """What the score can't exceed; None if vectors don't tell."""
        if by == "final_score":
            return alpha * semantic + max(1 - alpha, 0.0)
        return semantic if by == "semantic" else np.where(known, cosine, -np.inf) if by == "cosine" else None

    def run(batches: Batches) -> Batches:
        n, scorer = len(block.ids), Scorer(block)
        limits: dict[str | None, np.ndarray] = {}
        parts: list[pa.Table] = []
        kept = fresh = 0

        def cut() -> None:
            nonlocal parts, kept, fresh
            parts = [_best(pa.concat_tables(parts), k, each_source)]
            kept, fresh = parts[0].num_rows, 0
            q, score = (parts[0].column(c).to_numpy() for c in ("q", "rank_score"))
            source = parts[0].column("data_source_type").combine_chunks().dictionary_encode()
            codes = source.indices.fill_null(-1).to_numpy() if each_source else np.full(len(q), -1)
            for code, name in [(-1, None), *enumerate(source.dictionary.to_pylist() if each_source else [])]:
                mine = codes == code
                full = np.bincount(q[mine], minlength=n) == k
                low = np.full(n, np.inf)
                np.minimum.at(low, q[mine], score[mine])
                limits[name] = np.where(full, low, -np.inf)

        for batch in batches:
            for rows in _parts(batch, block):
                entries = scorer.entries(rows)
                ordinal = rows.column("ordinal").to_numpy()
                inside = _inside(rows, sources)
                unit, given = _matrix(rows.column("vector"), block.vectors.shape[1])
                for source, places in _of_sources(rows, each_source):
                    here = places[inside[places]]
                    if not len(here):
                        continue
                    here = here[np.argsort(ordinal[here], kind="stable")]
                    limit, top = limits.get(source, np.full(n, -np.inf)), bounds.top[source]
                    cosine = unit[here] @ block.vectors.T
                    known = given[here][:, None] & block.given
                    cosine[~known] = 0.0
                    semantic = np.where(top > 0, cosine / np.where(top > 0, top, 1.0), 0.0)
                    upper = reach(cosine, known, semantic)
                    if upper is not None:
                        able = (upper >= limit - SLACK).any(1)
                        if not able.all():
                            here, cosine, known, semantic = here[able], cosine[able], known[able], semantic[able]
                        if not len(here):
                            continue
                    lexical = scorer.scores(entries, rows.num_rows, here)
                    keyword = np.where(bounds.most == bounds.least, 0.5, (lexical - bounds.least) / spread_of)
                    figures = {"bm25": lexical, "cosine": cosine, "keyword": keyword, "semantic": semantic, "final_score": alpha * semantic + (1 - alpha) * keyword}
                    rank = np.round(figures[by], 9)  # the order of a sum decides no tie
                    usable = rank >= limit
                    if by == "cosine":
                        usable &= known
                    if usable.sum() > k * n:
                        chosen = np.argsort(-np.where(usable, rank, -np.inf), axis=0, kind="stable")[:k]
                        q = np.broadcast_to(np.arange(n), chosen.shape).ravel()
                        at = chosen.ravel()
                        some = usable[at, q]
                        at, q = at[some], q[some]
                    else:
                        at, q = np.nonzero(usable)
                    if not len(at):
                        continue
                    taken = pa.array(here[at])
                    values = {c: pa.array(figures[c][at, q], mask=~known[at, q] if c == "cosine" else None) for c in _FIGURES}
                    columns = [pa.array(q.astype(np.int32)), *(rows.column(c).take(taken) for c in ("doc_id", "data_source_type", "ordinal")), *values.values(), pa.array(rank[at, q])]
                    parts.append(pa.Table.from_arrays(columns, ["q", "doc_id", "data_source_type", "ordinal", *values, "rank_score"]))
                    fresh += len(at)
                if fresh > max(HELD, kept // 2):  # what can't be dropped counts once
                    cut()
        if parts:
            for out in _best(pa.concat_tables(parts), k, each_source).drop_columns(["rank_score"]).combine_chunks().to_batches():
                yield out

    return run


def search(index: TextIndex, queries: DataFrame, k: int = TOP_K, by: str = "final_score", sources: list[str] | None = None, each_source: bool = False, alpha: float = S.ALPHA) -> DataFrame:
    """(query_id, doc_id, data_source_type, ordinal, bm25, cosine, keyword, semantic, final_score, rank): the k best chunks of each query by one of the scores, ties by ordinal.

    Lexical scores are normalised over the whole corpus, semantic ones over the chunks of the
    filter: with sources (None or empty ones are no filter), only those chunks are found; with
    each_source there are k of each source, and the largest semantic score is the source's. A chunk
    or query without a vector has no cosine and a semantic score of 0; by cosine it isn't found.
    Scores are rounded to 9 digits for the order, so that the order of a sum decides no tie.
    """
    spark, docs = index.docs.sparkSession, index.docs
    kind = {f.name: f.dataType.simpleString() for f in [*docs.schema.fields, *queries.schema.fields]}
    out = f"q int, doc_id {kind['doc_id']}, data_source_type string, ordinal {kind['ordinal']}, " + ", ".join(f"{c} double" for c in _FIGURES)
    group = ["query_id", "data_source_type"] if each_source else ["query_id"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.round(by, 9)), "ordinal"))
    groups = max(1, docs.select("data_source_type").distinct().count()) if each_source else 1
    size = max(1, min(BLOCK, BOUNDS // (groups * max(1, k))))  # a task holds k rows of each query and source
    names = ["query_id", "doc_id", "data_source_type", "ordinal", *_FIGURES]
    whole = None
    for block in blocks_of(queries, index, size):
        bounds = bounds_of(index, block, sources, each_source)
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"q int, query_id {kind['query_id']}")
        rows = _scan(index, ["doc_id", "data_source_type", "ordinal", "terms", "counts", "dl", "vector"])
        found = rows.mapInArrow(_found(block, bounds, k, by, sources, each_source, alpha), out).join(F.broadcast(ids), "q").select(*names)
        whole = found if whole is None else whole.union(found)
    if whole is None:
        whole = spark.createDataFrame([], f"query_id {kind['query_id']}, {out.removeprefix('q int, ')}")
    return whole.withColumn("rank", rank).where(F.col("rank") <= k)


def dedup_best(found: DataFrame, *keys: str) -> DataFrame:
    """One row for each chunk (keys, doc_id unless others are given): its best score, at the place where it was first seen (arrival)."""
    keys = keys or ("doc_id",)
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round("final_score", 9)), "arrival")
    first = F.min("arrival").over(Window.partitionBy(*keys))
    return found.withColumn("first_arrival", first).withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def rerank(candidates: DataFrame, ranked: DataFrame, k: int = RERANKED, by: str = "query_id") -> DataFrame:
    """Candidates (by, idx, ...) in the order of ranked (by, ranked array<int>, null: the reply failed).

    Indices out of range are dropped, of repeated ones the first counts. The i-th has score
    1 - 0.01 i, candidates that aren't named follow in their order with 0. After a failed reply
    the order stays and there are no scores.
    """
    named = ranked.select(by, F.posexplode("ranked").alias("pos", "idx")).groupBy(by, "idx").agg(F.min("pos").alias("pos"))
    inside = named.join(candidates.select(by, "idx"), [by, "idx"]).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("pos")) - 1)
    joined = candidates.join(inside.select(by, "idx", "place"), [by, "idx"], "left").join(ranked.select(by, F.col("ranked").isNull().alias("failed")), by, "left")
    failed = F.coalesce("failed", F.lit(True))
    score = F.when(failed, F.lit(None)).when(F.col("place").isNotNull(), 1.0 - F.col("place") * 0.01).otherwise(0.0)
    order = Window.partitionBy(by).orderBy(F.asc_nulls_last(F.when(~failed, F.col("place"))), "idx")
    return joined.withColumn("rerank_score", score).withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("place", "failed")


def rerank_strict(candidates: DataFrame, ranked: DataFrame, k: int = RERANKED, by: str = "query_id") -> DataFrame:
    """As rerank, but a repeated index is listed again, and its score everywhere is 1 - 0.01 times the distinct indices seen before its last place."""
    listed = ranked.select(by, F.posexplode("ranked").alias("pos", "idx")).join(candidates.select(by, "idx"), [by, "idx"])
    first = F.row_number().over(Window.partitionBy(by, "idx").orderBy("pos")) == 1
    placed = listed.withColumn("first", first.cast("int"))
    seen = F.coalesce(F.sum("first").over(Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max_by("seen", "pos").over(Window.partitionBy(by, "idx"))
    named = placed.withColumn("seen", seen).withColumn("last", last).select(by, "idx", "pos", "last")
    joined = candidates.join(named, [by, "idx"], "left").join(ranked.select(by, F.col("ranked").isNull().alias("failed")), by, "left")
    score = F.when(F.coalesce("failed", F.lit(True)), F.lit(None)).otherwise(F.coalesce(1.0 - F.col("last") * 0.01, F.lit(0.0)))
    order = Window.partitionBy(by).orderBy(F.asc_nulls_last("pos"), "idx")
    return joined.withColumn("rerank_score", score).withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("pos", "last", "failed")


def distinct_sources(found: DataFrame, keys: list[str], by: str = "query_id", order: str = "rank") -> DataFrame:
    """The first row of each (by, keys), null keys being equal, in order."""
    return found.withColumn("seen", F.row_number().over(Window.partitionBy(by, *keys).orderBy(order))).where("seen = 1").drop("seen")


def source_of(chunk: dict[str, F.Column]) -> F.Column:
    """A found chunk as a source that is shown and judged; what it doesn't have is null, its text empty."""
    named = {"company": "company_name", "source_type": "data_source_type", "date": "fetched_date", "ticker": "ticker"}
    none = F.lit(None).cast("string")
    return F.struct(*(chunk.get(column, none).alias(name) for name, column in named.items()), F.coalesce(chunk.get("raw_chunk", none), F.lit("")).alias("content"))
