"""Vector codes by codebooks of parts, whose entries are searched through a geometric near-neighbour access tree.

Vectors become integers and are cut into parts; each part position has its own codebook, learnt by
rounds of assignment and integer means. The entries of a codebook stand in a tree: a node has split
points, and for each pair of them the range of distances from one to the entries below the other. A
query's distances to the split points rule out whole subtrees, strictly and with conservative
rounding; what is left is compared in integers, so that ties go to the lower entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, lookup, made, small_batches, table

SCALE, PARTS, ENTRIES, ROUNDS = 4_096, 8, 16, 6
#: Split points of a node.
DEGREE = 4
#: More than the relative error of a distance that is taken in doubles.
SLACK = 2.0**-40
#: Components that single precision can't hold count as non-finite.
MOST = 2.0**128
LONGEST = (1 << 63) - 1
LIMB = 64
Batches = Iterator[pa.RecordBatch]


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to an integer point."""
    away = rows - point
    return (away * away).sum(1)


def _length(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(squares, float))


@dataclass(frozen=True)
class Gnat:
    """A node: entries (split points) by number, and below each of them a node or none; least and most [i, j]: range of the distances from split point i to what is at or below split point j."""

    splits: list[int]
    below: list[Gnat | None]
    least: np.ndarray
    most: np.ndarray


def grow(entries: np.ndarray, chosen: list[int] | None = None, degree: int = DEGREE) -> Gnat:
    """The tree of the chosen entries: split points are far from each other, every other entry goes to the nearest one."""
    chosen = list(range(len(entries))) if chosen is None else chosen
    points = entries[chosen]
    splits = [0]
    near = squared(points, points[0])
    while len(splits) < min(degree, len(chosen)):
        splits.append(int(np.argmax([-1 if i in splits else d for i, d in enumerate(near.tolist())])))
        near = np.minimum(near, squared(points, points[splits[-1]]))
    away = np.array([squared(points, points[s]) for s in splits])
    of = away.argmin(0)
    of[splits] = np.arange(len(splits))
    groups = [np.flatnonzero(of == j) for j in range(len(splits))]
    length = _length(away)
    below = [[chosen[i] for i in g if i != s] for g, s in zip(groups, splits, strict=True)]
    return Gnat(
        [chosen[s] for s in splits],
        [grow(entries, b, degree) if b else None for b in below],
        np.array([[length[i, g].min() for g in groups] for i in range(len(splits))]) * (1 - SLACK),
        np.array([[length[i, g].max() for g in groups] for i in range(len(splits))]) * (1 + SLACK),
    )


def nearest(tree: Gnat, entries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each row's nearest entry, ties to the lower number; and how many distances were taken."""
    best = squared(rows, entries[tree.splits[0]])
    entry = np.full(len(rows), tree.splits[0])
    taken = len(rows)

    def look(k: int, at: np.ndarray) -> np.ndarray:
        nonlocal taken
        found = squared(rows[at], entries[k])
        taken += len(at)
        better = (found < best[at]) | ((found == best[at]) & (k < entry[at]))
        best[at[better]], entry[at[better]] = found[better], k
        return found

    def walk(node: Gnat, at: np.ndarray) -> None:
        away = [_length(look(k, at)) for k in node.splits]
        for j, child in enumerate(node.below):
            if child is not None and len(at):
                limit = _length(best[at]) * (1 + SLACK)
                out = np.zeros(len(at), bool)
                for i, d in enumerate(away):  # whatever is below j is at least so far away
                    out |= np.maximum(d * (1 - SLACK) - node.most[i, j], node.least[i, j] - d * (1 + SLACK)) > limit
                walk(child, at[~out])

    walk(tree, np.arange(len(rows)))
    return entry, best, taken


@dataclass(frozen=True)
class Codec:
    """Codebooks by part (entries x components, integers), and their trees."""

    books: list[np.ndarray]
    trees: list[Gnat]
    width: int
    scale: int

    @property
    def text(self) -> str:
        return ",".join(str(int(x)) for book in self.books for entry in book for x in entry)


def codec(books: list[list[list[int]]], width: int, scale: int = SCALE) -> Codec:
    small = max((abs(x) for book in books for entry in book for x in entry), default=0) < _safe(width // max(1, len(books)))
    arrays = [np.array(book, np.int64 if small else object) for book in books]
    return Codec(arrays, [grow(b) for b in arrays], width, scale)


def _safe(size: int) -> int:
    """Components below this have squared distances of `size` components that fit 62 bits."""
    return 1 << ((62 - max(1, size).bit_length()) // 2 - 1)


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * component) of each vector, filled with zeros up to the width; Python's own integers if any is large."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = column.flatten().to_numpy(zero_copy_only=False)
    out = np.floor(out * scale)
    if out.size and np.abs(out).max() >= _safe(width):
        return np.frompyfunc(int, 1, 1)(out).astype(object).reshape(out.shape)
    return out.astype(np.int64)


def _assigned(known: Codec, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(part of the rows, its entry, squared distance) by part."""
    size = known.width // len(known.books)
    for p, (book, tree) in enumerate(zip(known.books, known.trees, strict=True)):
        part = rows[:, p * size : (p + 1) * size]
        entry, distance, _ = nearest(tree, book, part)
        yield part, entry, distance


def _sums(known: Codec) -> Callable[[Batches], Batches]:
    """(part, entry, place, n, high, low): of a task's parts at each entry their number and the sums of their components, as high * 2^64 + low."""

    def run(batches: Batches) -> Batches:
        k, size = max(len(b) for b in known.books), known.width // len(known.books)
        total = np.zeros((len(known.books), k, size), object)
        count = np.zeros((len(known.books), k), np.int64)
        for batch in batches:
            for p, (part, entry, _) in enumerate(_assigned(known, integers(batch.column("v"), known.width, known.scale))):
                count[p] += np.bincount(entry, minlength=k)
                for e in np.unique(entry):
                    total[p, e] += part[entry == e].sum(0).astype(object)
        p, e, place = (x.ravel() for x in np.indices(total.shape))
        some = count[p, e] > 0
        p, e, place = p[some], e[some], place[some]
        values = [int(x) for x in total[p, e, place]]
        decimal = pa.decimal128(38, 0)
        yield made(
            part=(p, pa.int32()),
            entry=(e, pa.int32()),
            place=(place, pa.int32()),
            n=(count[p, e], pa.int64()),
            high=([Decimal(x >> LIMB) for x in values], decimal),
            low=([Decimal(x & ((1 << LIMB) - 1)) for x in values], decimal),
        )

    return run


def _coded(known: Codec) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = integers(batch.column("v"), known.width, known.scale)
            codes, error = [], np.zeros(len(rows), object)
            for _, entry, distance in _assigned(known, rows):
                codes.append(entry)
                error += distance.astype(object)
            text = ["".join(f"{x:02x}" for x in code) for code in np.array(codes).T.tolist()]
            errors = pa.array([min(int(x), LONGEST) for x in error], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), errors], ["id", "label", "code", "error"])

    return run


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codec | None:
    """Codebooks of the vectors (id, v: neither null nor with null or non-finite components); None if there are none.

    They start as the parts of the vectors of the smallest ids (nulls last, equal ids by vector). Of
    each round only sums by part, entry and place come to the driver.
    """
    figures = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not figures["n"]:
        return None
    width = max(1, -(-figures["width"] // parts)) * parts
    size = width // parts
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    rows = integers(first, width, scale).tolist()
    known = codec([[row[p * size : (p + 1) * size] for row in rows] for p in range(parts)], width, scale)
    for _ in range(rounds):
        found = vectors.select("v").mapInArrow(_sums(known), "part int, entry int, place int, n long, high decimal(38,0), low decimal(38,0)")
        books = [[list(map(int, entry)) for entry in book] for book in known.books]
        for r in found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).toLocalIterator():
            books[r["part"]][r["entry"]][r["place"]] = ((int(r["high"]) << LIMB) + int(r["low"])) // r["n"]
        known = codec(books, width, scale)
    return known


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of every row whose vector is neither null nor holds null or non-finite components; a component that single precision can't hold counts as such.

    Vectors shorter than the longest, whose length is rounded up to whole parts, are filled with
    zeros. error and label_error stop at the largest long. Null labels are one label, repeated rows
    are rows of their own; of fewer rows than entries the codebooks have as many entries as rows. An
    empty table, or one without a usable vector, gives an empty result.
    """
    spark = rows.sparkSession
    small_batches(spark)
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < MOST)
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(F.forall("v", sound))
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    known = learn(kept.select("id", "v"), parts, entries, rounds, scale)
    out = f"id {kind['id']}, label {kind['label']}, code string, error long"
    if known is None:
        return spark.createDataFrame([], out).select(F.col("id").alias(id_col), "code", "error", F.col("error").alias("label_error"), F.col("code").alias("codebooks_sha256"))
    coded = checkpointed(kept.mapInArrow(_coded(known), out).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    sums = coded.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    sums = checkpointed(sums.select("key", "n", F.least("total", F.lit(LONGEST)).cast("long").alias("label_error")), small=True)
    digest = hashlib.sha256(known.text.encode()).hexdigest()
    return lookup(coded, sums, ["key"], "n").select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Each round's assignment (a) and entries (c) as tables of their own."""
    assigned = """a{k} as materialized (
  select r, part, min({{'d': list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), 'e': entry}}) as best from pieces join c{k} using (part) group by r, part
)"""
    moved = """c{n} as materialized (
  select c.part, c.entry, coalesce(m.c, c.c) as c from c{k} c left join (
    select part, entry, list((s - ((s % n) + n) % n) // n order by place) as c from (
      select p.part, a.best.e as entry, place, sum(p.v[place]) as s, count(*) as n from pieces p join a{k} a using (r, part), unnest(range(1, len(p.v) + 1)) as t(place) group by all
    ) group by part, entry
  ) m on m.part = c.part and m.entry = c.entry
)"""
    steps = ",\n".join(f"{assigned.format(k=k)},\n{moved.format(k=k, n=k + 1)}" for k in range(ROUNDS))
    return f"""
with kept as (
  select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as hugeint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pieces as materialized (
  select r, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] as v from kept, range({PARTS}) t(part)
), c0 as materialized (
  select part, r - 1 as entry, v as c from pieces where r <= {ENTRIES}
),
{steps},
{assigned.format(k=ROUNDS)},
coded as (
  select r, string_agg(lpad(printf('%x', best.e), 2, '0'), '' order by part) as code, cast(sum(best.d) as bigint) as error from a{ROUNDS} group by r
), digest as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from c{ROUNDS}
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join kept using (r), digest
"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE_SQL = {"op12_vector_codes": _oracle()}
