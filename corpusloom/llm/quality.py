"""Quality rules: fixed limits, then robust multivariate outliers.

Statistics of each text are transformed to a vector. For each language and source a
minimum-covariance-determinant estimate of centre and scatter is made from all of its
vectors, and a text far from the centre by Mahalanobis distance is rejected. As most texts
have no symbols or repeats, a fixed diagonal is added to the scatter before its determinant
is taken, which makes this the regularised estimate with that target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import BLANK, checkpointed, small_batches, table, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Share of the vectors that the estimate is made from, and the least rows of a group with an estimate of its own.
SUPPORT, MIN_ROWS = 0.75, 60
#: Starts from drawn vectors beside the one from the medians, vectors of each, steps of all starts before the best goes on, and
#: steps at most; steps end when no group's determinant falls by this share.
DRAWS, DRAWN, FIRST_STEPS, MOST_STEPS, STILL = 3, 24, 2, 20, 1e-3
#: Squared distances are compared with this: the 1e-6 tail of chi-squared with 5 degrees of freedom.
LIMIT = 35.9
#: Variances get the square of this added, by transformed statistic, as most texts have no symbols or repeats and so no scatter of their own.
#: The mean word length of a short text varies by 0.05. One symbol, one repeated line and one repeated window of a text of MIN_WORDS
#: are four floors each, so that one line said twice (2 * 16 < LIMIT) doesn't reject the shortest text.
FLOORS = {"log_words": 0.05, "word_length": 0.05, "symbols": math.log1p(10 / MIN_WORDS) / 4, "dup_lines": math.log1p(10 / MIN_WORDS) / 4, "repeats": math.log1p(60 / MIN_WORDS) / 4}
VECTOR = tuple(FLOORS)
#: Width of the steps by which distances are told apart, in logarithms, and of the grid that estimates are made on.
STEP, GRID = 0.01, 0.01
#: Groups whose estimates go to every task; more are joined, in this many parts of a group.
BROADCAST_GROUPS, PARTS = 10_000, 16

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; a null text has no words."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = word_hashes(data)
    chars = len(text) - (len(data) - len(data.translate(None, BLANK)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(BLANK):
            seen.add(line)
    repeats = 0
    if len(words) > 3:
        found = windows(words, 3)
        _, inverse, count = np.unique(found, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(found)] |= again
        repeats = int(covered.sum())
    return len(words), chars, symbols, dup_lines, repeats


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(text.as_py()) for text in batch.column(0)]
        made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], *COUNTS])


def consistency(support: float) -> float:
    """The factor by which the scatter of the closest `support` of normal vectors is too small."""
    if support >= 1:
        return 1.0
    within = lambda x: math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)  # noqa: E731  chi-squared, 5 degrees of freedom
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if within(x) < support else (low, x)
    return support / (support - (x / 2) ** 2.5 * math.exp(-x / 2) / math.gamma(3.5))


def _estimated(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Centre, inverse scatter and the scatter's determinant (its logarithm) from sums; a row in, a row out."""
    d = len(VECTOR)
    floors = np.diag([x * x for x in FLOORS.values()])
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        first = np.array(batch.column("first").to_pylist(), float).reshape(-1, d)
        second = np.array(batch.column("second").to_pylist(), float).reshape(-1, d, d)
        centre = first / n[:, None]
        scatter = scale * (second / n[:, None, None] - centre[:, :, None] * centre[:, None, :]) + floors
        made = [pa.array(centre.tolist(), pa.list_(pa.float64())), pa.array(np.linalg.inv(scatter).reshape(-1, d * d).tolist(), pa.list_(pa.float64())), pa.array(np.linalg.slogdet(scatter)[1], pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), *made, batch.column("before")], ["key", "start", "centre", "inverse", "logdet", "before"])


_D = range(len(VECTOR))
_FIRST, _SECOND = [f"s{i}" for i in _D], [f"p{i}_{j}" for i in _D for j in _D if i <= j]


def _sums(weight: str | None = None) -> list[F.Column]:
    """Sums of the vectors v, each counted once or `weight` times."""
    n = weight or "1"
    first = [f"sum(v[{i}] * {n}) as s{i}" for i in _D]
    second = [f"sum(v[{i}] * v[{j}] * {n}) as p{i}_{j}" for i in _D for j in _D if i <= j]
    return [F.expr(x) for x in (f"sum({n}) as n", *first, *second)]


def _estimate(sums: DataFrame, scale: float = 1.0) -> DataFrame:
    """(key, start, centre, inverse, logdet, before) from sums of each key and start, the scatter times `scale`; before: the determinant of the estimate that the sums go back to, if they tell it."""
    second = F.array(*(f"p{min(i, j)}_{max(i, j)}" for i in _D for j in _D))
    before = F.col("logdet") if "logdet" in sums.columns else F.lit(None).cast("double")
    packed = sums.select("key", "start", "n", F.array(*_FIRST).alias("first"), second.alias("second"), before.alias("before"))
    return packed.mapInArrow(lambda batches: _estimated(batches, scale), "key string, start int, centre array<double>, inverse array<double>, logdet double, before double")


def _distance() -> F.Column:
    """The squared distance of v from `centre`, the inverse scatter being symmetric."""
    term = lambda i, j: f"{1 if i == j else 2} * (v[{i}] - centre[{i}]) * (v[{j}] - centre[{j}]) * inverse[{i * len(VECTOR) + j}]"
    return F.expr(" + ".join(term(i, j) for i in _D for j in _D if i <= j))


def _beside(rows: DataFrame, few: DataFrame, on: str, how: str = "inner", small: bool | None = None) -> DataFrame:
    """rows with what few has for their group: few goes to every task if it is small (counted, if that isn't known), else both sides are dealt out by parts of a group."""
    if few.count() <= BROADCAST_GROUPS if small is None else small:
        return rows.join(F.broadcast(few), on, how)
    parts = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)).cast("int")).join(parts, [on, "part"], how).drop("part")


def _concentrated(cells: DataFrame, estimates: DataFrame, share: float, small: bool) -> DataFrame:
    """The next estimates: from the vectors of each group among the `share` of it closest to the centre, to a step of the distance.

    Sums are made for each group, start and step of the distance before the shuffle; steps are then
    added up in order until the share is reached.
    """
    placed = _beside(cells, estimates, "key", small=small).select("key", "start", "logdet", F.floor(F.log(_distance() + 1e-9) / STEP).alias("step"), "v", "n")
    by_step = placed.groupBy("key", "start", "logdet", "step").agg(*_sums("n"))
    of_start = Window.partitionBy("key", "start", "logdet")
    upto = F.sum("n").over(of_start.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    kept = by_step.withColumns({"before": F.coalesce(upto, F.lit(0)), "all": F.sum("n").over(of_start)}).where(F.col("before") < share * F.col("all"))
    return _estimate(kept.groupBy("key", "start", "logdet").agg(*(F.expr(f"sum({c}) as {c}") for c in ("n", *_FIRST, *_SECOND))), consistency(share))


def _made(estimates: DataFrame, small: bool) -> tuple[DataFrame, float | None]:
    """estimates, once computed, and the largest fall of a determinant: the few of small ones are held by the driver, others are written."""
    if small:
        rows = estimates.toArrow()
        return estimates.sparkSession.createDataFrame(rows, estimates.schema), pc.max(pc.subtract(rows["before"], rows["logdet"])).as_py()
    now = checkpointed(estimates, small=True)
    return now, now.agg(F.max(F.col("before") - F.col("logdet"))).first()[0]


def estimate(vectors: DataFrame, support: float = SUPPORT, draws: int = DRAWS, most_steps: int = MOST_STEPS) -> DataFrame:
    """(key, start, centre, inverse, logdet), the regularised minimum-covariance-determinant estimate of each key from (key, v).

    Vectors are first counted in the cells of a grid of width GRID, less than a quarter of what is added
    to any deviation; all steps go over the cells, which stay few however many vectors there are.
    Starts are the vectors within 3 robust deviations of the group's medians in each statistic, and
    DRAWN vectors or so of each of `draws` ways of hashing. After FIRST_STEPS concentration steps the
    start with the smallest determinant goes on in each group, until no group's determinant falls by
    more than STILL. The driver holds the estimates of up to BROADCAST_GROUPS groups between steps.
    """
    floors = list(FLOORS.values())
    cells = checkpointed(vectors.groupBy("key", F.transform("v", lambda x: F.round(x / GRID) * GRID).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    middle = checkpointed(cells.groupBy("key").agg(F.sum("n").alias("rows"), *(F.percentile(F.col("v")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias(f"q{i}") for i in _D)), small=True)
    small = middle.count() <= BROADCAST_GROUPS
    spread = [F.abs(F.col("v")[i] - F.col(f"q{i}")[1]) <= 3 * F.greatest(0.74 * (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]), F.lit(floors[i])) for i in _D]
    near = spread[0] & spread[1] & spread[2] & spread[3] & spread[4]
    # How many vectors of a cell are drawn: its share of DRAWN, rounded up or down by chance.
    drawn = [F.floor(DRAWN * F.col("n") / F.col("rows") + F.pmod(F.xxhash64(F.lit(k), "key", "v"), F.lit(1 << 40)) / F.lit(float(1 << 40))) for k in range(1, draws + 1)]
    starts = F.filter(F.array(*(F.struct(F.lit(k).alias("start"), w.alias("n")) for k, w in enumerate((F.when(near, F.col("n")).otherwise(0), *drawn)))), lambda s: s["n"] > 0)
    begun = _beside(cells, middle, "key", small=small).select("key", "v", F.explode(starts).alias("of")).select("key", "v", "of.*")
    now, _ = _made(_estimate(begun.groupBy("key", "start").agg(*_sums("n"))), small)
    for _ in range(FIRST_STEPS):
        now, _ = _made(_concentrated(cells, now, support, small), small)
    best = now.groupBy("key").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    now, _ = _made(now.join(best, ["key", "start"]).select(*now.columns), small)
    for _ in range(most_steps - FIRST_STEPS):
        now, fell = _made(_concentrated(cells, now, support, small), small)
        if fell is None or fell <= STILL:
            break
    return now.drop("before")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", support: float = SUPPORT, min_rows: int = MIN_ROWS, limit: float = LIMIT) -> DataFrame:
    """(id_col, COUNTS, base_failed, distance, kept) of every row.

    base_failed: fewer than 50 words, or more than half of them in repeated three-word windows.
    Others are vectors of their (language, source); null is a value of its own there. A group of
    fewer than min_rows vectors is judged by the estimate of all vectors of its language, or, if these
    are too few, of all vectors; if there are fewer than min_rows in all, distance is null and they
    are kept. kept is false if base_failed, else distance (squared) <= limit. A null or empty text has
    no words. Repeated rows count as often as they stand; null ids stay; other columns don't matter.
    """
    small_batches(docs.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    counted = checkpointed(rows.mapInArrow(_counted, f"id {fields[id_col]}, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    vector = F.array(F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), F.log1p(10 * F.col("n_symbols") / words), F.log1p(10 * F.col("n_dup_lines") / words), F.log1p(10 * F.col("n_repeat_words") / words))
    group = lambda *parts: F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    plain = lambda n: F.coalesce(F.col(n), F.lit(0)) >= min_rows
    # What each group is judged by, and what its vectors add to.
    sizes = counted.where(~failed).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).select(group("lang", "source").alias("own"), group("lang").alias("whole"), "n")
    of_lang = sizes.groupBy("whole").agg(F.sum("n").alias("n_lang"), (F.min("n") < min_rows).alias("lang_asked"))
    of_all = of_lang.agg(F.sum("n_lang").alias("n_all"), F.max(F.col("n_lang") < min_rows).alias("all_asked"))
    every = F.lit("all")
    by = F.when(plain("n"), F.col("own")).when(plain("n_lang"), F.col("whole")).when(plain("n_all"), every)
    adds = F.filter(F.array(F.when(plain("n"), F.col("own")), F.when(plain("n_lang") & F.col("lang_asked"), F.col("whole")), F.when(plain("n_all") & F.col("all_asked"), every)), lambda k: k.isNotNull())
    plan = checkpointed(sizes.join(of_lang, "whole").crossJoin(F.broadcast(of_all)).select("own", by.alias("key"), adds.alias("adds")), small=True)
    judged = _beside(counted.withColumn("own", group("lang", "source")), plan, "own", "left").select("id", *COUNTS, failed.alias("base_failed"), "key", "adds", vector.alias("v"))
    found = estimate(judged.where("not base_failed").select(F.explode("adds").alias("key"), "v"), support).select("key", "centre", "inverse")
    out = _beside(judged.drop("adds"), found, "key", "left").withColumn("distance", F.when(~F.col("base_failed") & F.col("centre").isNotNull(), _distance()))
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL: dict[str, str] = {}
