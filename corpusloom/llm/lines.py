"""Line deduplication by overlapping three-line windows.

Windows of consecutive lines are hashed; of each window found more than once the first
occurrence stays, and the lines that later occurrences cover are removed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.llm.common import row_key, small_batches, table

LINES = 3


@F.arrow_udf(StringType())
def _without(text: pa.Array, starts: pa.Array, width: pa.Array) -> pa.Array:
    """The text without the lines that the windows at starts cover."""

    def one(text: str | None, starts: list[int] | None, width: int) -> str | None:
        if text is None or starts is None:
            return text
        covered, end = set(), 0
        for start in sorted(starts):
            covered.update(range(max(start, end), start + width))
            end = start + width
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in covered)

    return pa.array([one(*x) for x in zip(text.to_pylist(), starts.to_pylist(), width.to_pylist(), strict=True)], pa.string())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = LINES) -> DataFrame:
    """Every row of docs with its text cleaned, and n_lines, n_removed (long).

    A line ends at \\n and is compared as it is. Windows are all runs of `width` lines that
    hold one that isn't blank; a text with fewer lines has none and stays as it is. The first
    occurrence is the one with the smallest id (null first), then key of the text, then place;
    occurrences within one text count too. Rows equal in id and text are one document given
    twice and are cleaned alike. A null text stays null, with no lines; a text may become empty.
    Other columns pass through (n_lines and n_removed are replaced).

    Only hashes (128 bits) and places are shuffled by window, with sums before the shuffle;
    texts are joined by document, and only those that lose lines go through Python.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(width), x).alias("b"), x.rlike(r"[^\x20\x09-\x0D]").alias("said")))
    line = lambda i, k: F.get("lines", i + k)
    window = lambda i: F.struct(
        i.cast("int").alias("place"),
        F.xxhash64(*(line(i, k)["a"] for k in range(width))).alias("a"),
        F.xxhash64(*(line(i, k)["b"] for k in range(width))).alias("b"),
        F.array_contains(F.array(*(line(i, k)["said"] for k in range(width))), True).alias("said"),
    )
    placed = (
        docs.where(F.size(lines) >= width)
        .select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_key"), hashes.alias("lines"))
        .select("id", "text_key", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - width), window)).alias("w"))
        .where("w.said")
        .select("id", "text_key", "w.place", "w.a", "w.b")
    )
    at = F.struct(F.col("id").isNotNull().alias("known"), "id", "text_key", "place")
    repeated = placed.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last").select("a", "b", F.struct("first.id", "first.text_key", "first.place").alias("first"))
    later = placed.join(repeated, ["a", "b"]).where(~F.struct("id", "text_key", "place").eqNullSafe(F.col("first")))
    starts = later.groupBy(row_key("id", "text_key").alias("_key")).agg(F.collect_set("place").alias("_starts"))
    keyed = docs.withColumn("_text_key", F.xxhash64(text)).withColumn("_key", row_key(id_col, "_text_key"))
    joined = keyed.join(starts, "_key", "left")
    clean = F.when(F.col("_starts").isNull(), text).otherwise(_without(F.when(F.col("_starts").isNotNull(), text), "_starts", F.lit(width)))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + width - 1)))))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*(clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept), n_lines.alias("n_lines"), F.coalesce(F.when(F.col("_starts").isNotNull(), covered), F.lit(0)).cast("long").alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with lines as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from documents
), windows as (
  select doc_id, place, line || chr(10) || lead(line) over w || chr(10) || lead(line, 2) over w as content
  from lines window w as (partition by doc_id order by place)
), ranked as (
  select doc_id, place, row_number() over (partition by content order by doc_id, place) as occurrence
  from windows where regexp_matches(content, '[^\x20\x09-\x0D]')
), covered as (
  select distinct doc_id, place + k as place from ranked, (values (0), (1), (2)) as o(k) where occurrence > 1
), kept as (
  select l.doc_id, count(*) as n_lines, count(c.place) as n_removed,
         string_agg(l.line, chr(10) order by l.place) filter (c.place is null) as text
  from lines l left join covered c on l.doc_id = c.doc_id and l.place = c.place group by l.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
       coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed
from documents d left join kept k on d.doc_id = k.doc_id
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE_SQL = {"op6_line_dedup": ORACLE}
