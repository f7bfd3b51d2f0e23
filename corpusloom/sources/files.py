"""JSON files that may be missing or broken, and outputs of one file a row."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: The column of what can't be read as JSON.
BROKEN = "_broken"
#: What is read of a report of groups; an older form has slices too, whose groups are repeated here.
REPORT = "per_group map<string, struct<avg_overall_score: double, num_tests: bigint, count: bigint>>"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Records of JSON files, one a line, or one a file, with what can't be read in a column of its own, and nulls in the others; a missing path has none.

    A field of another type is null and its record is broken; fields that the schema lacks are passed over.
    """
    try:
        reader = spark.read.schema(f"{schema}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN).option("mode", "PERMISSIVE")
        return reader.option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, {BROKEN} string")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, avg_overall_score, num_tests) of a report of either form; none if the file is missing, broken or has no groups."""
    groups = read_json(spark, path, REPORT, lines=False).where(F.col(BROKEN).isNull()).select(F.explode("per_group").alias("group_id", "g"))
    return groups.select("group_id", "g.avg_overall_score", F.coalesce("g.num_tests", "g.count").alias("num_tests"))


def write_report(stats: DataFrame, path: str, slices: DataFrame | None = None) -> None:
    """A report of groups as one JSON file; with slices (slice, group_id, avg_overall_score, count) in the older form. Groups are few: they are one record."""
    entries = lambda rows, by, figures: rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("group_id", F.struct(*figures)))).alias("per_group"))
    if slices is None:
        report = entries(stats, [], ["avg_overall_score", "num_tests"])
    else:
        whole = entries(slices, [], ["avg_overall_score", "count"])
        by = entries(slices, ["slice"], ["avg_overall_score", "count"]).agg(F.map_from_entries(F.collect_list(F.struct("slice", "per_group"))).alias("per_slice"))
        report = by.crossJoin(whole)
    report.coalesce(1).write.json(path)


def kept_json(spark: SparkSession, path: str, schema: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What lies under a path; only if nothing does, it is made and written there first. A path that holds files without a record stays as it is."""
    try:
        spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        make().write.json(path)
    return read_json(spark, path, schema)


def unique(prefix: str, stamp: F.Column) -> F.Column:
    """A name with a time in it that no other row or run has."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit("_"), F.uuid())


def write_each(rows: DataFrame, folder: str, name_col: str = "name", text_col: str = "text") -> str:
    """Writes the text of each row as a file of its own: folder/run=<id>/name=<name>/part-...; returns the run's folder.

    Names must be unique, else the rows of a name are files beside each other. Every run has a new
    id, so it never overwrites another's files.
    """
    run = f"{folder}/run={uuid.uuid4().hex}"
    lone = rows.select(F.col(name_col).alias("name"), F.col(text_col).alias("value"))
    lone.write.partitionBy("name").text(run)
    return run


def read_each(spark: SparkSession, run: str) -> DataFrame:
    """(name, text) of the files of a run, whole."""
    read = spark.read.schema("value string, name string").text(run, wholetext=True)
    return read.select("name", F.left("value", F.length("value") - 1).alias("text"))  # a written line ends


def write_envelope(cases: DataFrame, path: str, source: str, stamp: F.Column) -> None:
    """Cases as one JSON record: when and of what they were made, and the list, which is bounded by how the cases were drawn."""
    listed = cases.agg(F.array_sort(F.collect_list(F.struct(*cases.columns))).alias("test_cases"))
    listed.select(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), F.lit(source).alias("source"), "test_cases").coalesce(1).write.json(path)


def read_envelope(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cases of an envelope, or of a bare list of them; none if the file is missing or broken."""
    whole = read_json(spark, path, f"test_cases array<struct<{schema}>>", lines=False)
    cases = whole.where(F.col(BROKEN).isNull() & F.col("test_cases").isNotNull()).select(F.explode("test_cases").alias("c")).select("c.*")
    columns = [c.strip().split(":")[0] for c in schema.split(", ") if ":" in c]
    bare = read_json(spark, path, schema.replace(": ", " "), lines=False).where(F.col(BROKEN).isNull() & F.coalesce(*(F.col(c).isNotNull() for c in columns[:1]))).select(*columns)
    return cases.select(*columns).unionByName(bare)
