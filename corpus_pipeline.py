"""Five stages from raw documents to a mix for training.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns what it keeps; all
but the last return the columns of documents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, lookup, table
from corpusloom.llm.decontaminate import find_contamination
from corpusloom.llm.jaccard import jaccard_components
from corpusloom.llm.language import identify, learn
from corpusloom.llm.lines import dedup_lines
from corpusloom.llm.mixing import mix


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter or with a narrow margin go."""
    return identify(docs, learn(docs)).where(~F.col("lang_rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go from texts, n_chars follows; a document of which only white space is left goes too."""
    clean = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones; repeated rows once, rows without an id all."""
    stays = jaccard_components(docs).groupBy("doc_id").agg(F.min("component_id").alias("first")).where("doc_id = first").select("doc_id")
    return docs.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text")
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"), id_col="row", keep_text=True)
    return found.where(F.size("spans") == 0).select("row.*", "text").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with how often it has each (copies) and when first (finish).

    Rows are told apart by a 128-bit key of all their columns, so rows that share an id, or have
    none, each have their own copies. Rows that are equal in every column are one row, with the
    copies of all of them. Columns of docs by these two names are replaced.
    """
    docs = docs.drop("copies", "finish")
    plain = [f.name for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]  # what can be hashed
    keys = [F.xxhash64(F.lit(i), *(F.struct(F.col(c).isNull(), F.col(c)) for c in plain)).alias(f"_key{i}") for i in (1, 2)]
    names = ["_key1", "_key2"]
    mixed = mix(docs.select("doc_id", "text", "source", *keys), carry=tuple(names))
    taken = mixed.groupBy(*names).agg(F.sum("copies").alias("copies"), F.min("finish").alias("finish"), F.count(F.lit(1)).alias("_rows"), F.count(F.lit(1)).alias("_weight")).where("copies > 0")
    taken = checkpointed(taken, small=True)
    found = lookup(docs.select("*", *keys), taken, names, "_weight")
    if not taken.where("_rows > 1").isEmpty():
        found = found.where("_rows = 1").unionByName(found.where("_rows > 1").dropDuplicates(names))
    return found.select(*docs.columns, "copies", "finish")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
]

#: SQL can express neither the compression classifier nor its effects on later stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
