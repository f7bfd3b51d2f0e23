"""Answer metrics by token overlap, as columns; every one is between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import metric_tokens


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(F.lit(empty))


def groundedness(answer: Column, chunks: Column) -> Column:
    """The share of the answer's tokens that are among the chunks'; 0 if either has none."""
    said, known = metric_tokens(answer), metric_tokens(F.array_join(chunks, " "))
    return _share(F.array_intersect(said, known), said, 0.0)


def answer_relevancy(query: Column, answer: Column) -> Column:
    """The share of the query's tokens found anywhere in the answer; no query or answer 0, no tokens 1."""
    asked, text = metric_tokens(query), F.lower(answer)
    empty = (F.coalesce(F.length(query), F.lit(0)) == 0) | (F.coalesce(F.length(answer), F.lit(0)) == 0)
    return F.when(empty, 0.0).otherwise(_share(F.filter(asked, lambda t: F.contains(text, t)), asked, 1.0))


def context_relevancy(query: Column, chunks: Column) -> Column:
    """The share of chunks with a token of the query in them; no chunks 0, no tokens 1."""
    asked = metric_tokens(query)
    hit = F.filter(chunks, lambda c: F.exists(asked, lambda t: F.contains(F.lower(c), t)))
    return F.when(F.size(chunks) == 0, 0.0).when(F.size(asked) == 0, 1.0).otherwise(F.size(hit) / F.size(chunks))


def found_share(answer: Column, expected: Column) -> Column:
    """The share of expected strings in the answer, in any case; 1 if none are expected. Sections and facts alike."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    return _share(F.filter(expected, lambda e: F.contains(text, F.lower(e))), expected, 1.0)


def source_coverage(types: Column, required: Column) -> Column:
    """The share of required source types among those given, in any case; repeats count; 1 if none are required."""
    given = F.transform(types, lambda t: F.lower(t))
    return _share(F.filter(required, lambda r: F.array_contains(given, F.lower(r))), required, 1.0)


def soft_recall(target: Column, retrieved: Column) -> Column:
    """1 for the target itself, 0.5 for its `A_B` prefix, 0.2 for its `A` prefix, else 0; no `_` or no target: 1 or 0."""
    ids = F.transform(retrieved, lambda r: F.coalesce(r, F.lit("")))
    two, one = F.substring_index(target, "_", 2), F.substring_index(target, "_", 1)
    score = (
        F.when(F.array_contains(ids, target), 1.0)
        .when(F.instr(target, "_") == 0, 0.0)
        .when(F.exists(ids, lambda r: r.startswith(two)), 0.5)
        .when(F.exists(ids, lambda r: r.startswith(one)), 0.2)
        .otherwise(0.0)
    )
    return F.when(target.isNull(), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def citations(answer: Column, sources: Column) -> Column:
    """(found, precision, recall, f1) of an answer's marks, `[3]`, `[Source 3]` or `[Document 3]`: how many there are, the share that are numbers of its sources (from 1), and the share of sources that are marked. All null without an answer; 0 where there is nothing to share."""
    marks = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(?:Source |Document )?(\d{1,9})\]"), 1), lambda x: x.cast("int"))

    def rated(marks: Column) -> Column:
        known = F.filter(marks, lambda x: x.between(1, sources))
        precision = F.coalesce(F.try_divide(F.size(known), F.size(marks)), F.lit(0.0))
        recall = F.coalesce(F.try_divide(F.size(F.array_distinct(known)), sources), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
        return F.struct(F.size(marks).alias("found"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))

    none = F.lit(None)
    empty = F.struct(none.cast("int").alias("found"), *(none.cast("double").alias(c) for c in ("precision", "recall", "f1")))
    return F.when(answer.isNull(), empty).otherwise(F.get(F.transform(F.array(marks), rated), F.lit(0)))
