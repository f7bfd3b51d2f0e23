"""Group fairness, run summaries and acceptance over validation results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.scores import shown

#: Averages of a group, by column of the results.
AVERAGES = {"overall_score": "avg_overall_score", "groundedness": "avg_groundedness", "relevancy": "avg_relevancy", "retrieval_recall": "avg_retrieval_recall"}
#: What a run must reach.
CRITERIA = {"execution_time": 300.0, "groundedness": 0.95, "overall_score": 0.80, "success_rate": 0.90}
MIN_SCORE, BOOST, MAX_GAP = 0.5, 1.05, 0.20


def group_of(query_id: F.Column) -> F.Column:
    """What stands before the first `_`; UNKNOWN without one."""
    return F.when(F.instr(query_id, "_") > 0, F.substring_index(query_id, "_", 1)).otherwise("UNKNOWN")


def group_stats(results: DataFrame, min_samples: int = 1) -> DataFrame:
    """A row for each group with min_samples tests: counts over all, means over the successful ones, 0 if none or no score."""
    ok = F.col("status") == "success"
    means = [F.coalesce(F.avg(F.when(ok, F.coalesce(c, F.lit(0.0)))), F.lit(0.0)).alias(name) for c, name in AVERAGES.items()]
    stats = results.groupBy(group_of(F.col("query_id")).alias("group_id")).agg(F.count(F.lit(1)).alias("num_tests"), F.count_if(ok).alias("num_success"), *means)
    return stats.where(F.col("num_tests") >= min_samples).withColumn("success_rate", F.col("num_success") / F.col("num_tests"))


def bias_check(stats: DataFrame, min_group_score: float = MIN_SCORE, max_allowed_gap: float = MAX_GAP) -> DataFrame:
    """One row: macro averages over groups, the gap of their scores, groups below the minimum, and whether all passed."""
    score = F.col("avg_overall_score")
    means = [F.avg(c).alias(f"global_{c}") for c in (*AVERAGES.values(), "success_rate")]
    low = F.array_sort(F.collect_list(F.when(score < min_group_score, F.col("group_id"))))
    out = stats.agg(F.count(F.lit(1)).alias("num_groups"), *means, F.coalesce(F.max(score) - F.min(score), F.lit(0.0)).alias("max_gap"), F.array_join(low, ",").alias("below"))
    return out.withColumn("disparity", F.col("max_gap") > max_allowed_gap).withColumn("passed", (F.col("num_groups") > 0) & ~F.col("disparity") & (F.col("below") == ""))


def slice_stats(results: DataFrame) -> DataFrame:
    """Counts and means by sector, by market cap and over all, in one pass."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for c, name in AVERAGES.items() if c in ("overall_score", "groundedness", "retrieval_recall")]
    cut = results.groupingSets([["sector"], ["market_cap"], []], "sector", "market_cap").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("num_tests"), *means)
    kind = F.when(F.col("level") == 1, "sector").when(F.col("level") == 2, "market_cap").otherwise("all")
    value = F.when(F.col("level") == 1, F.col("sector")).when(F.col("level") == 2, F.col("market_cap")).otherwise("all")
    return cut.select(kind.alias("slice"), value.alias("value"), "num_tests", *(F.col(AVERAGES[c]) for c in ("overall_score", "groundedness", "retrieval_recall")))


def boosts(stats: DataFrame, minimum: float = MIN_SCORE, boost: float = BOOST) -> DataFrame:
    """(group_id, boost) of the groups whose score is below the minimum."""
    return stats.where(F.coalesce("avg_overall_score", F.lit(1.0)) < minimum).select("group_id", F.lit(boost).alias("boost"))


def boost_apply(found: DataFrame, by_group: DataFrame, by: str = "query_id") -> DataFrame:
    """Scores times their group's boost, 1 if it has none, with a new rank; a missing score ranks as 0."""
    joined = found.join(by_group, "group_id", "left").withColumn("boost", F.coalesce("boost", F.lit(1.0)))
    joined = joined.withColumn("bias_boosted", F.col("boost") > 1.0).withColumn("final_score", F.col("final_score") * F.col("boost"))
    return joined.withColumn("boosted_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(F.coalesce("final_score", F.lit(0.0)), 9)), "rank")))


def summary(results: DataFrame) -> DataFrame:
    """One row: counts, and over the successful results mean, least, most and population deviation; of citations, where results have any, means over those that do."""
    ok = F.col("status") == "success"
    parts = [F.count(F.lit(1)).alias("num_tests"), F.count_if(ok).alias("num_success"), F.try_divide(F.count_if(ok), F.count(F.lit(1))).alias("success_rate")]
    for c in ("overall_score", "execution_time", "agent_confidence"):
        parts += [f(F.when(ok, F.col(c))).alias(f"{name}_{c}") for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))]
    parts += [F.avg(F.when(ok, F.col("groundedness"))).alias("avg_groundedness"), F.min(F.when(ok, F.col("groundedness"))).alias("min_groundedness"), F.avg(F.when(ok, F.col("relevancy"))).alias("avg_relevancy"), F.avg(F.when(ok, F.col("retrieval_recall"))).alias("avg_retrieval_recall")]
    cited = [c for c in ("citation_f1", "citation_precision", "citation_recall") if c in results.columns]
    return results.agg(*parts, *(F.avg(F.when(ok, F.col(c))).alias(f"avg_{c}") for c in cited))


def acceptance(totals: DataFrame) -> DataFrame:
    """Each criterion and whether all are met; a missing time counts as 999, another missing value as 0."""
    value = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    out = totals.select(
        (value("avg_execution_time", 999.0) < CRITERIA["execution_time"]).alias("time_ok"),
        (value("avg_groundedness", 0.0) >= CRITERIA["groundedness"]).alias("groundedness_ok"),
        (value("avg_overall_score", 0.0) >= CRITERIA["overall_score"]).alias("overall_ok"),
        (value("success_rate", 0.0) >= CRITERIA["success_rate"]).alias("success_ok"),
    )
    return out.withColumn("all_criteria_met", F.col("time_ok") & F.col("groundedness_ok") & F.col("overall_ok") & F.col("success_ok"))


def bias_markdown(stats: DataFrame, check: DataFrame, max_allowed_gap: float = MAX_GAP) -> DataFrame:
    """(report): one Markdown text with totals, a table of groups and the verdict. Groups are few: one row each in one text."""
    pct = lambda c, n=2: F.concat(shown(F.col(c) * 100, n), F.lit("%"))
    row = F.format_string("| %s | %d | %s | %s | %s | %s | %s |", "group_id", "num_tests", pct("success_rate", 1), pct("avg_overall_score"), pct("avg_groundedness"), pct("avg_relevancy"), pct("avg_retrieval_recall"))
    rows = stats.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", row.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.format_string("# Validation report\n\n| Metric | Value |\n| :--- | :--- |\n| Overall score | %s |\n| Success rate | %s |\n| Largest gap | %s (limit %s) |\n", pct("global_avg_overall_score"), pct("global_success_rate", 1), pct("max_gap"), F.lit(f"{max_allowed_gap:.0%}"))
    table = F.concat(F.lit("\n| Group | Tests | Success rate | Overall | Groundedness | Relevancy | Recall |\n| :--- | :---: | :---: | :---: | :---: | :---: | :---: |\n"), F.col("lines"))
    verdict = F.when(F.col("passed"), "\n\n## Passed\n").otherwise(F.concat(F.lit("\n\n## Failed\n\n- groups below the minimum: "), F.col("below"), F.when(F.col("disparity"), "\n- the gap exceeds its limit").otherwise(""), F.lit("\n")))
    return check.crossJoin(F.broadcast(rows)).select(F.concat(head, table, verdict).alias("report"))
