"""Request telemetry: latest events, averages, shares of agents, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scores import cost

WINDOW = 100


def latest(events: DataFrame, n: int = WINDOW) -> DataFrame:
    """The last n events; a partial top-n runs before anything is gathered."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def stats(events: DataFrame, n: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row: requests and errors over all, mean latency of the last n (0 if there are none); only of one path if it is given."""
    events = events.where(F.col("path") == path) if path else events
    totals = events.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"))
    recent = latest(events, n).agg(F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("avg_latency_ms"))
    return totals.crossJoin(F.broadcast(recent))


def agent_breakdown(events: DataFrame) -> DataFrame:
    """(agent, avg_ms): each agent's sum over the number of events that have any breakdown."""
    some = events.where(F.size("breakdown") > 0)
    total = some.agg(F.count(F.lit(1)).alias("n"))
    return some.select(F.explode("breakdown").alias("agent", "ms")).groupBy("agent").agg(F.sum("ms").alias("ms")).crossJoin(F.broadcast(total)).select("agent", (F.col("ms") / F.col("n")).alias("avg_ms"))


def hit_rate(events: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row over the last n events: the rate in per cent, and whether it is at least one half."""
    return latest(events, n).agg((F.avg("rag_hit") * 100).alias("hit_rate")).withColumn("healthy", F.col("hit_rate") >= 50)


def usage(events: DataFrame) -> DataFrame:
    """(event_id, total_ms, tokens, cost) of each event."""
    total = F.aggregate(F.map_values("breakdown"), F.lit(0.0), lambda a, x: a + x)
    return events.select("event_id", total.alias("total_ms"), "tokens", cost(F.col("tokens")).alias("cost"))
