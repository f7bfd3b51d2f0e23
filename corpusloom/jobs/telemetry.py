"""Queries over request events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scores import cost
from corpusloom.jobs import sql
from corpusloom.operators import telemetry as T
from corpusloom.sources.storage import new_path
from corpusloom.sources.tables import events_as_telemetry, table, telemetry
from corpusloom.streaming import telemetry as S
from corpusloom.streaming.telemetry import windowed


def last_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest(telemetry(spark, sf_dir)).select("event_id", "latency_ms", "status", "tokens")


def stats_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all requests."""
    return T.stats(telemetry(spark, sf_dir))


def analyze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the requests of the path that the endpoint itself counts."""
    return T.stats(telemetry(spark, sf_dir), path="/analyze")


def agent_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.agent_breakdown(telemetry(spark, sf_dir)).select("agent", F.round("avg_ms", 6).alias("avg_ms"))


def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hit_rate(telemetry(spark, sf_dir)).select(F.round("hit_rate", 6).alias("hit_rate"), "healthy")


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.usage(telemetry(spark, sf_dir)).select("event_id", F.round("total_ms", 6).alias("total_ms"), "tokens", F.round("cost", 6).alias("cost"))


def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of the last event."""
    last = F.max_by(F.struct("event_id", "tokens"), F.struct("ts", "event_id"))
    return telemetry(spark, sf_dir).agg(last.alias("e")).select("e.event_id", "e.tokens", F.round(cost(F.col("e.tokens")), 6).alias("cost"))


def latency_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the charts, an event each: its time from seconds since 1970, latency, whether it failed, tokens."""
    at = F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")))
    return telemetry(spark, sf_dir).select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), F.round("latency_ms", 4).alias("latency_ms"), (F.col("status") >= 400).cast("int").alias("error"), "tokens")


def usage_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's breakdown with the time of one more agent set in it, and the sum."""
    known = F.map_filter("breakdown", lambda k, v: k != "researcher")
    merged = F.map_concat(known, F.create_map(F.lit("researcher"), F.col("latency_ms")))
    total = F.aggregate(F.map_values(merged), F.lit(0.0), lambda a, x: a + x)
    return telemetry(spark, sf_dir).select("event_id", F.size(merged).cast("long").alias("n_agents"), F.round(total, 4).alias("total_ms"))


def hourly_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming extension's aggregation over the whole table."""
    return windowed(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "requests", F.round("latency", 4).alias("latency"))


def stream_last_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred events as the state of a stream over the event files has them."""
    folder = new_path(spark, "telemetry")
    name, wanted = next(iter(S.ROCKS.items()))
    before = spark.conf.get(name)
    spark.conf.set(name, wanted)
    try:
        S.run_telemetry(events_as_telemetry(S.read_events(spark, sf_dir)), folder)
    finally:
        spark.conf.set(name, before)
    return S.latest_of(spark, folder).select("event_id", "latency_ms", "status", "tokens")


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, errors and cost by path of a history that was appended batch by batch, the first batch twice."""
    folder = new_path(spark, "history")
    rows = telemetry(spark, sf_dir)
    for batch in (0, 1, 0):
        S.append_batch(rows.where(F.pmod("event_id", F.lit(2)) == batch), batch, folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    history = S.appended(spark, folder, schema)
    return history.groupBy("path").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.round(F.sum(cost(F.col("tokens"))), 6).alias("cost"))


QUERIES = {"stream_last_100": stream_last_100, "stream_history": stream_history, "last_100": last_100, "stats_endpoint": stats_endpoint, "analyze_stats": analyze_stats, "agent_breakdown": agent_breakdown, "hit_rate": hit_rate, "token_cost": token_cost, "last_event": last_event, "latency_series": latency_series, "usage_merged": usage_merged, "hourly_requests": hourly_requests}
_T = f"with {sql.TELEMETRY}"
ORACLE_SQL = {
    "stream_last_100": f"{_T} select event_id, latency_ms, status, tokens from latest",
    "stream_history": f"{_T} select path, count(*) as requests, count(*) filter (status >= 400) as errors, round(sum(tokens / 1000.0 * 0.002), 6) as cost from telemetry group by path",
    "last_100": f"{_T} select event_id, latency_ms, status, tokens from latest",
    "stats_endpoint": f"{_T} select count(*) as requests, count(*) filter (status >= 400) as errors, (select round(coalesce(avg(latency_ms), 0), 2) from latest) as avg_latency_ms from telemetry",
    "analyze_stats": f"{_T} select count(*) as requests, count(*) filter (status >= 400) as errors, (select round(coalesce(avg(latency_ms), 0), 2) from (select * from telemetry where path = '/analyze' order by ts desc, event_id desc limit 100)) as avg_latency_ms from telemetry where path = '/analyze'",
    "agent_breakdown": f"""{_T}, known as (select * from telemetry where detailed) select agent, round(sum(ms) / (select count(*) from known), 6) as avg_ms from (
  select 'researcher' as agent, latency_ms * 0.5 as ms from known union all select event_type, latency_ms * 0.25 from known) group by agent""",
    "hit_rate": f"{_T} select round(avg(rag_hit) * 100, 6) as hit_rate, avg(rag_hit) * 100 >= 50 as healthy from latest",
    "token_cost": f"{_T} select event_id, round(case when detailed then latency_ms * 0.75 else 0 end, 6) as total_ms, tokens, round(tokens / 1000.0 * 0.002, 6) as cost from telemetry",
    "last_event": f"{_T} select event_id, tokens, round(tokens / 1000.0 * 0.002, 6) as cost from telemetry order by ts desc, event_id desc limit 1",
    "latency_series": f"{_T} select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, round(latency_ms, 4) as latency_ms, cast(status >= 400 as integer) as error, tokens from telemetry",
    "usage_merged": f"{_T} select event_id, case when detailed then 2 else 1 end as n_agents, round(latency_ms + case when detailed then latency_ms * 0.25 else 0 end, 4) as total_ms from telemetry",
    "hourly_requests": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as requests, round(sum(value), 4) as latency from events group by all",
}
