"""Tables as the retrieval and evaluation jobs see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import json_safe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks; ordinal is the scan order, which breaks ties. Null text is empty."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("_", F.upper("lang"), "source", F.col("doc_id").cast("string")).alias("chunk_id"),
        F.coalesce("text", F.lit("")).alias("raw_chunk"),
        F.col("source").alias("data_source_type"),
        F.col("lang").alias("company_name"),
        F.col("doc_id").alias("ordinal"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, whole, as queries; a query's vector is that of its number, null if there is none."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return items.join(vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), "query_id", "left")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, query, answer, context): a user's turn, the assistant's next one, and the two turns before as chunks."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    at = lambda k: F.lag("text", k).over(order)
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("query"), F.lead("text").over(order).alias("answer"), F.lead("role").over(order).alias("next_role"), F.array_compact(F.array(at(2), at(1))).alias("context")
    )
    return turns.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "query", "answer", "context")


def events_as_telemetry(events: DataFrame) -> DataFrame:
    """Request events, of a table or a stream, with path, latency, token count, per-agent breakdown (empty for some) and retrieval hit."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.withColumn("k", k).select(
        "event_id",
        F.col("ts"),
        F.when(F.col("event_type") == "view", "/").otherwise("/analyze").alias("path"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("k") * 100).alias("tokens"),
        F.when(F.col("k") % 3 != 0, F.create_map(F.lit("researcher"), F.col("value") * 0.5, F.col("event_type"), F.col("value") * 0.25)).otherwise(F.create_map().cast("map<string,double>")).alias("breakdown"),
        (F.col("k") % 2).alias("rag_hit"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_telemetry(table(spark, sf_dir, "events"))


#: Fixed numbers that choose the form of a reply to an item: a reply of a later pass has another one.
MIX, STEP, CUT = 7_919, 104_729, 7


def form_of(forms: int, turn: int = 0) -> F.Column:
    """Which of so many forms an agent's reply to an item (item_id) has in a pass, counted from 0."""
    return F.expr(f"(abs(item_id) * {MIX} + {turn * STEP}) div {CUT} % {forms}")


#: Replies of agents as they come, whole, wrapped, broken or of another kind; `?` stands for the item's number, `#` for two digits of its own, `~` for its text, `<` and `>` for the halves of that.
AGENT_REPLIES = {
    "planner": {
        0: '```json\n{"sub_queries": ["<", ">", "?"]}\n```',
        1: 'Here they are: ["~"] and that is all',
        2: "There is nothing for ?",
        3: '{"ranked_indices": [?, 3, 99, -1, 3, 0]} as asked',
        4: '  ["~", ',
        5: '{"decision": "approve", ?}',
        6: '```\n{"sub_queries": []}\n```',
        7: '[">", "~", ?]',
        8: '{"note": {"sub_queries": 1}, "sub_queries": [">", "<"]}',
    },
    "orchestrator": {
        0: '```json\n{"type": "financial", "complexity": "simple", "workflow": "standard_research"}\n```',
        1: 'Sure: {"type": "case ?", "complexity": "complex"}',
        2: "no idea about ?",
        3: '["financial"]',
        4: '{"type": "broken", ',
        5: '{"type": null, "complexity": "complex", "workflow": "fast"}',
    },
    "evaluator": {
        0: '{"decision": "approve", "reason": "~", "confidence": 0.#, "hallucination_score": 0.1#}',
        1: '```json\n{"decision": "reject", "reason": "made up", "confidence": 0.0#, "hallucination_score": 0.#}\n```',
        2: "cannot say",
        3: '{"decision": "Reject"}',
        4: '{"confidence": 0.#}',
        5: '["approve"]',
        6: '{"decision": "reject", "reason": "again"} ?',
    },
    "golden": {
        0: '{"query": "What of ~", "fact": "?"}',
        1: '{"query": "only ?"}',
        2: "none",
        3: '{"query": null, "fact": "x"}',
        4: '{"fact": "y ?", "query": "z"} done',
        5: '[{"query": "q", "fact": "f"}]',
    },
    "reranker": {
        0: '{"ranked_indices": [3, 1, 3, 99, -1, 0, 1]}',
        1: '```json\n{"ranked_indices": [?, 2]}\n```',
        2: "no list for ?",
        3: '{"ranked": [1]}',
        4: '{"ranked_indices": ["1", 2]}',
        5: "[2, 1]",
        6: '{"ranked_indices": []}',
    },
}


def agent_replies(spark: SparkSession, sf_dir: str, agent: str, turn: int = 0) -> DataFrame:
    """(reply_id, prompt, reply) of an agent to each benchmark item in a pass."""
    cases = AGENT_REPLIES[agent]
    forms = spark.createDataFrame(list(cases.items()), "form int, reply string")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("prompt"), form_of(len(cases), turn).cast("int").alias("form")).join(F.broadcast(forms), "form")
    safe = F.translate(json_safe(F.col("prompt")), "<>?#~", "     ")
    half = F.floor(F.length(safe) / 2).cast("int")
    reply = F.replace(F.replace("reply", F.lit("?"), F.col("item_id").cast("string")), F.lit("#"), F.format_string("%02d", F.abs("item_id") * 37 % 100))
    for mark, text in (("~", safe), ("<", F.left(safe, half)), (">", F.substr(safe, half + 1))):
        reply = F.replace(reply, F.lit(mark), text)
    return items.select(F.col("item_id").alias("reply_id"), "prompt", reply.alias("reply"))


def replies(spark: SparkSession, sf_dir: str, turn: int = 0) -> DataFrame:
    """(reply_id, prompt, reply): a planner's replies as text, whole and broken."""
    return agent_replies(spark, sf_dir, "planner", turn)
