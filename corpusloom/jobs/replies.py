"""Queries over replies of agents: parsed, with what stands in for a missing or broken part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import with_json
from corpusloom.jobs import retrieval, sql
from corpusloom.operators import retrieval as R
from corpusloom.sources.tables import AGENT_REPLIES, agent_replies, replies

#: What stands for a reply that can't be read.
GENERAL = {"type": "general", "complexity": "complex", "workflow": "standard_research"}
NOT_EVALUATED = "Evaluation failed, defaulting to approval."
#: The least pass rate of the planner and the least retrieval recall; the most passes of a query.
PLANNER_RATE, RECALL_RATE, PASSES = 0.8, 0.5, 2


def _parsed(spark: SparkSession, sf_dir: str, agent: str, turn: int = 0) -> DataFrame:
    """(reply_id, json, object) of an agent's replies in a pass: object is the JSON if it is one, else null."""
    return with_json(agent_replies(spark, sf_dir, agent, turn), "reply").select("reply_id", "json", F.when(F.col("json").startswith("{"), F.col("json")).alias("object"))


def _field(name: str, kind: str = "string") -> F.Column:
    return F.from_json("object", f"struct<`{name}`: {kind}>")[name]


def orchestrator_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three fields of each reply; a reply without JSON gives the general ones, a missing field of a reply with it is null."""
    field = lambda name: F.when(F.col("json").isNull(), GENERAL[name]).otherwise(_field(name)).alias(name)
    return _parsed(spark, sf_dir, "orchestrator").select("reply_id", *map(field, GENERAL), F.col("json").isNull().alias("fallback"))


def _evaluated(spark: SparkSession, sf_dir: str, turn: int = 0) -> DataFrame:
    """(reply_id, decision, reason, confidence, hallucination): the decision as it is written; what is no object approves."""
    given = F.col("object").isNotNull()
    reason = F.when(given, F.coalesce(_field("reason"), F.lit("No reason provided"))).otherwise(NOT_EVALUATED)
    return _parsed(spark, sf_dir, "evaluator", turn).select(
        "reply_id",
        F.coalesce(_field("decision"), F.lit("approve")).alias("decision"),
        reason.alias("reason"),
        F.coalesce(_field("confidence", "double"), F.lit(0.5)).alias("confidence"),
        F.coalesce(_field("hallucination_score", "double"), F.lit(0.0)).alias("hallucination"),
    )


def evaluator_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)


def retry_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of each query, PASSES at most: another one, with a reply of its own, if the reply says `reject`, just so."""
    first = _evaluated(spark, sf_dir).select("reply_id", "decision")
    second = _evaluated(spark, sf_dir, 1).select("reply_id", F.col("decision").alias("second"))
    again = F.col("decision") == "reject"
    return first.join(second, "reply_id").select("reply_id", F.when(again, PASSES).otherwise(1).cast("long").alias("iterations"), F.when(again, F.col("second")).otherwise(F.col("decision")).alias("decision"), again.alias("retried"))


def golden_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases of the replies that have both keys, whatever their values."""
    has = lambda name: F.array_contains(F.json_object_keys("object"), name)
    kept = _parsed(spark, sf_dir, "golden").where(has("query") & has("fact"))
    return kept.select("reply_id", F.format_string("GOLD_%03d", "reply_id").alias("golden_id"), _field("query").alias("query"), _field("fact").alias("fact"))


def _planned(spark: SparkSession, sf_dir: str, turn: int = 0) -> DataFrame:
    """(reply_id, subs, fallback): the value of sub_queries of an object that has it, a list as it is, else the prompt alone; as a variant, of any kind."""
    value = F.try_parse_json(F.col("json"))
    of_object = F.try_variant_get(value, "$.sub_queries", "variant")
    has = F.array_contains(F.json_object_keys(F.when(F.col("json").startswith("{"), F.col("json"))), "sub_queries")
    found = F.when(has, of_object).when(F.col("json").startswith("["), value)
    return with_json(replies(spark, sf_dir, turn), "reply").select("reply_id", "prompt", found.alias("subs")).select("*", F.col("subs").isNull().alias("fallback"))


def planner_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries of each reply: valid if they are a list of 1 to 10 texts and nothing else."""
    listed = F.when(F.schema_of_variant("subs").startswith("ARRAY"), F.col("subs").cast("array<variant>"))
    texts = F.forall(listed, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")) == "STRING")
    valid = F.when(F.col("fallback"), True).otherwise(F.coalesce(F.size(listed).between(1, 10) & texts, F.lit(False)))
    count = F.when(F.col("fallback"), 1).when(listed.isNotNull(), F.size(listed))
    return _planned(spark, sf_dir).select("reply_id", count.cast("long").alias("n_sub_queries"), valid.alias("valid"), "fallback")


def planner_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.coalesce(F.avg(F.col("valid").cast("double")), F.lit(0.0))
    return planner_check(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_replies"), F.round(rate, 6).alias("pass_rate"), (rate >= PLANNER_RATE).alias("passed"))


def retrieval_recall_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0))
    return retrieval.raw_recall_rank(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_queries"), F.round(rate, 6).alias("recall"), (rate >= RECALL_RATE).alias("passed"))


def _rankings(spark: SparkSession, sf_dir: str, turn: int = 0) -> DataFrame:
    """(query_id, ranked): the indices of an object's ranked_indices, none if it has no such key, null if that isn't a list of whole numbers or there is no object."""
    has = F.array_contains(F.json_object_keys("object"), "ranked_indices")
    ranked = F.when(has, _field("ranked_indices", "array<int>")).when(F.col("object").isNotNull(), F.array().cast("array<int>"))
    return _parsed(spark, sf_dir, "reranker", turn).select(F.col("reply_id").alias("query_id"), ranked.alias("ranked"))


def rerank_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each query's 20 candidates by the reply's ranking; a failed reply leaves their order, without scores."""
    out = R.rerank(retrieval._candidates(spark, sf_dir), _rankings(spark, sf_dir), k=10)
    return out.select("query_id", "new_rank", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


def rerank_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with a repeated index listed again, and its last score in all its places."""
    out = R.rerank_strict(retrieval._candidates(spark, sf_dir), _rankings(spark, sf_dir), k=10)
    return out.select("query_id", "new_rank", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


def _replies(agent: str) -> str:
    return f"with {sql.agent_reply(AGENT_REPLIES[agent])}, {sql.extracted('replies', 'reply_id')}, p as (select *, case when starts_with(json, '{{') then cast(json as json) end as o from parsed)"


_EVALUATED = f"""{_replies("evaluator")}, evaluated as (
  select reply_id, coalesce(o->>'$.decision', 'approve') as decision, case when o is null then '{NOT_EVALUATED}' else coalesce(o->>'$.reason', 'No reason provided') end as reason,
         coalesce(cast(o->>'$.confidence' as double), 0.5) as confidence, coalesce(cast(o->>'$.hallucination_score' as double), 0.0) as hallucination from p
)"""
_PLANNED = f"""with {sql.REPLIES}, typed as (
  select reply_id, case when starts_with(json, '{{') then json_extract(cast(json as json), '$.sub_queries') when starts_with(json, '[') then cast(json as json) end as subs from parsed
), checked as (
  select reply_id, case when subs is null then 1 when json_type(subs) = 'ARRAY' then json_array_length(subs) end as n_sub_queries,
         case when subs is null then true when json_type(subs) <> 'ARRAY' then false
              else json_array_length(subs) between 1 and 10 and len(list_filter(json_extract(subs, '$[*]'), lambda x: json_type(x) = 'VARCHAR')) = json_array_length(subs) end as valid, subs is null as fallback from typed
)"""
_CANDIDATES = f"""{sql.agent_reply(AGENT_REPLIES["reranker"])}, {sql.extracted("replies", "reply_id")}, objects as (
  select reply_id, case when starts_with(json, '{{') then cast(json as json) end as o from parsed
), rankings as (
  select reply_id as query_id, case when o is null then null when json_extract(o, '$.ranked_indices') is null then cast([] as integer[])
    when len(list_filter(json_extract(o, '$.ranked_indices[*]'), lambda x: json_type(x) not in ('UBIGINT', 'BIGINT'))) > 0 then null
    else list_transform(json_extract(o, '$.ranked_indices[*]'), lambda x: cast(x as integer)) end as ranked from objects
), listed as (
  select query_id, unnest(ranked) as idx, unnest(range(len(ranked))) as pos from rankings
), valid as (
  select l.* from listed l join top t on t.query_id = l.query_id and t.rank - 1 = l.idx
), firsts as (
  select query_id, idx, row_number() over (partition by query_id order by min(pos)) - 1 as place, min(pos) as pos from valid group by query_id, idx
)"""

QUERIES = {
    "orchestrator_reply": orchestrator_reply,
    "evaluator_reply": evaluator_reply,
    "retry_control": retry_control,
    "golden_reply": golden_reply,
    "planner_check": planner_check,
    "planner_pass_rate": planner_pass_rate,
    "retrieval_recall_rate": retrieval_recall_rate,
    "rerank_reply": rerank_reply,
    "rerank_strict": rerank_strict,
}
ORACLE_SQL = {
    "orchestrator_reply": f"{_replies('orchestrator')} select reply_id, {', '.join(f"case when json is null then '{v}' else o->>'$.{k}' end as {k}" for k, v in GENERAL.items())}, json is null as fallback from p",
    "evaluator_reply": f"{_EVALUATED} select * from evaluated",
    "retry_control": f"""{_EVALUATED}, {sql.agent_reply(AGENT_REPLIES["evaluator"], 1, "again")}, {sql.extracted("again", "reply_id", name="again_parsed")}, second as (
  select reply_id, coalesce(case when starts_with(json, '{{') then cast(json as json) end->>'$.decision', 'approve') as decision from again_parsed
) select a.reply_id, case when a.decision = 'reject' then {PASSES} else 1 end as iterations, case when a.decision = 'reject' then b.decision else a.decision end as decision, a.decision = 'reject' as retried from evaluated a join second b using (reply_id)""",
    "golden_reply": f"{_replies('golden')} select reply_id, printf('GOLD_%03d', reply_id) as golden_id, o->>'$.query' as query, o->>'$.fact' as fact from p where list_contains(json_keys(o), 'query') and list_contains(json_keys(o), 'fact')",
    "planner_check": f"{_PLANNED} select * from checked",
    "planner_pass_rate": f"{_PLANNED} select count(*) as n_replies, round(coalesce(avg(cast(valid as integer)), 0), 6) as pass_rate, coalesce(avg(cast(valid as integer)), 0) >= {PLANNER_RATE} as passed from checked",
    "retrieval_recall_rate": f"select count(*) as n_queries, round(coalesce(avg(cast(hit as integer)), 0), 6) as recall, coalesce(avg(cast(hit as integer)), 0) >= {RECALL_RATE} as passed from ({retrieval.ORACLE_SQL['raw_recall_rank']})",
    "rerank_reply": f"""{retrieval._ALL}, {_CANDIDATES}, reranked as (
  select t.query_id, t.doc_id, case when r.ranked is null then null when f.place is not null then round(1.0 - f.place * 0.01, 6) else 0.0 end as rerank_score,
         row_number() over (partition by t.query_id order by case when r.ranked is not null then f.place end nulls last, t.rank) as new_rank
  from top t left join rankings r using (query_id) left join firsts f on f.query_id = t.query_id and f.idx = t.rank - 1
) select query_id, new_rank, doc_id, rerank_score from reranked where new_rank <= 10""",
    "rerank_strict": f"""{retrieval._ALL}, {_CANDIDATES}, scored_all as (
  select v.query_id, v.idx, v.pos, (select count(*) from firsts f where f.query_id = v.query_id and f.pos < v.pos) as before from valid v
), last_score as (
  select query_id, idx, arg_max(before, pos) as before from scored_all group by query_id, idx
), every as (
  select v.query_id, v.idx, v.pos as place, round(1.0 - l.before * 0.01, 6) as rerank_score from scored_all v join last_score l on l.query_id = v.query_id and l.idx = v.idx
  union all
  select t.query_id, t.rank - 1, 1000000 + t.rank, case when r.ranked is null then null else 0.0 end from top t left join rankings r using (query_id) left join firsts f on f.query_id = t.query_id and f.idx = t.rank - 1 where f.idx is null
), numbered as (
  select e.query_id, t.doc_id, e.rerank_score, row_number() over (partition by e.query_id order by e.place) as new_rank from every e join top t on t.query_id = e.query_id and t.rank - 1 = e.idx
) select query_id, new_rank, doc_id, rerank_score from numbered where new_rank <= 10""",
}
