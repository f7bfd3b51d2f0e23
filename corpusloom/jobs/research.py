"""The chain of many questions at once: planned sub-queries, searched in every source, pooled and reranked by question; and its passes over what a judge rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import token_estimate
from corpusloom.jobs import replies, retrieval, sql
from corpusloom.jobs.replies import PASSES
from corpusloom.operators import retrieval as R
from corpusloom.sources.storage import checkpointed
from corpusloom.sources.tables import AGENT_REPLIES, chunks, table, vectors

#: Fixed value: the answer when nothing was found.
NOTHING_FOUND = "I couldn't find relevant information to answer your query."
#: The i-th sub-query of a question has the vector of the question's number plus i times this.
VECTOR_STEP = 100


def sub_queries(spark: SparkSession, sf_dir: str, turn: int = 0) -> DataFrame:
    """(query_id <question, sub>, query, vector): the texts of each planner's reply in a pass, in order; the question itself if the reply has no list. What isn't a text is no sub-query."""
    planned = replies._planned(spark, sf_dir, turn)
    listed = F.when(F.schema_of_variant("subs").startswith("ARRAY"), F.col("subs").cast("array<variant>"))
    texts = F.transform(F.filter(listed, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")) == "STRING"), lambda x: x.cast("string"))
    each = planned.select(F.col("reply_id").alias("question"), F.posexplode(F.when(F.col("fallback"), F.array("prompt")).otherwise(texts)).alias("sub", "query"))
    number = each.withColumn("doc_id", F.abs("question") + VECTOR_STEP * F.col("sub"))
    return number.join(vectors(spark, sf_dir), "doc_id", "left").select(F.struct("question", "sub").alias("query_id"), "query", "vector")


def research(spark: SparkSession, sf_dir: str, queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(question, idx, doc_id, final_score, rerank_score, new_rank): of each question the best RERANKED of its pool.

    Every sub-query is searched in every source; a chunk counts once in a question, with its best
    score, where it first arrived (by sub-query, source and rank). The POOL best are reranked by the
    question's ranking (question, ranked).
    """
    arrival = F.struct(F.col("query_id.sub"), "data_source_type", "rank")
    found = R.search(retrieval.index_of(spark, sf_dir), queries, each_source=True).select(F.col("query_id.question").alias("question"), "doc_id", "final_score", arrival.alias("arrival"))
    once = R.dedup_best(found, "question", "doc_id")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc(F.round("final_score", 9)), "first_arrival"))
    pool = once.withColumn("idx", place - 1).where(F.col("idx") < R.POOL).select("question", "idx", "doc_id", "final_score")
    return R.rerank(pool, ranked.withColumnRenamed("query_id", "question"), k=R.RERANKED, by="question")


def research_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research(spark, sf_dir, sub_queries(spark, sf_dir), replies._rankings(spark, sf_dir))
    return out.select("question", "new_rank", "doc_id", F.round("final_score", 6).alias("final_score"), F.round("rerank_score", 6).alias("rerank_score"))


def passes(spark: SparkSession, sf_dir: str, most: int = PASSES) -> DataFrame:
    """(question, query, iterations, decision, n_sub_queries, best, answer): each question's last pass. What is rejected, just so, is planned, searched, answered and judged anew, `most` times in all; a pass sees only the rows that the one before rejected, and its figures replace theirs."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), F.coalesce("text", F.lit("")).alias("query"))
    texts = chunks(spark, sf_dir).select(F.col("doc_id").alias("best"), "raw_chunk")
    done = None
    for turn in range(most):
        queries = sub_queries(spark, sf_dir, turn).join(rows.select("question"), F.col("query_id.question") == F.col("question"), "left_semi")
        best = research(spark, sf_dir, queries, replies._rankings(spark, sf_dir, turn)).where("new_rank = 1").select("question", F.col("doc_id").alias("best"))
        counts = queries.groupBy(F.col("query_id.question").alias("question")).agg(F.count(F.lit(1)).alias("n_sub_queries"), F.sum(F.length("query")).alias("sub_chars"))
        judged = replies._evaluated(spark, sf_dir, turn).select(F.col("reply_id").alias("question"), "decision", "confidence")
        answered = rows.join(best, "question", "left").join(texts, "best", "left").join(counts, "question", "left").join(judged, "question")
        state = checkpointed(
            answered.select(
                "question",
                "query",
                F.lit(turn + 1).cast("long").alias("iterations"),
                "decision",
                "confidence",
                F.coalesce("n_sub_queries", F.lit(0)).alias("n_sub_queries"),
                F.coalesce("sub_chars", F.lit(0)).alias("sub_chars"),
                "best",
                F.coalesce("raw_chunk", F.lit(NOTHING_FOUND)).alias("answer"),
            )
        )
        again = F.col("decision") == "reject"
        ended = state if turn + 1 == most else state.where(~again)
        done = ended if done is None else done.unionByName(ended)
        rows = state.where(again).select("question", "query")
        if turn + 1 < most and rows.isEmpty():
            break
    return done


def retry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes, decision and answer of each question, with the tokens of its agents: those of a later pass replace the earlier ones', the first agent runs once."""
    first = token_estimate(F.col("query")).cast("long")
    planner = F.floor((F.length("query") + F.col("sub_chars")) / 4)
    judge = token_estimate(F.col("query"), F.col("answer")).cast("long")
    return passes(spark, sf_dir).select(
        "question", "iterations", "decision", F.col("confidence"), "n_sub_queries", "best", F.md5("answer").alias("answer_md5"), planner.alias("planner_tokens"), judge.alias("judge_tokens"), (first + planner + judge).alias("total_tokens")
    )


def _pass(turn: int) -> str:
    """CTEs of a pass: its sub-queries (subs), rankings and judgements."""
    reply = lambda agent, keep="reply_id": f"{sql.agent_reply(AGENT_REPLIES[agent], turn, f'{agent}{turn}')}, {sql.extracted(f'{agent}{turn}', keep, name=f'{agent}_parsed{turn}')}"
    return f"""{reply("planner", "reply_id, prompt")}, typed{turn} as (
  select reply_id, prompt, case when starts_with(json, '{{') then json_extract(cast(json as json), '$.sub_queries') when starts_with(json, '[') then cast(json as json) end as subs from planner_parsed{turn}
), texts{turn} as (
  select reply_id as question, case when subs is null then [prompt] when json_type(subs) = 'ARRAY' then list_transform(list_filter(json_extract(subs, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') else cast([] as varchar[]) end as texts from typed{turn}
), subs{turn} as (
  select {turn} as turn, question, unnest(range(len(texts))) as sub, unnest(texts) as query from texts{turn}
), {reply("reranker")}, rankings{turn} as (
  select reply_id as question, case when o is null then null when json_extract(o, '$.ranked_indices') is null then cast([] as integer[])
    when len(list_filter(json_extract(o, '$.ranked_indices[*]'), lambda x: json_type(x) not in ('UBIGINT', 'BIGINT'))) > 0 then null
    else list_transform(json_extract(o, '$.ranked_indices[*]'), lambda x: cast(x as integer)) end as ranked from (select reply_id, case when starts_with(json, '{{') then cast(json as json) end as o from reranker_parsed{turn})
), {reply("evaluator")}, judged{turn} as (
  select reply_id as question, coalesce(o->>'$.decision', 'approve') as decision, coalesce(cast(o->>'$.confidence' as double), 0.5) as confidence from (select reply_id, case when starts_with(json, '{{') then cast(json as json) end as o from evaluator_parsed{turn})
)"""


def _research(turns: int) -> str:
    """CTEs of passes over all questions, up to `reranked` (turn, question, idx, doc_id, final_score, rerank_score, new_rank)."""
    every = lambda name, extra="": " union all ".join(f"select {extra.format(t=t)}* from {name}{t}" for t in range(turns))
    queries = f"""queries as (
  select {{'turn': turn, 'question': question, 'sub': sub}} as query_id, query, cast(e.embedding as double[]) as vector from subs left join embeddings e on e.vec_id = abs(question) + {VECTOR_STEP} * sub
)"""
    return f"""{", ".join(map(_pass, range(turns)))}, subs as materialized ({every("subs")}), rankings as ({every("rankings", "{t} as turn, ")}), judged as ({every("judged", "{t} as turn, ")}),
{sql.bm25(queries)}, {sql.scored(each_source=True)}, {sql.TOP.format(by="query_id, data_source_type")}, arrived as (
  select query_id.turn as turn, query_id.question as question, doc_id, final_score, {{'sub': query_id.sub, 'source': data_source_type, 'rank': rank}} as arrival from ranked where rank <= {R.TOP_K}
), once as (
  select *, min(arrival) over (partition by turn, question, doc_id) as first_arrival from arrived qualify row_number() over (partition by turn, question, doc_id order by round(final_score, 9) desc, arrival) = 1
), pool as (
  select turn, question, doc_id, final_score, row_number() over (partition by turn, question order by round(final_score, 9) desc, first_arrival) - 1 as idx from once qualify idx < {R.POOL}
), named as (
  select turn, question, idx, min(pos) as pos from (select turn, question, unnest(ranked) as idx, unnest(range(len(ranked))) as pos from rankings) group by all
), placed as (
  select turn, question, idx, row_number() over (partition by turn, question order by pos) - 1 as place from named join pool using (turn, question, idx)
), reranked as (
  select p.*, case when r.ranked is null then null when place is not null then 1.0 - place * 0.01 else 0.0 end as rerank_score,
         row_number() over (partition by turn, question order by case when r.ranked is not null then place end nulls last, idx) as new_rank
  from pool p left join rankings r using (turn, question) left join placed using (turn, question, idx) qualify new_rank <= {R.RERANKED}
)"""


_FOUND = NOTHING_FOUND.replace("'", "''")
QUERIES = {"research_topk": research_topk, "retry_run": retry_run}
ORACLE_SQL = {
    "research_topk": f"with {_research(1)} select question, new_rank, doc_id, round(final_score, 6) as final_score, round(rerank_score, 6) as rerank_score from reranked",
    "retry_run": f"""with {_research(PASSES)}, counted as (
  select turn, question, count(*) as n, sum(length(query)) as chars from subs group by all
), each as (
  select turn, item_id as question, coalesce(b.text, '') as query, decision, confidence, coalesce(n, 0) as n, coalesce(chars, 0) as chars, r.doc_id as best, case when r.doc_id is null then '{_FOUND}' else coalesce(d.text, '') end as answer
  from benchmark b join judged j on j.question = b.item_id left join counted c using (turn, question) left join (select * from reranked where new_rank = 1) r using (turn, question) left join documents d on d.doc_id = r.doc_id
), last as (
  select e.* from each e where turn = 0 and decision <> 'reject' {" ".join(f"union all select e.* from each e join each p on p.question = e.question and p.turn = {t - 1} where e.turn = {t} and p.decision = 'reject'" + ("" if t + 1 == PASSES else " and e.decision <> 'reject'") for t in range(1, PASSES))}
)
select question, cast(turn + 1 as bigint) as iterations, decision, confidence, n as n_sub_queries, best, md5(answer) as answer_md5, cast((length(query) + chars) // 4 as bigint) as planner_tokens, cast((length(query) + length(answer)) // 4 as bigint) as judge_tokens,
  cast(length(query) // 4 + (length(query) + chars) // 4 + (length(query) + length(answer)) // 4 as bigint) as total_tokens from last""",
}
