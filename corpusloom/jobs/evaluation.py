"""Queries over answers, validation results and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import metrics as M
from corpusloom.functions import scores as S
from corpusloom.functions.text import company_code, snippet, title, with_json
from corpusloom.jobs import retrieval, sql
from corpusloom.jobs.validation import RUN, results
from corpusloom.operators import evaluation as E
from corpusloom.sources.tables import answers, chunks, replies, table

#: Chunks of the golden sample.
SAMPLED = 20
#: What the answers are expected to hold: the corpus has sentences, not sections.
EXPECTED = ["the", "and", "de la", "der", "100%"]


def _expected() -> F.Column:
    return F.array(*map(F.lit, EXPECTED))


def _metric(spark: SparkSession, sf_dir: str, name: str, score: F.Column) -> DataFrame:
    return answers(spark, sf_dir).select("conv_id", "turn", F.round(score, 6).alias(name))


def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "groundedness", M.groundedness(F.col("answer"), F.col("context")))


def answer_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "answer_relevancy", M.answer_relevancy(F.col("query"), F.col("answer")))


def context_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "context_relevancy", M.context_relevancy(F.col("query"), F.col("context")))


def section_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "section_completeness", M.found_share(F.col("answer"), _expected()))


def factual_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the first three words of the question in the answer?"""
    return _metric(spark, sf_dir, "factual_accuracy", M.found_share(F.col("answer"), F.split(title(F.col("query"), 3), " ")))


def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd turns have no expected facts, so that metric isn't there for them."""
    answer, query = F.col("answer"), F.col("query")
    parts = {"groundedness": M.groundedness(answer, F.col("context")), "answer_relevancy": M.answer_relevancy(query, answer), "factual_accuracy": F.when(F.col("turn") % 2 == 0, M.found_share(answer, F.split(title(query, 3), " "))), "section_completeness": M.found_share(answer, _expected())}
    return _metric(spark, sf_dir, "overall_score", S.overall(parts))


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sources found for a query, the share of three that are required; one is asked for twice."""
    found = retrieval.hybrid_topk(spark, sf_dir).join(chunks(spark, sf_dir).select("doc_id", "data_source_type"), "doc_id")
    types = found.groupBy("query_id").agg(F.collect_set("data_source_type").alias("types"))
    return types.select("query_id", F.round(M.source_coverage(F.col("types"), F.array(*map(F.lit, ("SRC0", "src1", "Src0")))), 6).alias("coverage"))


def soft_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk of a query's number against the ids that were found for the query."""
    ids = chunks(spark, sf_dir).select("doc_id", "chunk_id")
    found = retrieval.hybrid_topk(spark, sf_dir).join(ids, "doc_id").groupBy("query_id").agg(F.collect_list("chunk_id").alias("ids"))
    return found.join(ids.select(F.col("doc_id").alias("query_id"), F.col("chunk_id").alias("target")), "query_id", "left").select("query_id", M.soft_recall(F.col("target"), F.col("ids")).alias("recall"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.group_stats(results(spark, sf_dir)))


def bias_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.bias_check(E.group_stats(results(spark, sf_dir))))


def slice_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.slice_stats(results(spark, sf_dir)))


def boost_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.boosts(E.group_stats(results(spark, sf_dir)))


def boost_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval._search(spark, sf_dir).withColumn("group_id", F.col("data_source_type"))
    out = E.boost_apply(found, boost_map(spark, sf_dir))
    return out.select("query_id", "boosted_rank", "doc_id", F.round("final_score", 6).alias("final_score"), "bias_boosted")


def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.summary(results(spark, sf_dir)))


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.acceptance(E.summary(results(spark, sf_dir)))


def bias_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = E.group_stats(results(spark, sf_dir))
    return E.bias_markdown(stats, E.bias_check(stats))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_json(replies(spark, sf_dir), "reply").select("reply_id", "prompt", "json", "error")


def extracted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("reply_id", "json", "error")


def golden_sample(spark: SparkSession, sf_dir: str, pool: int = 100, count: int = SAMPLED, seed: str = "golden", with_order: bool = False) -> DataFrame:
    """A seeded sample of long chunks of the first hundred: the sample is the feature. with_order: with each one's place (i), from 1."""
    first = chunks(spark, sf_dir).orderBy("ordinal").limit(pool).where(F.length("raw_chunk") > 100)
    drawn = first.orderBy(F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))), "doc_id").limit(count)
    place = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))), "doc_id"))
    return drawn.select("doc_id", snippet(F.col("raw_chunk"), 200).alias("snippet"), *([place.alias("i")] if with_order else []))


def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = company_code(F.col("raw_chunk"))
    return chunks(spark, sf_dir).select("doc_id", F.format_string("%s_%03d", code, "doc_id").alias("case_id"), F.format_string("GOLD_%03d_%s", "doc_id", F.left(code, F.lit(3))).alias("golden_id"))


def session_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is named by the first four words of its first user turn."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select("conv_id", title(F.col("text")).alias("title"))


def traffic_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where("status = 'success'").select("query_id", S.confidence_light(F.col("agent_confidence")).alias("confidence"), S.hallucination_light(1 - F.col("groundedness")).alias("hallucination"))


def response_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown report of each answered question with its metrics."""
    score = S.shown(M.groundedness(F.col("answer"), F.col("context")))
    body = F.concat(F.lit("# Report\n\n**Query:** "), F.coalesce("query", F.lit("")), F.lit("\n\n## Answer\n\n"), F.coalesce("answer", F.lit("No answer")), F.lit("\n\n## Groundedness\n\n**"), score, F.lit("** / 1.0\n\n## Sources\n"))
    listed = F.array_join(F.transform("context", lambda c, i: F.concat(F.lit("\n### Source "), (i + 1).cast("string"), F.lit("\n\n"), c, F.lit("\n"))), "")
    report = F.concat(body, F.when(F.size("context") > 0, listed).otherwise("\nNo sources.\n"))
    return answers(spark, sf_dir).select("conv_id", "turn", F.length(report).cast("long").alias("n_chars"), F.md5(report).alias("report_md5"))


_EXPECTED = "[" + ", ".join(f"'{x}'" for x in EXPECTED) + "]"
_SAID, _KNOWN, _ASKED = sql.metric_tokens("answer"), sql.metric_tokens("coalesce(array_to_string(context, ' '), '')"), sql.metric_tokens("query")
_GROUNDED = f"case when len({_SAID}) > 0 then len(list_intersect({_SAID}, {_KNOWN})) / len({_SAID}) else 0.0 end"
_RELEVANT = f"case when coalesce(length(query), 0) = 0 or coalesce(length(answer), 0) = 0 then 0.0 when len({_ASKED}) = 0 then 1.0 else len(list_filter({_ASKED}, lambda t: contains(lower(answer), t))) / len({_ASKED}) end"
_TITLE3 = f"list_filter(string_split_regex(query, '{sql.WS}'), lambda t: t <> '')[1:3]"
_FACTS = f"case when len({_TITLE3}) = 0 then 0.0 + cast(contains(lower(answer), '') as integer) else len(list_filter({_TITLE3}, lambda e: contains(lower(coalesce(answer, '')), lower(e)))) / len({_TITLE3}) end"
_SECTIONS = f"len(list_filter({_EXPECTED}, lambda e: contains(lower(coalesce(answer, '')), lower(e)))) / 5.0"
_A = f"with {sql.ANSWERS} select conv_id, turn, "
_GROUP_AVG = ("avg_overall_score", "avg_groundedness", "avg_relevancy", "avg_retrieval_recall", "success_rate")
_CHECK = f"""check1 as (
  select count(*) as num_groups, {", ".join(f"avg({c}) as global_{c}" for c in _GROUP_AVG)}, coalesce(max(avg_overall_score) - min(avg_overall_score), 0) as max_gap,
         coalesce(string_agg(group_id, ',' order by group_id) filter (avg_overall_score < 0.5), '') as below from stats
), checked as (select *, max_gap > 0.2 as disparity, num_groups > 0 and not max_gap > 0.2 and below = '' as passed from check1)"""
_SUMMARY = (
    "count(*) as num_tests, count(*) filter (status = 'success') as num_success, round(count(*) filter (status = 'success') / count(*), 6) as success_rate, "
    + ", ".join(f"round({f}({c}) filter (status = 'success'), 6) as {n}_{c}" for c in ("overall_score", "execution_time", "agent_confidence") for n, f in (("avg", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_pop")))
    + ", round(avg(groundedness) filter (status = 'success'), 6) as avg_groundedness, round(min(groundedness) filter (status = 'success'), 6) as min_groundedness, round(avg(relevancy) filter (status = 'success'), 6) as avg_relevancy, round(avg(retrieval_recall) filter (status = 'success'), 6) as avg_retrieval_recall"
    + "".join(f", round(avg({c}) filter (status = 'success'), 6) as avg_{c}" for c in ("citation_f1", "citation_precision", "citation_recall"))
)
_CODE = "coalesce(nullif(left(upper(replace(regexp_replace(raw_chunk, '[^\\p{L}\\p{N}]', '', 'g'), 'ß', 'SS')), 10), ''), 'UNKNOWN')"
_TOP = retrieval.ORACLE_SQL["hybrid_topk"]

QUERIES = {
    "groundedness": groundedness,
    "answer_relevancy": answer_relevancy,
    "context_relevancy": context_relevancy,
    "section_completeness": section_completeness,
    "factual_accuracy": factual_accuracy,
    "overall_score": overall_score,
    "source_coverage": source_coverage,
    "soft_recall": soft_recall,
    "group_stats": group_stats,
    "bias_check": bias_check,
    "slice_stats": slice_stats,
    "boost_map": boost_map,
    "boost_apply": boost_apply,
    "summary_stats": summary_stats,
    "acceptance": acceptance,
    "bias_report": bias_report,
    "extract_json": extracted_json,
    "golden_sample": golden_sample,
    "case_ids": case_ids,
    "session_title": session_title,
    "traffic_light": traffic_light,
    "response_report": response_report,
}
ORACLE_SQL = {
    "groundedness": f"{_A} round({_GROUNDED}, 6) as groundedness from answers",
    "answer_relevancy": f"{_A} round({_RELEVANT}, 6) as answer_relevancy from answers",
    "context_relevancy": f"{_A} round(case when len(context) = 0 then 0.0 when len({_ASKED}) = 0 then 1.0 else len(list_filter(context, lambda c: len(list_filter({_ASKED}, lambda t: contains(lower(c), t))) > 0)) / len(context) end, 6) as context_relevancy from answers",
    "section_completeness": f"{_A} round({_SECTIONS}, 6) as section_completeness from answers",
    "factual_accuracy": f"{_A} round({_FACTS}, 6) as factual_accuracy from answers",
    "overall_score": f"{_A} round(least(0.2 * {_GROUNDED} + 0.6 * {_RELEVANT} + 0.1 * case when turn % 2 = 0 then {_FACTS} else 0 end + 0.1 * {_SECTIONS}, 1.0), 6) as overall_score from answers",
    "source_coverage": f"select query_id, round(len(list_filter(['src0', 'src1', 'src0'], lambda r: list_contains(types, r))) / 3, 6) as coverage from (select query_id, list(distinct lower(source)) as types from ({_TOP}) t join documents using (doc_id) group by query_id)",
    "soft_recall": f"""with {sql.CHUNKS}, found as (select query_id, list(chunk_id) as ids from ({_TOP}) t join chunks using (doc_id) group by query_id)
select query_id, case when chunk_id is null then 0.0 when list_contains(ids, chunk_id) then 1.0 when strpos(chunk_id, '_') = 0 then 0.0
  when len(list_filter(ids, lambda r: starts_with(r, split_part(chunk_id, '_', 1) || '_' || split_part(chunk_id, '_', 2)))) > 0 then 0.5 when len(list_filter(ids, lambda r: starts_with(r, split_part(chunk_id, '_', 1)))) > 0 then 0.2 else 0.0 end as recall
from found left join chunks c on c.doc_id = query_id""",
    "group_stats": f"with {RUN}, {sql.GROUPS} select group_id, num_tests, num_success, {', '.join(f'round({c}, 6) as {c}' for c in _GROUP_AVG)} from stats",
    "bias_check": f"with {RUN}, {sql.GROUPS}, {_CHECK} select num_groups, {', '.join(f'round(global_{c}, 6) as global_{c}' for c in _GROUP_AVG)}, round(max_gap, 6) as max_gap, below, disparity, passed from checked",
    "slice_stats": f"""with {RUN} select case when grouping(sector) = 0 then 'sector' when grouping(market_cap) = 0 then 'market_cap' else 'all' end as slice, case when grouping(sector) = 0 then sector when grouping(market_cap) = 0 then market_cap else 'all' end as value,
  count(*) as num_tests, round(coalesce(avg(overall_score), 0), 6) as avg_overall_score, round(coalesce(avg(groundedness), 0), 6) as avg_groundedness, round(coalesce(avg(retrieval_recall), 0), 6) as avg_retrieval_recall
from results group by grouping sets ((sector), (market_cap), ())""",
    "boost_map": f"with {RUN}, {sql.GROUPS} select group_id, 1.05 as boost from stats where avg_overall_score < 0.5",
    "boost_apply": f"""with {RUN}, {sql.GROUPS}, boosted as (
  select t.query_id, t.rank, t.doc_id, t.final_score * case when s.avg_overall_score < 0.5 then 1.05 else 1.0 end as final_score, coalesce(s.avg_overall_score < 0.5, false) as bias_boosted
  from top t left join stats s on s.group_id = t.data_source_type
) select query_id, row_number() over (partition by query_id order by round(final_score, 9) desc, rank) as boosted_rank, doc_id, round(final_score, 6) as final_score, bias_boosted from boosted""",
    "summary_stats": f"with {RUN} select {_SUMMARY} from results",
    "acceptance": f"""with {RUN}, s as (select {_SUMMARY} from results), c as (
  select coalesce(avg_execution_time, 999) < 300 as time_ok, coalesce(avg_groundedness, 0) >= 0.95 as groundedness_ok, coalesce(avg_overall_score, 0) >= 0.8 as overall_ok, coalesce(success_rate, 0) >= 0.9 as success_ok from s
) select *, time_ok and groundedness_ok and overall_ok and success_ok as all_criteria_met from c""",
    "bias_report": f"""with {RUN}, {sql.GROUPS}, {_CHECK}, lines as (
  select string_agg(printf('| %s | %d | %.1f%% | %.2f%% | %.2f%% | %.2f%% | %.2f%% |', group_id, num_tests, floor(success_rate * 100 * 10 + 0.5) / 10, floor(avg_overall_score * 100 * 100 + 0.5) / 100, floor(avg_groundedness * 100 * 100 + 0.5) / 100, floor(avg_relevancy * 100 * 100 + 0.5) / 100, floor(avg_retrieval_recall * 100 * 100 + 0.5) / 100), chr(10) order by group_id) as lines from stats
) select replace(printf('# Validation report\\n\\n| Metric | Value |\\n| :--- | :--- |\\n| Overall score | %.2f%% |\\n| Success rate | %.1f%% |\\n| Largest gap | %.2f%% (limit 20%%) |\\n\\n| Group | Tests | Success rate | Overall | Groundedness | Relevancy | Recall |\\n| :--- | :---: | :---: | :---: | :---: | :---: | :---: |\\n',
  floor(global_avg_overall_score * 100 * 100 + 0.5) / 100, floor(global_success_rate * 100 * 10 + 0.5) / 10, floor(max_gap * 100 * 100 + 0.5) / 100), '\\n', chr(10)) || lines || case when passed then replace('\\n\\n## Passed\\n', '\\n', chr(10)) else replace('\\n\\n## Failed\\n\\n- groups below the minimum: ', '\\n', chr(10)) || below || case when disparity then chr(10) || '- the gap exceeds its limit' else '' end || chr(10) end as report from checked, lines""",
    "extract_json": f"with {sql.REPLIES} select reply_id, json, error from parsed",
    "golden_sample": f"with {sql.CHUNKS} select doc_id, replace(left(raw_chunk, 200), chr(10), ' ') as snippet from (select * from chunks order by ordinal limit 100) where length(raw_chunk) > 100 order by md5('golden' || doc_id), doc_id limit 20",
    "case_ids": f"with {sql.CHUNKS} select doc_id, printf('%s_%03d', {_CODE}, doc_id) as case_id, printf('GOLD_%03d_%s', doc_id, left({_CODE}, 3)) as golden_id from chunks",
    "session_title": f"select conv_id, array_to_string(list_filter(string_split_regex(text, '{sql.WS}'), lambda t: t <> '')[1:4], ' ') as title from (select conv_id, arg_min(text, turn) as text from conversations where role = 'user' group by conv_id)",
    "traffic_light": f"""with {RUN} select query_id, case when agent_confidence >= 0.7 then 'green' when agent_confidence >= 0.4 then 'yellow' else 'red' end as confidence,
  case when 1 - groundedness <= 0.3 then 'green' when 1 - groundedness <= 0.6 then 'yellow' else 'red' end as hallucination from results where status = 'success'""",
    "response_report": f"""with {sql.ANSWERS}, whole as (select conv_id, turn, replace('# Report\\n\\n**Query:** ', '\\n', chr(10)) || coalesce(query, '') || replace('\\n\\n## Answer\\n\\n', '\\n', chr(10)) || coalesce(answer, 'No answer') || replace('\\n\\n## Groundedness\\n\\n**', '\\n', chr(10)) || printf('%.2f', floor({_GROUNDED} * 100 + 0.5) / 100) || replace('** / 1.0\\n\\n## Sources\\n', '\\n', chr(10))
  || case when len(context) > 0 then array_to_string(list_transform(context, lambda c, i: chr(10) || '### Source ' || i || chr(10) || chr(10) || c || chr(10)), '') else chr(10) || 'No sources.' || chr(10) end as report from answers)
select conv_id, turn, length(report) as n_chars, md5(report) as report_md5 from whole""",
}
