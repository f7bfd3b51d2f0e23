"""Reports, and the tables that pass through files on their way: cases, results and group statistics as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import scores as S
from corpusloom.functions.text import stripped, token_estimate
from corpusloom.jobs import evaluation, replies, retrieval, sql, validation
from corpusloom.jobs.validation import RUN, results
from corpusloom.operators import evaluation as E
from corpusloom.sources.files import read_each, read_envelope, read_report, unique, write_each, write_envelope, write_report
from corpusloom.sources.storage import new_path, shared_folder, through_json
from corpusloom.sources.tables import answers, chunks, table

#: The answer when nothing was found, and characters of a source that a judge reads.
NOTHING_FOUND, SOURCE_CHARS = "I couldn't find relevant information to answer your query.", 2000
#: What the cards of a run must reach.
CARDS = {"success_rate": 0.9, "overall_score": 0.8, "execution_time": 300.0, "groundedness": 0.95}
#: One source in so many is a bare name in plain_source_blocks; cases that are run again after they failed.
BARE, AGAIN = 3, 10
#: The least fused score of a chunk that an answer is written from.
USABLE = 0.5


def _digest(spark_rows: DataFrame, keys: list[str], text: F.Column) -> DataFrame:
    return spark_rows.select(*keys, F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): the Markdown report of each case that has an answer: answer, scores, sources numbered from 1, decision and passes. Its headings are fixed."""
    evaluated = replies.evaluator_reply(spark, sf_dir).select(F.col("reply_id").alias("item_id"), "confidence", "hallucination")
    passes = replies.retry_control(spark, sf_dir).select(F.col("reply_id").alias("item_id"), "iterations", "decision")
    rows = validation._answered(spark, sf_dir).where("answer is not null").join(evaluated, "item_id").join(passes, "item_id")
    one = lambda c, i: F.concat(F.lit("\n### Source "), (i + 1).cast("string"), F.lit("\n\n- **Company:** "), F.coalesce(c["company_name"], F.lit("Unknown")), F.lit("\n- **Type:** "), F.coalesce(c["data_source_type"], F.lit("Unknown")), F.lit("\n- **Date:** Unknown\n- **Ticker:** N/A\n"))
    sources = F.array_join(F.transform("found", one), "")
    text = F.concat(
        F.lit("# Report\n\n**Query:** "), "query", F.lit("\n\n---\n\n## Answer\n\n"), "answer",
        F.lit("\n\n---\n\n## Confidence Score\n\n**"), S.shown(F.col("confidence")), F.lit("** / 1.0\n\n## Hallucination Score\n\n**"), S.shown(F.col("hallucination")), F.lit("** / 1.0\n\n---\n\n## Sources\n\n"),
        F.when(F.size("found") > 0, sources).otherwise("\nNo sources available.\n"),
        F.lit("\n---\n\n## Metadata\n\n- **Evaluation:** "), "decision", F.lit("\n- **Iterations:** "), F.col("iterations").cast("string"), F.lit("\n"),
    )
    return rows.select("query_id", text.alias("text"))


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_reports(spark, sf_dir), ["query_id"], F.col("text"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports, each written as a file of its own with a name that no other has, and read again: the file's name begins with the time of the case's event."""
    stamp = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    named = _reports(spark, sf_dir).select(F.concat(unique("response", stamp), F.lit("_"), "query_id").alias("name"), "text")
    run = write_each(named, f"{shared_folder(spark)}/reports")
    parts = F.split("name", "_")
    read = read_each(spark, run).select(F.array_join(F.slice(parts, 5, 9), "_").alias("query_id"), F.array_join(F.slice(parts, 1, 3), "_").alias("stem"), "text")
    return _digest(read, ["query_id", "stem"], F.col("text"))


def golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases from a seeded sample of chunks and the replies to them, in order, written with an envelope and read again: replies without both keys make none."""
    sample = evaluation.golden_sample(spark, sf_dir, with_order=True)
    first = replies.golden_reply(spark, sf_dir).orderBy("reply_id").limit(evaluation.SAMPLED)  # no more are asked for
    made = first.withColumn("i", F.row_number().over(Window.orderBy("reply_id")))
    cases = sample.join(made.select("i", "query", "fact"), "i").join(chunks(spark, sf_dir).select("doc_id", "chunk_id", F.upper("company_name").alias("ticker"), "company_name", "data_source_type"), "doc_id")
    form = cases.select(
        F.format_string("GOLD_%03d_%s", "i", F.left(F.coalesce("ticker", F.lit("UNKNOWN")), F.lit(3))).alias("query_id"),
        "query",
        F.array("fact").alias("expected_facts"),
        F.array("chunk_id").alias("expected_chunk_ids"),
        F.struct(F.coalesce("ticker", F.lit("UNKNOWN")).alias("ticker"), F.col("company_name").alias("company"), F.col("data_source_type").alias("source")).alias("metadata"),
    )
    path = new_path(spark, "golden")
    write_envelope(form, path, "sample", F.current_timestamp())
    read = read_envelope(spark, path, "query_id: string, query: string, expected_facts: array<string>, expected_chunk_ids: array<string>, metadata: struct<ticker:string,company:string,source:string>")
    return read.select("query_id", "query", F.array_join("expected_facts", "|").alias("facts"), F.array_join("expected_chunk_ids", "|").alias("chunk_ids"), "metadata.ticker", "metadata.company", "metadata.source")


def source_text(sources: F.Column) -> F.Column:
    """Sources (content, plain) as numbered blocks, each cut at SOURCE_CHARS: a record's content, or what a source without one is as text."""
    block = lambda s, i: F.concat(F.lit("--- Source "), (i + 1).cast("string"), F.lit(" ---\n"), F.left(F.coalesce(s["content"], s["plain"], F.lit("")), F.lit(SOURCE_CHARS)), F.lit("\n\n"))
    return F.array_join(F.transform(sources, block), "")


def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The found chunks of each case as blocks for a judge, each cut at SOURCE_CHARS, which is the feature."""
    source = lambda c: F.struct(c["raw_chunk"].alias("content"), F.lit(None).cast("string").alias("plain"))
    return _digest(validation._answered(spark, sf_dir).withColumn("sources", F.transform("found", source)), ["query_id"], source_text(F.col("sources")))


def plain_source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of sources of which every BARE-th is a bare name instead of a record with content: that is then the text."""
    rows = validation._answered(spark, sf_dir)
    source = lambda c, i: F.struct(F.when(i % BARE != BARE - 1, c["raw_chunk"]).alias("content"), c["chunk_id"].alias("plain"))
    return _digest(rows.withColumn("sources", F.transform("found", source)), ["query_id"], source_text(F.col("sources")))


def prompt_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one prompt: system texts with an empty line behind, user texts as they are, assistant texts left out."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role").isin("system", "user"))
    text = F.coalesce("text", F.lit(""))
    part = F.struct("turn", F.when(F.col("role") == "system", F.concat(text, F.lit("\n\n"))).otherwise(text).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return _digest(whole, ["conv_id"], F.array_join(F.transform("parts", lambda p: p["text"]), ""))


def synthesis_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a synthesis returns for each query: of no usable chunks the fixed answer with confidence 0, else the answer, with no confidence."""
    usable = retrieval._search(spark, sf_dir).where(F.col("final_score") >= USABLE).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.min_by("doc_id", "rank").alias("best"))
    best = usable.join(chunks(spark, sf_dir).select(F.col("doc_id").alias("best"), "raw_chunk"), "best")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(best, "query_id", "left")
    return rows.select("query_id", F.md5(F.coalesce("raw_chunk", F.lit(NOTHING_FOUND))).alias("answer_md5"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.when(F.col("n_sources").isNull(), 0.0).alias("confidence"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("conv_id", "turn", token_estimate(F.col("query"), F.col("answer")).alias("tokens"))


def boost_from_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts of the groups of a report in the older form, whose groups are sectors and market caps, and of one in the present form, whose groups are companies; both written as files and read again."""
    cut = E.slice_stats(results(spark, sf_dir)).where("slice <> 'all'").select("slice", F.col("value").alias("group_id"), "avg_overall_score", F.col("num_tests").alias("count"))
    older, present = new_path(spark, "older_report"), new_path(spark, "bias_report")
    write_report(cut, older, slices=cut)
    write_report(E.group_stats(results(spark, sf_dir)), present)
    return E.boosts(read_report(spark, older)).unionByName(E.boosts(read_report(spark, present)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def bias_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as one JSON text, read back by path: whether all passed, how many groups, and the scores of the groups in order."""
    stats = E.group_stats(results(spark, sf_dir))
    groups = stats.agg(F.array_sort(F.collect_list(F.struct("group_id", F.round("avg_overall_score", 6).alias("avg_overall_score"), "num_tests"))).alias("per_group"))
    report = E.bias_check(stats).crossJoin(F.broadcast(groups)).select(F.to_json(F.struct(F.col("passed").alias("bias_passed"), "per_group", F.struct(F.split("below", ",").alias("per_group_thresholds"), F.col("disparity").alias("disparity_failure")).alias("failures"))).alias("report"))
    read = F.from_json("report", "struct<bias_passed: boolean, per_group: array<struct<group_id: string, avg_overall_score: double, num_tests: bigint>>, failures: struct<disparity_failure: boolean>>")
    lines = F.transform(read["per_group"], lambda g: F.concat_ws(":", g["group_id"], g["num_tests"].cast("string"), S.shown(g["avg_overall_score"], 4)))
    return report.select(read["bias_passed"].alias("bias_passed"), F.size(read["per_group"]).cast("long").alias("n_groups"), F.array_join(lines, ",").alias("groups"), read["failures"]["disparity_failure"].alias("disparity_failure"))


def results_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's results, written as JSON and read again, with their summary and whether all criteria are met."""
    totals = E.summary(through_json(results(spark, sf_dir), "results"))
    return _rounded(totals.select("num_tests", "num_success", "success_rate", "avg_overall_score").crossJoin(F.broadcast(E.acceptance(totals).select("all_criteria_met"))))


def run_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each card of a run: its title, value, and whether it reaches its limit (time: stays below)."""
    totals = E.summary(results(spark, sf_dir)).select("success_rate", F.col("avg_overall_score").alias("overall_score"), F.col("avg_execution_time").alias("execution_time"), F.col("avg_groundedness").alias("groundedness"))
    cards = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("value"), (F.col(name) < limit if name == "execution_time" else F.col(name) >= limit).alias("passed")) for name, limit in CARDS.items())))
    return totals.select(cards.alias("c")).select(F.initcap(F.replace(F.col("c.name"), F.lit("_"), F.lit(" "))).alias("title"), F.round("c.value", 6).alias("value"), "c.passed")


def slice_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of both slices, one below the other."""
    cut = E.slice_stats(results(spark, sf_dir))
    return _rounded(cut.where("slice = 'sector'").unionByName(cut.where("slice = 'market_cap'")).select("slice", "value", "num_tests", "avg_overall_score"))


def payload_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's payload as an open map: its id and text are taken out, all else is metadata; null values have no key."""
    rows = chunks(spark, sf_dir)
    payload = F.map_from_arrays(F.array(*map(F.lit, rows.columns)), F.array(*(F.col(c).cast("string") for c in rows.columns)))
    metadata = F.map_filter(payload, lambda k, v: ~k.isin("chunk_id", "raw_chunk") & v.isNotNull())
    pairs = F.array_sort(F.transform(F.map_entries(metadata), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("chunk_id", F.size(metadata).cast("long").alias("n_keys"), F.array_join(pairs, "&").alias("metadata"))


def first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a chunk's texts that isn't empty (text, else its title, else its source); chunks with none are left out. Cut for an inspector, who sees marks only where it is cut, as a case's target, which always ends in them, and for a prompt."""
    docs = table(spark, sf_dir, "documents")
    filled = lambda c: F.nullif(c, F.lit(""))
    text = F.coalesce(filled(stripped(F.col("text"))), filled(F.col("lang")), filled(F.col("source")))
    clean = F.replace(text, F.lit('"'), F.lit(""))
    return docs.where(text.isNotNull()).select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("text_md5"), F.concat(F.left(clean, F.lit(200)), F.when(F.length(clean) > 200, "...").otherwise("")).alias("shown"), F.concat(F.left(clean, F.lit(200)), F.lit("...")).alias("target_text"), F.length(F.left(clean, F.lit(1000))).cast("long").alias("prompt_chars"))


def choose_cases(rows: DataFrame, wanted: DataFrame | tuple | list | None = None, limit: int | None = 0, by: str = "query_id", order: str = "item_id") -> DataFrame:
    """Cases of the ids wanted, in a list or a table (by), none meaning all; at most so many in order, 0 or none meaning all. Unknown, repeated and null ids choose nothing more."""
    if isinstance(wanted, DataFrame):
        rows = rows.join(wanted.select(by), by, "left_semi")
    elif wanted:
        rows = rows.where(F.col(by).isin(*wanted))
    return rows.orderBy(order).limit(limit) if limit else rows


def chosen_cases(spark: SparkSession, sf_dir: str, wanted: tuple = (), limit: int | None = 0) -> DataFrame:
    """Cases of some ids, none meaning all, and at most so many, 0 or none meaning all, in order."""
    return choose_cases(validation.cases(spark, sf_dir), wanted, limit).select("query_id", "sector", "market_cap")


def failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first AGAIN cases, in order, of those that failed in the run."""
    failed = results(spark, sf_dir).where("status = 'failed'").select("query_id")
    return choose_cases(validation.cases(spark, sf_dir), failed, AGAIN).select("query_id", "sector", "market_cap")


def newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, the newest first (the largest id), with their number of turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return turns.orderBy(F.desc("conv_id"))


def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's time as names of files, as a month in words, in ISO form, and back from seconds since 1970."""
    at = F.col("ts").cast("timestamp")
    labels = {"stamp": "yyyyMMdd_HHmmss", "month": "MMMM yyyy", "iso": "yyyy-MM-dd'T'HH:mm:ss"}
    back = F.date_format(F.timestamp_seconds(F.unix_timestamp(at)), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", *(F.date_format(at, form).alias(name) for name, form in labels.items()), back.alias("back"))


def _nl(text: str) -> str:
    """A text with line ends as an SQL expression."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _shown(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', floor(({x}) * {10**digits} + 0.5) / {10**digits})"


def _digest_sql(keys: str, text: str, rest: str) -> str:
    return f"select {keys}, length({text}) as n_chars, md5({text}) as text_md5 from {rest}"


_SUMMARY = """summed as (
  select count(*) as num_tests, count(*) filter (status = 'success') as num_success, count(*) filter (status = 'success') / count(*) as success_rate, avg(overall_score) filter (status = 'success') as overall_score,
         avg(execution_time) filter (status = 'success') as execution_time, avg(groundedness) filter (status = 'success') as groundedness from results
)"""
_FOUND = f"(select t.query_id as item_id, list({{'i': t.rank, 'chunk_id': upper(d.lang) || '_' || d.source || '_' || d.doc_id, 'company_name': d.lang, 'data_source_type': d.source, 'text': coalesce(d.text, '')}} order by t.rank) as listed from ({retrieval.ORACLE_SQL['hybrid_topk']}) t join documents d using (doc_id) group by t.query_id)"
_SOURCE = f"{_nl(chr(10) + '### Source ')} || c.i || {_nl(chr(10) * 2 + '- **Company:** ')} || coalesce(c.company_name, 'Unknown') || {_nl(chr(10) + '- **Type:** ')} || coalesce(c.data_source_type, 'Unknown') || {_nl(chr(10) + '- **Date:** Unknown' + chr(10) + '- **Ticker:** N/A' + chr(10))}"
_REPORT = f"""{_nl("# Report\n\n**Query:** ")} || r.query || {_nl("\n\n---\n\n## Answer\n\n")} || r.answer || {_nl("\n\n---\n\n## Confidence Score\n\n**")} || {_shown("e.confidence", 2)} || {_nl("** / 1.0\n\n## Hallucination Score\n\n**")}
  || {_shown("e.hallucination", 2)} || {_nl("** / 1.0\n\n---\n\n## Sources\n\n")} || case when len(listed) > 0 then array_to_string(list_transform(listed, lambda c: {_SOURCE}), '') else {_nl("\nNo sources available.\n")} end
  || {_nl("\n---\n\n## Metadata\n\n- **Evaluation:** ")} || p.decision || {_nl("\n- **Iterations:** ")} || p.iterations || chr(10)"""
_TEXTS = "coalesce(nullif(" + f"regexp_replace(text, '^{sql.WS}|{sql.WS}$', '', 'g')" + ", ''), nullif(lang, ''), nullif(source, ''))"

QUERIES = {
    "full_report": full_report,
    "report_files": report_files,
    "golden_cases": golden_cases,
    "source_blocks": source_blocks,
    "plain_source_blocks": plain_source_blocks,
    "prompt_by_role": prompt_by_role,
    "synthesis_shell": synthesis_shell,
    "token_estimates": token_estimates,
    "boost_from_report": boost_from_report,
    "bias_report_json": bias_report_json,
    "results_summary": results_summary,
    "run_cards": run_cards,
    "slice_union": slice_union,
    "payload_metadata": payload_metadata,
    "first_text": first_text,
    "chosen_cases": chosen_cases,
    "failed_cases": failed_cases,
    "newest_sessions": newest_sessions,
    "date_labels": date_labels,
}
ORACLE_SQL = {
    "full_report": f"""with {RUN}, reports as (
  select r.query_id, {_REPORT} as report from results r join {_FOUND} f using (item_id) join ({replies.ORACLE_SQL["evaluator_reply"]}) e on e.reply_id = r.item_id join ({replies.ORACLE_SQL["retry_control"]}) p on p.reply_id = r.item_id where r.answer is not null
) {_digest_sql("query_id", "report", "reports")}""",
    "source_blocks": f"""with {RUN}, blocks as (
  select c.query_id, coalesce(array_to_string(list_transform(listed, lambda c: '--- Source ' || c.i || ' ---' || chr(10) || left(c.text, {SOURCE_CHARS}) || chr(10) || chr(10)), ''), '') as blocks from cases c left join {_FOUND} f using (item_id)
) {_digest_sql("query_id", "blocks", "blocks")}""",
    "plain_source_blocks": f"""with {RUN}, blocks as (
  select c.query_id, coalesce(array_to_string(list_transform(listed, lambda c: '--- Source ' || c.i || ' ---' || chr(10) || left(case when c.i % {BARE} = 0 then c.chunk_id else c.text end, {SOURCE_CHARS}) || chr(10) || chr(10)), ''), '') as blocks from cases c left join {_FOUND} f using (item_id)
) {_digest_sql("query_id", "blocks", "blocks")}""",
    "prompt_by_role": f"""with whole as (
  select conv_id, string_agg(case when role = 'system' then coalesce(text, '') || chr(10) || chr(10) else coalesce(text, '') end, '' order by turn) as prompt from conversations where role in ('system', 'user') group by conv_id
) {_digest_sql("conv_id", "prompt", "whole")}""",
    "synthesis_shell": f"""with usable as (select query_id, count(*) as n_sources, arg_min(doc_id, rank) as best from ({retrieval.ORACLE_SQL["hybrid_topk"]}) where final_score >= {USABLE} group by query_id)
select b.item_id as query_id, md5(case when u.query_id is null then {_nl(NOTHING_FOUND)} else coalesce(d.text, '') end) as answer_md5, coalesce(n_sources, 0) as n_sources, case when u.query_id is null then 0.0 end as confidence
from benchmark b left join usable u on u.query_id = b.item_id left join documents d on d.doc_id = u.best""",
    "token_estimates": f"with {sql.ANSWERS} select conv_id, turn, cast(floor((length(coalesce(query, '')) + length(coalesce(answer, ''))) / 4) as integer) as tokens from answers",
    "boost_from_report": f"""with {RUN}, {sql.GROUPS}, slices as (
  select sector as group_id, avg(overall_score) as score from results group by sector union all select market_cap, avg(overall_score) from results group by market_cap
) select group_id, 1.05 as boost from slices where score < 0.5 union all select group_id, 1.05 from stats where avg_overall_score < 0.5""",
    "report_files": f"""with {RUN}, reports as (
  select r.query_id, {_REPORT} as report from results r join {_FOUND} f using (item_id) join ({replies.ORACLE_SQL["evaluator_reply"]}) e on e.reply_id = r.item_id join ({replies.ORACLE_SQL["retry_control"]}) p on p.reply_id = r.item_id where r.answer is not null
) {_digest_sql("query_id, 'response_20240101_000000' as stem", "report", "reports")}""",
    "golden_cases": f"""with {sql.CHUNKS}, sampled as (
  select *, row_number() over (order by md5('golden' || doc_id), doc_id) as i from (select * from chunks order by ordinal limit 100) where length(raw_chunk) > 100 qualify i <= 20
), replied as (
  select query, fact, row_number() over (order by reply_id) as i from ({replies.ORACLE_SQL["golden_reply"]})
) select printf('GOLD_%03d_%s', i, left(coalesce(upper(company_name), 'UNKNOWN'), 3)) as query_id, query, coalesce(fact, '') as facts, coalesce(chunk_id, '') as chunk_ids, coalesce(upper(company_name), 'UNKNOWN') as ticker, company_name as company, data_source_type as source
from sampled join replied using (i)""",
    "bias_report_json": f"""with {RUN}, {sql.GROUPS}, checked as (select max(avg_overall_score) - min(avg_overall_score) > 0.2 as disparity, count(*) filter (avg_overall_score < 0.5) as low, count(*) as n from stats)
select n > 0 and not disparity and low = 0 as bias_passed, n as n_groups, (select string_agg(group_id || ':' || num_tests || ':' || {_shown("round(avg_overall_score, 6)", 4)}, ',' order by group_id) from stats) as groups, disparity as disparity_failure from checked""",
    "results_summary": f"""with {RUN}, {_SUMMARY} select num_tests, num_success, round(success_rate, 6) as success_rate, round(overall_score, 6) as avg_overall_score,
  coalesce(execution_time, 999) < 300 and coalesce(groundedness, 0) >= 0.95 and coalesce(overall_score, 0) >= 0.8 and coalesce(success_rate, 0) >= 0.9 as all_criteria_met from summed""",
    "run_cards": f"""with {RUN}, {_SUMMARY}, cards as (
  {" union all ".join(f"select '{name}' as name, {name} as value, {name} {'<' if name == 'execution_time' else '>='} {limit} as passed from summed" for name, limit in CARDS.items())}
) select array_to_string(list_transform(string_split(name, '_'), lambda x: upper(x[1]) || x[2:]), ' ') as title, round(value, 6) as value, passed from cards""",
    "slice_union": f"""with {RUN} select 'sector' as slice, sector as value, count(*) as num_tests, round(coalesce(avg(overall_score), 0), 6) as avg_overall_score from results group by sector
union all select 'market_cap', market_cap, count(*), round(coalesce(avg(overall_score), 0), 6) from results group by market_cap""",
    "payload_metadata": f"""with {sql.CHUNKS} select chunk_id, len(pairs) as n_keys, array_to_string(list_sort(pairs), '&') as metadata from (
  select chunk_id, list_filter(['doc_id=' || doc_id, 'data_source_type=' || data_source_type, 'company_name=' || company_name, 'ordinal=' || ordinal], lambda x: x is not null) as pairs from chunks)""",
    "first_text": f"""with texts as (select doc_id, replace({_TEXTS}, '"', '') as clean from documents where {_TEXTS} is not null)
select doc_id, length(clean) as n_chars, md5(clean) as text_md5, left(clean, 200) || case when length(clean) > 200 then '...' else '' end as shown, left(clean, 200) || '...' as target_text, length(left(clean, 1000)) as prompt_chars from texts""",
    "failed_cases": f"with {RUN} select query_id, sector, market_cap from results where status = 'failed' order by item_id limit {AGAIN}",
    "chosen_cases": f"with {RUN} select query_id, sector, market_cap from cases",
    "newest_sessions": "select conv_id, count(*) as n_turns from conversations group by conv_id order by conv_id desc",
    "date_labels": "select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp, strftime(ts, '%B %Y') as month, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, strftime(ts, '%Y-%m-%d %H:%M:%S') as back from events",
}
