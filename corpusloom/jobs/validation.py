"""A validation run: test cases, searched, answered and measured; its rows are what statistics of groups and runs read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.functions import scores as S
from corpusloom.functions.text import company_code, metric_tokens
from corpusloom.jobs import replies, retrieval, sql
from corpusloom.sources.storage import made_once, stored, through_json, written
from corpusloom.sources.tables import AGENT_REPLIES, chunks, table

#: Every so many cases one's run fails, one expects no facts, one no sections, one's answer has words of another chunk, and one's no marks of its sources.
FAILED, NO_FACTS, NO_SECTIONS, MADE_UP, UNMARKED = 11, 5, 4, 3, 6
#: Characters of the best chunk and of another one that such an answer has.
SAID, INVENTED = 400, 200
#: Which chunk is wanted, and which one is made up from, by a case's number.
TARGET, OTHER = (37, 11), (53, 29)
#: Sources that an answer must rest on.
REQUIRED = ("src1", "SRC2", "src3")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, query, target, other): benchmark items with the chunks that each one asks for and is made up from."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("query")).crossJoin(F.broadcast(n))
    at = lambda k: (F.abs("item_id") * k[0] + k[1]) % F.greatest("n", F.lit(1))
    return items.select("item_id", "query", F.when(F.col("item_id") % 3 == 0, F.col("item_id")).otherwise(at(TARGET)).alias("target"), at(OTHER).alias("other"))


def _picked(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """The chunks of some ids (doc_id), written, so that tokens are made of these alone; all others are read and left where they are."""
    return stored(chunks(spark, sf_dir).join(stored(ids.distinct(), "ids"), "doc_id", "left_semi"), "picked")


def cases(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Test cases of the benchmark items: for one in three the chunk of its number should be found, for the others another one. The three longest words of that chunk are the facts, the first two in order the sections. docs: chunks that hold the wanted ones, if they are at hand."""
    items = _items(spark, sf_dir)
    if docs is None:
        docs = _picked(spark, sf_dir, items.select(F.col("target").alias("doc_id")))
    tokens = metric_tokens(F.col("raw_chunk"))
    longest = F.transform(F.slice(F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1, 3), lambda x: x["t"])
    known = docs.select(F.col("doc_id").alias("target"), "chunk_id", "data_source_type", "company_name", F.length("raw_chunk").alias("size"), longest.alias("longest"), F.slice(F.array_sort(tokens), 1, 2).alias("first"))
    return items.join(known, "target", "left").select(
        "item_id",
        "other",
        F.format_string("%s_%03d", F.coalesce("data_source_type", F.lit("none")), "item_id").alias("query_id"),
        "query",
        F.col("chunk_id").alias("target_chunk_id"),
        F.coalesce("company_name", F.lit("none")).alias("sector"),
        F.when(F.col("size") > 2000, "large").otherwise("small").alias("market_cap"),
        F.when(F.col("item_id") % NO_FACTS != NO_FACTS - 1, F.col("longest")).alias("expected_answer_contains"),
        F.when(F.col("item_id") % NO_SECTIONS != NO_SECTIONS - 1, F.col("first")).alias("required_sections"),
    )


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases, written as JSON and read again."""
    read = through_json(cases(spark, sf_dir), "test_cases")
    joined = lambda c: F.array_join(c, "|").alias(c)
    return read.select("query_id", "query", "target_chunk_id", "sector", "market_cap", joined("expected_answer_contains"), joined("required_sections"))


#: Forms of a company's questions: number, text (`~` stands for the company), what the answer should hold, the sources and sections it needs, and how it is judged.
TEMPLATES = (
    (1, "Who is ~?", "~|founded", "encyclopedia", "Overview", "contains"),
    (2, "What did ~ earn last quarter?", "earned|quarter|%", "filing", "Results", "contains"),
    (3, "How has ~ grown within a year?", "growth|year|%", "filing", "Results|Growth", "contains"),
    (4, "What is new at ~?", "~|news", "news", "Developments", "contains"),
    (5, "Give a full account of ~", "~|earned|founded", "filing|encyclopedia|news", "Overview|Results|Developments", "comprehensive"),
)


def template_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for every company (a language and source of the chunks) and template, with the number of chunks that are known of it."""
    forms = spark.createDataFrame(list(TEMPLATES), "number int, text string, expected string, required_sources string, required_sections string, evaluation_type string")
    companies = chunks(spark, sf_dir).groupBy(F.concat_ws(" ", "company_name", "data_source_type").alias("company")).agg(F.count(F.lit(1)).alias("n_chunks"))
    named = lambda c: F.replace(c, F.lit("~"), F.col("company"))
    return companies.crossJoin(F.broadcast(forms)).select(
        F.format_string("%s_%02d", company_code(F.col("company")), "number").alias("query_id"), named(F.col("text")).alias("query"), "company", named(F.col("expected")).alias("expected_answer_contains"), "required_sources", "required_sections", "evaluation_type", "n_chunks"
    )


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, name) for name in ("documents", "embeddings", "benchmark", "events")]


def _answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with the chunks found for them in order, and an answer from these: the best chunk, or its beginning and words of another one. answer is null if the run failed."""
    top, items = stored(retrieval._search(spark, sf_dir).select("query_id", "rank", "doc_id"), "top"), _items(spark, sf_dir)
    known = _picked(spark, sf_dir, top.select("doc_id").union(items.select("target")).union(items.select("other")))
    each = top.join(known.select("doc_id", "chunk_id", "raw_chunk", "company_name", "data_source_type"), "doc_id")
    listed = each.groupBy(F.col("query_id").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "raw_chunk", "company_name", "data_source_type"))).alias("found"))
    other = known.select(F.col("doc_id").alias("other"), F.left("raw_chunk", F.lit(INVENTED)).alias("invented"))
    joined = cases(spark, sf_dir, known).join(listed, "item_id", "left").join(other, "other", "left").withColumn("found", F.coalesce("found", F.array().cast(listed.schema["found"].dataType)))
    best = F.get("found", F.lit(0))["raw_chunk"]
    made_up = F.concat_ws(" ", F.left(best, F.lit(SAID)), "invented")
    answer = F.when(F.col("item_id") % MADE_UP == 1, made_up).otherwise(best)
    number = lambda c: F.concat(F.lit(" ["), c.cast("string"), F.lit("]"))
    marks = F.when(F.col("item_id") % UNMARKED != UNMARKED - 1, F.concat(number(F.col("item_id") % 25), F.lit(" [Source "), (F.col("item_id") % 3 + 1).cast("string"), F.lit("][Document 2]")))
    answer = F.concat_ws("", answer, marks)
    return joined.withColumn("answer", F.when((F.size("found") > 0) & (F.col("item_id") % FAILED != FAILED - 1), answer)).drop("invented", "other")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of a run, which is made once for the files as they are."""
    path = made_once(spark, "answers", _inputs(spark, sf_dir), lambda: written(_answer(spark, sf_dir), "answers"))
    return spark.read.parquet(path)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each case; a failed one has an overall score of 0 and no metrics. Its seconds are those of the event of its number."""
    answer, query = F.col("answer"), F.col("query")
    texts, ids = (F.transform("found", lambda c: c[name]) for name in ("raw_chunk", "chunk_id"))  # noqa: B023
    ok = answer.isNotNull()
    when = lambda c: F.when(ok, c)
    recall = M.soft_recall(F.col("target_chunk_id"), ids)
    cited = M.citations(answer, F.size("found"))
    kinds = F.array_distinct(F.transform("found", lambda c: F.struct(c["company_name"], c["data_source_type"])))
    parts = {
        "groundedness": M.groundedness(answer, texts),
        "answer_relevancy": M.answer_relevancy(query, answer),
        "factual_accuracy": F.when(F.col("expected_answer_contains").isNotNull(), M.found_share(answer, F.col("expected_answer_contains"))),
        "section_completeness": F.when(F.col("required_sections").isNotNull(), M.found_share(answer, F.col("required_sections"))),
    }
    rows = _answered(spark, sf_dir).withColumns({name: when(c) for name, c in parts.items()}).withColumns({"context_relevancy": when(M.context_relevancy(query, texts)), "retrieval_recall": when(recall)})
    overall = F.when(ok, S.overall({name: F.col(name) for name in parts})).otherwise(0.0)
    evaluated = replies.evaluator_reply(spark, sf_dir).select(F.col("reply_id").alias("item_id"), "confidence")
    timed = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("value").alias("seconds")).join(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", "left_semi")
    return rows.join(evaluated, "item_id", "left").join(timed, "item_id", "left").withColumns(
        {
            "status": F.when(ok, "success").otherwise("failed"),
            "overall_score": overall,
            "retrieval_hit": when(F.col("retrieval_recall") > 0.9),
            "num_retrieved_chunks": when(F.size("found")).cast("long"),
            "num_sources": when(F.size(kinds)).cast("long"),
            "citation": F.when(cited["found"] > 0, cited),
            "agent_confidence": when(F.col("confidence")),
            "execution_time": F.coalesce("seconds", F.lit(0.0)),
        }
    )


_SCORES = ("groundedness", "answer_relevancy", "context_relevancy", "section_completeness", "factual_accuracy", "retrieval_recall", "overall_score")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a run, without texts: it is made once for the files as they are, and all statistics read it."""
    path = made_once(spark, "run", _inputs(spark, sf_dir), lambda: written(_measured(spark, sf_dir).drop("found", "query", "answer"), "run"))
    return spark.read.parquet(path)


def validation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).select("query_id", "status", *(F.round(c, 6).alias(c) for c in _SCORES), "retrieval_hit", "num_retrieved_chunks", "num_sources", "agent_confidence", "execution_time")


def metric_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scores are made of: counts of tokens, and the keywords, facts and sections that were found, and those that weren't."""
    rows = _answered(spark, sf_dir).where("answer is not null")
    texts = F.array_join(F.transform("found", lambda c: c["raw_chunk"]), " ")
    tokens = rows.select("*", F.lower("answer").alias("low"), metric_tokens(F.col("answer")).alias("said"), metric_tokens(texts).alias("known"), F.array_sort(metric_tokens(F.col("query"))).alias("asked"))
    lacks = lambda listed: F.filter(listed, lambda x: ~F.contains(F.col("low"), F.lower(x)))
    joined = lambda listed: F.array_join(listed, "|")
    has = lambda listed: F.filter(listed, lambda x: F.contains(F.col("low"), F.lower(x)))
    return tokens.select(
        "query_id",
        F.size(F.array_intersect("said", "known")).cast("long").alias("supported_tokens"),
        F.size("said").cast("long").alias("total_answer_tokens"),
        F.format_string("Found %d/%d query keywords", F.size(has(F.col("asked"))), F.size("asked")).alias("explanation"),
        joined(has(F.col("asked"))).alias("found_keywords"),
        joined(lacks(F.col("asked"))).alias("missing_keywords"),
        joined(has(F.col("expected_answer_contains"))).alias("found_facts"),
        joined(lacks(F.col("expected_answer_contains"))).alias("missing_facts"),
        joined(has(F.col("required_sections"))).alias("found_sections"),
        joined(lacks(F.col("required_sections"))).alias("missing_sections"),
        joined(F.slice(F.transform("found", lambda c: c["chunk_id"]), 1, 5)).alias("first_ids"),
    )


def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each answer with marks of its sources: how many there are, and how well they name these."""
    return run(spark, sf_dir).where("citation is not null").select("query_id", F.col("citation.found").cast("long").alias("citations_found"), *(F.round(f"citation.{c}", 6).alias(c) for c in ("precision", "recall", "f1")))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's rows as statistics read them."""
    return run(spark, sf_dir).select("query_id", "sector", "market_cap", "status", "overall_score", "groundedness", F.col("answer_relevancy").alias("relevancy"), "retrieval_recall", "agent_confidence", "execution_time", *(F.col(f"citation.{c}").alias(f"citation_{c}") for c in ("precision", "recall", "f1")))


RUN = f"""{sql.BM25}, {sql.scored()}, {sql.TOP.format(by="query_id")}, top as (select * from ranked where rank <= 20), found as (
  select t.query_id as item_id, list(c.raw_chunk order by t.rank) as texts, list(c.chunk_id order by t.rank) as ids, count(distinct (c.company_name, c.data_source_type)) as num_sources
  from top t join chunks c using (doc_id) group by t.query_id
), {sql.agent_reply(AGENT_REPLIES["evaluator"])}, {sql.extracted("replies", "reply_id")}, confidences as (
  select reply_id as item_id, coalesce(cast(case when starts_with(json, '{{') then cast(json as json) end->>'$.confidence' as double), 0.5) as confidence from parsed
), items as (
  select item_id, coalesce(b.text, '') as query, c.chunk_id as target_chunk_id, c.data_source_type, c.company_name, length(c.raw_chunk) as size, {sql.metric_tokens("coalesce(b.text, '')")} as asked, {sql.metric_tokens("c.raw_chunk")} as words,
         left(o.raw_chunk, {INVENTED}) as invented
  from (select *, greatest((select count(*) from documents), 1) as n from benchmark) b left join chunks c on c.doc_id = case when item_id % 3 = 0 then item_id else (abs(item_id) * {TARGET[0]} + {TARGET[1]}) % n end
  left join chunks o on o.doc_id = (abs(item_id) * {OTHER[0]} + {OTHER[1]}) % n
), cases as (
  select *, printf('%s_%03d', coalesce(data_source_type, 'none'), item_id) as query_id, coalesce(company_name, 'none') as sector, case when size > 2000 then 'large' else 'small' end as market_cap,
         case when item_id % {NO_FACTS} <> {NO_FACTS - 1} then case when size is not null then list_transform(list_sort(list_transform(words, lambda t: {{'n': -length(t), 't': t}}))[1:3], lambda x: x.t) end end as expected,
         case when item_id % {NO_SECTIONS} <> {NO_SECTIONS - 1} then case when size is not null then list_sort(words)[1:2] end end as sections
  from items
), answered as (
  select c.*, coalesce(texts, []) as texts, coalesce(ids, []) as ids, num_sources, case when len(texts) > 0 and c.item_id % {FAILED} <> {FAILED - 1} then case when c.item_id % {MADE_UP} = 1 then left(texts[1], {SAID}) || coalesce(' ' || invented, '') else texts[1] end || case when c.item_id % {UNMARKED} <> {UNMARKED - 1} then ' [' || (c.item_id % 25) || '] [Source ' || (c.item_id % 3 + 1) || '][Document 2]' else '' end end as answer
  from cases c left join found f on f.item_id = c.item_id
), tokened as (
  select *, {sql.metric_tokens("answer")} as said, {sql.metric_tokens("coalesce(array_to_string(texts, ' '), '')")} as known, lower(answer) as low from answered
), measured as (
  select t.*, case when answer is not null then case when len(said) > 0 then len(list_intersect(said, known)) / len(said) else 0.0 end end as groundedness,
    case when answer is not null then case when length(query) = 0 or length(answer) = 0 then 0.0 when len(asked) = 0 then 1.0 else len(list_filter(asked, lambda x: contains(low, x))) / len(asked) end end as relevancy,
    case when answer is not null then case when len(texts) = 0 then 0.0 when len(asked) = 0 then 1.0 else len(list_filter(texts, lambda c: len(list_filter(asked, lambda x: contains(lower(c), x))) > 0)) / len(texts) end end as context,
    case when answer is not null and sections is not null then case when len(sections) = 0 then 1.0 else len(list_filter(sections, lambda x: contains(low, lower(x)))) / len(sections) end end as completeness,
    case when answer is not null and expected is not null then case when len(expected) = 0 then 1.0 else len(list_filter(expected, lambda x: contains(low, lower(x)))) / len(expected) end end as accuracy,
    case when answer is not null then case when target_chunk_id is null then 0.0 when list_contains(ids, target_chunk_id) then 1.0 when strpos(target_chunk_id, '_') = 0 then 0.0
      when len(list_filter(ids, lambda r: starts_with(r, split_part(target_chunk_id, '_', 1) || '_' || split_part(target_chunk_id, '_', 2)))) > 0 then 0.5
      when len(list_filter(ids, lambda r: starts_with(r, split_part(target_chunk_id, '_', 1)))) > 0 then 0.2 else 0.0 end end as retrieval_recall,
    case when answer is not null then confidence end as agent_confidence, coalesce(e.value, 0.0) as execution_time, case when answer is not null then 'success' else 'failed' end as status
  from tokened t left join confidences using (item_id) left join events e on e.event_id = t.item_id
), cited as (
  select item_id, list_transform(regexp_extract_all(answer, '\\[(?:Source |Document )?(\\d{{1,9}})\\]', 1), lambda x: cast(x as integer)) as marks, len(texts) as n from answered where answer is not null
), known as (
  select item_id, n, marks, list_filter(marks, lambda x: x between 1 and n) as known from cited where len(marks) > 0
), rated as (
  select item_id, len(marks) as citations_found, len(known) / len(marks) as citation_precision, coalesce(len(list_distinct(known)) / nullif(n, 0), 0.0) as citation_recall from known
), results as (
  select measured.*, citations_found, citation_precision, citation_recall, coalesce(2 * citation_precision * citation_recall / nullif(citation_precision + citation_recall, 0), case when citations_found is not null then 0.0 end) as citation_f1, case when answer is not null then least(0.2 * groundedness + 0.6 * relevancy + 0.1 * coalesce(accuracy, 0) + 0.1 * coalesce(completeness, 0), 1.0) else 0.0 end as overall_score from measured left join rated using (item_id)
)"""

_NAMED = "replace({}, '~', company)"
_CODE = "coalesce(nullif(left(upper(regexp_replace(company, '[^\\p{L}\\p{N}]', '', 'g')), 10), ''), 'UNKNOWN')"
_FORMS = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in form) + ")" for form in TEMPLATES)

QUERIES = {"test_cases": test_cases, "template_cases": template_cases, "validation_run": validation_run, "metric_details": metric_details, "citation_scores": citation_scores}
ORACLE_SQL = {
    "citation_scores": f"with {RUN} select query_id, citations_found, round(citation_precision, 6) as precision, round(citation_recall, 6) as recall, round(citation_f1, 6) as f1 from results where citations_found is not null",
    "template_cases": f"""with {sql.CHUNKS}, companies as (select concat_ws(' ', company_name, data_source_type) as company, count(*) as n_chunks from chunks group by 1)
select printf('%s_%02d', {_CODE}, number) as query_id, {_NAMED.format("text")} as query, company, {_NAMED.format("expected")} as expected_answer_contains, required_sources, required_sections, evaluation_type, n_chunks
from companies, (values {_FORMS}) as forms(number, text, expected, required_sources, required_sections, evaluation_type)""",
    "test_cases": f"with {RUN} select query_id, query, target_chunk_id, sector, market_cap, array_to_string(expected, '|') as expected_answer_contains, array_to_string(sections, '|') as required_sections from cases",
    "validation_run": f"""with {RUN} select query_id, status, round(groundedness, 6) as groundedness, round(relevancy, 6) as answer_relevancy, round(context, 6) as context_relevancy, round(completeness, 6) as section_completeness,
  round(accuracy, 6) as factual_accuracy, round(retrieval_recall, 6) as retrieval_recall, round(overall_score, 6) as overall_score, case when answer is not null then retrieval_recall > 0.9 end as retrieval_hit,
  case when answer is not null then len(texts) end as num_retrieved_chunks, case when answer is not null then num_sources end as num_sources, agent_confidence, execution_time from results""",
    "metric_details": f"""with {RUN} select query_id, len(list_intersect(said, known)) as supported_tokens, len(said) as total_answer_tokens, printf('Found %d/%d query keywords', len(list_filter(asked, lambda x: contains(low, x))), len(asked)) as explanation,
  {", ".join(f"array_to_string(list_filter({c}, lambda x: {no}contains(low, lower(x))), '|') as {word}_{name}" for c, name in (("list_sort(asked)", "keywords"), ("expected", "facts"), ("sections", "sections")) for no, word in (("", "found"), ("not ", "missing")))}, array_to_string(ids[1:5], '|') as first_ids from results where answer is not null""",
}
