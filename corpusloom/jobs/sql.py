"""SQL of the oracles: pieces that several of them share."""

from __future__ import annotations

from corpusloom.functions.text import PUNCTUATION, STOPWORDS
from corpusloom.sources.tables import AGENT_REPLIES, CUT, MIX, STEP

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{WS}'), lambda t: t <> '')"


def metric_tokens(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOPWORDS)
    bare = f"translate(lower(coalesce({text}, '')), '{PUNCTUATION.replace(chr(39), chr(39) * 2)}', '')"
    return f"list_distinct(list_filter(string_split_regex({bare}, '{WS}'), lambda t: length(t) > 1 and not list_contains([{stops}], t)))"


CHUNKS = """chunks as (
  select doc_id, upper(lang) || '_' || source || '_' || cast(doc_id as varchar) as chunk_id, coalesce(text, '') as raw_chunk,
         source as data_source_type, lang as company_name, doc_id as ordinal
  from documents
)"""

QUERIES = """queries as (
  select item_id as query_id, coalesce(text, '') as query, cast(e.embedding as double[]) as vector
  from benchmark left join embeddings e on e.vec_id = item_id
)"""

def bm25(queries: str) -> str:
    """CTEs of the chunks, the queries and their lexical scores."""
    return f"""{CHUNKS}, {queries}, tokens as (
  select doc_id, {words("raw_chunk")} as tokens from chunks
), corpus as (
  select count(*) as n_docs, sum(len(tokens)) as n_tokens, sum(len(tokens)) / count(*) as avgdl from tokens
), tf as (
  select doc_id, dl, t, count(*) as tf from (select doc_id, len(tokens) as dl, unnest(tokens) as t from tokens) group by all
), raw as (
  select t, count(*) as df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) as raw_idf from tf, corpus group by t
), terms as (
  select t, df, raw_idf, case when raw_idf < 0 then 0.25 * (select avg(raw_idf) from raw) else raw_idf end as idf from raw
), asked as (
  select query_id, t, count(*) as times from (select query_id, unnest({words("query")}) as t from queries) group by all
), lexical as (
  select query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as bm25
  from tf join asked using (t) join terms using (t), corpus group by query_id, doc_id
), bounds as (
  select query_id, case when count(l.doc_id) < any_value(n_docs) then least(coalesce(min(bm25), 0), 0) else min(bm25) end as least,
         case when count(l.doc_id) < any_value(n_docs) then greatest(coalesce(max(bm25), 0), 0) else max(bm25) end as most
  from queries left join lexical l using (query_id), corpus group by query_id
)"""


BM25 = bm25(QUERIES)


def scored(where: str = "true", each_source: bool = False) -> str:
    """The CTE `scored` after those of BM25."""
    group = "query_id, data_source_type" if each_source else "query_id"
    return f"""pairs as (
  select q.query_id, c.doc_id, c.data_source_type, c.ordinal, list_cosine_similarity(q.vector, cast(e.embedding as double[])) as cosine,
         case when b.most = b.least then 0.5 else (coalesce(l.bm25, 0) - b.least) / (b.most - b.least) end as keyword
  from chunks c cross join queries q join bounds b using (query_id)
  left join embeddings e on e.vec_id = c.doc_id left join lexical l on l.query_id = q.query_id and l.doc_id = c.doc_id
  where {where}
), scaled as (
  select *, coalesce(max(cosine) over (partition by {group}), 1.0) as top from pairs
), scored as (
  select query_id, doc_id, data_source_type, ordinal, case when top > 0 then coalesce(cosine, 0) / top else 0 end as semantic, keyword,
         0.7 * case when top > 0 then coalesce(cosine, 0) / top else 0 end + 0.3 * keyword as final_score
  from scaled
)"""


TOP = "ranked as (select *, row_number() over (partition by {by} order by round(final_score, 9) desc, ordinal) as rank from scored)"

ANSWERS = """answers as (
  select conv_id, turn, query, answer, list_filter([a, b], lambda x: x is not null) as context from (
    select conv_id, turn, role, text as query, lead(text) over w as answer, lead(role) over w as next_role, lag(text, 2) over w as a, lag(text, 1) over w as b
    from conversations window w as (partition by conv_id order by turn)
  ) where role = 'user' and next_role = 'assistant'
)"""

#: The CTE `stats` of groups, after `results`.
GROUPS = """stats as (
  select case when contains(query_id, '_') then split_part(query_id, '_', 1) else 'UNKNOWN' end as group_id, count(*) as num_tests, count(*) filter (status = 'success') as num_success,
         coalesce(avg(coalesce(overall_score, 0)) filter (status = 'success'), 0) as avg_overall_score, coalesce(avg(coalesce(groundedness, 0)) filter (status = 'success'), 0) as avg_groundedness,
         coalesce(avg(coalesce(relevancy, 0)) filter (status = 'success'), 0) as avg_relevancy, coalesce(avg(coalesce(retrieval_recall, 0)) filter (status = 'success'), 0) as avg_retrieval_recall,
         count(*) filter (status = 'success') / count(*) as success_rate
  from results group by 1
)"""

TELEMETRY = """parsed as (
  select *, cast(json_extract(props, '$.k') as integer) as k from events
), telemetry as (
  select event_id, ts, value as latency_ms, case when event_type = 'error' then 500 else 200 end as status, k * 100 as tokens, k % 2 as rag_hit, event_type, k % 3 <> 0 as detailed, case when event_type = 'view' then '/' else '/analyze' end as path from parsed
), latest as (select * from telemetry order by ts desc, event_id desc limit 100)"""


def extracted(table: str, keep: str, column: str = "reply", name: str = "parsed") -> str:
    """CTEs that end in `name`: the columns to keep, and json and error of a text column, as extract_json has them."""
    return f"""{name}_bodies as (
  select *, case when regexp_matches(plain, '(?s)```(?:json)?\\s*(.*?)\\s*```') then regexp_extract(plain, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) else plain end as body
  from (select *, regexp_replace({column}, '^{WS}|{WS}$', '', 'g') as plain from {table})
), {name}_spans as (
  select *, case when o then strpos(body, '{{') else strpos(body, '[') end as first,
         case when strpos(reverse(body), case when o then '}}' else ']' end) > 0 then length(body) - strpos(reverse(body), case when o then '}}' else ']' end) + 1 else 0 end as last
  from (select *, strpos(body, '{{') > 0 and (strpos(body, '[') = 0 or strpos(body, '{{') < strpos(body, '[')) as o from {name}_bodies)
), {name} as (
  select {keep}, case when error is null then found end as json, error from (
    select *, case when first = 0 then 'none found' when last < first then 'no closer' when not json_valid(found) then 'parse error' end as error
    from (select *, substr(body, first, greatest(last - first + 1, 0)) as found from {name}_spans)
  )
)"""


_SAFE = r"translate(regexp_replace(coalesce(text, ''), '[\x00-\x1F\"\\]', ' ', 'g'), '<>?#~', '     ')"
_HALF = f"cast(floor(length({_SAFE}) / 2) as integer)"


def form_of(forms: int, turn: int = 0) -> str:
    return f"(abs(item_id) * {MIX} + {turn * STEP}) // {CUT} % {forms}"


def agent_reply(cases: dict[int, str], turn: int = 0, name: str = "replies") -> str:
    """The CTE of one agent's replies in a pass, with the marks of a case filled in."""
    marks = {"?": "item_id", "#": "printf('%02d', abs(item_id) * 37 % 100)", "~": _SAFE, "<": f"left({_SAFE}, {_HALF})", ">": f"substr({_SAFE}, {_HALF} + 1)"}

    def filled(case: str) -> str:
        text = case.replace("'", "''").replace("\n", "' || chr(10) || '")
        return "'" + "".join(f"' || {marks[c]} || '" if c in marks else c for c in text) + "'"

    return f"""{name} as (
  select item_id as reply_id, coalesce(text, '') as prompt, case {form_of(len(cases), turn)} {" ".join(f"when {k} then {filled(v)}" for k, v in cases.items())} end as reply from benchmark
)"""


REPLIES = f"{agent_reply(AGENT_REPLIES['planner'])}, {extracted('replies', 'reply_id, prompt, reply')}"
