"""Columns of text, scores and metrics on hand-written rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.functions import scores as S
from corpusloom.functions import text as X
from corpusloom.jobs import reports
from corpusloom.operators import retrieval as R


def one(spark, column, **values):
    """The column's value on a row with these values, given as SQL."""
    return spark.sql("select " + ", ".join(f"{v} as {k}" for k, v in values.items())).select(column.alias("out")).first()["out"]


def test_words_split_at_every_unicode_space(spark):
    assert one(spark, X.words(F.col("t")), t=r"'A b　c,  d E\u001c f'") == ["a", "b", "c,", "d", "e", "f"]
    assert one(spark, X.words(F.col("t")), t="''") == []


def test_metric_tokens(spark):
    assert one(spark, X.metric_tokens(F.col("t")), t="\"What is Inc.'s stock-based x plan, plan?\"") == ["incs", "stockbased", "plan"]
    assert one(spark, X.metric_tokens(F.col("t")), t="'what is the a'") == []
    assert one(spark, X.metric_tokens(F.col("t")), t="cast(null as string)") == []


@pytest.mark.parametrize(
    ("reply", "json", "error"),
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}', None),
        ("```\n[1]\n```", "[1]", None),
        ('so: {"a": [1]} and {"b": 2} end', None, "parse error"),
        ('first [1, {"a": 2}] then', '[1, {"a": 2}]', None),
        ("[1, 2", None, "no closer"),
        ("nothing", None, "none found"),
        ("", None, "none found"),
        ("] [", None, "no closer"),
    ],
)
def test_extract_json(spark, reply, json, error):
    row = X.with_json(spark.createDataFrame([(reply, "x")], "reply string, error string"), "reply").first()
    assert (row["json"], row["error"]) == (json, error)


def test_ids_and_titles(spark):
    assert one(spark, X.company_code(F.col("t")), t="'Amazon.com Inc'") == "AMAZONCOMI"
    assert one(spark, X.company_code(F.col("t")), t="'--'") == "UNKNOWN"
    assert one(spark, X.title(F.col("t")), t="'  How  did it go today'") == "How did it go"
    assert one(spark, X.snippet(F.col("t"), 3), t=r"'a\nbcd'") == "a b"
    assert one(spark, X.token_estimate(F.col("a"), F.col("b")), a="'abc'", b="'de'") == 1


def test_scores(spark):
    assert one(spark, S.min_max(F.col("s"), F.col("a"), F.col("b")), s="1d", a="1d", b="1d") == 0.5
    assert one(spark, S.max_scale(F.col("s"), F.col("m")), s="-1d", m="0d") == 0.0
    assert one(spark, S.max_scale(F.col("s"), F.col("m")), s="-1d", m="2d") == -0.5
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a="array(1d, 0d)", b="array(0d, 0d)") == 0.0
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a="array(3d, 4d)", b="array(3d, 4d)") == pytest.approx(1.0)
    assert one(spark, S.confidence_light(F.col("a")), a="0.7d") == "green"
    assert one(spark, S.hallucination_light(F.col("a")), a="0.61d") == "red"
    assert one(spark, S.shown(F.col("a")), a="0.125d") == "0.13"


@pytest.mark.parametrize(("g", "r", "want"), [(0.5634466308884913, 0.9545454545454546, 0.685416598904971), (0.4427733283665487, 0.849624060150376, 0.5983291017635353), (0.4375, 0.8, 0.5675)])
def test_overall_of_published_runs(spark, g, r, want):
    parts = {"groundedness": F.col("g"), "answer_relevancy": F.col("r"), "factual_accuracy": F.lit(None), "section_completeness": F.lit(None)}
    assert one(spark, S.overall(parts), g=f"{g!r}d", r=f"{r!r}d") == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("g", "r", "want"), [(0.45, 11 / 13, 0.25923076923076926), (0.4305555555555556, 0.75, 0.23611111111111116), (0.5625, 1.0, 0.3125)])
def test_overall_with_other_weights(spark, g, r, want):
    parts = {"groundedness": F.col("g"), "answer_relevancy": F.col("r")}
    assert one(spark, S.overall(parts, {"groundedness": 0.2, "answer_relevancy": 0.2}), g=f"{g!r}d", r=f"{r!r}d") == pytest.approx(want, abs=1e-12)


def test_overall_is_capped(spark):
    assert one(spark, S.overall({"groundedness": F.col("g")}, {"groundedness": 2.0}), g="1d") == 1.0


def test_metrics(spark):
    assert one(spark, M.groundedness(F.col("a"), F.col("c")), a="'Revenue grew fast'", c="array('revenue fell', 'it grew')") == pytest.approx(2 / 3)
    assert one(spark, M.groundedness(F.col("a"), F.col("c")), a="''", c="array('x')") == 0.0
    assert one(spark, M.answer_relevancy(F.col("q"), F.col("a")), q="'the of'", a="'x'") == 1.0
    assert one(spark, M.answer_relevancy(F.col("q"), F.col("a")), q="'plan cost'", a="'Planning'") == 0.5
    assert one(spark, M.answer_relevancy(F.col("q"), F.col("a")), q="'plan'", a="cast(null as string)") == 0.0
    assert one(spark, M.context_relevancy(F.col("q"), F.col("c")), q="'plan'", c="array('a PLAN', 'no')") == 0.5
    assert one(spark, M.context_relevancy(F.col("q"), F.col("c")), q="'plan'", c="cast(array() as array<string>)") == 0.0
    assert one(spark, M.found_share(F.col("a"), F.col("e")), a="'100% of A_B'", e="array('100%', 'a_b', 'AxB')") == pytest.approx(2 / 3)
    assert one(spark, M.found_share(F.col("a"), F.col("e")), a="'x'", e="cast(array() as array<string>)") == 1.0
    assert one(spark, M.source_coverage(F.col("t"), F.col("r")), t="array('SEC')", r="array('sec', 'sec', 'news')") == pytest.approx(2 / 3)


@pytest.mark.parametrize(("target", "ids", "want"), [("A_B_1", ["A_B_1"], 1.0), ("A_B_1", ["A_B_2"], 0.5), ("A_B_1", ["A_C_2"], 0.2), ("A_B_1", ["X"], 0.0), ("uuid", ["uuid2"], 0.0), ("uuid", ["uuid"], 1.0), (None, ["A"], 0.0), ("F_sec_1", ["FOO_x_1", None], 0.2)])
def test_soft_recall(spark, target, ids, want):
    df = spark.createDataFrame([(target, ids)], "target string, ids array<string>")
    assert df.select(M.soft_recall(F.col("target"), F.col("ids"))).first()[0] == want


def test_sources_as_text(spark):
    """A record's content, else what the source is as text; each is cut, none is left out."""
    rows = spark.createDataFrame([(1, [("abc", "x"), (None, "name"), ("", "y"), (None, None), ("z" * 2_500, None)]), (2, [])], "id int, sources array<struct<content:string,plain:string>>")
    got = {r["id"]: r["text"] for r in rows.select("id", reports.source_text(F.col("sources")).alias("text")).collect()}
    assert got == {1: "".join(f"--- Source {i + 1} ---\n{t}\n\n" for i, t in enumerate(["abc", "name", "", "", "z" * 2_000])), 2: ""}


def test_source_records(spark):
    """What a chunk doesn't have is null, its text empty."""
    chunk = spark.createDataFrame([("c", None, None)], "company_name string, ticker string, raw_chunk string")
    record = R.source_of({c: F.col(c) for c in chunk.columns})
    assert chunk.select(record.alias("s")).select("s.*").first().asDict() == {"company": "c", "source_type": None, "date": None, "ticker": None, "content": ""}


def test_choosing_cases(spark):
    rows = spark.createDataFrame([(i, f"q{i % 4}") for i in range(8)] + [(9, None)], "item_id int, query_id string")
    ids = lambda *chosen: [r["item_id"] for r in reports.choose_cases(rows, *chosen).orderBy("item_id").collect()]
    table = spark.createDataFrame([("q1",), ("q1",), (None,), ("none",)], "query_id string")
    assert ids() == ids(None, 0) == ids((), None) == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    assert ids(("q1", "q3", "none")) == [1, 3, 5, 7] and ids(["q1", "q3"], 3) == [1, 3, 5] and ids((), 2) == [0, 1]
    assert ids(table) == [1, 5] and ids(table, 1) == [1] and ids(table.limit(0)) == []
