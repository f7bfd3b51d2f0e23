"""Operators of retrieval, evaluation and telemetry on hand-written rows."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.operators import evaluation as E
from corpusloom.operators import telemetry as T
from corpusloom.operators.index import build_index, open_index, with_postings
from corpusloom.sources import storage
from corpusloom.streaming import telemetry as stream


def okapi(docs, query):
    """The published formula, by hand."""
    tokens = [d.lower().split() for d in docs]
    n, avg = len(docs), sum(map(len, tokens)) / len(docs)
    df = {t: sum(t in d for d in tokens) for d in tokens for t in d}
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.lower().split()) for d in tokens]


DOCS = ["the red fox", "the blue fox fox", "", "the green dog", "the dog the end"]


def test_bm25(spark):
    chunks = spark.createDataFrame([(i, d or None, "s", i) for i, d in enumerate(DOCS)], "doc_id long, raw_chunk string, data_source_type string, ordinal long")
    queries = spark.createDataFrame([(0, "the fox fox", None), (1, "unknown", None), (2, "", None), (3, None, None)], "query_id long, query string, vector array<double>")
    got = {(r["query_id"], r["doc_id"]): r["bm25"] for r in retrieval.search(build_index(chunks), queries, by="bm25").collect()}
    want = okapi(DOCS, "the fox fox")
    assert {k: pytest.approx(v, abs=1e-8) for (q, k), v in got.items() if q == 0} == dict(enumerate(want))
    assert len(got) == 20 and not any(v for (q, _), v in got.items() if q > 0)
    bounds = {r["query_id"]: (r["least"], r["most"]) for r in retrieval.keyword_bounds(build_index(chunks), queries).collect()}
    assert bounds[0] == (pytest.approx(min(want), abs=1e-8), pytest.approx(max(want), abs=1e-8)) and bounds[1] == bounds[3] == (0.0, 0.0)
    assert retrieval.keyword_bounds(build_index(chunks.limit(0)), queries).count() == 0


def corpus(spark):
    chunks = spark.createDataFrame([(i, d, "ab"[i % 2], i) for i, d in enumerate(DOCS)], "doc_id long, raw_chunk string, data_source_type string, ordinal long")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (3, [0.0, 1.0])], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(7, "fox", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    return build_index(chunks, vectors), queries


def test_hybrid_scores(spark):
    rows = {r["doc_id"]: r for r in retrieval.search(*corpus(spark)).collect()}
    assert len(rows) == 5 and rows[0]["semantic"] == 1.0 and rows[1]["semantic"] == -1.0 and rows[2]["semantic"] == 0.0
    assert rows[1]["keyword"] == 1.0 and rows[0]["final_score"] == pytest.approx(0.7 + 0.3 * rows[0]["keyword"], abs=1e-8)


@pytest.mark.parametrize("each_source", [False, True])
def test_search_against_brute_force(spark, monkeypatch, each_source):
    """Many chunks and queries in small blocks and parts of batches, vectors that are null, short, zero or hold nulls."""
    import random

    import numpy as np

    for name, value in (("BLOCK", 3),):
        monkeypatch.setattr(retrieval, name, value)
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 12))), r.choice(["a", "b", None]), i) for i in range(60)]
    kinds = (None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0])
    vec = {i: kinds[i % 7] if i % 7 < 4 else [r.uniform(-1, 1) for _ in range(3)] for i in range(50)}
    asked = [(q, " ".join(r.choices(words, k=4)), None if q == 2 else [r.uniform(-1, 1) for _ in range(3)]) for q in range(7)]
    index = build_index(
        spark.createDataFrame(docs, "doc_id long, raw_chunk string, data_source_type string, ordinal long").repartition(4),
        spark.createDataFrame(list(vec.items()), "doc_id long, vector array<double>"),
        block_docs=7,
    )
    found = retrieval.search(index, spark.createDataFrame(asked, "query_id long, query string, vector array<double>"), k=5, each_source=each_source)
    got = {}
    for x in found.orderBy("rank").collect():
        got.setdefault((x["query_id"], x["data_source_type"] if each_source else 0), []).append((x["doc_id"], round(x["final_score"], 6)))
    full = lambda v: np.array([x or 0.0 for x in v] + [0.0] * (3 - len(v)))
    want = {}
    for q, text, v in asked:
        lexical = okapi([d[1] for d in docs], text)
        keyword = [(x - min(lexical)) / (max(lexical) - min(lexical)) for x in lexical]
        cosine = {}
        for i, u in vec.items():
            if u is not None and v is not None:
                length = np.linalg.norm(full(u)) * np.linalg.norm(v)
                cosine[i] = float(full(u) @ np.array(v) / length) if length else 0.0
        for source in ("a", "b", None) if each_source else (0,):
            inside = [d[0] for d in docs if not each_source or d[2] == source]
            top = max([cosine[i] for i in inside if i in cosine], default=1.0)
            score = {i: 0.7 * (cosine.get(i, 0.0) / top if top > 0 else 0.0) + 0.3 * keyword[i] for i in inside}
            want[q, source] = [(i, pytest.approx(score[i], abs=1e-6)) for i in sorted(inside, key=lambda i: (-round(score[i], 9), i))[:5]]
    assert got == want


def test_postings_give_what_a_scan_gives(spark):
    """Top-k and extremes by block maxima: queries with words of no chunk, of every chunk, and of so many that their weight would be negative."""
    import random

    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = ["all " + " ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randint(0, 30))) for _ in range(300)] + ["all rare rare rare", "all"]
    chunks = spark.createDataFrame([(i, d, None, i) for i, d in enumerate(docs)], "doc_id long, raw_chunk string, data_source_type string, ordinal long").repartition(3)
    index = build_index(chunks, block_docs=16)
    asked = ["rare", "rare w50", "w0 w1 w2", "all", "all w3", "nowhere", "", "w7 w7 w9", "w40 w41 w42"]
    queries = spark.createDataFrame([(i, q, None) for i, q in enumerate(asked)], "query_id long, query string, vector array<double>")
    scores = [okapi(docs, q) for q in asked]
    bounds = {x["query_id"]: (x["least"], x["most"]) for x in retrieval.keyword_bounds(index, queries).collect()}
    assert bounds == {q: (pytest.approx(min(s), abs=1e-9), pytest.approx(max(s), abs=1e-9)) for q, s in enumerate(scores)}
    got = {q: [] for q in range(len(asked))}
    for x in retrieval.lexical_topk(index, queries, 5).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["doc_id"], x["bm25"]))
    for q, s in enumerate(scores):
        best = sorted((i for i in range(len(docs)) if round(s[i], 9)), key=lambda i: (-round(s[i], 9), i))[:5]  # noqa: B023
        assert got[q] == [(i, pytest.approx(s[i], abs=1e-9)) for i in best]
    rare = next(retrieval.blocks_of(queries.where("query_id = 1"), open_index(spark, index.path)))
    found = retrieval.lexical(index, rare)
    assert 0 < found.decoded.count() < 0.5 * found.listed.count()


def test_a_block_lies_together_whatever_the_join(spark):
    """Vectors that are too many to be sent to every task: a word has one posting row in a block, not one in each part of the join; postings are written when they are asked for."""
    docs = spark.range(300).selectExpr("id as doc_id", "concat('all w', id % 7) as raw_chunk", "'s' as data_source_type", "id as ordinal")
    vectors = docs.select("doc_id").selectExpr("doc_id", "array(1.0D, cast(doc_id as double)) as vector")
    queries = spark.createDataFrame([(1, "w1 w2", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bare = build_index(docs, vectors, block_docs=16, postings=False)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert bare.postings is None and open_index(spark, bare.path).postings is None
    with pytest.raises(ValueError):
        bare.asked([1])
    index = with_postings(bare)
    assert with_postings(open_index(spark, bare.path)).postings.count() == index.postings.count() == index.postings.select("h", "block").distinct().count()
    assert index.postings.agg({"n": "sum"}).first()[0] == 600 and index.docs.where("vector[1] = doc_id").count() == 300
    assert {r["df"] for r in index.terms.collect()} == {300, 43, 42}
    assert retrieval.lexical_topk(index, queries, 5).count() == 5 == retrieval.search(bare, queries, k=5).count()


def test_batches_are_bounded_in_bytes(spark):
    """What a task of a scan takes up at once doesn't grow with the index."""
    import pyarrow as pa

    docs = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 500), x -> concat('w', x * (id + 1))), ' ') as raw_chunk", "'s' as data_source_type", "id as ordinal")
    index = build_index(docs, postings=False)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    found = retrieval._scan(index, ["doc_id", "terms", "counts"]).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 2000 and max(r["size"] for r in found) < 5 << 20


def test_a_search_moves_no_postings(spark, monkeypatch):
    """Extremes and searches read no postings, and an index of many files is scanned by tasks that its size doesn't add to."""
    chunks = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}", "ab"[i % 2], i) for i in range(60)], "doc_id long, raw_chunk string, data_source_type string, ordinal long")
    index = build_index(chunks.repartition(30))
    queries = spark.createDataFrame([(1, "w1 w2", None)], "query_id long, query string, vector array<double>")

    def none(*_):
        raise AssertionError("postings are read")

    monkeypatch.setattr(type(index), "asked", none)
    assert retrieval.keyword_bounds(index, queries).count() == 1 and retrieval.search(index, queries, k=5).count() == 5
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        most = retrieval.SCANS * spark.sparkContext.defaultParallelism
        assert retrieval._scan(index, ["doc_id"]).rdd.getNumPartitions() <= most < open_index(spark, index.path).docs.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_frequent_words_by_a_matrix_product(monkeypatch):
    """Scores are the same whichever words go by a matrix product, and for rows that are named."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    dense = r.normal(size=(9, 5)) * (r.random((9, 5)) < 0.6)
    word, query = np.nonzero(dense)
    block = retrieval.Block(list(range(5)), np.zeros((5, 0)), np.zeros(5, bool), np.arange(9), np.searchsorted(word, np.arange(10)), query, dense[word, query], 4.0, 1.5, 0.75)
    terms = [sorted(r.choice(12, r.integers(0, 9), replace=False).tolist()) for _ in range(20)]
    counts = [[int(x) for x in r.integers(1, 4, len(t))] for t in terms]
    rows = pa.RecordBatch.from_pydict({"terms": pa.array(terms, pa.list_(pa.int64())), "counts": pa.array(counts, pa.list_(pa.int32())), "dl": pa.array([sum(c) for c in counts], pa.int32())})
    want = np.zeros((20, 5))
    for i, (t, c) in enumerate(zip(terms, counts, strict=True)):
        for h, tf in zip(t, c, strict=True):
            want[i] += (dense[h] if h < 9 else 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * sum(c) / 4.0))
    for most, worth in ((256, 0.0), (2, 0.0), (256, 2.0), (256, 0.3)):
        monkeypatch.setattr(retrieval, "FREQUENT", most)
        monkeypatch.setattr(retrieval, "WORTH", worth)
        scorer = retrieval.Scorer(block)
        entries = scorer.entries(rows)
        assert np.allclose(scorer.scores(entries, 20), want)
        named = np.array([7, 3, 19])
        assert np.allclose(scorer.scores(entries, 20, named), want[named])


def test_scores_in_parts(monkeypatch):
    """Sparse products in bounded memory give what a dense one gives."""
    import numpy as np

    r = np.random.default_rng(1)
    dense = r.normal(size=(9, 5)) * (r.random((9, 5)) < 0.5)
    word, query = np.nonzero(dense)
    block = retrieval.Block(list(range(5)), np.zeros((5, 0)), np.zeros(5, bool), np.arange(9), np.searchsorted(word, np.arange(10)), query, dense[word, query], 1.0, 1.5, 0.75)
    rows, words, values = r.integers(0, 4, 50), r.integers(0, 9, 50), r.normal(size=50)
    left = np.zeros((4, 9))
    np.add.at(left, (rows, words), values)
    for cells in (1, 7, 1000):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        assert np.allclose(block.scores(rows, words, values, 4), left @ dense)
        some = np.array([True, False, False, True, False])
        assert np.allclose(block.only(some).scores(rows, words, values, 4), left @ (dense * some))


def test_scores_that_differ_beyond_the_sixth_digit_only(spark):
    """The order is by 9 digits of the unrounded score, which is handed on as it is."""
    seen = spark.createDataFrame([(1, 0.123456499, 1), (1, 0.123456501, 2), (2, 0.12345650004, 0)], "doc_id long, final_score double, arrival int")
    assert {(x["doc_id"], x["final_score"], x["first_arrival"]) for x in retrieval.dedup_best(seen).collect()} == {(1, 0.123456501, 1), (2, 0.12345650004, 0)}


def test_filter_keeps_lexical_scale_but_not_the_vectors(spark):
    rows = {r["doc_id"]: r for r in retrieval.search(*corpus(spark), sources=["b"]).collect()}
    assert set(rows) == {1, 3} and rows[1]["keyword"] == 1.0 and rows[1]["semantic"] == 0.0  # the largest cosine is 0 there
    assert retrieval.search(*corpus(spark), sources=["none"]).count() == 0
    assert retrieval.search(*corpus(spark), sources=[]).count() == 5


def test_ties_by_ordinal_and_dedup(spark):
    chunks = spark.createDataFrame([(i, "same words", "s", i) for i in (6, 5, 4)], "doc_id long, raw_chunk string, data_source_type string, ordinal long").repartition(3)
    query = spark.createDataFrame([(1, "words", None)], "query_id long, query string, vector array<double>")
    assert [r["doc_id"] for r in retrieval.search(build_index(chunks), query, 2).orderBy("rank").collect()] == [4, 5]
    seen = spark.createDataFrame([(1, 0.2, 1), (1, 0.9, 4), (2, 0.5, 2), (None, 0.1, 0), (None, 0.1, 3)], "doc_id long, final_score double, arrival int")
    assert {(r["doc_id"], r["final_score"], r["first_arrival"]) for r in retrieval.dedup_best(seen).collect()} == {(1, 0.9, 1), (2, 0.5, 2), (None, 0.1, 0)}


@pytest.mark.parametrize(
    ("ranked", "want"),
    [([2, 0], [(2, 1.0), (0, 0.99), (1, 0.0)]), ([5, -1, 1, 1, 2], [(1, 1.0), (2, 0.99), (0, 0.0)]), ([], [(0, 0.0), (1, 0.0), (2, 0.0)]), (None, [(0, None), (1, None), (2, None)])],
)
def test_rerank(spark, ranked, want):
    candidates = spark.createDataFrame([(1, i) for i in range(3)], "query_id long, idx int")
    orders = spark.createDataFrame([(1, ranked)], "query_id long, ranked array<int>")
    out = retrieval.rerank(candidates, orders).orderBy("new_rank").collect()
    assert [(r["idx"], r["rerank_score"]) for r in out] == want
    assert retrieval.rerank(candidates.limit(0), orders).count() == 0


@pytest.mark.parametrize(
    ("ranked", "want"),
    [([0, 2, 0, 9], [(0, 0.98), (2, 0.99), (0, 0.98), (1, 0.0)]), ([1], [(1, 1.0), (0, 0.0), (2, 0.0)]), ([], [(0, 0.0), (1, 0.0), (2, 0.0)]), (None, [(0, None), (1, None), (2, None)])],
)
def test_rerank_strict(spark, ranked, want):
    candidates = spark.createDataFrame([(1, i) for i in range(3)], "query_id long, idx int")
    orders = spark.createDataFrame([(1, ranked)], "query_id long, ranked array<int>")
    out = retrieval.rerank_strict(candidates, orders).orderBy("new_rank").collect()
    assert [(r["idx"], r["rerank_score"]) for r in out] == want
    assert retrieval.rerank_strict(candidates.limit(0), orders).count() == 0


def test_written_as_json_and_read_again(spark):
    rows = [(1, "a\n\"b\"", 0.1, ["x", None]), (None, None, None, None), (2, "é", float("inf"), [])]
    df = spark.createDataFrame(rows, "id long, text string, score double, list array<string>")
    read = storage.through_json(df, "rows")
    assert read.schema == df.schema and sorted(map(tuple, read.collect()), key=repr) == sorted(rows, key=repr)
    assert storage.through_json(df.limit(0), "rows").count() == 0


def test_distinct_sources_treats_nulls_as_equal(spark):
    found = spark.createDataFrame([(1, 1, None, "x"), (1, 2, None, "x"), (1, 3, "c", "x")], "query_id long, rank int, a string, b string")
    assert sorted(r["rank"] for r in retrieval.distinct_sources(found, ["a", "b"]).collect()) == [1, 3]


RESULTS = "query_id string, sector string, market_cap string, status string, overall_score double, groundedness double, relevancy double, retrieval_recall double, agent_confidence double, execution_time double"


def results(spark):
    rows = [("A_1", "t", "s", "success", 0.8, 0.5, 1.0, None, 0.5, 1.0), ("A_2", "t", "l", "failed", 0.0, None, None, None, None, 9.0), ("B_1", "u", "l", "success", 0.4, 0.1, 0.2, 0.3, 0.1, 3.0), ("solo", "u", "s", "failed", 0.0, None, None, None, None, 2.0)]
    return spark.createDataFrame(rows, RESULTS)


def test_groups_and_bias(spark):
    stats = {r["group_id"]: r for r in E.group_stats(results(spark)).collect()}
    assert set(stats) == {"A", "B", "UNKNOWN"} and stats["A"]["success_rate"] == 0.5 and stats["A"]["avg_overall_score"] == 0.8
    assert stats["A"]["avg_retrieval_recall"] == 0.0 and stats["UNKNOWN"]["avg_overall_score"] == 0.0
    assert E.group_stats(results(spark), 2).count() == 1
    check = E.bias_check(E.group_stats(results(spark))).first()
    assert check["below"] == "B,UNKNOWN" and check["disparity"] and not check["passed"]
    assert not E.bias_check(E.group_stats(results(spark).limit(0))).first()["passed"]


def test_limits_are_strict(spark):
    stats = spark.createDataFrame([("a", 0.5), ("b", 0.75)], "group_id string, avg_overall_score double")
    for c in ("avg_groundedness", "avg_relevancy", "avg_retrieval_recall", "success_rate"):
        stats = stats.withColumn(c, F.lit(1.0))
    assert E.bias_check(stats, 0.5, 0.25).first()["passed"]
    assert E.boosts(stats).count() == 0


def test_macro_mean_and_gap_of_a_published_report(spark):
    scores = [0.685416598904971, 0.5983291017635353, 0.5675]
    stats = spark.createDataFrame([(str(i), s, 0.0, 0.0, 0.0, 1.0) for i, s in enumerate(scores)], "group_id string, avg_overall_score double, avg_groundedness double, avg_relevancy double, avg_retrieval_recall double, success_rate double")
    row = E.bias_check(stats).first()
    assert row["global_avg_overall_score"] == pytest.approx(0.6170819002228355) and row["max_gap"] == pytest.approx(0.11791659890497097) and row["passed"]


def test_boost(spark):
    found = spark.createDataFrame([(1, "low", 1, 0.99), (1, "high", 2, 1.0), (1, None, 3, None)], "query_id long, group_id string, rank int, final_score double")
    boosts = spark.createDataFrame([("low", 1.05)], "group_id string, boost double")
    out = {r["rank"]: r for r in E.boost_apply(found, boosts).collect()}
    assert out[1]["bias_boosted"] and out[1]["boosted_rank"] == 1 and out[2]["boosted_rank"] == 2 and out[3]["boosted_rank"] == 3


def test_summary(spark):
    rows = [(f"A_{i}", "t", "s", "success", s, None, None, None, None, 1.0) for i, s in enumerate((0.25923076923076926, 0.23611111111111116, 0.3125))]
    row = E.summary(spark.createDataFrame(rows, RESULTS)).first()
    assert row["std_overall_score"] == pytest.approx(0.03198505186280067, abs=1e-15) and row["avg_groundedness"] is None
    empty = E.acceptance(E.summary(spark.createDataFrame([], RESULTS))).first()
    assert not empty["time_ok"] and not empty["all_criteria_met"]
    assert E.slice_stats(results(spark)).count() == 5


EVENTS = "event_id long, ts timestamp_ntz, latency_ms double, status int, tokens int, breakdown map<string,double>, rag_hit int"


def test_telemetry(spark):
    start = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, start + dt.timedelta(minutes=i), float(i), 500 if i == 3 else 200, i, {"a": 2.0} if i % 2 else {}, i % 2) for i in range(120)], EVENTS)
    row = T.stats(events).first()
    assert (row["requests"], row["errors"], row["avg_latency_ms"]) == (120, 1, 69.5)
    assert T.latest(events).count() == 100 and T.hit_rate(events).first()["healthy"]
    assert [(r["agent"], r["avg_ms"]) for r in T.agent_breakdown(events).collect()] == [("a", 2.0)]
    assert T.usage(events).where("event_id = 1").first()["cost"] == pytest.approx(0.000002)
    none = events.limit(0)
    assert T.stats(none).first()["avg_latency_ms"] == 0.0 and T.agent_breakdown(none).count() == 0


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.toPandas().to_parquet(tmp_path / "events-1.parquet", coerce_timestamps="us")
    read = stream.read_events(spark, str(tmp_path))
    query = stream.windowed(read).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    key = lambda r: (r["start"], r["event_type"], r["requests"], round(r["latency"], 6))
    assert sorted(map(key, spark.table("hourly").collect())) == sorted(map(key, stream.windowed(source).collect()))
