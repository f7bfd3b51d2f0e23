"""Files that may be missing or broken, outputs of one file a row, and telemetry that is appended and held as state."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import telemetry as T
from corpusloom.sources import files, storage
from corpusloom.sources.tables import events_as_telemetry
from corpusloom.streaming import telemetry as stream


def test_json_that_is_broken_in_part(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('{"a": 1, "b": "x"}\n{"a": "no number", "b": "y"}\nnot json\n{"b": "z", "c": 3}\n\n')
    rows = files.read_json(spark, str(path), "a int, b string").collect()
    assert [(r["a"], r["b"], r[files.BROKEN] is None) for r in rows] == [(1, "x", True), (None, "y", False), (None, None, False), (None, "z", True)]
    assert files.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0


PRESENT = {"bias_passed": False, "global": {"x": 1}, "per_group": {"A": {"avg_overall_score": 0.4, "num_tests": 2, "extra": []}, "B": {"avg_overall_score": 0.5}, "C": {"num_tests": 1}}}
OLDER = {"timestamp": "t", "global_metrics": {"count": 5}, "per_slice": {"sector": {"Tech": {"count": 3, "avg_overall_score": 0.31}}}, "per_group": {"Tech": {"count": 3, "avg_overall_score": 0.31}, "Large": {"count": 2, "avg_overall_score": 0.7}}}


@pytest.mark.parametrize(
    ("text", "want"),
    [(json.dumps(PRESENT, indent=2), {"A"}), (json.dumps(OLDER), {"Tech"}), ("{broken", set()), ("[]", set()), ("{}", set()), ("", set()), (None, set()), ('{"per_group": 3}', set())],
)
def test_reports_of_both_forms(spark, tmp_path, text, want):
    """A group without a score isn't below the minimum; a missing or broken report boosts nothing."""
    path = tmp_path / "report.json"
    if text is not None:
        path.write_text(text)
    assert {r["group_id"] for r in E.boosts(files.read_report(spark, str(path))).collect()} == want


def test_reports_written_and_read(spark, tmp_path):
    stats = spark.createDataFrame([("A", 0.2, 3), ("B", 0.9, 1)], "group_id string, avg_overall_score double, num_tests long")
    files.write_report(stats, str(tmp_path / "now"))
    cut = spark.createDataFrame([("sector", "t", 0.1, 2), ("cap", "l", 0.8, 1)], "slice string, group_id string, avg_overall_score double, count long")
    files.write_report(stats, str(tmp_path / "then"), slices=cut)
    read = lambda name: sorted(map(tuple, files.read_report(spark, str(tmp_path / name)).collect()))
    assert read("now") == [("A", 0.2, 3), ("B", 0.9, 1)] and read("then") == [("l", 0.8, 1), ("t", 0.1, 2)]


def test_cases_are_made_only_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("a", len(made))], "id string, n long")

    path = str(tmp_path / "cases")
    for _ in range(2):
        assert [(r["id"], r["n"]) for r in files.kept_json(spark, path, "id string, n long", make).collect()] == [("a", 1)]
    assert len(made) == 1


def test_one_file_for_each_row(spark, tmp_path):
    """Any text comes back whole; runs stand beside each other."""
    texts = [("a", "one\ntwo\n\n"), ("b", "é  \r\n"), ("c", ""), ("d e/f", "x" * 100_000)]
    rows = spark.createDataFrame(texts, "name string, text string")
    runs = [files.write_each(rows, str(tmp_path)) for _ in range(2)]
    assert runs[0] != runs[1]
    for run in runs:
        assert sorted(map(tuple, files.read_each(spark, run).collect())) == sorted(texts)
    stamp = F.lit(dt.datetime(2024, 5, 6, 7, 8, 9))
    names = [r[0] for r in spark.range(50).select(files.unique("response", stamp)).collect()]
    assert len(set(names)) == 50 and all(n.startswith("response_20240506_070809_") for n in names)


def test_envelopes(spark, tmp_path):
    cases = spark.createDataFrame([("q1", ["f"], ("T", 1)), ("q2", [], None)], "query_id string, facts array<string>, metadata struct<ticker:string,n:bigint>")
    schema = "query_id: string, facts: array<string>, metadata: struct<ticker:string,n:bigint>"
    files.write_envelope(cases, str(tmp_path / "golden"), "test", F.current_timestamp())
    assert sorted(files.read_envelope(spark, str(tmp_path / "golden"), schema).collect()) == sorted(cases.collect())
    (tmp_path / "bare.json").write_text('[{"query_id": "x", "facts": ["y"]}]')
    assert [tuple(r) for r in files.read_envelope(spark, str(tmp_path / "bare.json"), schema).collect()] == [("x", ["y"], None)]
    assert files.read_envelope(spark, str(tmp_path / "none"), schema).count() == 0


def test_made_once_for_the_same_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    made = []
    get = lambda: storage.made_once(spark, "x", [spark.read.parquet(path)], lambda: made.append(1) or len(made))
    assert get() == 1 == get()
    spark.range(9).write.mode("append").parquet(path)
    assert get() == 2


def event_rows(seed, n):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(i, start + dt.timedelta(seconds=r.randrange(500)), 1, r.choice(["view", "error", "click"]), float(i), '{"k": %d}' % (i % 7)) for i in range(n)]


def test_latest_as_state(spark, tmp_path):
    """Events in several files, out of order, some twice, and more files after the stream was stopped: the state has what the table has."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    rows = event_rows(1, 400)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(*next(iter(stream.ROCKS.items())))
    try:
        done = []
        for i, part in enumerate((rows[:150], rows[100:300], rows[300:] + rows[:20])):
            spark.createDataFrame(part, stream.EVENTS).coalesce(1).toPandas().to_parquet(folder / f"events-{i}.parquet", coerce_timestamps="us")
            done = {r[0]: r for r in done + part}.values()
            done = list(done)
            if i:
                stream.run_telemetry(events_as_telemetry(stream.read_events(spark, str(folder), files=1)), out, n=30)
                table = events_as_telemetry(spark.createDataFrame(done, stream.EVENTS))
                want = [r["event_id"] for r in T.latest(table, 30).collect()]
                assert [r["event_id"] for r in stream.latest_of(spark, out, 30).collect()] == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    history = stream.appended(spark, f"{out}/history", "event_id long")
    assert history.count() == 150 + 200 + 120


def test_a_batch_again_changes_nothing(spark, tmp_path):
    events = events_as_telemetry(spark.createDataFrame(event_rows(2, 60), stream.EVENTS))
    path = str(tmp_path / "history")
    assert stream.appended(spark, path, "event_id long").count() == 0
    for batch in (0, 1, 1, 0, 1):
        stream.append_batch(events.where(F.pmod("event_id", F.lit(2)) == batch), batch, path)
    assert sorted(r["event_id"] for r in stream.appended(spark, path, "event_id long").collect()) == list(range(60))
    row = T.stats(events, path="/analyze").first()
    assert row["requests"] == events.where("path = '/analyze'").count() < 60
