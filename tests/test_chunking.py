"""Chunks by separators, incremental runs and citations, on hand-written and random rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.operators import chunking as C


def recursive(text, limit, separators):
    """The same pieces by plain recursion."""
    if len(text) <= limit:
        return [text] if text else []
    if not separators:
        return [text[:limit], *recursive(text[limit:], limit, separators)]
    mark, finer = separators[0], separators[1:]
    parts = [p + mark for p in text.split(mark)]
    parts[-1] = parts[-1][: len(parts[-1]) - len(mark)]
    return [x for p in parts if p for x in recursive(p, limit, finer)]


def test_pieces_and_chunks():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choices(["a", "bc", " ", "\n", "\n\n", ". ", "longerword", "é"], k=r.randint(0, 80)))
        limit = r.randint(1, 40)
        overlap = r.randint(0, limit - 1)
        got = [text[a:b] for a, b in C.pieces(text, limit)]
        assert got == recursive(text, limit, C.SEPARATORS)
        chunks = list(C.spans(text, limit, overlap))
        assert all(0 < b - a <= limit for a, b in chunks)
        whole, end = "", 0
        for a, b in chunks:
            assert end - overlap <= a <= end < b
            whole += text[end:b]
            end = b
        assert whole == text
        for (_, b), (_, b2) in zip(chunks, chunks[1:], strict=False):  # none could have been longer by its next piece
            nxt = next(p for p in C.pieces(text, limit) if p[0] == b)
            first = next(a for a, e in chunks if e == b)
            assert nxt[1] - first > limit and b2 >= nxt[1]


def test_chunks_of_a_table(spark):
    rows = [(1, "one. two\n\nthree"), (2, None), (3, ""), (None, "x" * 30), (4, "w " * 9_000)]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, raw_chunk string, id string").repartition(3)
    got = {}
    for r in C.recursive_chunks(docs, limit=12, overlap=4).orderBy("pos").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["chunk"]))
    assert set(got) == {1, None, 4}
    for i, text in rows:
        assert got.get(i, []) == [(a, text[a:b]) for a, b in C.spans(text or "", 12, 4)]
    with pytest.raises(ValueError):
        C.recursive_chunks(docs, limit=5, overlap=5)
    assert C.recursive_chunks(docs.limit(0)).count() == 0


def test_runs_take_only_what_has_changed(spark, tmp_path):
    path = str(tmp_path / "state")
    seen = []

    def frame(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    def work(docs):
        seen.append(sorted(r["doc_id"] for r in docs.collect()))

    first = [(1, "a"), (2, None), (3, "c"), (None, "x")]
    assert C.process(frame(first), path, work, 1) == 3 and seen == [[1, 2, 3]]
    assert C.process(frame(first), path, work, 2) == 0 and len(seen) == 1
    second = [(1, "a"), (2, ""), (3, "C"), (4, "d")]
    assert C.process(frame(second), path, work, 3) == 2 and seen[-1] == [3, 4]
    third = [(1, "a"), (4, "d"), (4, "d")]
    assert {r["id"]: r["status"] for r in C.changes(frame(third), C.state_of_runs(spark, path)).collect()} == {1: "same", 2: "gone", 3: "gone", 4: "same"}
    assert C.process(frame(third), path, work, 4) == 0
    assert C.process(frame(second), path, work, 5) == 2 and seen[-1] == [2, 3]  # what was gone is new again


def test_a_run_that_fails_is_done_again(spark, tmp_path):
    path = str(tmp_path / "state")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")

    def fails(_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        C.process(docs, path, fails, 1)
    assert C.process(docs, path, lambda _: None, 1) == 1


@pytest.mark.parametrize(
    ("answer", "sources", "want"),
    [
        ("a [1] b [Source 2] [9]", 4, (3, 2 / 3, 0.5)),
        ("[2][2] [Document 2]", 2, (3, 1.0, 0.5)),
        ("none", 3, (0, 0.0, 0.0)),
        ("[1]", 0, (1, 0.0, 0.0)),
        ("[0] [x] [12345678901]", 5, (1, 0.0, 0.0)),
        (None, 3, (None, None, None)),
    ],
)
def test_citations(spark, answer, sources, want):
    row = spark.createDataFrame([(answer, sources)], "answer string, n int").select(M.citations(F.col("answer"), F.col("n")).alias("c")).first()["c"]
    found, precision, recall = want
    assert (row["found"], row["precision"], row["recall"]) == (found, precision, recall)
    f1 = None if found is None else 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    assert row["f1"] == (f1 if f1 is None else pytest.approx(f1))
