"""Operators over a whole corpus, against brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, jaccard, lines, mixing, registry
from corpusloom.llm.common import checkpointed, table
from corpusloom.llm.graph import components
from tests.conftest import DATA
from tests.test_queries import TABLES, plain


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    df = registry.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in sorted(names)) for row in df.collect()), key=repr)
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in want.fetchall()), key=repr)


# Jaccard join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if a is not None and b is not None and s and 100 * len(s & t) >= 80 * len(s | t):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[root(i)].append(a)
    return sorted(((a, len(s), min(least[root(i)]) if a is not None else None) for i, (a, s) in enumerate(sets)), key=repr)


def found_components(df):
    return sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=repr)


def test_jaccard_on_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found_components(odd) == brute_components(rows)
    assert found_components(odd.limit(0)) == []


def test_jaccard_of_whole_table(spark):
    docs = table(spark, DATA, "documents")
    assert found_components(docs) == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_jaccard_around_the_limit_and_in_hot_groups(spark, monkeypatch):
    """Near copies in chains, a passage that many share, and low limits, so that every path is taken."""
    monkeypatch.setattr(jaccard, "COMMON", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rows = []
    for k in range(12):  # a chain: neighbours are linked, its ends aren't
        words = [f"c{i}" for i in range(60)]
        words[: 3 * k] = [f"x{i}" for i in range(3 * k)]
        rows.append((100 + k, " ".join(words)))
    passage = [f"p{i}" for i in range(70)]
    for k in range(25):
        rows.append((200 + k, " ".join([f"u{k}_{i}" for i in range(5 + 4 * (k % 5))] + passage)))
    for n in range(1, 12):
        for cut in (0, 1, 2):
            rows.append((300 + 10 * n + cut, " ".join(f"s{n}_{i}" for i in range(n + 4 - cut) if n + 4 - cut > 0)))
    rows += [(500, "a b"), (501, "A B"), (502, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_components(df) == brute_components(rows)


def test_heavy_sets_keep_each_band():
    """Two bands in which a set is heavy already, each listed by two tasks, and a common segment beside a mark."""
    rows = [(7, 7, 3), (7, 7, 4)] * 2 + [(9, 8, jaccard.CODES + 5), (9, 8, jaccard.MARK), (9, 8, jaccard.CODES + 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["key", "a", "code"])
    met = pa.Table.from_batches(jaccard._met(iter([batch]))).to_pylist()
    assert {(r["x"], r["code"]) for r in met if r["code"] is not None} == {(7, 3), (7, 4), (8, jaccard.CODES + 5)}


@pytest.mark.parametrize("rows", [1, 2, 7, 1000])
def test_groups_over_batches(monkeypatch, rows):
    """A group is the same however its rows are dealt to batches: pairs of a small one, a star and counts of a common one."""
    monkeypatch.setattr(jaccard, "COMMON", 4)
    one = jaccard.CODES + 5
    index = [(-5, a, one) for a in (3, 1, 2, 3)] + [(0, a % 40, one) for a in range(80)] + [(4, 9, one)] + [(8, a, one + jaccard.SALTED) for a in (5, 6)] + [(9, 1, one), (9, 2, jaccard.MARK)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*index[i : i + rows])], ["key", "a", "code"]) for i in range(0, len(index), rows)]
    met = pa.Table.from_batches(jaccard._met(iter(batches))).to_pylist()
    pairs = {frozenset((r["x"], r["y"])) for r in met if r["code"] is None}
    assert pairs >= {frozenset(x) for x in ((1, 2), (1, 3), (2, 3), (5, 6))} and all(len(x) == 2 for x in pairs)
    star = pairs - {frozenset(x) for x in ((1, 2), (1, 3), (2, 3), (5, 6))}
    near = {0}
    for _ in range(40):
        near |= {b for x in star if x & near for b in x}
    assert near == set(range(40)) and len(star) < 45
    assert {(r["x"], r["code"]) for r in met if r["code"] is not None} == {*((a, one) for a in range(40)), (5, one), (6, one), (1, one)}


def test_very_large_sets_keep_their_bands(monkeypatch):
    """A set beyond band 63 whose segments are all common is heavy in its own bands."""
    size = 2_800_000
    tokens = jaccard.mixed(np.arange(size, dtype=np.uint64))
    monkeypatch.setattr(jaccard, "shingles_of", lambda text: tokens)
    monkeypatch.setattr(jaccard, "COMMON", 0)
    index = pa.Table.from_batches(jaccard._indexed(iter([pa.RecordBatch.from_arrays([pa.array(["x"])], ["text"])]))).sort_by("key")
    met = pa.Table.from_batches(jaccard._met(iter(index.to_batches(max_chunksize=500_000))))
    code = met.filter(pc.is_valid(met["code"]))["code"].to_numpy()
    kinds, count = np.unique(code, return_counts=True)
    heavy = sorted(int(k % jaccard.CODES) for k, n in zip(kinds, count, strict=True) if n >= k // jaccard.CODES)
    assert heavy == jaccard._bands_of(size) and heavy[1] >= 64


def test_bands_and_counts_of_a_code_stay_apart():
    assert jaccard.CODES > len(jaccard.BANDS) > 64


@pytest.mark.parametrize("limit", [8, 1000])
def test_neighbourhoods_over_batches(limit):
    """Pairs of a neighbourhood don't depend on how its rows are dealt to batches; the minor side is compared with all of other components."""
    rows = [(k, 0, 0, minor, True, True, 10 * k + j, 10 * k + j // 2, 20, b"\0" * 64) for k in range(5) for minor, many in ((False, range(6)), (True, range(2, 6))) for j in many]
    names = ["key", "i", "j", "minor", "whole", "own", "a", "root", "n", "sketch"]
    batches = pa.Table.from_arrays([pa.array(x) for x in zip(*rows)], names).to_batches(max_chunksize=limit)
    found = pa.Table.from_batches(jaccard._compared(iter(batches))).to_pylist()
    assert {(r["x"], r["y"]) for r in found} == {(10 * k + i, 10 * k + j) for k in range(5) for i in range(6) for j in range(i + 1, 6) if i // 2 != j // 2}


def test_jaccard_without_broadcasts(spark, monkeypatch):
    for name in ("BROADCAST_IDS", "BROADCAST_SKETCHES", "BROADCAST_KEYS"):
        monkeypatch.setattr(jaccard, name, 0)
    test_jaccard_around_the_limit_and_in_hot_groups(spark, monkeypatch)


def test_components(spark):
    edges = spark.createDataFrame([(2, 1), (2, 3), (3, 4), (9, 8), (8, 9), (7, 7), (None, 1), (20, 10), (20, 30), (30, 5)], "x long, y long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8), (5, 5), (10, 5), (20, 5), (30, 5)}
    assert components(edges.limit(0)).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "x long, y long")
    assert {r["root"] for r in components(path).collect()} == {0}


# lines


def brute_lines(rows):
    seen, out = set(), []
    first = {}
    for i, text in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = text.split("\n")
        for p in range(len(parts) - 2):
            window = tuple(parts[p : p + 3])
            if any(re.search(r"[^\x20\x09-\x0D]", x) for x in window):
                if window in seen:
                    first.setdefault((i, text), set()).update(range(p, p + 3))
                seen.add(window)
    for i, text in rows:
        gone = first.get((i, text), set())
        out.append((i, text if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone), len(gone)))
    return sorted(out, key=repr)


LINES = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\na\na\na\na"), (3, "a\na\na\na\na"), (4, "\n\n\n\n"), (5, "\n\n\n\n"), (6, "a\nb"), (7, None), (8, ""), (9, "a\nb\nc\nd\nz"), (None, "b\nc\nd"), (10, "q\r\nb\nc")]


def test_lines(spark, odd):
    df = spark.createDataFrame(LINES, "doc_id long, text string").withColumn("lines", F.lit("clash")).withColumn("_key", F.lit(1))
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(df).collect()), key=repr)
    assert got == brute_lines(LINES)
    out = lines.dedup_lines(odd)
    assert out.count() == 9 and set(odd.columns) < set(out.columns)
    assert lines.dedup_lines(odd.limit(0)).count() == 0


# mixing


def test_targets_by_iteration(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, None: 50, "d": 0}
    sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        free -= over
    want |= share
    assert {r["source"]: pytest.approx(r["target"]) for r in mixing.targets_of(sized).collect()} == want


def test_mix(spark, odd):
    docs = table(spark, DATA, "documents")
    one, many = (mixing.mix(docs, bucket_rows=n).orderBy("doc_id").collect() for n in (1_000_000, 3))
    assert [r["taken"] for r in one] == [r["taken"] for r in many]  # buckets don't matter
    total = sum(r["size"] for r in one)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in one:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and all(r["taken"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mix_of_any_ids(spark):
    """Ids with quotes and backslashes, and rows without an id, which stand by their texts."""
    docs = table(spark, DATA, "documents")
    quoted = docs.withColumn("doc_id", F.concat(F.lit("o'br\\ien\"-"), F.col("doc_id").cast("string")))
    rows = mixing.mix(quoted).collect()
    assert len(rows) == docs.count() and sum(r["taken"] for r in rows) > 0
    for kind in ("decimal(20,3)", "string", "int"):
        assert mixing.mix(docs.withColumn("doc_id", F.col("doc_id").cast(kind))).agg(F.sum("taken")).first()[0] > 0
    nameless = mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert 0 < nameless.where("taken > 0").count() <= docs.count() and nameless.select("finish").distinct().count() > 100


# decontamination


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, named = set(), set()
    for item, t in items:
        bench = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(10, len(bench))
        for w in {tuple(bench[i : i + n]) for i in range(len(bench) - n + 1)} if n else ():
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) == w:
                    hit.update(range(p, p + n))
                    named.update([str(item)] if item is not None else [])
    return len(words), len(hit), sorted(named)


ITEMS = [(1, "One two three, four five six seven eight nine ten eleven twelve"), (2, "tiny é"), (10, "tiny é"), (3, None), (4, "..."), (None, "zz top of the pops"), (5, "one two three four five six seven eight nine ten")]
TEXTS = [(1, "say one TWO three four-five six seven eight nine ten eleven now"), (2, "tiny é é tiny é"), (3, None), (4, ""), (5, "zz top of the pops"), (6, "one two three four five six seven eight nine"), (None, "x tiny é"), (1, "say one TWO three four-five six seven eight nine ten eleven now"), (7, "ten " * 500 + "twelve one two three four five six seven eight nine ten eleven twelve")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contamination(spark, odd, limit):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("key", F.lit("clash"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n", F.lit("clash"))
    found = decontaminate.find_contamination(docs, bench, broadcast_bytes=limit).collect()
    got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in found), key=repr)
    assert got == sorted(((i, *brute_hits(t, ITEMS)) for i, t in TEXTS), key=repr)
    assert decontaminate.find_contamination(odd, bench, broadcast_bytes=limit).count() == 9
    assert decontaminate.find_contamination(docs, bench.limit(0), broadcast_bytes=limit).where(F.size("spans") > 0).count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench, broadcast_bytes=limit).count() == 0


# pipeline


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = checkpointed(stages["language_id"](spark, docs, DATA))
    assert kept.columns == columns and kept.count() >= 0.98 * docs.count()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    clean = checkpointed(stages["line_dedup"](spark, kept, DATA))
    want = {i: t for i, t, gone in brute_lines(rows) if not gone or re.search(r"[^\x20\x09-\x0D]", t)}
    assert clean.columns == columns and {r["doc_id"]: r["text"] for r in clean.collect()} == want
    assert clean.where("n_chars != length(text)").count() == 0
    single = checkpointed(stages["near_duplicates"](spark, clean, DATA))
    firsts = {c for _, _, c in brute_components(list(want.items()))}
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(firsts)
    safe = checkpointed(stages["decontaminate"](spark, single, DATA))
    assert safe.columns == columns and sorted(r["doc_id"] for r in safe.collect()) == sorted(i for i in firsts if not brute_hits(want[i], items)[1])
    mixed = stages["source_mix"](spark, safe, DATA)
    assert [r["copies"] in (1, 2) for r in mixed.collect()] == [True] * mixed.count() and mixed.columns == [*columns, "copies", "finish"]
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(safe).collect() if r["copies"]}
    assert {r["doc_id"]: r["copies"] for r in mixed.collect()} == taken


def test_pipeline_mix_keeps_its_budget(spark):
    """Rows without an id, and rows that share one, have copies of their own: the words taken are near each source's target. Equal rows are one, with all their copies."""
    r = np.random.default_rng(7)
    rows = [(None if i % 2 else i // 6, " ".join(["w"] * int(r.integers(1, 30)) + [f"x{i}"]), None, f"s{i % 3}", 0) for i in range(120)]
    rows += [(None, "same words in each", None, "s0", 0)] * 4 + [(3, "the same twice", None, "s1", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id")))
    out = dict(corpus_pipeline.STAGES)["source_mix"](spark, docs, DATA).collect()
    size = lambda t: len(t.split())
    targets = {x["source"]: x["target"] for x in mixing.mix(docs).select("source", "target").distinct().collect()}
    for source, target in targets.items():
        words = sum(size(x["text"]) * x["copies"] for x in out if x["source"] == source)
        assert abs(words - target) <= 2 * max(size(t) for _, t, *_ in rows)
    whole = sum(size(x["text"]) * x["copies"] for x in out)
    assert sum(targets.values()) - 62 <= whole <= sum(targets.values())
    assert whole == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    times = {(x["doc_id"], x["text"]): rows.count((x["doc_id"], x["text"], None, x["source"], 0)) for x in out}
    assert len(times) == len(out) and all(0 < x["copies"] <= 2 * times[x["doc_id"], x["text"]] for x in out)


def test_pipeline_bears_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = checkpointed(stage(spark, docs, DATA))
        if name != "source_mix":
            assert docs.columns == odd.columns
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "5", "7", "None"]


def test_pipeline_of_empty_and_unlabelled_tables(spark):
    """No rows give no rows in every stage; without labels no language is known and only texts without a letter go."""
    docs = table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
    bare = docs.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert dict(corpus_pipeline.STAGES)["language_id"](spark, bare.unionByName(bare.limit(3).withColumn("text", F.lit("12 - 34"))), DATA).count() == 20


def test_decontamination_of_rows_with_maps(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("items", F.lit("clash"))
    rows = docs.select(F.struct("doc_id", "extra").alias("row"), "text")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = [sorted((str(r["row"]["doc_id"]), r["text"], len(r["spans"])) for r in decontaminate.find_contamination(rows, bench, id_col="row", keep_text=True, broadcast_bytes=n).collect() if r["text"]) for n in (0, 1 << 20)]
    assert found[0] == found[1] and len(found[0]) == len([t for _, t in TEXTS if t])


def test_jaccard_needs_whole_ids(spark):
    with pytest.raises(TypeError):
        jaccard.jaccard_components(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
