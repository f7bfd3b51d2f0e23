"""Near-duplicate vectors, vector codes, and their tree, against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import codes, neighbours
from corpusloom.llm.common import lookup, table
from tests.conftest import DATA

SCHEMA = "embedding array<float>, vec_id long, label int, node string, v string, k1 string, size string, cell string, root string, code string, error string"


def frame(spark, rows):
    """Vectors with columns of clashing names."""
    return spark.createDataFrame([(v, i, label, *"abcdefgh") for i, v, label in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, threshold=0.98):
    """(id, links, component) of each row by all pairs."""
    n = len(rows)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if x is not None and x == y and usable(a) and usable(b) and len(a) == len(b) and any(a) and any(b):
                a, b = np.float32(a).astype(float), np.float32(b).astype(float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(n):
        seen, rest = {i}, [i]
        while rest:
            for j in near[rest.pop()]:
                if j not in seen:
                    seen.add(j)
                    rest.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), least, least is not None and rows[i][0] == least))
    return sorted(out, key=repr)


def clusters(seed, n, width=8, labels=3):
    """Vectors around a few centres, at all distances from them, with copies."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = centres[r.integers(6)] + r.normal(size=width) * r.choice([0.0, 0.02, 0.1, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(labels))))
    return rows


ODD = [
    (1, None, 1),
    (2, [], 1),
    (3, [0.0, 0.0], 1),
    (4, [1.0, None], 1),
    (5, [1.0, float("nan")], 1),
    (6, [1.0, float("inf")], 1),
    (7, [1.0, 2.0], None),
    (8, [1.0, 2.0], 1),
    (8, [1.0, 2.0], 1),
    (8, [2.0, 4.0], 1),
    (9, [1.0, 2.0, 0.0], 1),
    (None, [1.0, 2.0], 1),
    (None, [5.0, -2.0], 2),
    (10, [1.0, 2.0], 2),
    (11, [3e38, 3e38], 3),
    (12, [1e-30, 1e-30], 3),
    (13, [-0.0, 1.0], 4),
    (14, [0.0, 1.0], 4),
    (15, [7.0], 5),
    (16, [0.5], 5),
]


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates(spark, monkeypatch, block):
    """All links of odd rows and of clusters, also when cells are dealt out in blocks of few rows."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    for rows in (ODD, clusters(1, 400)):
        got = neighbours.near_duplicates(frame(spark, rows), target=1.0, per_cell=16)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_cells_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "BROADCAST", 0)
    rows = clusters(2, 200)
    assert sorted(map(tuple, neighbours.near_duplicates(frame(spark, rows), target=1.0, per_cell=16).collect()), key=repr) == brute(rows)


def test_near_duplicates_of_nothing(spark):
    assert neighbours.near_duplicates(frame(spark, []).limit(0)).count() == 0
    assert list(map(tuple, neighbours.near_duplicates(frame(spark, [(3, None, None)])).collect())) == [(3, 0, 3, True)]


def test_recall_at_the_threshold():
    """Pairs just above the threshold, the hardest ones, are met at about the target rate; no cell is visited out of order."""
    r = np.random.default_rng(0)
    rows = r.normal(size=(4000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    index = neighbours.fit(rows, 12)
    away = r.normal(size=rows.shape)
    away -= (away * rows).sum(1, keepdims=True) * rows
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.981 * rows + math.sqrt(1 - 0.981**2) * away
    at = list(index.visited(rows))
    home = [v[0] for v in index.visited(near)]
    assert sum(h in v for h, v in zip(home, at, strict=True)) / len(home) > 0.98
    assert np.mean([len(v) for v in at]) < 0.1 * 144
    one, two = index.excess(rows[:50])
    for i in range(50):
        whole = sorted((one[i, a] + two[i, b], a * 12 + b) for a in range(12) for b in range(12))
        assert [c for d, c in whole if d <= index.reach] == neighbours.traverse(one[i], two[i], index.reach)


def test_links_of_a_whole_table(spark):
    """check_s has groups of near copies; every link is found, and none else."""
    path = "/root/testdata/check_s"
    rows = table(spark, path, "embeddings").toPandas().sort_values("vec_id")
    got = neighbours.op11_embedding_near_dedup(spark, path).toPandas().sort_values("vec_id")
    x = np.array(rows["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, links = rows["label"].to_numpy(), np.zeros(len(x), int)
    for k in np.unique(label):
        at = np.flatnonzero(label == k)
        links[at] = (x[at] @ x[at].T >= 0.98).sum(1) - 1
    found = got["n_links"].to_numpy()
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() > 0


def test_lookup_of_hot_keys(spark):
    left = spark.createDataFrame([(i % 7 if i < 3000 else i, i) for i in range(6000)], "k long, x long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("y", F.col("k") * 2)
    got = lookup(left, right, ["k"], "n")
    assert got.count() == 6000 and got.where("y <> k * 2").count() == 0 and got.columns == ["k", "x", "y"]
    assert lookup(left, right.where("k <> 3"), ["k"], "n", "left").where("y is null").count() == left.where("k = 3").count()


def coded(rows, parts=8, entries=16, rounds=6):
    """The contract by hand, in Python's integers."""
    kept = sorted(((i is None, i or 0, v), i, v, label) for i, v, label in rows if usable(v))
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for _, i, v, label in kept]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    size = width // parts
    cut = [[(v + [0] * width)[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    best = lambda p, part: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[best(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[best(p, c[p]) for p in range(parts)] for c in cut]
    most = (1 << 63) - 1
    error = [min(most, sum(d for d, _ in f)) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, min(most, sum(e2 for (_, _, l2), e2 in zip(kept, error, strict=True) if l2 == label)), digest) for (i, _, label), f, e in zip(kept, found, error, strict=True)), key=repr)


@pytest.mark.parametrize("rows", [ODD, clusters(3, 150, 16), clusters(4, 9, 11), [r for r in ODD if not r[1] or max(map(abs, filter(None, r[1])), default=0) < 1e6]])
def test_codes(spark, rows):
    """Also huge components, short vectors, fewer rows than entries, null labels and ids."""
    got = codes.compress(frame(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == coded(rows)


def test_codes_of_nothing(spark):
    assert codes.compress(frame(spark, []).limit(0)).count() == 0 == codes.compress(frame(spark, [(1, None, 1)])).count()


@pytest.mark.parametrize("kind", [np.int64, object])
def test_tree_gives_what_a_scan_gives(kind):
    """Many ties, repeated entries, one entry, and entries far apart, for which few distances are taken."""
    r = random.Random(5)
    for n, spread in ((1, 3), (2, 2), (16, 2), (16, 1000), (90, 4)):
        entries = np.array([[r.randint(-spread, spread) for _ in range(3)] for _ in range(n)]).astype(kind)
        rows = np.array([[r.randint(-spread, spread) for _ in range(3)] for _ in range(300)]).astype(kind)
        entry, distance, _ = codes.nearest(codes.grow(entries), entries, rows)
        want = [min((int(((row - e) ** 2).sum()), k) for k, e in enumerate(entries)) for row in rows]
        assert list(zip(distance.tolist(), entry.tolist(), strict=True)) == want
    entries = np.array([[100_000 * (i // 4), i % 4] for i in range(64)])
    _, _, taken = codes.nearest(codes.grow(entries), entries, entries.repeat(5, 0) + 1)
    assert taken < 0.5 * 64 * 5 * 64


def test_integers():
    column = pa.array([[0.1, -0.1, float(np.float32(1e-45))], [1.0], []], pa.list_(pa.float32()))
    assert codes.integers(column, 3).tolist() == [[409, -410, 0], [4096, 0, 0], [0, 0, 0]]
    large = codes.integers(pa.array([[3e38]], pa.list_(pa.float32())), 1)
    assert large.dtype == object and large[0, 0] == int(float(np.float32(3e38))) * 4096


def test_whole_tables_of_codes(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table(spark, DATA, "embeddings").collect()]
    assert sorted(map(tuple, codes.op12_vector_codes(spark, DATA).collect()), key=repr) == coded(rows)
