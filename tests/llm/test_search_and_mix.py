import math
import random
from collections import defaultdict

import numpy as np
import pytest

from auditloom.llm import hnsw as H
from auditloom.llm import mixing as M

from .test_near_dedup import words_of


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, dim))
    return (centers[rng.integers(0, 20, n)] + 0.6 * rng.normal(size=(n, dim))) * rng.uniform(0.5, 2, (n, 1))


def inner(a, b):
    """The inner product, summed in the order of the components."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def brute(rows, queries, k):
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    own = {}
    for i, v in queries:
        if (i, v) in rows:
            own[i] = min(own.get(i, v), v)
    out = {}
    for q, asked in own.items():
        near = sorted((-inner(v, asked), i) for i, v in rows if len(v) == len(asked))
        near.remove((-inner(asked, asked), q))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found_by(frame, asked, k=20):
    found = defaultdict(list)
    for r in H.search(H.build_index(frame), asked, k).orderBy("query_id", "rank").collect():
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return dict(found)


def test_recall_and_order(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(6000, 24, 1))]
    rows += [(7000 + i, rows[20][1]) for i in range(40)]  # equal vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = found_by(frame, frame.where("vec_id % 20 = 0"))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert set(found) == set(want)
    known = dict(rows)
    hits = 0
    for q, near in found.items():
        assert len(near) == 20 and len({i for i, _ in near}) == 20
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and all(s == inner(known[i], known[q]) for i, s in near)
        hits += sum(s >= want[q][-1][1] for _, s in near)
    assert hits / (20 * len(want)) > 0.95
    assert found[20] == want[20] and found[7000] == want[7000]  # ties in order of the ids


@pytest.mark.parametrize(("dim", "count"), [(64, 19), (64, 4000), (257, 300)])
def test_ties_are_exact(spark, dim, count):
    """Equal vectors have equal scores, in shards of any size, so their ranks are those of their ids."""
    r = np.random.default_rng(dim + count)
    one, two = r.normal(size=dim).tolist(), r.normal(size=dim).astype(np.float32).astype(float).tolist()
    rows = [(i * 7 % 100_003, one if i % 3 else two) for i in range(count)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [x for x in rows if x[0] % 20 == 0][:40]
    assert found_by(frame, spark.createDataFrame(asked, frame.schema)) == brute(rows, asked, 20)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (9, [2.0, 2.0, 2.0]), (20, [0.5, 0.5]), (60, None), (11, [-1.0, 4.0]), (11, [9.0, 9.0])]
    rows += [(80, [3.0, 3.0]), (80, [2.0, 8.0])] + [(90, [1.0, 1.5])] * 30
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    for k in (1, 3, 20, 60):
        assert found_by(frame, frame.where("vec_id % 20 = 0"), k) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], k)
    none = frame.limit(0)
    assert found_by(none, none) == {} and found_by(frame, none) == {} and found_by(none, frame) == {}


def test_shards_by_rows_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(H, "MIN_SHARDS", 1)
    monkeypatch.setattr(H, "SHARD_ROWS", 200)
    monkeypatch.setattr(H, "SHARD_BYTES", 8 * 300 * 50)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(600, 8, 2))] + [(1000 + i, v.tolist()) for i, v in enumerate(vectors(300, 300, 3))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = H.build_index(frame)
    assert {(r.dim, r["count"]) for r in index.groupBy("dim").count().collect()} == {(8, 3), (300, 6)}
    assert found_by(frame, frame.where("vec_id % 20 = 0")) == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)


def brute_targets(sizes):
    """Sharing by weight, capping and sharing the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target = sum(sizes.values()), dict.fromkeys(names, 0.0)
    free, left = set(names), float(total)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            for s in free:
                target[s] = share * weight[s]
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def corpus(n, seed):
    r = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "zz", "tiny"]
    rows = []
    for i in range(n):
        s = names[0] if r.random() < 0.5 else r.choice(names[:-1])
        rows.append((i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice((0, 1, 5, 40, 200)))), s))
    rows += [(5000, "one", "tiny"), (5001, None, "tiny"), (1, rows[1][1], rows[1][2]), (1, rows[1][1], rows[1][2]), (None, "no id", "a"), (1, "other text here", rows[1][2])]
    rows += [(None, "same words " * 9, "b")] * 120 + [(None, f"different words {i} " * 3, "b") for i in range(60)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    rows = corpus(400, seed)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, k int")
    got = M.taken(docs).collect()
    again = M.taken(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    size_of = [(i, len(words_of(t)), s) for i, t, s in rows]
    assert sorted((str((r.doc_id, r.size, r.source)) for r in got)) == sorted(map(str, size_of))
    sizes = defaultdict(int)
    for _, n, s in size_of:
        sizes[s] += n
    want = brute_targets(sizes)
    mass = defaultdict(int)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        mass[r.source] += r.taken
    for s, t in want.items():
        assert abs(mass[s] - t) <= 4 + 0.01 * t
    out = M.mix(docs)
    assert out.columns == docs.columns
    copies, held = defaultdict(int), defaultdict(int)
    for r in out.collect():
        held[r.doc_id, r.source] += 1
    for r in got:
        copies[r.doc_id, r.source] += int(r.taken / r.size + 0.5) if r.size else 0
    assert {k: v for k, v in copies.items() if v} == held


def test_schedule_is_evenly_spread(spark):
    docs = spark.createDataFrame([(i, "w " * 64, "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    rows = M.schedule(docs).where("number is not null").select("number", "source", "target", "words").collect()
    n_slots = max(r.number for r in rows) + 1
    total = sum({r.source: r.target for r in rows}.values())
    for r in {r.source: r for r in rows}.values():
        slots = sorted({x.number for x in rows if x.source == r.source})
        for k in range(1, 20):
            upto = n_slots * k // 20
            assert abs(sum(x < upto for x in slots) - upto * r.target / total) < 5


def test_many_sources(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(1, 30), f"s{r.randrange(700):x}" if i % 3 else "hot") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.taken(docs).collect()
    sizes, mass = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    want = brute_targets(sizes)
    assert len(got) == len(rows) and len(want) > 600
    for x in got:
        assert math.isclose(x.target, want[x.source], rel_tol=1e-9) and x.source_size == sizes[x.source] and 0 <= x.taken <= 3 * x.size
        mass[x.source] += x.taken
    assert all(abs(mass[s] - t) <= 6 for s, t in want.items())


def test_small(spark):
    schema = "doc_id long, text string, source string"
    for rows, want in (([], []), ([(1, None, None)], [(1, 0, 0, 0.0, 0)]), ([(1, "a b c", None)], [(1, 3, 3, 3.0, 3)])):
        got = [tuple(r) for r in M.taken(spark.createDataFrame(rows, schema)).select("doc_id", "size", "source_size", "target", "taken").collect()]
        assert got == want
        assert M.mix(spark.createDataFrame(rows, schema)).count() == (1 if rows and rows[0][1] else 0)
