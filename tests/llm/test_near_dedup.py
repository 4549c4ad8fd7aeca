import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.llm import near_dedup as N
from auditloom.llm import textkernel as K

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def shingles(text, width):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words_of(text)]
    return set() if not w else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return {(d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True)}


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"W{i}" if i % 3 else f"wört{i}" for i in range(400)]
    rows = []
    for d in range(n):
        base = r.choice(rows)[1] if rows and r.random() < 0.6 else None
        if base and words_of(base):
            w = words_of(base)
            for _ in range(r.choice((0, 1, 1, 2, 4, 8))):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = r.choice(SPACE).join(w)
        else:
            text = " ".join(r.choice(vocab) for _ in range(r.choice((1, 2, 3, 30, 80, 200))))
        rows.append((d, text))
    return rows


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 512), (5, 80, 512), (3, 85, 4)])
def test_against_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(N, "BUCKET_BLOCK", block)
    monkeypatch.setattr(N, "GROUP_BYTES", 4000 * block)
    monkeypatch.setattr(N, "ROOT_BYTES", block * 20)
    rows = [*corpus(250, width), (900, None), (901, ""), (902, " \t\n"), (903, "w1"), (904, "W1 "), (905, "a b"), (906, "A  b"), (907, "long " * 30000)]
    got = {tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    assert got == brute(rows, width, percent)


@pytest.mark.parametrize("changed", [3, 14, 60])
def test_large_groups(spark, monkeypatch, changed):
    """A group of which all, some or no members link, in many blocks."""
    monkeypatch.setattr(N, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(N, "GROUP_BYTES", 8000)
    r = random.Random(changed)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(120):
        w = list(base)
        for k in r.sample(range(200), r.randint(0, changed)):
            w[k] = f"x{r.randrange(10**6)}"
        rows.append((500 - d, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(x) for x in N.near_duplicates(frame, 3, 85).collect()}
    assert got == brute(sorted(rows), 3, 85)


def test_rows_are_copied_a_bounded_number_of_times(spark):
    """Every row of a bucket or a group goes to one unit, as long as the group is in bounds."""
    rows = spark.range(8000).select(F.lit(1).alias("key"), F.lit(8000).alias("n"), F.col("id").alias("rep"))
    assert N._dealt(rows).count() == 8000


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept int, n_shingles int")
    assert N.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kept int, component_id int")
    got = sorted(map(tuple, N.near_duplicates(docs).collect()), key=str)
    assert got == [(4, 2, 4, True), (9, 2, 4, False), (9, 2, 4, False), (None, 2, None, True), (None, 2, None, True)]
    kept = N.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [4, None, None]
    other = "one two three four five six seven"
    rows = [(4, "a b c d e f"), (9, "a b c d e f"), (9, other), (9, other), (3, "z y x w v u"), (3, "q q q q q q q")]
    kept = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(3, "q q q q q q q"), (3, "z y x w v u"), (4, "a b c d e f"), (9, other)]


def test_estimate_tracks_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for shared in (0, 50, 150, 255, 300):
        base = rng.integers(0, 2**63, 600).astype(np.uint64)
        a, b = np.unique(base[:300]), np.unique(np.concatenate([base[:shared], base[300 : 600 - shared]]))
        u, v = (N.registers(np.array([0, len(x)]), x) for x in (a, b))
        true = shared / (600 - shared)
        e = N.estimate(u, v, np.array([300.0]), np.array([300.0]))[0]
        errors.append(abs(e - true))
        assert e < 0.03 or N.estimated_over(e - 0.02, u, v, np.array([300.0]), np.array([300.0]))[0]
        assert e > 0.97 or not N.estimated_over(e + 0.02, u, v, np.array([300.0]), np.array([300.0]))[0]
        both = N.registers(np.array([0, len(np.union1d(a, b))]), np.union1d(a, b))
        assert (both == np.maximum(u, v)).all()  # sketches merge
    assert max(errors) < 0.15


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nab　é😀\x0b\x1c", max_size=40)), max_size=12), st.integers(2, 40))
@settings(max_examples=60, deadline=None)
def test_scan(texts, segment):
    old, K.SEGMENT = K.SEGMENT, segment
    try:
        w = K.scan(pa.array(texts, pa.string()))
    finally:
        K.SEGMENT = old
    got = [[] for _ in texts]
    for d, s, e in zip(w.doc, w.start, w.end, strict=True):
        got[d].append(bytes(w.data[s:e]).decode())
    assert got == [words_of(t) for t in texts]
    marks = {}
    for d, s, e, h in zip(w.doc, w.start, w.end, w.hash, strict=True):
        assert marks.setdefault(bytes(w.data[s:e]), h) == h
    assert len(set(marks.values())) == len(marks)
