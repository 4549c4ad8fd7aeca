import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from auditloom.llm import grams as G
from auditloom.llm import quality as Q
from auditloom.llm import rules as R

from .test_near_dedup import SPACE, words_of


def text(r, bad, n):
    base = [r.choice("the of and to cat house river stone green walk".split()) for _ in range(n)]
    return " ".join(w + r.choice(("###", "$$$", "***")) for w in base) if bad else " ".join(base)


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = [(i, text(r, i % 7 == 0, r.randint(55, 150))) for i in range(n)]
    labels = [(i, int(i % 7 != 0), 0) for i in range(0, n, 2)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, target string, bucket int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "é\x0b日本 😀 #$"), (905, "a b c a b c"), (906, "x\nx\n\n x\ny\ny\nx"), (907, "word " * 20000), (None, "the cat"), (3, "the cat")]


def xx(value, seed):
    return xxhash.xxh64_intdigest(value, seed)


def spark_hash(*values):
    """xxhash64 of the engine: strings by their bytes, longs by their 8 bytes, seed 42 passed on."""
    seed = 42
    for v in values:
        seed = xx(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_rules(rows, labels):
    quality = {}
    for i, q, t in labels:
        quality.setdefault(i, []).append((q, t))
    good = {i for i, x in quality.items() if i is not None and min(q for q, _ in x) == 1 and max(t or 0 for _, t in x) == 0}
    grams = []
    for _, t in rows:
        h = [spark_hash(w) for w in words_of(t)]
        grams.append([x % R.BUCKETS for x in h] + [R.BUCKETS + spark_hash(a, b) % R.BUCKETS for a, b in zip(h, h[1:], strict=False)])
    raw, target = [0] * (2 * R.BUCKETS), [0] * (2 * R.BUCKETS)
    for (i, _), g in zip(rows, grams, strict=True):
        for b in g:
            raw[b] += 1
            target[b] += i in good
    llr = []
    for part in (range(R.BUCKETS), range(R.BUCKETS, 2 * R.BUCKETS)):
        share = sum(target[b] for b in part) / max(1, sum(raw[b] for b in part))
        llr += [math.log((target[b] + R.PRIOR) / (share * raw[b] + R.PRIOR)) for b in part]
    out = []
    for (i, t), g in zip(rows, grams, strict=True):
        t = t or ""
        w = words_of(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n_of = {}
        for x in windows:
            n_of[x] = n_of.get(x, 0) + 1
        repeated = {k + d for k, x in enumerate(windows) if n_of[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        score = sum(llr[b] for b in g) / len(g) if g and any(target) else 0.0
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), round(score, 9), failed, not failed and score >= R.THRESHOLD))
    return sorted(out, key=str)


def test_rules_against_brute_force(spark):
    rows, labels = corpus(120)
    r = random.Random(2)
    rows += ODD + [(2000 + i, "".join(r.choice(("a", "b", "c", " ", SPACE, "\n")) for _ in range(400))) for i in range(20)]
    labels += [(3, 1, None), (0, 1, 0), (None, 1, 0)]
    docs, labs = frames(spark, rows, labels)
    got = [(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, round(x.llr, 9), x.base_failed, x.kept) for x in R.judge(docs, labs).collect()]
    want = brute_rules(rows, labels)
    assert [g[:6] + g[7:] for g in sorted(got, key=str)] == [w[:6] + w[7:] for w in want]
    assert np.allclose([g[6] for g in sorted(got, key=str)], [w[6] for w in want])
    kept = R.select(docs, labs)
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)


def test_rules_without_rows_or_labels(spark):
    docs, labs = frames(spark, corpus(20)[0], [])
    assert all(x.llr == 0.0 and x.kept for x in R.judge(docs, labs).collect() if not x.base_failed)
    assert R.judge(docs.limit(0), labs).count() == 0 and R.select(docs.limit(0), labs).count() == 0


def test_rules_plan_is_native(spark):
    docs, labs = frames(spark, *corpus(20))
    plan = R.judge(docs, labs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_classifier(spark):
    rows, labels = corpus(300)
    docs, labs = frames(spark, rows + ODD, labels)
    got = {x.doc_id: x for x in Q.resample(docs, labs).collect()}
    held = [i for i, _ in rows if i % 2]  # not labelled
    right = [got[i].kept == (i % 7 != 0) for i in held]
    assert sum(right) / len(right) > 0.97
    assert not any(got[i].kept for i in (900, 901, 902))
    kept = Q.select(docs, labs)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x.doc_id) for x in Q.resample(docs.repartition(7), labs).collect() if x.kept)
    assert Q.select(docs.limit(0), labs).count() == 0
    long = spark.createDataFrame([(1, "the cat " * 2_000_000, "x", 0)], docs.schema)
    assert [x.kept for x in Q.resample(long, labs).collect()] == [True] and R.judge(long, labs).first().n_words == 4_000_000
    unlabelled = Q.resample(docs, labs.limit(0)).collect()
    assert all(x.kept == (x.n_grams > 0) and x.log_weight == 0 for x in unlabelled)


M64 = 2**64 - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def word_hash(w):
    """A polynomial in the bytes of a word and its length."""
    raw, total, power = w.encode(), 0, 1
    for byte in raw:
        total, power = total + (byte + 1) * power & M64, power * 0x9E3779B97F4A7C15 & M64
    return mixed(total + len(raw) * 0xD6E8FEB86659FD93 & M64)


def pair_hash(a, b):
    acc = (2 ^ a) * 0x9E3779B97F4A7C15 & M64
    acc ^= acc >> 29
    acc = (acc ^ b) * 0xC2B2AE3D27D4EB4F & M64
    return mixed(acc ^ acc >> 29)


def shape_class(byte):
    if 97 <= byte <= 122 or byte >= 128:
        return 1
    return 2 if 65 <= byte <= 90 else 3 if 48 <= byte <= 57 else byte


def brute_buckets(text, buckets):
    """Buckets of words, word pairs and pairs of shapes, told from the text alone."""
    words = words_of(text)
    h = [word_hash(w) for w in words]
    shape = [shape_class(r[0]) << 16 | shape_class(r[min(1, len(r) - 1)]) << 8 | shape_class(r[-1]) for r in (w.encode() for w in words)]
    pairs = list(zip(range(len(words)), range(1, len(words)), strict=False))
    out = [mixed(x ^ 0x9E3779B97F4A7C15) % buckets for x in h]
    out += [mixed(pair_hash(h[i], h[j]) ^ 0xC2B2AE3D27D4EB4F) % buckets for i, j in pairs]
    return out + [mixed((shape[i] << 25 | shape[j] << 1 | (h[i] == h[j])) ^ 0x165667B19E3779F9) % buckets for i, j in pairs]


def brute_selection(rows, labels):
    """({id: (n_grams, log weight, key)}, ids kept) by plain Python: hashes, models, tempered weights, k and the choice."""
    quality = {}
    for i, q, t in labels:
        if i is not None and q is not None:
            quality.setdefault(i, []).append((q, t))
    good = {i: min(q for q, _ in x) == 1 for i, x in quality.items()}
    train = {i for i, x in quality.items() if good[i] and max(t for _, t in x) == 0}
    raw, target, of = {}, {}, {}
    for i, t in rows:
        of[i] = brute_buckets(t or "", Q.BUCKETS)
        for b in of[i]:
            raw[b] = raw.get(b, 0) + 1
            target[b] = target.get(b, 0) + (i in train)
    share = sum(target.values()) / sum(raw.values())
    found = {}
    for i, g in of.items():
        weight = sum(math.log((target[b] + Q.PRIOR) / (raw[b] * share + Q.PRIOR)) for b in g) * Q.PASSAGE / (Q.PASSAGE + len(g))
        uniform = ((mixed((i * 0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4F) & M64) >> 11) + 0.5) / 2**53
        found[i] = (len(g), weight, weight - math.log(-math.log(uniform)))
    ranked = sorted((i for i in of if of[i]), key=lambda i: -found[i][2])
    known = [i for i in ranked if i in good]
    return found, set(ranked[: math.ceil(len(ranked) * sum(good[i] for i in known) / len(known))])


def test_selection_against_brute_force(spark):
    rows, labels = corpus(80)
    rows += [(900, None), (901, "a"), (902, "é é 日本 A1 b-"), (903, " ")]
    labels += [(8, 1, 1), (901, 1, 1), (10, 0, 0), (None, 1, 0), (902, None, 0)]
    want, kept = brute_selection(rows, labels)
    got = {x.doc_id: x for x in Q.resample(*frames(spark, rows, labels)).collect()}
    for i, (n, weight, key) in want.items():
        assert got[i].n_grams == n and math.isclose(got[i].log_weight, weight, abs_tol=1e-9) and math.isclose(got[i].key, key, abs_tol=1e-9)
    assert {i for i, x in got.items() if x.kept} == kept and 0 < len(kept) < len(rows)


def test_noise_matters_between_good_documents(spark):
    rows, labels = corpus(300)
    docs, labs = frames(spark, rows, labels)
    got = Q.resample(docs, labs, k=150).collect()
    plain = {x.doc_id for x in sorted(got, key=lambda x: -x.log_weight)[:150]}
    kept = {x.doc_id for x in got if x.kept}
    assert len(kept) == 150 and 20 < len(kept - plain) < 130 and not any(i % 7 == 0 for i in kept)


def test_gumbel_top_k(spark):
    rows, labels = corpus(200)
    docs, labs = frames(spark, rows, labels)
    every = sorted((x.key for x in Q.resample(docs, labs).collect()), reverse=True)
    for k in (0, 1, 17, 200, 500):
        assert sorted((x.key for x in Q.resample(docs, labs, k=k).collect() if x.kept), reverse=True) == every[:k]
    noise = Q.gumbel(pa.array(range(20000), pa.int64()))
    assert abs(noise.mean() - 0.5772) < 0.04 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.04


def many_words(n, seed=3):
    """A corpus with more n-grams than the floor of buckets holds; bad documents have n-grams of their own."""
    r = random.Random(seed)
    rows = [(i, " ".join(f"{'bad' if i % 7 == 0 else 'good'}{r.randrange(200)}" if r.random() < 0.6 else f"w{r.randrange(10**6)}" for _ in range(100))) for i in range(n)]
    return rows, [(i, int(i % 7 != 0), 0) for i in range(0, n, 2)]


def test_buckets_grow_with_the_corpus(spark):
    small, large = (frames(spark, *many_words(n))[0] for n in (200, 3200))
    held = G.bucket_count(small, 6, 64)
    assert held > 64 and abs(G.bucket_count(large, 6, 64) - 4 * held) <= 24
    assert G.bucket_count(small, 1, R.BUCKETS) == R.BUCKETS and G.bucket_count(small.limit(0), 6, 64) == 64


def test_bad_documents_fail_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 64)
    for n in (1600, 6400):
        docs, labs = frames(spark, *many_words(n))
        kept = {x.doc_id: x.kept for x in R.judge(docs, labs).collect()}
        assert sum(kept[i] for i in range(0, n, 7)) <= 0.05 * n / 7
        assert sum(kept[i] for i in range(n) if i % 7) >= 0.95 * n * 6 / 7


def test_distributed_table_gives_the_same(spark, monkeypatch):
    rows, labels = corpus(150)
    docs, labs = frames(spark, rows + ODD + rows[:5], labels)
    dense = [sorted(map(str, (x.select("doc_id", *(F.round(c, 6) if c in ("llr", "log_weight", "key") else c for c in x.columns[1:])).collect()))) for x in (R.judge(docs, labs), Q.resample(docs, labs), R.select(docs, labs), Q.select(docs, labs))]
    monkeypatch.setattr(R, "DENSE", 1)
    monkeypatch.setattr(Q, "DENSE", 1)
    wide = [sorted(map(str, (x.select("doc_id", *(F.round(c, 6) if c in ("llr", "log_weight", "key") else c for c in x.columns[1:])).collect()))) for x in (R.judge(docs, labs), Q.resample(docs, labs), R.select(docs, labs), Q.select(docs, labs))]
    assert dense == wide
