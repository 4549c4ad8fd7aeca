import random
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from auditloom.llm import pieces as P

TEXTS = ["", None, " ", "the cat sat", "the cat sat", "  a\t\tb  \n c ", "日本語 😀𝔸 x", "▁ literal ▁mark", "a" * 3000, "x\x00y", "éèê ü ß", "The quick brown fox. " * 40]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_pieces", P.F.lit("clash"))


def test_lossless_and_reproducible(spark):
    one, two = (sorted(map(tuple, P.encode(docs(spark).repartition(n), with_text=True).collect())) for n in (1, 5))
    assert one == two
    assert [r[-1] for r in one] == [t or "" for t in TEXTS] and all(r[3] for r in one)
    back = P.decode(P.encode(docs(spark))).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert one[3][2] != one[4][2] or one[3][1] == one[4][1]  # other ids, other draws
    same = P.encode(spark.createDataFrame([(5, "the cat sat")] * 3, "doc_id long, text string")).collect()
    assert len({tuple(r.piece_ids) for r in same}) == 1
    assert P.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sampling_follows_the_lattice():
    v = P.vocabulary(P.MODEL)
    text = " onions"
    ids = {v.bytes_of[i].decode(): i for i in v.ids}

    def all_ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                for rest in all_ways(s[k:]):
                    yield (ids[s[:k]], *rest)

    weight = {w: float(np.exp(sum(v.log_p[i] for i in w))) for w in all_ways(text)}
    n = 40_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["onions"] * n)], names=["doc_id", "text"])
    seen = {}
    for out in P._encoder(P.MODEL, False)(iter([batch])):
        for way in out.column("piece_ids").to_pylist():
            seen[tuple(way)] = seen.get(tuple(way), 0) + 1
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for way, w in weight.items():
        share = w / total
        assert abs(seen.get(way, 0) / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 2e-4


def test_store_forgets(monkeypatch):
    monkeypatch.setattr(P, "KEEP_EDGES", 50)
    monkeypatch.setattr(P, "SLICE", 200)
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(40)) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches(list(P._encoder(P.MODEL, True)(iter([batch]))))
    assert out.column("decoded").to_pylist() == texts


@pytest.fixture(scope="module")
def unigram():
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    return Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))


def test_counts_equal_the_tokenizer(spark, unigram):
    r = random.Random(5)
    texts = [t for t in TEXTS if t is None or "▁" not in t] + ["".join(r.choice("aeiou tnshr  .,\né日") for _ in range(r.randint(1, 300))) for _ in range(150)]
    got = P.count_tokens(docs(spark, texts)).collect()
    for row in got:
        text = texts[row.doc_id] or ""
        assert row.n_chars == len(text)
        # characters that are no pieces come as their bytes: runs of them are one unknown to the tokenizer, of equal length
        assert row.n_tokens == (len(unigram.encode("▁" + text.replace(" ", "▁")).ids) if text else 0), text
    assert P.count_tokens(docs(spark, [])).count() == 0


def brute_count(counter, text):
    best = {0: (0.0, 0)}
    lengths = {}
    for piece in counter.automaton:
        lengths[piece] = counter.automaton.get(piece)
    for end in range(1, len(text) + 1):
        ways = [(best[s][0] + lengths[text[s:end]][1], -s, best[s][1] + 1) for s in range(max(0, end - 20), end) if text[s:end] in lengths]
        if text[end - 1] not in counter.singles:
            ways.append((best[end - 1][0] + counter.unknown, -(end - 1), best[end - 1][1] + len(text[end - 1].encode())))
        top = max(ways)
        best[end] = (top[0], top[2])
    return best[len(text)]


def test_counts_with_literal_marks():
    counter = P.Counter(P.vocabulary(P.MODEL))
    for text in (" ▁ literal", "▁▁", "a▁b", " the▁cat"):
        pieces = ["".join(g) for _, g in groupby(text, key=lambda c: c == "\n")]
        assert [counter.one(p) for p in pieces] == [brute_count(counter, p) for p in pieces]
