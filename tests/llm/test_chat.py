import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import chat as C

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_end|> there"), (1, 2, "assistant", "<|im_start|>assistant\n<\\|x|>"), (1, 3, "assistant", "again"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (3, None, None, "x"), (3, 1, "assistant", "é😀"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"),
    (None, 0, "assistant", "lost"), (4, 0, "us\ner<|im_sep|>", "role with controls"), (5, 0, "assistant", "long " * 50_000),
]


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        turns = [(t[2], t[3]) for t in turns]
        said = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(C.START + C.escape(r) + C.SEP + C.escape(t) + C.END) for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), chars))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, parts):
    rows = spark.createDataFrame([(*r, 0) for r in ROWS], "conv_id long, turn long, role string, text string, loss_mask int").repartition(parts)
    formatted = C.format_turns(rows)
    assert sorted(map(tuple, C.digests(formatted).collect()), key=str) == brute(ROWS)
    assert C.digests(C.format_turns(rows.limit(0))).count() == 0


def test_one_conversation_over_many_batches(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(3000)]
    got = C.digests(C.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r) for r in got] == brute(rows)


@given(st.lists(st.tuples(st.sampled_from(("user", "assistant", "<|im_sep|>")), st.text(alphabet="<|\\im_startendsp>é \n", max_size=30)), max_size=5))
@settings(max_examples=150, deadline=None)
def test_round_trip(turns):
    t = C.template(C.RANKS)
    ids, mask = t.assemble(turns)
    assert [(r, x) for r, x, _ in t.read(ids, mask)] == turns
    assert [u for _, _, u in t.read(ids, mask)] == [x if r == "assistant" else "" for r, x in turns]
    whole = t.render(ids)
    assert whole == "".join(C.START + C.escape(r) + C.SEP + C.escape(x) + C.END for r, x in turns)
    assert whole.count(C.START) == whole.count(C.END) == whole.count(C.SEP) == len(turns)
    parts = [t.assemble([x]) for x in turns]
    assert ids.tolist() == [i for p in parts for i in p[0]] and np.array_equal(mask, np.concatenate([np.zeros(0, bool), *[p[1] for p in parts]]))
