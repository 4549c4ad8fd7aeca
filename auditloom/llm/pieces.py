"""SentencePiece segmentations: sampled encoding, decoding, and exact token counts.

Texts are taken as the tokenizer takes them: one space in front of a text that
is not empty, spaces stand for the word mark, no other change.  No piece has a
space after another character and no piece has a tab or line break, so every
piece lies inside one unit: a run of spaces with the word behind it, or one
other white-space byte.  Lattices are therefore built per distinct unit.

Sampling is forward filtering, backward sampling.  Piece z has probability
proportional to (rank + 1) ** -TEMPER, its rank being that of the vocabulary's
score.  Forward sums give every byte position of a unit the total weight of the
segmentations up to it; going backward from the unit's end, each step draws the
last piece by its share of that sum.  Draws are hashes of doc_id, the unit's
place in the text and the step, so a rerun gives the same pieces.

Counting is Viterbi over the same vocabulary with its scores: an Aho-Corasick
automaton lists the pieces ending at each character, longest first, and a later
one wins only if it is strictly better, which is the tokenizer's tie rule.
Scores are integers, so the sum over units is exact.

A character that is no piece becomes the pieces of its UTF-8 bytes.  A literal
word mark in a text is such a character, so decoding always gives the text back.

Cases: null and empty texts have no pieces; a text of white space has pieces;
rows without doc_id share a seed; repeated rows get equal pieces; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import prepare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEMPER = 2.0
#: Bytes of text handled at once, and what a worker remembers from text to text.
SLICE = 1 << 20
KEEP_EDGES, KEEP_COUNTS = 2_000_000, 1_000_000

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces as bytes with spaces for word marks, their ids and scores, and the ids of bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [b""] * sp.get_piece_size()
        self.ids, self.scores = [], []
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = sp.id_to_piece(i).replace("▁", " ").encode()
                self.ids.append(i)
                self.scores.append(sp.get_score(i))
        self.lowest = min(self.scores)
        order = np.argsort(-np.array(self.scores), kind="stable")
        rank = np.empty(len(order))
        rank[order] = np.arange(len(order))
        self.log_p = np.full(len(self.bytes_of), -TEMPER * np.log(len(order) + 1.0))
        self.log_p[self.ids] = -TEMPER * np.log(rank + 1.0)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({len(self.bytes_of[i]) for i in self.ids}):
            own = np.array([i for i in self.ids if len(self.bytes_of[i]) == length], dtype=np.int32)
            joined = np.frombuffer(b"".join(self.bytes_of[i] for i in own), dtype=np.uint8)
            at = np.arange(len(own), dtype=np.int64) * length
            marks = K.fingerprints(joined, at, at + length)
            order = np.argsort(marks)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[marks >> _U(48)] = True
            self.by_length[length] = marks[order], own[order], seen

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, bounds, start of every unit and the end, text of every unit); data has the leading spaces."""
    texts = column.fill_null("")
    texts = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " "), texts, "")
    data, bounds = K.text_buffers(texts)
    space = data == 0x20
    other = K.WHITE[data] & ~space
    first = np.zeros(len(data), dtype=bool)
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    first |= other
    first[1:] |= other[:-1] | (space[1:] & ~space[:-1])
    start = np.flatnonzero(first)
    doc = np.searchsorted(bounds, start, side="right") - 1
    return data, bounds, np.append(start, len(data)), doc


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after another, and where each begins."""
    at = np.cumsum(length) - length
    return data[np.repeat(start - at, length) + np.arange(int(length.sum()))], at


class Lattices:
    """Forward-filtered lattices of the units seen so far, as flat arrays.

    Node `base[u] + p` is position p of unit u.  The edges that end in a node
    are neighbours from `begin` on; `share` is their cumulative share of the
    node's forward sum, the last one's being 1, so a draw steps along a few.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.marks = pd.Index(np.zeros(0, dtype=_U))
        self.base = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.share = np.zeros(0)
        self.id = np.zeros(0, dtype=np.int32)
        self.length = np.zeros(0, dtype=np.int32)
        self.nodes = 0

    def place(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The store's index of every unit; new ones are added."""
        code, distinct = pd.factorize(marks)
        if len(self.share) > KEEP_EDGES:
            self.clear()
        known = self.marks.get_indexer(pd.Index(distinct))
        new = np.flatnonzero(known < 0)
        if len(new):
            where = np.empty(len(distinct), dtype=np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
            known[new] = len(self.base) + np.arange(len(new))
            self._add(*_gather(data, start[where[new]], length[where[new]]), length[where[new]])
            self.marks = self.marks.append(pd.Index(distinct[new]))
        return known[code]

    def _add(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        n, total = len(size), len(data)
        base = at + np.arange(n)  # one node more than bytes in every unit
        room = np.repeat(at + size, size) - np.arange(total)  # bytes left in the unit
        node = np.arange(total) + np.repeat(np.arange(n), size)  # of the position before each byte
        sums = np.zeros(total + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * K._power(K._BASE, total + 1)[:total], out=sums[1:])
        back = K._power(K._INVERSE, total + 1)
        first = (data & 0xC0) != 0x80
        single = np.zeros(total, dtype=bool)
        chars = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        found = []
        for length, (marks, ids, seen) in self.vocab.by_length.items():
            p = np.flatnonzero((room >= length) & first)
            if not len(p):
                break
            h = K.mix64((sums[p + length] - sums[p]) * back[p] + _U((length * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
            maybe = seen[h >> _U(48)]
            p, h = p[maybe], h[maybe]
            i = np.minimum(np.searchsorted(marks, h), len(marks) - 1)
            hit = marks[i] == h
            p, i = p[hit], i[hit]
            single[p[chars[p] == length]] = True
            found.append((node[p] + length, ids[i], length))
        for length in (1, 2, 3, 4):
            p = np.flatnonzero(first & ~single & (chars == length) & (room >= length))
            found.append((node[p] + length, np.full(len(p), -1, dtype=np.int32), length))
        n_nodes = total + n
        count = np.zeros(n_nodes + 1, dtype=np.int64)
        for end, _, _ in found:
            count[end + 1] += 1
        begin = np.cumsum(count)
        fill = begin[:-1].copy()
        ids = np.empty(int(begin[-1]), dtype=np.int32)
        lengths = np.empty(len(ids), dtype=np.int32)
        for end, own, length in found:
            slot = fill[end]
            ids[slot], lengths[slot] = own, length
            fill[end] += 1
        weight = np.where(ids >= 0, self.vocab.log_p[ids], -2 * TEMPER * np.log(len(self.vocab.ids)))
        forward = np.full(n_nodes, -np.inf)
        forward[base] = 0.0
        share = np.empty(len(ids))
        in_edges = np.diff(begin)
        place = np.arange(n_nodes) - np.repeat(base, size + 1)
        live = np.flatnonzero(in_edges)
        live = live[np.argsort(place[live], kind="stable")]
        cuts = np.searchsorted(place[live], np.arange(1, (int(size.max()) if n else 0) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            ends = live[lo:hi]
            if not len(ends):
                continue
            k = in_edges[ends]
            off = np.cumsum(k) - k
            e = np.repeat(begin[ends] - off, k) + np.arange(int(k.sum()))
            value = weight[e] + forward[np.repeat(ends, k) - lengths[e]]
            top = np.maximum.reduceat(value, off)
            part = np.exp(value - np.repeat(top, k))
            whole = np.add.reduceat(part, off)
            forward[ends] = top + np.log(whole)
            run = np.cumsum(part / np.repeat(whole, k))
            run -= np.repeat(np.concatenate([[0.0], run[off[1:] - 1]]), k)
            run[off + k - 1] = 1.0
            share[e] = run
        self.begin = np.concatenate([self.begin, begin[:-1] + len(self.share)])
        self.share = np.concatenate([self.share, share])
        self.id, self.length = np.concatenate([self.id, ids]), np.concatenate([self.length, lengths])
        self.base, self.size = np.concatenate([self.base, base + self.nodes]), np.concatenate([self.size, size])
        self.nodes += n_nodes

    def sample(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces per unit, ids, lengths): one drawn segmentation for each unit in turn."""
        low, at = self.base[unit], self.base[unit] + self.size[unit]
        who = np.arange(len(unit))
        drawn, owners = [], []
        step = 0
        while len(who):
            step += 1
            u = K.unit(K.mix64(seed[who] + _U((step * int(_GOLD)) & 0xFFFFFFFFFFFFFFFF)))
            edge = self.begin[at]
            on = np.flatnonzero(self.share[edge] < u)
            while len(on):
                edge[on] += 1
                on = on[self.share[edge[on]] < u[on]]
            drawn.append(edge)
            owners.append(who)
            at = at - self.length[edge]
            more = at > low[who]
            who, at = who[more], at[more]
        count = np.zeros(len(unit), dtype=np.int64)
        for own in owners:
            count[own] += 1
        end = np.cumsum(count)
        edges = np.empty(int(end[-1]) if len(end) else 0, dtype=np.int64)
        for back, (own, edge) in enumerate(zip(owners, drawn, strict=True), 1):
            edges[end[own] - back] = edge
        return count, self.id[edges], self.length[edges]


def _encoder(path: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        store = Lattices(vocab)
        for batch in batches:
            for part in K.slices(batch, "text", SLICE):
                data, bounds, start, doc = units(part.column("text"))
                length = np.diff(start)
                index = store.place(data, start[:-1], length, K.fingerprints(data, start[:-1], start[1:]))
                row = part.column("doc_id").fill_null(0).to_numpy().view(_U)
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                count, ids, lengths = store.sample(index, K.mix64(K.mix64(row + _GOLD)[doc] + number.astype(_U) * _GOLD))
                spread = np.where(ids < 0, lengths, 1)
                flat = np.repeat(ids, spread)
                missing = np.flatnonzero(ids < 0)
                if len(missing):  # bytes of characters that are no pieces
                    begin = np.cumsum(lengths) - lengths
                    raw, _ = _gather(data, begin[missing], lengths[missing].astype(np.int64))
                    flat[flat < 0] = vocab.byte_ids[raw]
                ends = np.concatenate([[0], np.cumsum(spread)])[np.concatenate([[0], np.cumsum(count)])]
                ends = ends[np.searchsorted(doc, np.arange(part.num_rows + 1))]
                back = [vocab.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                same = pc.equal(pa.array(back, type=pa.binary()), part.column("text").fill_null("").cast(pa.binary()))
                columns = [part.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), same]
                names = ["doc_id", "n_pieces", "piece_ids", "lossless"]
                if with_text:
                    columns.append(pa.array(back, type=pa.binary()).cast(pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str = MODEL, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_pieces, piece_ids, whether decoding gave the text back, and on request the decoded text."""
    prepare(docs.sparkSession)
    return _texts(docs).mapInArrow(_encoder(path, with_text), "doc_id long, n_pieces long, piece_ids array<int>, lossless boolean" + ", decoded string" * with_text)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """Per row of encoded (doc_id, piece_ids): doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(np.array(ids or [], dtype=np.int32)) for ids in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    prepare(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "piece_ids").mapInArrow(run, "doc_id long, text string")


class Counter:
    """Best score and piece count of units, by Aho-Corasick matches and dynamic programming."""

    def __init__(self, vocab: Vocabulary) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.singles = set()
        for i, score in zip(vocab.ids, vocab.scores, strict=True):
            piece = vocab.bytes_of[i].decode()
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.singles.add(piece)
        self.automaton.make_automaton()
        self.unknown = vocab.lowest - 10.0
        self.marks = pd.Index(np.zeros(0, dtype=_U))
        self.best, self.pieces = np.zeros(0), np.zeros(0, dtype=np.int64)

    def one(self, text: str) -> tuple[float, int]:
        """With characters that are no pieces: each is an edge of its own, worth `unknown` and as many pieces as bytes."""
        n = len(text)
        best, count = [None] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for i, c in enumerate(text):
            for length, score in ends[i]:
                value = best[i + 1 - length] + score
                if best[i + 1] is None or value > best[i + 1]:
                    best[i + 1], count[i + 1] = value, count[i + 1 - length] + 1
            if c not in self.singles:
                value = best[i] + self.unknown
                if best[i + 1] is None or value > best[i + 1]:
                    best[i + 1], count[i + 1] = value, count[i] + len(c.encode())
        return best[n], count[n]

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units that consist of single-character pieces go through the automaton in one run, apart by line breaks."""
        best_of, count_of = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        plain = []
        for i, t in enumerate(texts):
            if self.singles.issuperset(t):
                plain.append(i)
            else:
                best_of[i], count_of[i] = self.one(t)
        joined = "\n".join([texts[i] for i in plain])
        best, count = [0.0] * (len(joined) + 1), [0] * (len(joined) + 1)
        last = 0
        for end, (length, score) in self.automaton.iter(joined):
            value = best[end + 1 - length] + score
            if end + 1 != last:
                last = end + 1
                best[last], count[last] = value, count[last - length] + 1
            elif value > best[last]:
                best[last], count[last] = value, count[last - length] + 1
        if plain:
            at = np.cumsum([len(texts[i]) + 1 for i in plain]) - 1
            best_of[plain], count_of[plain] = np.array(best)[at], np.array(count)[at]
        return best_of, count_of

    def look(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best score, pieces) of every unit."""
        code, distinct = pd.factorize(K.fingerprints(data, start, start + length))
        if len(self.marks) > KEEP_COUNTS:
            self.marks, self.best, self.pieces = pd.Index(np.zeros(0, dtype=_U)), np.zeros(0), np.zeros(0, dtype=np.int64)
        known = self.marks.get_indexer(pd.Index(distinct))
        new = np.flatnonzero(known < 0)
        if len(new):
            where = np.empty(len(distinct), dtype=np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
            raw, at = _gather(data, start[where[new]], length[where[new]])
            raw, at = raw.tobytes(), at.tolist()
            best, count = self.many([raw[a:b].decode() for a, b in zip(at, [*at[1:], len(raw)], strict=True)])
            known[new] = len(self.marks) + np.arange(len(new))
            self.marks, self.best, self.pieces = self.marks.append(pd.Index(distinct[new])), np.concatenate([self.best, best]), np.concatenate([self.pieces, count])
        return self.best[known][code], self.pieces[known][code]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Per row of docs: doc_id, n_chars (code points), n_tokens and the best segmentation's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(vocabulary(path))
        counter = _counters[path]
        for batch in batches:
            for part in K.slices(batch, "text", SLICE):
                data, _, start, doc = units(part.column("text"))
                best, count = counter.look(data, start[:-1], np.diff(start))
                total = np.bincount(doc, weights=count, minlength=part.num_rows).astype(np.int64)
                score = np.bincount(doc, weights=best, minlength=part.num_rows)
                chars = pc.utf8_length(part.column("text").fill_null("")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), chars, pa.array(total), pa.array(score)], names=["doc_id", "n_chars", "n_tokens", "score"])

    prepare(docs.sparkSession)
    return _texts(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")
