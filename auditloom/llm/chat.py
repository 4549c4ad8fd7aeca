"""Chat formatting by token-level assembly.

A conversation is the tokens of its turns: im_start, the role's tokens, im_sep,
the text's tokens, im_end.  The three control tokens have reserved ids above the
vocabulary and are spliced between segments that are encoded separately, so no
text can produce them.  In the rendered string the control tokens are written
out; inside roles and texts every "<|" is therefore escaped to "<\\|", and one
backslash is added to any "<", backslashes, "|" that is there already, which
takes one backslash away again when read.

The loss mask covers the tokens of assistant texts.  Spans are opened with +1 and
closed with -1 and the mask is the prefix sum of these marks.

Rows are dealt by conv_id and sorted by turn; a task folds its sorted rows one
by one with running digests, so memory does not depend on a conversation's
length.  The digest of a conversation is sequential, hence one conversation is
one task's work.

Cases: null text, role and turn are empty, empty and first; rows with the same
turn are ordered by role, then text; repeated rows are turns of their own; rows
without conv_id are one conversation; an empty table gives only what is added;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Reserved ids come this far after the vocabulary's last rank; the one between is its end-of-text id.
RESERVED_FROM = 1

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


class Template:
    """The byte-level tokenizer with three reserved ids."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.start, self.sep, self.end = (len(self.bytes_of) + RESERVED_FROM + i for i in range(3))

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, loss mask) of some turns (role, text)."""
        ids: list[int] = []
        opened, closed = [], []
        for role, text in turns:
            ids.append(self.start)
            ids += self.tokens.encode_ordinary(escape(role))
            ids.append(self.sep)
            opened.append(len(ids)) if role == "assistant" else None
            ids += self.tokens.encode_ordinary(escape(text))
            closed.append(len(ids)) if role == "assistant" else None
            ids.append(self.end)
        marks = np.zeros(len(ids) + 1, dtype=np.int32)
        np.add.at(marks, opened, 1)
        np.add.at(marks, closed, -1)
        return np.array(ids, dtype=np.int32), np.cumsum(marks)[:-1].astype(bool)

    def _text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()

    def render(self, ids: np.ndarray) -> str:
        """The formatted string."""
        names = {self.start: START, self.sep: SEP, self.end: END}
        cuts = np.flatnonzero(ids >= self.start)
        out, at = [], 0
        for c in cuts.tolist():
            out += [self._text(ids[at:c]), names[int(ids[c])]]
            at = c + 1
        return "".join([*out, self._text(ids[at:])])

    def read(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str]]:
        """(role, text, text under the mask) of each turn, from the output alone."""
        begins, seps, ends = (np.flatnonzero(ids == x).tolist() for x in (self.start, self.sep, self.end))
        out = []
        for b, s, e in zip(begins, seps, ends, strict=True):
            body = ids[s + 1 : e]
            out.append((unescape(self._text(ids[b + 1 : s])), unescape(self._text(body)), unescape(self._text(body[mask[s + 1 : e]]))))
        return out


_templates: dict[str, Template] = {}


def template(path: str) -> Template:
    if path not in _templates:
        _templates[path] = Template(path)
    return _templates[path]


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def format_turns(conversations: DataFrame, path: str = RANKS) -> DataFrame:
    """Per turn, in order within each conversation: conv_id, turn, token_ids and loss_mask.

    A conversation's tokens are its turns' tokens one after another.
    """
    prepare(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        for batch in batches:
            made = [t.assemble([row]) for row in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.bool_()))], names=["conv_id", "turn", "token_ids", "loss_mask"])

    return _sorted(conversations).mapInArrow(run, "conv_id long, turn long, token_ids array<int>, loss_mask array<boolean>")


class _Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, t: Template, ids: np.ndarray, mask: np.ndarray) -> None:
        self.chars += len(t.render(ids))
        for role, text, under in t.read(ids, mask):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            self.loss.update(under.encode())
            self.loss_chars += len(under)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame, path: str = RANKS) -> DataFrame:
    """Per conversation of format_turns(): counts and digests of what its tokens and mask say."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, now, done = template(path), None, []
        for batch in batches:
            ids, mask = batch.column("token_ids"), batch.column("loss_mask")
            flat, marks, at = ids.flatten().to_numpy(), mask.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(t, flat[at[i] : at[i + 1]], marks[at[i] : at[i + 1]])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(now.row(), types, strict=True)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
