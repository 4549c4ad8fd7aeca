"""Near-duplicate documents by SetSketch registers, bands, a likelihood estimate and exact verification.

Every text becomes the set of its distinct w-word shingles (A-Z lower-cased).
Each set gets a SetSketch: register i holds floor(1 - log_b h_i), clipped to 16
bits, where h_i is the least value that any shingle puts there.  Shingles place
exponentially spaced points on registers chosen at random, stopping once no
register of the set can still change.  Sketches of equal sets are equal,
sketches merge by register-wise maximum, and two registers agree with a
probability close to the Jaccard similarity.

Rows with equal sets are one class, represented by its least id.  Classes that
share a band of registers are candidates.  A candidate pair is dropped only if
the joint maximum-likelihood estimate from both sketches lies more than MARGIN
standard deviations under the threshold; all others are decided on full sets.

Two passes keep pairs from being written out.  The first joins bucket mates
with enough equal registers into groups, giving only links of a spanning forest.
The second holds members against each other by size, then estimate, then full
sets, and searches breadth first, so that again it gives only spanning links.  A
group of up to GROUP_BYTES of text is one unit of work.  In a larger one all are
first held against the group's least member; those that link to it are in one
component already, and only the others are then held against each other and
against the rest, in blocks of GROUP_BYTES, each pair of blocks being one unit.
Large buckets are split into blocks likewise, so nothing has to fit one task.

Cases: null and blank texts have empty sets and stay alone; a text with fewer
than w words is one shingle, its whole sequence; rows that share an id are one
document; rows without an id are kept and linked with nothing; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import checked, components, prepare, settle

REGISTERS = 128
ROWS_PER_BAND = 4
BASE = 1.001
RATE = 20.0
LIMIT = 65535
MARGIN = 5.0
#: Rows of a bucket in one block, bytes of text of a group in one block; buckets of up to SMALL rows are held against each other all at once.
BUCKET_BLOCK, GROUP_BYTES, SMALL = 8192, 2 << 20, 8
#: So many bytes of the groups' least members may be broadcast.
ROOT_BYTES = 64 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, shingles): text i's distinct shingle fingerprints, sorted, are shingles[bounds[i]:bounds[i+1]]."""
    words = K.scan(column, lower=True)
    doc, grams = K.ngrams(words, width)
    counts = words.per_doc()
    short = np.flatnonzero((counts > 0) & (counts < width))
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(column)))]).astype(np.int64)
    whole = {}
    for i in short.tolist():
        acc = K.mix64(np.array([counts[i] + 1_000_003], dtype=_U))
        for h in words.hash[first[i] : first[i + 1]]:
            acc = K.mix64(acc * _STEP + h)
        whole[i] = acc
    out, bounds = [], np.zeros(len(column) + 1, dtype=np.int64)
    for i in range(len(column)):
        if i in whole:
            part = whole[i]
        else:
            part = np.sort(grams[at[i] : at[i + 1]])
            if len(part) > 1:
                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        out.append(part)
        bounds[i + 1] = bounds[i] + len(part)
    return bounds, np.concatenate(out) if out else np.zeros(0, dtype=_U)


def registers(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers, one row of REGISTERS uint16 per set."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    least = np.full(n * REGISTERS, np.inf)
    x = np.zeros(len(shingles))
    state, step = shingles, 0
    while len(state):
        step += 1
        r = K.mix64(state + _U((step * int(_STEP)) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(K.unit(r)) / (RATE * REGISTERS)
        np.minimum.at(least, doc * REGISTERS + (K.mix64(r ^ _STEP) % _U(REGISTERS)).astype(np.int64), x)
        present, place = np.unique(doc, return_inverse=True) if step > 1 else (np.arange(n), doc)
        alive = x < least.reshape(n, REGISTERS)[present].max(axis=1)[place]
        state, x, doc = state[alive], x[alive], doc[alive]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least) / np.log(BASE))
    return np.clip(np.nan_to_num(k, nan=0.0, neginf=0.0), 0, LIMIT).astype(np.uint16).reshape(n, REGISTERS)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                bounds, shingles = shingle_sets(part.column("text"), width)
                sizes = np.diff(bounds)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                marks = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.zeros(len(sizes), dtype=_U)
                    np.add.at(total, doc, K.mix64(shingles ^ _U(salt)))
                    marks.append(pa.array(K.mix64(total + sizes.astype(_U)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("mark"), pa.array(sizes), *marks, _binary(registers(bounds, shingles))], names=["doc_id", "mark", "n_shingles", "f1", "f2", "sketch"])

    return run


def _likelihood(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray):
    """Log-likelihood of Jaccard values given register rows u, v and set sizes nu, nv; it is concave."""
    above, below = (u > v).sum(axis=1), (u < v).sum(axis=1)
    equal = u.shape[1] - above - below
    a, b = nu / (nu + nv), nv / (nu + nv)
    scale = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE), 1e-12, 1 - 1e-12)

    def value(j: np.ndarray | float) -> np.ndarray:
        up, down = p(a - b * j), p(b - a * j)
        return above * np.log(up) + below * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))

    return value, np.minimum(a / b, b / a)


def estimate(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard estimates, by golden-section search."""
    value, high = _likelihood(u, v, nu, nv)
    low, ratio = np.zeros(len(high)), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = value(left) > value(right)
        high, low = np.where(better, right, high), np.where(better, low, left)
    return (low + high) / 2


def estimated_over(level: float, u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Whether estimate() reaches level, told by the slope of the concave likelihood there."""
    value, _ = _likelihood(u, v, nu, nv)
    return value(level + 1e-4) >= value(level)


def _rows(column: pa.Array) -> np.ndarray:
    data, _ = K.text_buffers(column)
    return data.view(np.uint16).reshape(len(column), REGISTERS)


def _floor(percent: int) -> float:
    share = percent / 100
    return share - MARGIN * np.sqrt(share * (1 - share) / REGISTERS)


def _chunks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups of a sorted partition, with the bounds of the groups in each run."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def ready(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, rows
        if not rows:
            return
        full = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(full.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = full.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        bounds = np.append(np.flatnonzero(new), full.num_rows)
        if not last:
            bounds = bounds[:-1]
        held, rows = full.slice(int(bounds[-1])).to_batches(), full.num_rows - int(bounds[-1])
        if len(bounds) > 1:
            yield full.slice(0, int(bounds[-1])), bounds

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= size:
                yield from ready(False)
    yield from ready(True)


def _search(n: int, same_block: np.ndarray | None, test) -> Iterator[list[int]]:
    """The connected components of more than one node of the graph on 0..n-1 whose edges test(x, others) tells.

    same_block, if given, holds each node's block; then only pairs of different blocks count.
    """
    left = np.ones(n, dtype=bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front, reached = [root], [root]
        while front:
            x = front.pop()
            others = np.flatnonzero(left if same_block is None else left & (same_block != same_block[x]))
            if not len(others):
                continue
            near = others[test(x, others)]
            left[near] = False
            front += near.tolist()
            reached += near.tolist()
        if len(reached) > 1:
            yield reached


def _to_least(rep: np.ndarray, reached: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links from the members of a component to its least id: equal buckets give equal links."""
    own = rep[reached]
    return own[own != own.min()], np.full(int((own != own.min()).sum()), own.min())


def _grouper(percent: int):
    """Links that span the graph of bucket mates with enough equal registers."""
    need = int(np.ceil(_floor(percent) * REGISTERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in _chunks(batches, ("key", "bi", "bj"), 16384):
            sketch = _rows(part.column("sketch").combine_chunks())
            rep, size = part.column("rep").to_numpy(), part.column("n_shingles").to_numpy()
            block, pair = part.column("block").to_numpy(), part.column("bi").to_numpy() != part.column("bj").to_numpy()
            lengths = np.diff(bounds)
            x, y, links = [], [], []
            # within small groups, row k is held against row k + step
            for step in range(1, SMALL):
                at = np.repeat(bounds[:-1], np.where(lengths <= SMALL, np.maximum(lengths - step, 0), 0))
                if not len(at):
                    break
                run_of = np.maximum(lengths - step, 0) * (lengths <= SMALL)
                at = at + np.arange(len(at)) - np.repeat(np.cumsum(run_of) - run_of, run_of)
                other = at + step
                fits = (100 * np.minimum(size[at], size[other]) >= percent * np.maximum(size[at], size[other])) & ((sketch[at] == sketch[other]).sum(axis=1) >= need)
                x.append(at[fits])
                y.append(other[fits])
            for g in np.flatnonzero(lengths > SMALL).tolist():
                lo, hi = int(bounds[g]), int(bounds[g + 1])
                sk, sz = sketch[lo:hi], size[lo:hi]

                def test(i, others, sk=sk, sz=sz):
                    return (100 * np.minimum(sz[i], sz[others]) >= percent * np.maximum(sz[i], sz[others])) & ((sk[others] == sk[i]).sum(axis=1) >= need)

                links += [_to_least(rep[lo:hi], c) for c in _search(hi - lo, block[lo:hi] if pair[lo] else None, test)]
            links += [(rep[i], rep[j]) for i, j in zip(x, y, strict=True)]
            if links:
                a, b = (np.concatenate([link[side] for link in links]) for side in (0, 1))
                out = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    return run


def _verifier(width: int, percent: int):
    """Links that span the graph of group mates whose full sets are similar enough."""
    floor = _floor(percent)
    need = int(np.ceil(floor * REGISTERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in _chunks(batches, ("grp", "bi", "bj"), 512):
            sketch, text = _rows(part.column("sketch").combine_chunks()), part.column("text").combine_chunks()
            rep, size = part.column("rep").to_numpy(), part.column("n_shingles").to_numpy()
            block, pair = part.column("block").to_numpy(), part.column("bi").to_numpy() != part.column("bj").to_numpy()
            links = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                at, grams = shingle_sets(text.slice(lo, hi - lo), width)
                sk, sz = sketch[lo:hi], size[lo:hi]

                def test(i, others, sk=sk, sz=sz, at=at, grams=grams):
                    good = (100 * np.minimum(sz[i], sz[others]) >= percent * np.maximum(sz[i], sz[others])) & ((sk[others] == sk[i]).sum(axis=1) >= need)
                    ask = np.flatnonzero(good)
                    if not len(ask):
                        return good
                    y = others[ask]
                    ask_of = estimated_over(floor, sk[i : i + 1], sk[y], np.full(len(y), float(sz[i])), sz[y].astype(float))
                    own = grams[at[i] : at[i + 1]]
                    for k in np.flatnonzero(ask_of).tolist():
                        ask_of[k] = _similar(own, grams[at[y[k]] : at[y[k] + 1]], percent)
                    good[ask] = ask_of
                    return good

                links += [_to_least(rep[lo:hi], c) for c in _search(hi - lo, block[lo:hi] if pair[lo] else None, test)]
            if links:
                a, b = (np.concatenate([link[side] for link in links]) for side in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _against_root(width: int, percent: int):
    """Rows of large groups beside their group's least member: adds whether they link to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                at, grams = shingle_sets(part.column("text"), width)
                sizes = np.diff(at)
                hit, roots = np.zeros(part.num_rows, dtype=bool), {}
                for i, grp in enumerate(part.column("grp").to_pylist()):
                    if grp not in roots:
                        roots[grp] = shingle_sets(pa.array([part.column("root")[i].as_py()], pa.string()), width)[1]
                    own = roots[grp]
                    if 100 * min(sizes[i], len(own)) >= percent * max(sizes[i], len(own)):
                        hit[i] = _similar(own, grams[at[i] : at[i + 1]], percent)
                columns = [part.column(c) for c in ("grp", "rep", "n_shingles", "sketch", "text")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hit)], names=["grp", "rep", "n_shingles", "sketch", "text", "hit"])

    return run


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    place = np.searchsorted(one, two)
    both = int((one[np.minimum(place, len(one) - 1)] == two).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _dealt(rows: DataFrame) -> DataFrame:
    """Bucket rows (key, n, rep, ...) to blocks; a row goes to every pair of blocks that has its own."""
    n = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    rows = rows.withColumn("block", F.when(n > 1, F.pmod(F.xxhash64("rep", F.lit(7)), n)).otherwise(0).cast("int"))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("bi", F.least("block", "_j")).withColumn("bj", F.greatest("block", "_j")).drop("_j", "n")
    return rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")


def _verified(whole: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that span the graph of group mates; whole has (grp, rep, n_shingles, sketch, text)."""
    columns = ["grp", "rep", "n_shingles", "sketch", "text"]
    bytes_ = F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 64
    sums = settle(whole.groupBy("grp").agg(F.sum(bytes_).alias("bytes")), "bytes")
    large = sums.where(F.col("bytes") > GROUP_BYTES).select("grp")
    search = lambda rows: rows.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj").mapInArrow(_verifier(width, percent), "a long, b long")
    zero = F.lit(0)
    if large.isEmpty():
        return search(whole.select("*", zero.alias("bi"), zero.alias("bj"), zero.alias("block")))
    large = checked(settle(large, "large"))
    links = search(whole.join(large, "grp", "left_anti").select("*", zero.alias("bi"), zero.alias("bj"), zero.alias("block")))
    inside = whole.join(large, "grp", "left_semi")
    roots = settle(inside.where("rep = grp").select("grp", F.col("text").alias("root")), "roots")
    known = roots.agg(F.sum(F.octet_length("root"))).first()[0] or 0
    beside = inside.where("rep <> grp").join(F.broadcast(roots) if known <= ROOT_BYTES else roots, "grp")
    held = settle(beside.mapInArrow(_against_root(width, percent), "grp long, rep long, n_shingles long, sketch binary, text string, hit boolean"), "held")
    links = links.union(held.where("hit").select("rep", "grp"))
    left = held.groupBy("grp").agg(F.sum(F.when(F.col("hit"), 0).otherwise(bytes_)).alias("out"), F.sum(F.when(F.col("hit"), bytes_).otherwise(0)).alias("in"))
    left = checked(settle(left.where("out > 0").select("grp", *(F.greatest(F.lit(1), F.ceil(F.col(c) / GROUP_BYTES)).cast("int").alias(f"n_{c}") for c in ("out", "in"))), "left"))
    rows = held.join(left, "grp").withColumn("hash", F.xxhash64("rep", F.lit(7)))
    # blocks of the others are numbered from 0, those of the linked ones after them
    others = rows.where("NOT hit").withColumn("block", F.pmod("hash", "n_out").cast("int")).withColumn("_j", F.explode(F.sequence(zero, F.col("n_out") + F.col("n_in") - 1)))
    linked = rows.where("hit").withColumn("block", (F.pmod("hash", "n_in") + F.col("n_out")).cast("int")).withColumn("_j", F.explode(F.sequence(zero, F.col("n_out") - 1)))
    pairs = others.unionByName(linked).withColumn("bi", F.least("block", "_j")).withColumn("bj", F.greatest("block", "_j"))
    return links.union(search(pairs.select(*columns, "bi", "bj", "block")))


def _mark() -> Column:
    """What tells the texts of rows with one id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id and kept."""
    return _labelled(docs, width, percent).drop("mark")


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates() with the rows' marks."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _mark().alias("mark"))
    sets = settle(texts.mapInArrow(_sketcher(width), "doc_id long, mark long, n_shingles long, f1 long, f2 long, sketch binary"), "sets")
    classes = settle(
        sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    known = classes.select("rep", "n_shingles", "sketch")

    bands = REGISTERS // ROWS_PER_BAND
    key = f"xxhash64(substring(sketch, k * {2 * ROWS_PER_BAND} + 1, {2 * ROWS_PER_BAND}), k)"
    rows = classes.select("rep", F.expr(f"explode(transform(sequence(0, {bands - 1}), k -> {key}))").alias("key"))
    counts = settle(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")  # written: the join may then be split at large keys
    shared = settle(rows.join(counts, "key"), "shared")
    mates = _dealt(shared.join(known, "rep")).select("key", "bi", "bj", "block", "rep", "n_shingles", "sketch").mapInArrow(_grouper(percent), "a long, b long")
    group = components(mates)

    group = settle(group.union(group.select("root", "root").distinct()).toDF("rep", "grp"), "groups")
    asked = texts.select(F.col("doc_id").alias("rep"), "text").join(checked(group.select("rep")), "rep", "left_semi")
    whole = settle(group.join(known, "rep").join(asked, "rep").select("grp", "rep", "n_shingles", "sketch", "text"), "texts")
    label = components(_verified(whole, width, percent))

    member = classes.select("f1", "f2", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("root", "rep").alias("root"))
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return sets.drop("sketch").join(member, ["f1", "f2"], "left").select("doc_id", "mark", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns.

    Of rows alike in id and text one stays; rows that share an id and differ in
    text are judged apart; rows without id all stay.
    """
    labelled = settle(_labelled(docs, width, percent).groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("doc_id IS NOT NULL AND (NOT kept OR n > 1)"), "labelled")
    key = {"__loom_id": F.col("doc_id").cast("long"), "__loom_mark": _mark()}
    on = [c == F.col(n) for n, c in key.items()]
    gone = settle(labelled.where("NOT kept").toDF("__loom_id", "__loom_mark", "__loom_k", "__loom_n").drop("__loom_k", "__loom_n"), "gone")
    rest = docs.join(checked(gone), on, "left_anti")
    twice = settle(labelled.where("kept").toDF("__loom_id", "__loom_mark", "__loom_k", "__loom_n").drop("__loom_k"), "twice")
    if twice.isEmpty():
        return rest
    held = rest.join(checked(twice), on, "left")
    single = held.where("__loom_id IS NULL").select(*docs.columns)
    return single.unionByName(held.where("__loom_id IS NOT NULL").dropDuplicates(["__loom_id", "__loom_mark"]).select(*docs.columns))
