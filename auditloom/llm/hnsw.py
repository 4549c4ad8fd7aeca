"""Approximate nearest neighbours by inner product: one hierarchical small-world graph per shard.

Rows are dealt to shards by a hash of id and vector.  Each shard's graph is built
by one task over its distinct vectors and kept as flat arrays in a table: nodes in
the order of their levels, so that every layer is a prefix, per layer one block of
neighbour numbers, and per node the rows that have its vector.  For inner products,
vectors get one more component that gives all of them the same length; the nearest
by angle is then the largest inner product.

Nodes join in batches.  A batch searches the graph that stands, its members are
also held against each other, and links are chosen by the usual rule: a
candidate is linked unless it is nearer to one already linked.  All searches of
a batch advance together, several nodes at a time, as array operations.

The query vectors are written as a table once.  A task that holds a shard reads
them from there in batches, so neither graphs nor queries are shuffled; it gives
the k best candidates of its shard by their inner products, summed in double
precision in the order of the components.  The best of all shards are ranked, ties
to the smaller id.

Every row is indexed.  A shard has at most about SHARD_ROWS rows and SHARD_BYTES
of vectors, so it fits one task and one row of the table.

Cases: a vector that is null or zero, or has a null or non-finite component, and
a row without id take no part; vectors of different lengths are searched apart;
rows that share an id are candidates each, equal ones as often as they occur; of
queries that share an id one counts, that with the least vector, and the row with
its id and vector is its own; a query with fewer than k candidates gets all of
them; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import checked, new_path, prepare, settle

MIN_SHARDS, SHARD_ROWS, SHARD_BYTES = 16, 50_000, 128 << 20
LINKS, BUILD_WIDTH, SEARCH_WIDTH, BEAM = 16, 96, 256, 8
#: Query components in one batch of a search.
BATCH = 1 << 20
INDEX = "dim int, shard int, ids binary, copies binary, first binary, vectors binary, layers array<binary>, sizes array<int>"

_U = np.uint64


class Graph:
    """A layered graph over vectors of equal length; layer l has the first sizes[l] nodes."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], sizes: list[int]) -> None:
        self.vectors, self.layers, self.sizes = vectors, layers, sizes

    def search_layer(self, layer: int, queries: np.ndarray, entries: np.ndarray, width: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), best first, -1 where there are fewer; only nodes under upto have links."""
        n, b = len(queries), min(width, upto)
        links = self.layers[layer]
        nodes = np.full((n, b), -1, dtype=np.int32)
        score = np.full((n, b), -np.inf, dtype=np.float32)
        entries = entries[:, :b]
        nodes[:, : entries.shape[1]] = entries
        score[:, : entries.shape[1]] = np.where(entries >= 0, np.einsum("qed,qd->qe", self.vectors[entries], queries), -np.inf)
        seen = np.zeros((n, upto + 1), dtype=bool)
        np.put_along_axis(seen, np.where(entries >= 0, entries, upto), True, axis=1)
        fresh = nodes >= 0
        active = np.flatnonzero(fresh.any(axis=1))
        while len(active):
            value = np.where(fresh[active], score[active], -np.inf)
            beam = min(BEAM, b)
            pick = np.argpartition(-value, beam - 1, axis=1)[:, :beam]
            real = np.take_along_axis(value, pick, axis=1) > -np.inf
            fresh[active[:, None], pick] = False
            near = links[np.where(real, np.take_along_axis(nodes[active], pick, axis=1), 0)]
            near = np.where(real[:, :, None], near, -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            new = (near >= 0) & (near < upto)
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            near = np.where(new, near, upto)
            new &= ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            keep = int(new.sum(axis=1).max()) if new.size else 0
            if keep:
                order = np.argsort(~new, axis=1, kind="stable")[:, :keep]
                near, new = np.take_along_axis(near, order, axis=1), np.take_along_axis(new, order, axis=1)
                sim = np.einsum("qed,qd->qe", self.vectors[np.where(new, near, 0)], queries[active])
                sim = np.where(new, sim, -np.inf).astype(np.float32)
                all_nodes = np.concatenate([nodes[active], np.where(new, near, -1).astype(np.int32)], axis=1)
                all_score = np.concatenate([score[active], sim], axis=1)
                all_fresh = np.concatenate([fresh[active], new], axis=1)
                top = np.argpartition(-all_score, b - 1, axis=1)[:, :b]
                nodes[active] = np.take_along_axis(all_nodes, top, axis=1)
                score[active] = np.take_along_axis(all_score, top, axis=1)
                fresh[active] = np.take_along_axis(all_fresh, top, axis=1)
            active = active[fresh[active].any(axis=1)]
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(score, order, axis=1)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The nodes found for every query, best first."""
        step = max(1, min(256, (32 << 20) // (len(self.vectors) + 1)))
        out = np.full((len(queries), min(width, len(self.vectors))), -1, dtype=np.int32)
        for at in range(0, len(queries), step):
            part = queries[at : at + step]
            entries = np.zeros((len(part), 1), dtype=np.int32)
            for layer in range(len(self.layers) - 1, 0, -1):
                entries = self.search_layer(layer, part, entries, 4, self.sizes[layer])[0]
            out[at : at + step] = self.search_layer(0, part, entries, width, self.sizes[0])[0]
        return out


def _choose(vectors: np.ndarray, own: np.ndarray, cands: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """For each own vector, up to `links` of its candidates (sorted, best first; -1: none)."""
    n, c = cands.shape
    between = np.einsum("ncd,nkd->nck", vectors[np.maximum(cands, 0)], vectors[np.maximum(cands, 0)])
    taken = np.zeros((n, c), dtype=bool)
    for i in range(c):
        nearer = (taken & (between[:, i, :] > sims[:, i, None])).any(axis=1)
        taken[:, i] = (cands[:, i] >= 0) & ~nearer & (taken.sum(axis=1) < links)
    rank = np.where(taken, np.arange(c), np.where(cands >= 0, c + np.arange(c), 3 * c))
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.full((n, links), -1, dtype=np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(cands, order, axis=1)
    return out


def points_of(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component, all of length 1."""
    length = np.linalg.norm(vectors, axis=1)
    rest = np.sqrt(np.maximum(length.max() ** 2 - length**2, 0))
    return (np.concatenate([vectors, rest[:, None]], axis=1) / max(float(length.max()), 1e-300)).astype(np.float32)


def build(vectors: np.ndarray, ids: np.ndarray) -> tuple[Graph, np.ndarray]:
    """(graph, order): the graph over vectors[order]; levels come from hashes of the ids."""
    n = len(vectors)
    level = np.floor(-np.log(K.unit(K.mix64(ids.view(_U) + _U(9)))) / np.log(LINKS)).astype(int)
    order = np.lexsort((K.mix64(ids.view(_U) + _U(99)), -level))
    level = level[order]
    points = points_of(vectors)[order]
    sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)]
    widths = [2 * LINKS, *[LINKS] * (len(sizes) - 1)]
    graph = Graph(points, [np.full((s, w), -1, dtype=np.int32) for s, w in zip(sizes, widths, strict=True)], sizes)
    at = 1
    while at < n:
        end = min(n, at + max(1, min(at // 2, 256)))
        for layer in range(len(sizes)):
            stop = min(end, sizes[layer])
            if stop > at:
                _join(graph, layer, at, stop, widths[layer])
        at = end
    return graph, order


def _join(graph: Graph, layer: int, at: int, stop: int, width: int) -> None:
    """Link nodes at..stop-1 into a layer that holds the nodes before them."""
    own, v = np.arange(at, stop, dtype=np.int32), graph.vectors
    entries = np.zeros((len(own), 1), dtype=np.int32)
    for upper in range(len(graph.sizes) - 1, layer, -1):
        upto = min(at, graph.sizes[upper])
        entries = graph.search_layer(upper, v[own], entries, 4, upto)[0]
    found, sims = graph.search_layer(layer, v[own], entries, BUILD_WIDTH, at)
    mutual = v[own] @ v[own].T
    np.fill_diagonal(mutual, -np.inf)
    few = min(len(own), 2 * LINKS)
    mates = np.argpartition(-mutual, few - 1, axis=1)[:, :few]
    mate_sims = np.take_along_axis(mutual, mates, axis=1)
    cands = np.concatenate([found, np.where(mate_sims > -np.inf, own[mates], -1)], axis=1)
    sims = np.concatenate([sims, mate_sims], axis=1)
    best = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * LINKS]
    chosen = _choose(v, own, np.take_along_axis(cands, best, axis=1), np.take_along_axis(sims, best, axis=1), LINKS)
    links = graph.layers[layer]
    links[at:stop, : chosen.shape[1]] = chosen
    # links back: what a node has and what it is offered, chosen anew where it is too much
    source = np.repeat(own, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), 512):
        part, begin, many = nodes[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
        offered = np.full((len(part), int(many.max())), -1, dtype=np.int32)
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        offered[np.repeat(np.arange(len(part)), many), place] = source[np.repeat(begin, many) + place]
        cands = np.concatenate([links[part], offered], axis=1)
        cands.sort(axis=1)
        cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1
        sims = np.where(cands >= 0, np.einsum("ncd,nd->nc", v[np.maximum(cands, 0)], v[part]), -np.inf)
        best = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * LINKS]
        cands, sims = np.take_along_axis(cands, best, axis=1), np.take_along_axis(sims, best, axis=1)
        room = (cands >= 0).sum(axis=1) <= width
        new = np.full((len(part), width), -1, dtype=np.int32)
        new[room, : min(width, cands.shape[1])] = cands[room, :width]
        if (~room).any():
            new[~room] = _choose(v, part[~room], cands[~room], sims[~room], width)
        links[part] = new


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _packed(vectors: np.ndarray) -> bytes:
    """Vectors in four bytes a component where those hold them exactly, else in eight."""
    short = vectors.astype(np.float32)
    return (short if (short.astype(np.float64) == vectors).all() else vectors).tobytes()


def _unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def _builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (dim, shard, vec_id, v, copies) to one row per shard with its flat arrays."""
    held: list[pa.RecordBatch] = []
    key = None

    def done() -> pa.RecordBatch:
        dim, shard = key
        ids, copies = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("vec_id", "copies"))
        vectors = np.concatenate([_matrix(b.column("v"), dim) for b in held])
        by = np.lexsort((ids, *vectors.T[::-1]))
        ids, copies, vectors = ids[by], copies[by], vectors[by]
        start = np.flatnonzero(np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)]))
        graph, order = build(vectors[start], ids[start])
        length = np.diff(np.append(start, len(ids)))[order]
        first = np.concatenate([[0], np.cumsum(length)])
        rows = np.repeat(start[order] - first[:-1], length) + np.arange(len(ids))
        raw = [ids[rows].tobytes(), copies[rows].tobytes(), first.tobytes(), _packed(vectors[start][order])]
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([r], pa.binary()) for r in raw), pa.array([[x.tobytes() for x in graph.layers]], pa.list_(pa.binary())), pa.array([graph.sizes], pa.list_(pa.int32()))],
            names=["dim", "shard", "ids", "copies", "first", "vectors", "layers", "sizes"])

    for batch in batches:
        dims, shards = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (shards[1:] != shards[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            now = (int(dims[a]), int(shards[a]))
            if key is not None and now != key:
                yield done()
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), bad.alias("bad"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND NOT coalesce(bad, true) AND exists(v, x -> x <> 0)").select("vec_id", "v", F.size("v").alias("dim"))


def build_index(rows: DataFrame) -> DataFrame:
    """One row per shard: ids and copies of its rows, the first row of each node, node vectors, neighbour blocks and layer sizes."""
    prepare(rows.sparkSession)
    rows = valid(rows)
    room = F.least(F.lit(SHARD_ROWS), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    shards = settle(rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.greatest(F.lit(MIN_SHARDS), F.ceil(F.col("n") / room)).cast("int").alias("shards")), "shards")
    total = shards.agg(F.sum("shards")).first()[0] or 1
    distinct = rows.groupBy("dim", "vec_id", "v").agg(F.count("*").alias("copies")).join(checked(shards), "dim")
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), "shards").cast("int")).repartition(min(total, 100_000), "dim", "shard").sortWithinPartitions("dim", "shard")
    return settle(dealt.select("dim", "shard", "vec_id", "v", "copies").mapInArrow(_builder, INDEX), "graphs")


class Shard:
    """One row of the index, ready for searches."""

    def __init__(self, row: dict) -> None:
        self.ids, self.copies, self.first = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "copies", "first"))
        self.dim, n = row["dim"], len(self.first) - 1
        self.vectors = _unpacked(row["vectors"], n, self.dim)
        self.graph = Graph(points_of(self.vectors), [np.frombuffer(x, dtype=np.int32).reshape(s, -1) for x, s in zip(row["layers"], row["sizes"], strict=True)], row["sizes"])

    def nearest(self, asked: np.ndarray, queries: np.ndarray, k: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query, ids and scores of the k best rows that the graph leads to, best first."""
        points = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
        found = self.graph.search(points.astype(np.float32), max(width, k + 1))
        for q, nodes in enumerate(found):
            nodes = nodes[nodes >= 0]
            score = np.cumsum(self.vectors[nodes] * queries[q], axis=1)[:, -1]  # in the order of the components
            best = np.argsort(-score, kind="stable")[: k + 1]
            edge = score[best[-1]] if len(best) else 0.0
            best = np.flatnonzero(score >= edge)
            many = np.minimum(np.diff(self.first)[nodes[best]], k + 1)  # of rows with one vector the k + 1 least ids do
            rows = np.repeat(self.first[nodes[best]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            ids, copies, scores = self.ids[rows], self.copies[rows].copy(), np.repeat(score[best], many)
            own = np.flatnonzero(ids == asked[q])
            own = own[[np.array_equal(self.vectors[np.searchsorted(self.first, rows[o], side="right") - 1], queries[q]) for o in own]] if len(own) else own
            copies[own] -= 1
            copies = np.minimum(copies, k)
            order = np.lexsort((ids, -scores))
            order = np.repeat(order, copies[order])[:k]
            yield ids[order], scores[order]


def _searcher(path: str, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset

        store, root = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[at].as_py() for c in batch.schema.names})
                wanted = pa.dataset.field("dim") == shard.dim
                for part in pa.dataset.dataset(root, filesystem=store, format="parquet").to_batches(columns=["vec_id", "v"], filter=wanted, batch_size=max(1, BATCH // shard.dim)):
                    if not part.num_rows:
                        continue
                    asked = part.column("vec_id").to_numpy()
                    near = list(shard.nearest(asked, _matrix(part.column("v"), shard.dim), k, width))
                    ids = np.repeat(asked, [len(i) for i, _ in near])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([i for i, _ in near])), pa.array(np.concatenate([s for _, s in near]))], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_WIDTH) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score."""
    spark = queries.sparkSession
    prepare(spark)
    path = new_path(spark, "queries")
    valid(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).write.parquet(path)
    found = index.mapInArrow(_searcher(path, k, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
