"""Vector search, similarity joins, leader clustering and matching.

Vectors are arrays of double; similarities are inner products, rounded to five
places where they leave the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import ROW_BYTES, parts, parts_of, settle, shared_path

TOP_K, DUPLICATE = 10, 0.90
#: Rows of a block in a join, queries in a batch, corpus rows that a batch is held against, and those of one product.
BLOCK, BATCH, CORPUS_BLOCK, TILE = 4096, 1024, 16_384, 4096
#: So many bytes of vectors are held at once, whatever their width.
HELD_BYTES = 64 << 20
#: So many keys of several blocks may be broadcast, and so many tasks a core share the pairs of blocks.
BROADCAST_KEYS, TASKS_PER_CORE = 100_000, 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(table: pa.Table) -> np.ndarray:
    v = table.column("vec").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _stored(store: pa.fs.FileSystem, root: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a stored table in batches: one file and one row group at a time, nothing read ahead."""
    import pyarrow.parquet

    for info in sorted(store.get_file_info(pa.fs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f, pyarrow.parquet.ParquetFile(f) as table:
                yield from (batch for batch in table.iter_batches(rows, columns=columns, use_threads=False) if batch.num_rows)


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products to five places, in one array."""
    score = left @ right.T
    np.round(score, 5, out=score)
    score += 0.0
    return score


def top_k(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, drop_self: bool = False) -> DataFrame:
    """(query_id, rank, id, similarity): the k most similar rows, ties to the smaller id.

    Queries are written once; the tasks of the corpus read them in batches, so
    neither side is copied or shuffled.  Each block of corpus rows gives k
    candidates a query by matrix products, and the window ranks these few.  A
    task holds one block, one batch and one product of a batch and a tile of the
    block, however many rows there are.
    """
    path = shared_path(queries.sparkSession, "queries")
    queries.select("id", "vec").write.parquet(path)

    def tile(asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = _scores(vectors, block)
        if drop_self:
            score[asked[:, None] == ids[None, :]] = -np.inf
        n = min(k, len(ids))
        edge = score.max(axis=1, keepdims=True) if n == 1 else np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n : len(ids) - n + 1]
        q, c = np.nonzero((score >= edge) & (score > -np.inf))
        return first(q, ids[c], score[q, c])

    def first(q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], ids[keep], score[keep]

    def best(asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        found = [tile(asked, vectors, ids[at : at + TILE], block[at : at + TILE]) for at in range(0, len(ids), TILE)]
        q, c, score = first(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(c), pa.array(score)], names=["query_id", "id", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, matrix = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for part in _stored(store, root, ["id", "vec"], BATCH):
                yield best(part.column("id").to_numpy(), _matrix(pa.Table.from_batches([part])), ids, matrix)

        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = pa.Table.from_batches([batch.slice(at, TILE)])
                held.append((part.column("id").to_numpy(), _matrix(part)))
                if sum(len(ids) for ids, _ in held) >= CORPUS_BLOCK or sum(m.nbytes for _, m in held) >= HELD_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    found = corpus.select("id", "vec").mapInArrow(run, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _alike(a: np.ndarray, left: np.ndarray, b: np.ndarray, right: np.ndarray, threshold: float, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (smaller id, larger id, similarity) between two blocks, or with `both` false inside one, a tile at a time."""
    for i in range(0, len(a), BATCH):
        for j in range(0, len(b), TILE):
            x, y = a[i : i + BATCH], b[j : j + TILE]
            score = _scores(left[i : i + BATCH], right[j : j + TILE])
            p, q = np.nonzero(score >= threshold)
            p, q, found = x[p], y[q], score[p, q]
            keep = p != q if both else p < q
            yield np.minimum(p, q)[keep], np.maximum(p, q)[keep], found[keep]


def pairs(rows: DataFrame, threshold: float = DUPLICATE, key: str | None = None, n_parts: int | None = None) -> DataFrame:
    """(key,) a, b, similarity of rows (id, vec[, key]) at least `threshold` alike, a < b.

    With a key only rows of one key are held against each other (null is a key).
    The rows of a key of up to BLOCK meet in one task; keys are dealt into n_parts,
    by default counted.  Larger keys are cut into blocks by their own size, which
    are written once as files; a task reads the two blocks of each of its pairs, so
    no row is copied or shuffled more than once.  Only pairs that pass are written
    out.
    """
    by = key or "_k"
    df = (rows if key else rows.withColumn("_k", F.lit(0))).select(by, "id", "vec")
    kind = dict(df.dtypes)[by]
    schema = f"`{by}` {kind}, a long, b long, similarity double"
    large = df.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")).where("_n > 1")
    large = settle(large.withColumn("_g", F.row_number().over(Window.orderBy("_n", "_by"))), "keys")
    n_large, n_pairs = large.agg(F.count("*"), F.sum(F.col("_n").cast("long") * (F.col("_n") + 1) / 2).cast("long")).first()
    known = F.broadcast(large) if n_large <= BROADCAST_KEYS else large
    same = F.col(by).eqNullSafe(F.col("_by"))

    def within(group: pa.Table) -> pa.Table:
        ids, m = group.column("id").to_numpy(), _matrix(group)
        a, b, score = (np.concatenate(x) for x in zip(*_alike(ids, m, ids, m, threshold, False), strict=True))
        return pa.table({by: pa.repeat(group.column(by)[0], len(a)), "a": a, "b": b, "similarity": score})

    found = []
    if n_large:
        found.append(_between(df.join(known, same), large, by, schema, threshold, n_pairs))
    if key or not n_large:
        small = df.join(known, same, "left_anti") if n_large else df
        found.append(small.repartition(n_parts or (_parts(df) if key else 1), by).groupBy(by).applyInArrow(within, schema))
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return out if key else out.drop("_k")


def _between(rows: DataFrame, large: DataFrame, by: str, schema: str, threshold: float, n_pairs: int) -> DataFrame:
    """pairs() of the large keys (_by, _n blocks, number _g), rows with their key's number and blocks."""
    spark = rows.sparkSession
    path = shared_path(spark, "blocks")
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).select("_g", "_b", "id", "vec").repartition("_g", "_b")
    dealt.write.partitionBy("_g", "_b").parquet(path)
    low = large.withColumn("_lo", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    work = low.withColumn("_hi", F.explode(F.sequence("_lo", F.col("_n") - 1))).select(F.col("_by").alias(by), "_g", "_lo", "_hi")
    order = ("_g", "_lo", "_hi")
    work = work.repartitionByRange(min(n_pairs, TASKS_PER_CORE * spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(path)
        held: tuple[tuple[int, int] | None, tuple[np.ndarray, np.ndarray] | None] = (None, None)

        def block(g: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            folder = f"{root}/_g={g}/_b={b}"
            if store.get_file_info(folder).type == pa.fs.FileType.NotFound:  # no id fell into it
                return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
            table = pa.Table.from_batches(list(_stored(store, folder, ["id", "vec"], BLOCK)))
            return table.column("id").to_numpy(), _matrix(table)

        for batch in batches:
            for at, (g, lo, hi) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_g", "_lo", "_hi")), strict=True)):
                if held[0] != (g, lo):
                    held = ((g, lo), block(g, lo))
                first, second = held[1], held[1] if lo == hi else block(g, hi)
                if len(first[0]) and len(second[0]):
                    for a, b, score in _alike(*first, *second, threshold, lo != hi):
                        yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(by)[at], len(a)), pa.array(a), pa.array(b), pa.array(score)], names=[by, "a", "b", "similarity"])

    return work.mapInArrow(run, schema)


def _parts(rows: DataFrame) -> int:
    n, values = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vec").cast("long")), F.lit(0))).first()
    return parts(rows.sparkSession, n * ROW_BYTES + 8 * values)


def leaders(rows: DataFrame, threshold: float = DUPLICATE, key: str = "label") -> DataFrame:
    """A10: (key, id, leader): in order of id, a row not yet absorbed leads and absorbs all later rows alike enough to it.

    Rows of equal vectors have the same leader: whoever absorbs the first of them
    comes before all and absorbs all, else the first leads the others.  So one row
    stands for its copies (told by 128-bit hashes of key and vector), and a large
    group of copies gives no edges.  A vector not alike to itself (zero) has no
    copies.  Joins sort: the tables are small as files but not as broadcasts.
    """
    digest = [F.xxhash64(key, "vec").alias("_h"), F.xxhash64(F.lit(1), key, "vec").alias("_g")]
    held = settle(rows.select(key, "id", "vec", *digest, (F.round(dot(F.col("vec"), F.col("vec")), 5) >= threshold).alias("_alike")), "vectors")
    n = _parts(held)
    copied = held.where("_alike").groupBy(key, "_h", "_g").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    copied = settle(copied.select(F.col(key).alias("_key"), "_h", "_g", "_first"), "copies")
    held, copied = held.repartition(n, "_h", "_g"), copied.repartition(n, "_h", "_g")
    same = (held["_h"] == copied["_h"]) & (held["_g"] == copied["_g"]) & held["_alike"]
    tagged = held.join(copied.hint("merge"), same, "left").select(key, "id", "vec", "_first")
    alone = _fold(tagged.where("_first IS NULL OR _first = id").select(key, "id", "vec"), threshold, key, n)
    alone = settle(alone, "leaders")
    firsts = alone.select(F.col(key).alias("_key"), F.col("id").alias("_id"), "leader")
    firsts = firsts.join(copied.select(F.col("_key").alias("_k2"), "_first").hint("merge"), F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_id") == F.col("_first")), "left_semi")
    others = tagged.where("_first <> id").select(key, "id", "_first")
    others = others.join(firsts.hint("merge"), others[key].eqNullSafe(firsts["_key"]) & (others["_first"] == firsts["_id"])).select(key, "id", "leader")
    return alone.unionByName(others)


def _fold(rows: DataFrame, threshold: float, key: str, n_parts: int) -> DataFrame:
    """leaders() of rows without copies.

    The similarity join is blocked; only its edges, usually few, meet in one
    ordered fold per key, which streams over the sorted edges.
    """
    edges = pairs(rows, threshold, key, n_parts).select(key, "a", "b")
    every = rows.select(F.col(key), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"))
    kind = dict(every.dtypes)[key]
    dealt = every.unionByName(edges).repartition(n_parts, key).sortWithinPartitions(key, "a", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leader = None, {}
        for batch in batches:
            out = ([], [], [])
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in (key, "a", "b")), strict=True):
                if k != now:
                    now, leader = k, {}
                if b is None:
                    leader.setdefault(a, a)
                    for column, value in zip(out, (k, a, leader[a]), strict=True):
                        column.append(value)
                elif leader[a] == a:
                    leader.setdefault(b, a)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(key).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=[key, "id", "leader"])

    return dealt.mapInArrow(run, f"`{key}` {kind}, id long, leader long")


def merge(requirements: DataFrame, clusters: DataFrame, optional: list[str], within: str | None = None, n_parts: int | None = None) -> DataFrame:
    """One row per leader: content of the most complete member, references of all, in order.

    requirements has id, text, reference and the optional columns.  With `within`,
    a column of both, ids count within its values.  Rows are dealt into n_parts, by
    default counted; clusters are never broadcast: as many rows as requirements,
    they are a small file.
    """
    keys = [within] if within else []
    n, at = n_parts or parts_of(requirements, "text"), [*keys, "id"]
    led = clusters.select(*at, "leader").repartition(n, *at)
    df = requirements.repartition(n, *at).join(led.hint("merge"), at).withColumn("_score", X.completeness([F.col(c) for c in optional], F.col("text")))
    content = [c for c in requirements.columns if c not in ("id", "reference", *keys)]
    best = F.min_by(F.struct(*content, "reference"), F.struct(-F.col("_score"), F.col("id")))
    refs = F.sort_array(F.collect_list(F.when(F.coalesce(F.col("reference"), F.lit("")) != "", F.struct("id", "reference"))))
    out = df.repartition(n, *keys, "leader").groupBy(*keys, "leader").agg(best.alias("_best"), F.array_join(F.array_distinct(F.transform(refs, lambda r: r["reference"])), "; ").alias("_refs"), F.count("*").alias("members"))
    reference = F.when(F.col("members") > 1, F.nullif("_refs", F.lit(""))).otherwise(F.col("_best.reference"))
    return out.select(*keys, F.col("leader").alias("id"), *(F.col(f"_best.{c}").alias(c) for c in content), reference.alias("reference"), "members")


def best_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per left row, its most similar right row."""
    return top_k(left, right, 1).select("query_id", F.col("id").alias("match_id"), "similarity")
