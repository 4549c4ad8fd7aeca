"""Tables of the engine: keyed upserts as parts, artifact caches, sessions.

A store is a folder of parts that never change, so an upsert never overwrites
what a running query reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as X
from ..operators import review
from . import corpus

CACHE_VERSION = "v1"


def latest_by_key(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """All rows, of equal keys the one of the highest version."""
    both = old.unionByName(new)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


class Table:
    """A keyed table under a path; created on first use, empty until then.

    The table is a sequence of parts.  An upsert writes one part of its own rows;
    a reader lays the later parts over the first, so two writers lose nothing, and
    no part is changed once it is there.  When PARTS of them stand, they are
    merged into one that names what it covers: all but the first while they are
    small beside it, so a large first part is rewritten seldom.
    """

    PARTS, REWRITE = 16, 4

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _fs(self, *names: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _parts(self) -> tuple[list[str], set[str]]:
        """Names of the complete parts in order of writing, and of those that a merged part covers."""
        fs, root = self._fs()
        if not fs.exists(root):
            return [], set()
        done, covered = [], set()
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            inside = {f.getPath().getName() for f in fs.listStatus(status.getPath())}
            if "_SUCCESS" in inside:
                done.append(name)
            if "_covers" in inside:
                stream = fs.open(self._fs(name, "_covers")[1])
                covered.update(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split())
                stream.close()
        return sorted(done), covered

    def _live(self) -> list[str]:
        done, covered = self._parts()
        return [name for name in done if name not in covered]

    def _load(self, parts: list[str]) -> DataFrame:
        """The parts laid over each other; the first stays in place but for the keys of later ones."""
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        first, *later = (self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}") for name in parts)
        if not later:
            return first
        new = later[0].withColumn("_v", F.lit(0))
        for n, part in enumerate(later[1:], 1):
            new = new.unionByName(part.withColumn("_v", F.lit(n)))
        new = new if len(later) == 1 else new.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("_v")))).where("_n = 1").drop("_n")
        keys = new.select(F.col(self.key).alias("_key"))
        return first.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").unionByName(new.drop("_v"))

    def read(self) -> DataFrame:
        return self._load(self._live())

    def upsert(self, rows: DataFrame) -> None:
        """Idempotent: rows replace those of equal keys; of equal keys among rows one stays."""
        live = self._live()
        number = int(live[-1].split("-")[0]) + 1 if live else 0
        schemas.conform(rows, self.schema).dropDuplicates([self.key]).write.parquet(f"{self.path}/{number:08d}-{uuid.uuid4().hex}")
        self._compact()

    def _bytes(self, name: str) -> int:
        fs, path = self._fs(name)
        return fs.getContentSummary(path).getLength()

    def _compact(self) -> None:
        """Merge parts where PARTS stand; until its list is there the merged part only repeats the others."""
        live = self._live()
        if len(live) < self.PARTS:
            return
        first, *later = live
        whole = self._bytes(first) <= self.REWRITE * sum(map(self._bytes, later))
        merged = live if whole else later
        name = f"{merged[-1].split('-')[0]}-{uuid.uuid4().hex}"
        self._load(merged).write.parquet(f"{self.path}/{name}")
        fs, draft = self._fs(name, "_covers.draft")
        out = fs.create(draft)
        out.write(bytearray("\n".join(merged).encode()))
        out.close()
        fs.rename(draft, self._fs(name, "_covers")[1])

    def vacuum(self) -> int:
        """Delete the covered parts, oldest first, and give their number; for times when no reader is at work."""
        done, covered = self._parts()
        gone = [name for name in done if name in covered]
        for name in gone:
            fs, path = self._fs(name)
            fs.delete(path, True)
        return len(gone)

    def count(self) -> int:
        return self.read().count()


# The distances a collection may have; the second is that of one which names none.
DISTANCES = ("cosine", "l2")


class Collections:
    """Named tables of vectors under a path, each with the distance it was made with."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.known = Table(spark, f"{self.path}/_collections", schemas.struct("name string, distance string"), "name")

    def get(self, name: str, schema: T.StructType, key: str = "id", distance: str | None = None) -> Table:
        """The collection of that name, made where there is none; one that exists keeps its distance, and asking for another raises."""
        if distance not in (None, *DISTANCES):
            raise ValueError(f"{distance} is none of {', '.join(DISTANCES)}")
        held = self.distance(name)
        if held is None:
            self.known.upsert(self.spark.createDataFrame([(name, distance or DISTANCES[1])], self.known.schema))
        elif distance not in (None, held):
            raise ValueError(f"collection {name} has the distance {held}")
        return Table(self.spark, f"{self.path}/{name}", schema, key)

    def distance(self, name: str) -> str | None:
        row = self.known.read().where(F.col("name") == name).first()
        return row and row["distance"]

    def measure(self, name: str, similarity: Column) -> Column:
        """The collection's distance of vectors of unit length from their inner product."""
        held = self.distance(name)
        if held is None:
            raise KeyError(name)
        return 1 - similarity if held == "cosine" else 2 - 2 * similarity


class Cache(Table):
    """Artifacts by version, document and section hash; a switched-off cache misses and keeps nothing."""

    def __init__(self, spark: SparkSession, path: str, enabled: bool = True, version: str = CACHE_VERSION) -> None:
        super().__init__(spark, path, schemas.struct("cache_key string, version string, kind string, payload string"), "cache_key")
        self.enabled, self.version = enabled, version

    def lookup(self, asked: DataFrame, kind: str) -> DataFrame:
        """Asked (cache_key, …) with payload, null on a miss; an unreadable store misses."""
        try:
            held = self.read().where((F.col("kind") == kind) & (F.col("version") == self.version)).select("cache_key", "payload")
            held.schema  # noqa: B018  analysis happens here
        except AnalysisException:
            held = self.spark.createDataFrame([], "cache_key string, payload string")
        return asked.join(held if self.enabled else held.limit(0), "cache_key", "left")

    def put(self, rows: DataFrame, kind: str) -> None:
        """rows (cache_key, payload)."""
        if self.enabled:
            self.upsert(rows.withColumn("kind", F.lit(kind)).withColumn("version", F.lit(self.version)))


def section_cache_key(heading: Column, level: Column, text: Column, tables: Column, prompt_version: str) -> Column:
    """F41."""
    return X.tagged_hash(F.concat(text, F.array_join(tables, "\n")), heading, level.cast("string"), F.lit(prompt_version))


def with_cache(asked: DataFrame, held: DataFrame, keys: list[str], compute) -> DataFrame:
    """Rows of asked found in held, and compute() of the others."""
    hits = asked.join(held, keys).withColumn("cached", F.lit(True))
    misses = compute(asked.join(held.select(*keys), keys, "left_anti")).withColumn("cached", F.lit(False))
    return hits.unionByName(misses)


class Sessions:
    """Review sessions with their requirements and evaluations."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.sessions = Table(spark, f"{path}/sessions", schemas.SESSION, "id")
        child = lambda s: T.StructType([T.StructField("session_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), *s.fields])
        self.requirements = Table(spark, f"{path}/requirements", child(schemas.REQUIREMENT), "key")
        self.evaluations = Table(spark, f"{path}/evaluations", child(schemas.EVALUATION), "key")

    def upload(self, filename: str, doc_type: str, created_at: datetime) -> str:
        if not filename.lower().endswith(".pdf"):
            raise ValueError("only .pdf files are taken")
        session = uuid.uuid4().hex
        self.sessions.upsert(self.spark.createDataFrame([(session, filename, doc_type, created_at, "extracting", 0)], schemas.SESSION))
        return session

    def _file(self, session: str) -> tuple:
        """The Hadoop file system and path of a session's document."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/uploads/{session}.pdf")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def receive(self, filename: str, content: bytes, reader: Callable[[bytes], list[str]] = corpus.pdf_text) -> dict:
        """Save an uploaded document under a new id, count its pages, route it and register its session.

        More pages with text than review.PAGE_THRESHOLD make it a compliance
        document, else it is narrative; one without text has nothing to extract
        and is ready for review.  A document that cannot be read is removed again.
        """
        if not filename.lower().endswith(".pdf"):
            raise ValueError("only .pdf files are taken")
        session = uuid.uuid4().hex
        fs, path = self._file(session)
        out = fs.create(path)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        try:
            pages = corpus.parse_files(corpus.corpus_files(self.spark, path.toString()), reader)
            seen = pages.agg(F.count("text").alias("n"), F.max(F.when(F.col("error") != corpus.NO_TEXT, F.col("error"))).alias("error")).first()
            if seen["error"]:
                raise ValueError(seen["error"])
            doc_type = "compliance" if seen["n"] > review.PAGE_THRESHOLD else "narrative"
            status = "extracting" if seen["n"] else "reviewing"
            self.sessions.upsert(self.spark.createDataFrame([(session, filename, doc_type, datetime.now(UTC), status, 0)], schemas.SESSION))
        except Exception as e:
            fs.delete(path, False)
            raise ValueError(f"could not process {filename}: {e}") from e
        return {"session_id": session, "filename": filename, "doc_type": doc_type, "extraction_status": "processing" if seen["n"] else "complete", "requirements": []}

    def document(self, session: str) -> DataFrame:
        """The saved document of a session as a row of corpus_files(); KeyError where there is none."""
        fs, path = self._file(session)
        if not fs.exists(path):
            raise KeyError(session)
        return corpus.corpus_files(self.spark, path.toString())

    def get(self, session: str) -> DataFrame:
        found = self.sessions.read().where(F.col("id") == session).limit(1)
        if found.isEmpty():
            raise KeyError(session)
        return found

    def set_status(self, session: str, status: str) -> None:
        """Only along extracting, reviewing, critic, complete; a review may be started anew."""
        now = self.get(session).first()["status"]
        order = schemas.SESSION_STATUS
        if order.index(status) < order.index(now):
            raise ValueError(f"{now} cannot become {status}")
        self.sessions.upsert(self.get(session).withColumn("status", F.lit(status)))

    def put(self, table: Table, session: str, rows: DataFrame, key: str) -> None:
        numbered = rows if "seq" in rows.columns else rows.withColumn("seq", F.col(key).cast("long"))
        table.upsert(numbered.withColumn("session_id", F.lit(session)).withColumn("key", F.concat_ws("::", F.lit(session), F.col(key))))

    def results(self, session: str) -> DataFrame:
        """One row: the session with its requirements and evaluations, in order."""
        nested = lambda t, s: t.read().where(F.col("session_id") == session).agg(F.sort_array(F.collect_list(F.struct("seq", *s.fieldNames()))).alias("v")).scalar()
        return self.get(session).withColumn("requirements", nested(self.requirements, schemas.REQUIREMENT)).withColumn("evaluations", nested(self.evaluations, schemas.EVALUATION))


def write_csv(rows: DataFrame, path: str, order: str) -> None:
    """One CSV file with a header, in order; quotes are doubled.

    An export is one reviewer's download, so one file is its contract.
    """
    rows.orderBy(order).coalesce(1).drop(order).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).option("emptyValue", "").csv(path)
