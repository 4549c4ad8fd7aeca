"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if all runs on it, else an error."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="auditloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        known = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/auditloom/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that several uses compute it once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A partition to be sorted or aggregated is to hold so many bytes, a row counting for so many beside its text.
PART_BYTES, ROW_BYTES = 4 << 20, 100


def parts(spark: SparkSession, size: int) -> int:
    """Into how many partitions rows of `size` bytes in memory are dealt.

    Splits and merged shuffle partitions go by compressed bytes, which may be a
    hundredth of what a task then holds; repartition(n, ...) is not merged.  Of
    more parts than the threshold a task would hold all that it sends.
    """
    most = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(1, min(most, -(-size // PART_BYTES)))


def parts_of(df: DataFrame, *texts: str) -> int:
    """parts() of df by a pass that counts its rows and the length of its texts."""
    n, *chars = df.agg(F.count("*"), *(F.coalesce(F.sum(F.length(c).cast("long")), F.lit(0)) for c in texts)).first()
    return parts(df.sparkSession, n * ROW_BYTES + sum(chars))


#: A table of one split is dealt out if it holds so many bytes.
SPREAD_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of Parquet files; one that is a single split is dealt to all cores, others are read as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES
    return df if small or df.rdd.getNumPartitions() > 1 else df.repartition(spark.sparkContext.defaultParallelism)
