"""What the operators of this subpackage share: table access, the shared folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The byte table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs
    in one process (tests). On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="docquill-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of whole texts of `rows` rows instead of Spark's 10,000, unless the session has a size of its own: a
    batch of long texts is held several times over by the executor and its Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path: lineage is cut, and a lost executor costs nothing that was
    written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def trimmed() -> None:
    """Gives what a Python worker has freed back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sampled(df: DataFrame, hash_: Column, rows: int) -> DataFrame:
    """At most `rows` rows of df, those with the least hash. Rows that can't be among them (but for a chance of about
    e^-rows) are left out before the sort, so that what tasks send doesn't grow with their number."""
    n = df.count()
    most = 1.0 if n <= 4 * rows else 4.0 * rows / n
    return df.where(F.pmod(hash_, F.lit(1 << 40)) < F.lit(int(most * (1 << 40)))).orderBy(F.pmod(hash_, F.lit(1 << 40)), *df.columns).limit(rows)


def chosen(df: DataFrame, hash_: Column, rows: int) -> DataFrame:
    """At most `rows` rows of df, those with the least hash, in order. Only hashes are sorted; rows of equal hash, which may
    be any number, meet in no place but the limit."""
    h = F.pmod(hash_, F.lit(1 << 40))
    last = sampled(df.select(h.alias("h")), F.col("h"), rows).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(last if last is not None else -1)).limit(rows).orderBy(h, *df.columns)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v), root being the smallest node reachable.

    Alternating large and small stars on aggregates and joins: nothing is gathered per node, so a hub is a skewed
    join (which AQE splits), not a list in one task. Every round is written to the shared folder, and the one before deleted.
    """
    canon = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = written_at(canon, "links")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e, later = written_at(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        removed(edges.sparkSession, path)
        path = later
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
