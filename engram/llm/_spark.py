"""Shared Spark plumbing: written tables, bounded Arrow batches, distributed ranks."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Measured bytes up to which a side may be broadcast, and rows of a table of counts that is known to have no more.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 500_000

#: Rows of narrow tables that go into a file, and files of a table whose rows were counted, at least.
FILE_ROWS, LEAST_FILES = 16_000, 8
#: Rows that a range of a distributed rank has, about.
RANGE_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster, whose
    executors wouldn't share that, is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='engram-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Workspace:
    """Tables written to the shared folder, to cut lineage and to read a result more than once."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/engram/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: about how many rows go in, if that is known; then small tables get few files."""
        path = f"{self.root}/{name}"
        if rows is not None:
            df = df.coalesce(max(LEAST_FILES, rows // FILE_ROWS))
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark remove shuffle files that nothing refers to any more, after a table was written."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Drops all tables but these."""
        path, fs = self._path()
        for status in fs.listStatus(path):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)


def small_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Python workers get at most so many rows and bytes at once (but a whole row always), so that a worker's memory doesn't follow the length
    of texts. The settings are the session's; plans that are built later read them when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def maybe_broadcast(small: DataFrame) -> DataFrame:
    """A broadcast hint only if its rows, measured first, stay under BROADCAST_BYTES; Spark shuffles otherwise."""
    width = F.lit(8 * (1 + len(small.columns))).cast("long")
    for c, kind in small.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
    size = small.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def ranges_for(rows: int) -> int:
    """Into how many ranges so many rows are cut, so that a range stays about as large at any size: a power of two."""
    return max(64, 1 << max(rows // RANGE_ROWS, 1).bit_length())


def rank_in_groups(
    df: DataFrame, group: list[str], order: Column, ties: list[Column], out: str, weight: Column | None = None, buckets: int = 1024, groups: int | None = None
) -> DataFrame:
    """Exact rank (from 0), or exact exclusive running sum of `weight`, inside each group, without
    bringing a group into one task: `order` (a long, evenly spread such as a hash) is cut into `buckets` (a power of two)
    ranges, range totals are prefix-summed on the small (group, range) table, and only ranges are sorted. groups: a known bound on
    the number of groups; with few of them, the (group, range) table is broadcast, and rows are exchanged only once.
    Columns of df aren't named like the inner ones, which begin with _rank.
    """
    o, w, b, t, off, r = (f"_rank_{x}" for x in ("order", "weight", "range", "total", "offset", "place"))
    weight = F.lit(1).cast("bigint") if weight is None else weight
    bits = (buckets - 1).bit_length()
    top = F.shiftrightunsigned(F.col(o), 64 - bits) if bits else F.lit(0)
    keyed = df.withColumn(o, order).withColumn(w, weight.cast("bigint")).withColumn(b, top.cast("int"))
    # A hash is signed: flip its sign bit's place by ranking unsigned buckets, and sort unsigned inside.
    keyed = keyed.withColumn(o, F.col(o).bitwiseXOR(F.lit(-(2**63))))
    totals = keyed.groupBy(*group, b).agg(F.sum(w).alias(t))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_rank_g{i}") for i, g in enumerate(group)],
        F.col(b).alias("_rank_at"),
        F.coalesce(F.sum(t).over(before), F.lit(0)).alias(off),
    )
    inside = Window.partitionBy(*group, b).orderBy(o, *ties).rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn(r, F.coalesce(F.sum(w).over(inside), F.lit(0)))
    on = F.col(b) == F.col("_rank_at")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_rank_g{i}"))
    if groups is not None and groups * buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return ranked.join(offsets, on).select(*df.columns, (F.col(r) + F.col(off)).cast("bigint").alias(out))
