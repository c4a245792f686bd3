"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str = "scratch") -> str:
    """A new place in the folder that all executors share: spark.checkpoint.dir; where that is unset a local session gets a temporary one, and a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='engram-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/engram/{name}-{uuid.uuid4().hex[:12]}"


def scratch(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """write(df, name), which writes a table and reads it again: it cuts the lineage of iterative plans."""
    place = scratch_path(spark)

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{place}/{name}")
        return spark.read.schema(df.schema).parquet(f"{place}/{name}")

    return write
