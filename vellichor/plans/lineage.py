"""Cutting lineage with tables in the shared folder of the cluster.

``spark.checkpoint.dir`` names that folder. It is read from the session; where
it is unset, a local master (tests, a laptop) gets a temporary folder, which is
removed when Python ends, and any other master an error: its executors would
each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from vellichor.plans.session import steady

_fallback: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared folder, unique to this call."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        key = spark.sparkContext.applicationId
        if key not in _fallback:
            _fallback[key] = tempfile.mkdtemp(prefix="vellichor-")
            atexit.register(shutil.rmtree, _fallback[key], ignore_errors=True)
        base = "file://" + _fallback[key]
    return f"{base.rstrip('/')}/vellichor/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Unlike a local checkpoint the files survive the loss of any executor, and
    readers get column pruning and pushed filters.
    """
    spark = steady(df.sparkSession)
    path = scratch_dir(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
