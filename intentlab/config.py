"""Session construction and the shared work folder.

On a cluster the shared folder comes from ``spark.checkpoint.dir``; a
default under the system temp folder is set only for a local master, where
driver and executors are one process (tests). Elsewhere a missing setting
is an error: executors would write to disks that the others cannot read.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "intentlab", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("INTENTLAB_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("INTENTLAB_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:  # else the cluster's own setting holds
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read and write (the checkpoint folder).

    Reads ``spark.checkpoint.dir`` or the context's checkpoint folder; sets a
    local default when neither is configured and the master is ``local``.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="intentlab-ckpt-")
    sc.setCheckpointDir(local)
    return (sc.getCheckpointDir() or local).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def shuffle_partitions(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover - conf always present in practice
        return 200


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared folder and read it back.

    Cuts the lineage (a lost executor recomputes from this table, not from
    the raw joins) and gives later passes a stable, deterministic input.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
