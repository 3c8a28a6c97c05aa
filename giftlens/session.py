"""SparkSession defaults and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC clock, ANSI arithmetic, adaptive execution
# with skew splitting and partition coalescing.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "giftlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("GIFTLENS_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; a scratch folder only for a local
    master without that setting (tests). Elsewhere executors would not see it: raise."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="giftlens-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, how: str | None = None) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and continue from the
    stored copy (survives executor loss, unlike a local checkpoint).

    ``parquet`` (default) writes a parquet table there and reads it back: compressed,
    column pruning, and file sizes that the planner knows, so small tables are
    broadcast without a shuffle of the large side. ``checkpoint`` uses
    ``DataFrame.checkpoint``, which stores uncompressed rows."""
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    how = how or os.environ.get("GIFTLENS_CUT", "parquet")
    if how == "checkpoint":
        return df.checkpoint(eager=True)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
