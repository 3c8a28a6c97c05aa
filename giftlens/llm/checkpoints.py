"""Intermediate results in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch folder only for a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="llm-checkpoint-")


def written(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder, so that later steps and lost executors reread it."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``written``, but as Parquet: what reads it again takes only the columns that it needs."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def exchanges_freed(spark):
    """Inside, what a query has shuffled is deleted when it ends; results that are used again are ``stored``."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def bucketed(df: DataFrame, key: str, parts: int):
    """Inside, the frame as a table in buckets of ``key``: what groups it by that need not shuffle it again."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(parts, key).write.option("path", f"{shared_dir(spark).rstrip('/')}/{name}")
     .bucketBy(parts, key).saveAsTable(name))
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
