"""Structured Streaming jobs.

R2 — hourly usage: the usage log as a stream in tumbling one-hour windows. The streaming state is
one row per (hour, user), so distinct users are exact; each micro-batch upserts the (hour, user)
rows that it changed into a keyed table (``keyed_table``), named by its batch, so a retried
batch changes nothing. ``read_hourly_usage`` adds them up per hour. There is no watermark by
default: files may come in any order over any number of batches and every row counts. A caller who
sets a watermark bounds the state and accepts that later rows are dropped.

R1 — classification loop: classifier replies arrive as files. A batch applies to the products
it holds replies for, and to no others: a pending product without a reply in this batch keeps
waiting for a later one. The product table is a keyed table: a batch reads and writes only the
buckets of its replies' products, as deltas; full buckets are folded after it. A retried batch
finds its step published; a new query continues from the newest state, whatever its own batch numbers are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giftlens.functions.numeric import exact_sum
from giftlens.streaming.keyed_table import KeyedTable

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


HOUR_USER = "window_start timestamp_ntz, user_id long, calls long, error_count long, latency decimal(38,6), timed long"


def hourly_user_usage(log: DataFrame, watermark: str | None = None) -> DataFrame:
    """Per hour and user: calls, errors, exact sum and number of latencies (on batch and streaming frames).
    Windows need a TIMESTAMP column: wall-clock NTZ times are read in the
    session zone (UTC) and the window bounds are returned as NTZ again."""
    ts = log.withColumn("date_time", F.col("date_time").cast("timestamp"))
    ts = ts.withWatermark("date_time", watermark) if watermark else ts
    return (ts.groupBy(F.window("date_time", "1 hour").alias("w"), "user_id")
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.count_if(F.col("response_status_code") >= 400).alias("error_count"),
                 exact_sum(F.col("response_time_ms")).alias("latency"),
                 F.count("response_time_ms").alias("timed"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "user_id", "calls", "error_count", "latency", "timed"))


def hourly_totals(usage: DataFrame) -> DataFrame:
    """R2: per hour calls, active users, errors and average latency from one row per (hour, user)."""
    latency = F.sum("latency").cast("double") / F.nullif(F.sum("timed"), F.lit(0))
    return (usage.groupBy("window_start")
            .agg(F.sum("calls").alias("calls"), F.count("user_id").alias("active_users"),
                 F.sum("error_count").alias("error_count"), latency.alias("avg_response_time"))
            .select("window_start", (F.col("window_start") + F.expr("INTERVAL 1 HOUR")).alias("window_end"),
                    "calls", "active_users", "error_count", "avg_response_time"))


def start_hourly_usage(spark: SparkSession, events_dir: str, out_dir: str, checkpoint: str,
                       file_glob: str = "events*.parquet", available_now: bool = True,
                       state_partitions: int | None = None, files_per_batch: int | None = None,
                       watermark: str | None = None, buckets: int = 8):
    """Start R2 over event parquet files in ``events_dir``; returns the query.
    ``state_partitions`` fixes the number of state-store partitions of a new
    query (a stream takes the shuffle-partition setting when it starts and
    keeps it in its checkpoint); the session setting is restored afterwards.
    ``files_per_batch`` splits a backlog into batches; no row depends on it."""
    from giftlens.sources.fixtures import log_from_events
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    agg = hourly_user_usage(log_from_events(reader.parquet(events_dir)), watermark)
    if not _exists(spark, out_dir):
        KeyedTable.create(spark.createDataFrame([], HOUR_USER), out_dir, ["window_start", "user_id"], buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable(batch.sparkSession, out_dir)
        table.upsert(batch, checkpoint, batch_id)
        table.compact()

    w = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    if state_partitions is None:
        return w.start()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        return w.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def _exists(spark: SparkSession, table_dir: str) -> bool:
    try:
        KeyedTable(spark, table_dir)
    except ValueError:
        return False
    return True


def read_hourly_usage(spark: SparkSession, out_dir: str) -> DataFrame:
    """The hours of the table that :func:`start_hourly_usage` keeps."""
    return hourly_totals(KeyedTable(spark, out_dir).rows())


def start_classification(spark: SparkSession, replies_dir: str, replies_schema: T.StructType,
                         table_dir: str, checkpoint: str, now=None, available_now: bool = True,
                         files_per_batch: int | None = None):
    """Apply every batch of classifier replies to the product table and publish the next version."""
    reader = spark.readStream.schema(replies_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    w = (reader.parquet(replies_dir).writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, batch_id: apply_replies(batch, batch_id, table_dir, checkpoint, now)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def apply_replies(batch: DataFrame, batch_id: int, table_dir: str, query_key: str, now=None) -> None:
    """One step of R1: products with a reply in ``batch`` are classified, all others stay as they are.

    Only the buckets of those products are read, and only their rows are written.
    (``query_key``, ``batch_id``) names the step: once published, a replay changes nothing."""
    from giftlens.operators.products import apply_classification, classification_outcome

    table = KeyedTable(batch.sparkSession, table_dir)
    if table.is_done(query_key, batch_id):
        return
    answered = batch.select("present_hash").distinct()
    asked = table.rows(table.buckets_of(answered)).join(answered, "present_hash", "left_semi")
    changed = apply_classification(asked, classification_outcome(asked, batch), now=now)
    table.upsert(changed, query_key, batch_id)
    table.compact()


def published(spark: SparkSession, table_dir: str) -> DataFrame:
    """One row per published version: (version, query_key, batch_id)."""
    return KeyedTable(spark, table_dir).published().select("version", "query_key", "batch_id").distinct()


def write_first_version(table: DataFrame, table_dir: str, buckets: int | None = None) -> None:
    """Store ``table`` as version 0 of a keyed table of products."""
    KeyedTable.create(table, table_dir, ["present_hash"], buckets)


def latest_version(spark: SparkSession, table_dir: str) -> DataFrame:
    """Rows of the newest published state of a keyed table."""
    return KeyedTable(spark, table_dir).rows()
