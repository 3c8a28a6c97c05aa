"""Table schemas, bootstrap, existence check and the usage-log append sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("username", T.StringType(), False),
    T.StructField("api_key_hash", T.StringType(), False), T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("is_active", T.BooleanType()),
    T.StructField("is_admin", T.BooleanType()),
])
LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("user_id", T.LongType()),
    T.StructField("date_time", T.TimestampType()), T.StructField("api_route", T.StringType()),
    T.StructField("request_payload", T.StringType()), T.StructField("response_payload", T.StringType()),
    T.StructField("response_status_code", T.IntegerType()), T.StructField("response_time_ms", T.FloatType()),
    T.StructField("error_message", T.StringType()),
])
PRESENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("present_hash", T.StringType(), False),
    *[T.StructField(c, T.StringType()) for c in [
        "present_name", "present_vendor", "model_name", "model_no", "thread_id", "run_id",
        "item_main_category", "item_sub_category", "color", "brand", "vendor"]],
    T.StructField("value_price", T.FloatType()),
    *[T.StructField(c, T.StringType()) for c in ["target_demographic", "utility_type", "durability", "usage_type"]],
    T.StructField("classified_at", T.TimestampType()), T.StructField("classification_status", T.StringType()),
])
TABLES = {"user": (USER_SCHEMA, None), "user_api_call_log": (LOG_SCHEMA, "log_date"),
          "present_attributes": (PRESENT_SCHEMA, None)}


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def create_tables(spark: SparkSession, location: str, drop: bool = False) -> None:
    """Create the three tables as parquet tables under ``location``
    (idempotent; ``drop`` recreates them). The log is partitioned by day."""
    for name, (schema, part) in TABLES.items():
        if drop:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        cols = _ddl(schema) + (f", `{part}` date" if part else "")
        parted = f" PARTITIONED BY (`{part}`)" if part else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({cols}) USING parquet{parted} "
                  f"LOCATION '{location.rstrip('/')}/{name}'")


def tables_exist(spark: SparkSession, names=tuple(TABLES)) -> bool:
    """All named tables are registered."""
    return all(spark.catalog.tableExists(n) for n in names)


def append_calls(calls: DataFrame, table: str = "user_api_call_log") -> None:
    """S5 + S6 + X12: append API calls; dict/struct payloads are serialised to
    JSON text, a missing timestamp becomes the current time, rows land in their
    day partition."""
    def as_json(c: str):
        f = calls.schema[c].dataType
        return F.col(c) if isinstance(f, T.StringType) else F.to_json(F.col(c))
    ts = F.coalesce(F.col("date_time").cast("timestamp"), F.current_timestamp()) \
        if "date_time" in calls.columns else F.current_timestamp()
    out = calls.select(
        F.col("id").cast("long"), F.col("user_id").cast("long"), ts.alias("date_time"),
        F.col("api_route"), as_json("request_payload").alias("request_payload"),
        as_json("response_payload").alias("response_payload"),
        F.col("response_status_code").cast("int"), F.col("response_time_ms").cast("float"),
        F.col("error_message").cast("string"))
    out.withColumn("log_date", F.to_date("date_time")).write.insertInto(table)
