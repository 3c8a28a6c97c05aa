"""Queries: file sources and table sinks, as round trips through the shared folder.

Each query writes a fixture in a source's format, reads it back through the source and returns its rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.plans.registry import register
from giftlens.session import ensure_checkpoint_dir
from giftlens.sources import files as S
from giftlens.sources import fixtures as FX
from giftlens.sources import tables as T


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _write_csv(df, path: str) -> None:
    (df.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


@register("training_csv_sources", sql=f"SELECT {', '.join(K.SELECTION_COLUMNS)} FROM fx_damaged")
def q_training_csv_sources(spark, sf):
    """The three training files; texts with quotes, tabs, spaces and nulls come back as they were."""
    base = _folder(spark, "csv")
    _write_csv(FX.faulty_selections(spark, sf).select(*K.SELECTION_COLUMNS), f"{base}/selections")
    _write_csv(FX.catalog(spark, sf), f"{base}/catalog")
    _write_csv(FX.employees(spark, sf), f"{base}/employees")
    rows, _, _ = S.load_three_files(spark, f"{base}/selections", f"{base}/catalog", f"{base}/employees")
    return rows.drop("event_seq")


@register("product_csv_source", sql="SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in S.PRODUCT_CSV_COLUMNS) + " FROM fx_presents")
def q_product_csv_source(spark, sf):
    """The product attribute file."""
    path = _folder(spark, "products")
    _write_csv(FX.presents(spark, sf).select(*S.PRODUCT_CSV_COLUMNS), path)
    return S.read_product_csv(spark, path).where("_corrupt_record IS NULL").select(*S.PRODUCT_CSV_COLUMNS)


@register("usage_log_sink", sql="""
SELECT CAST(date_time AS DATE) AS log_date, api_route, CAST(COUNT(*) AS BIGINT) AS calls, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users,
       CAST(COUNT(error_message) AS BIGINT) AS errors, MIN(request_payload) AS first_payload
FROM fx_log GROUP BY 1, 2""")
def q_usage_log_sink(spark, sf):
    """S5 + S6 + S7: the log table, created, appended to, and read by its day partitions."""
    base = _folder(spark, "tables")
    T.create_tables(spark, base, drop=True)
    T.append_calls(FX.api_log(spark, sf))
    log = spark.read.parquet(f"{base}/user_api_call_log")
    return log.groupBy("log_date", "api_route").agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("users"), F.count("error_message").alias("errors"),
        F.min("request_payload").alias("first_payload"))


@register("json_requests_source", sql="""
SELECT cvr, male_count, female_count, product_id, description,
       CAST(row_number() OVER (PARTITION BY request_id ORDER BY product_id) - 1 AS INTEGER) AS position
FROM fx_requests""")
def q_json_requests_source(spark, sf):
    """Requests of at most 100 gifts as JSON lines, read and exploded."""
    path = _folder(spark, "requests")
    gifts = F.sort_array(F.collect_list(F.struct(F.col("product_id").alias("id"), "description"))).alias("presents")
    FX.requests(spark, sf).groupBy("request_id", "cvr", "male_count", "female_count").agg(gifts).drop("request_id").write.json(path)
    return S.read_requests(spark, path).select("cvr", "male_count", "female_count", "product_id", "description", "position")
