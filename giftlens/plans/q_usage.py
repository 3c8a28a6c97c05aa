"""Queries: usage-log statistics, listings, retention, user maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftlens.operators import usage as U
from giftlens.plans.registry import register
from giftlens.sources import fixtures as FX

# Fixed clock of the fixtures (the log covers January 2024).
AS_OF = "2024-01-31 00:00:00"
# Retention runs on a later clock so that the 90-day rule removes old rows.
RETENTION_AS_OF = "2024-04-15 00:00:00"

_TS = f"TIMESTAMP '{AS_OF}'"
_JSON = "CASE WHEN json_valid({c}) THEN CAST(json({c}) AS VARCHAR) ELSE {c} END"
_PREVIEW = ("CASE WHEN json_valid({c}) AND length(CAST(json({c}) AS VARCHAR)) <= 500 "
            "THEN CAST(json({c}) AS VARCHAR) END")


@register("user_api_stats", sql=f"""
SELECT user_id, CAST(COUNT(*) AS BIGINT) AS total_calls, CAST(SUM(CAST(response_time_ms AS DECIMAL(38,6))) AS DOUBLE) / COUNT(response_time_ms) AS avg_response_time,
       MAX(response_time_ms) AS max_response_time, MIN(response_time_ms) AS min_response_time,
       CAST(COUNT(CASE WHEN response_status_code >= 400 THEN 1 END) AS BIGINT) AS error_count,
       CAST(COUNT(DISTINCT api_route) AS BIGINT) AS unique_endpoints
FROM fx_log WHERE date_time >= {_TS} - INTERVAL 30 DAY GROUP BY user_id""", rounded=["avg_response_time"])
def q_user_api_stats(spark, sf):
    return U.user_api_stats(FX.api_log(spark, sf), AS_OF, days=30)


@register("user_endpoint_stats", sql=f"""
SELECT user_id, api_route, CAST(COUNT(*) AS BIGINT) AS call_count, CAST(SUM(CAST(response_time_ms AS DECIMAL(38,6))) AS DOUBLE) / COUNT(response_time_ms) AS avg_response_time
FROM fx_log WHERE date_time >= {_TS} - INTERVAL 30 DAY GROUP BY user_id, api_route""",
          rounded=["avg_response_time"])
def q_user_endpoint_stats(spark, sf):
    return U.user_endpoint_stats(FX.api_log(spark, sf), AS_OF, days=30)


@register("system_api_stats", sql=f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_calls, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS active_users,
       CAST(SUM(CAST(response_time_ms AS DECIMAL(38,6))) AS DOUBLE) / COUNT(response_time_ms) AS avg_response_time,
       CAST(COUNT(CASE WHEN response_status_code >= 400 THEN 1 END) AS BIGINT) AS error_count,
       CAST(COUNT(CASE WHEN response_status_code >= 500 THEN 1 END) AS BIGINT) AS server_error_count
FROM fx_log WHERE date_time >= {_TS} - INTERVAL 24 HOUR""", rounded=["avg_response_time"])
def q_system_api_stats(spark, sf):
    return U.system_api_stats(FX.api_log(spark, sf), AS_OF, hours=24)


@register("top_users", sql=f"""
SELECT l.user_id, u.username, CAST(COUNT(*) AS BIGINT) AS call_count
FROM fx_log l JOIN fx_users u ON l.user_id = u.id
WHERE l.date_time >= {_TS} - INTERVAL 24 HOUR
GROUP BY l.user_id, u.username ORDER BY call_count DESC, l.user_id LIMIT 10""")
def q_top_users(spark, sf):
    return U.top_users(FX.api_log(spark, sf), FX.users(spark, sf), AS_OF, hours=24, k=10)


@register("recent_errors", sql=f"""
SELECT l.id, l.date_time, u.username, l.api_route, l.response_status_code, l.error_message,
       {_JSON.format(c='l.request_payload')} AS request_payload
FROM fx_log l JOIN fx_users u ON l.user_id = u.id
WHERE l.response_status_code >= 400 ORDER BY l.date_time DESC, l.id DESC LIMIT 100""")
def q_recent_errors(spark, sf):
    return U.recent_errors(FX.api_log(spark, sf), FX.users(spark, sf), limit=100)


@register("recent_logs", sql=f"""
SELECT l.id, strftime(l.date_time, '%Y-%m-%d %H:%M:%S.%f') AS date_time, u.username, l.api_route,
       l.response_status_code, l.response_time_ms, l.error_message,
       {_PREVIEW.format(c='l.request_payload')} AS request_payload,
       {_PREVIEW.format(c='l.response_payload')} AS response_payload
FROM fx_log l JOIN fx_users u ON l.user_id = u.id ORDER BY l.date_time DESC, l.id DESC LIMIT 10""",
          rounded=["response_time_ms"])
def q_recent_logs(spark, sf):
    return U.recent_logs(FX.api_log(spark, sf), FX.users(spark, sf), limit=10)


@register("retain_logs", sql=f"""
SELECT * FROM fx_log
WHERE NOT coalesce(date_time < TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL 90 DAY, false)""",
          rounded=["response_time_ms"])
def q_retain_logs(spark, sf):
    return U.keep_recent(FX.api_log(spark, sf), "date_time", RETENTION_AS_OF, days=90)


@register("log_retention_report", sql=f"""
SELECT CAST(COUNT(*) FILTER (WHERE NOT coalesce(date_time < TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL 90 DAY, false)) AS BIGINT) AS kept,
       CAST(COUNT(*) FILTER (WHERE coalesce(date_time < TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL 90 DAY, false)) AS BIGINT) AS deleted
FROM fx_log""")
def q_log_retention_report(spark, sf):
    return U.retention_report(FX.api_log(spark, sf), "date_time", RETENTION_AS_OF, days=90)


@register("list_users", sql="""
SELECT id, username, created_at, updated_at, is_active, is_admin FROM fx_users WHERE is_active""")
def q_list_users(spark, sf):
    return U.list_users(FX.users(spark, sf), active_only=True)


@register("user_count", sql="SELECT CAST(COUNT(*) AS BIGINT) AS user_count FROM fx_users")
def q_user_count(spark, sf):
    return U.user_count(FX.users(spark, sf))


@register("hash_keys", sql="""
SELECT id, username, created_at, updated_at, is_active, is_admin, sha256(api_key) AS api_key_hash FROM fx_users""")
def q_hash_keys(spark, sf):
    return U.hash_keys(FX.users(spark, sf))


@register("set_user_active", sql=f"""
SELECT id, username, api_key, created_at,
       CASE WHEN is_admin THEN {_TS} ELSE updated_at END AS updated_at,
       CASE WHEN is_admin THEN false ELSE is_active END AS is_active, is_admin
FROM fx_users""")
def q_set_user_active(spark, sf):
    users = FX.users(spark, sf)
    changes = users.filter("is_admin").select("username", F.lit(False).alias("is_active"))
    return U.set_user_active(users, changes, now=AS_OF)


@register("purge_users", sql="SELECT * FROM fx_users WHERE is_active")
def q_purge_users(spark, sf):
    users = FX.users(spark, sf)
    return U.purge_users(FX.api_log(spark, sf), users, users.filter(~F.col("is_active")))[1]


@register("purge_user_logs", sql="""
SELECT * FROM fx_log WHERE user_id NOT IN (SELECT id FROM fx_users WHERE NOT is_active)""",
          rounded=["response_time_ms"])
def q_purge_user_logs(spark, sf):
    users = FX.users(spark, sf)
    return U.purge_users(FX.api_log(spark, sf), users, users.filter(~F.col("is_active")))[0]


_HOURLY_SQL = """
SELECT time_bucket(INTERVAL 1 HOUR, date_time) AS window_start,
       time_bucket(INTERVAL 1 HOUR, date_time) + INTERVAL 1 HOUR AS window_end,
       CAST(COUNT(*) AS BIGINT) AS calls, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS active_users,
       CAST(COUNT(CASE WHEN response_status_code >= 400 THEN 1 END) AS BIGINT) AS error_count,
       CAST(SUM(CAST(response_time_ms AS DECIMAL(38,6))) AS DOUBLE) / COUNT(response_time_ms) AS avg_response_time
FROM fx_log GROUP BY 1, 2"""


@register("usage_hourly", sql=_HOURLY_SQL, rounded=["avg_response_time"])
def q_usage_hourly(spark, sf):
    return U.usage_hourly(FX.api_log(spark, sf))


@register("usage_hourly_stream", sql=_HOURLY_SQL, rounded=["avg_response_time"])
def q_usage_hourly_stream(spark, sf):
    """R2 as a Structured Streaming job over the event files (availableNow),
    read back from its sink; the same hours as the batch aggregate."""
    import uuid
    from giftlens.session import ensure_checkpoint_dir
    from giftlens.streaming.jobs import read_hourly_usage, start_hourly_usage
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/usage-stream-{uuid.uuid4().hex}"
    q = start_hourly_usage(spark, sf, f"{base}/out", f"{base}/checkpoint", file_glob="events.parquet",
                           state_partitions=spark.sparkContext.defaultParallelism)
    q.awaitTermination()
    return read_hourly_usage(spark, f"{base}/out")
