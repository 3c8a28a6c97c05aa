"""API usage log statistics, listings and user-table maintenance.

Every trailing window takes an explicit ``as_of`` timestamp (default: the
current timestamp), so results are reproducible. Filters on ``date_time`` are
plain comparisons and reach the parquet scan as pushed filters.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.functions.numeric import exact_avg


def _as_of(as_of) -> Column:
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    # a string -> TIMESTAMP_NTZ cast does not depend on any time zone
    return F.lit(str(as_of)).cast("timestamp_ntz")


def since(df: DataFrame, as_of=None, days: int = 0, hours: int = 0, col: str = "date_time") -> DataFrame:
    """Rows with ``col >= as_of - interval``."""
    cutoff = _as_of(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))
    return df.filter(F.col(col) >= cutoff)


def user_api_stats(log: DataFrame, as_of=None, days: int = K.USER_STATS_DAYS) -> DataFrame:
    """Per user over the last ``days``: calls, avg/max/min latency, errors
    (status >= 400) and distinct routes."""
    return (since(log, as_of, days=days).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("total_calls"),
                 exact_avg(F.col("response_time_ms")).alias("avg_response_time"),
                 F.max("response_time_ms").alias("max_response_time"),
                 F.min("response_time_ms").alias("min_response_time"),
                 F.count_if(F.col("response_status_code") >= 400).alias("error_count"),
                 F.countDistinct("api_route").alias("unique_endpoints")))


def user_endpoint_stats(log: DataFrame, as_of=None, days: int = K.USER_STATS_DAYS) -> DataFrame:
    """Per (user, route) calls and average latency, busiest first."""
    return (since(log, as_of, days=days).groupBy("user_id", "api_route")
            .agg(F.count(F.lit(1)).alias("call_count"),
                 exact_avg(F.col("response_time_ms")).alias("avg_response_time"))
            .orderBy(F.desc("call_count"), "user_id", "api_route"))


def system_api_stats(log: DataFrame, as_of=None, hours: int = K.SYSTEM_STATS_HOURS) -> DataFrame:
    """Calls, active users, average latency, errors (>= 400) and server
    errors (>= 500) over the last ``hours``. One global aggregate (partial
    aggregation per task, one final row)."""
    return since(log, as_of, hours=hours).agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.countDistinct("user_id").alias("active_users"),
        exact_avg(F.col("response_time_ms")).alias("avg_response_time"),
        F.count_if(F.col("response_status_code") >= 400).alias("error_count"),
        F.count_if(F.col("response_status_code") >= 500).alias("server_error_count"))


def top_users(log: DataFrame, users: DataFrame, as_of=None, hours: int = K.SYSTEM_STATS_HOURS,
              k: int = 10) -> DataFrame:
    """A9 + T1: the ``k`` users with most calls over the last ``hours``; ties by
    user id. Counts are aggregated before the join, so the join sees one row
    per active user; the top-k is a bounded TakeOrderedAndProject."""
    calls = since(log, as_of, hours=hours).groupBy("user_id").agg(F.count(F.lit(1)).alias("call_count"))
    j = calls.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
    return j.orderBy(F.desc("call_count"), "user_id").limit(k).select("user_id", "username", "call_count")


def json_text(c: Column) -> Column:
    """X11: compact JSON text of a payload; unparsable text is kept as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def _latest_with_user(log: DataFrame, users: DataFrame, limit: int) -> DataFrame:
    """The latest ``limit`` calls of known users with their names. The join and the
    top-N run on (id, time, user) alone; payloads are then read for those ids only
    (at most ``limit`` of them: a proven bound for the broadcast)."""
    named = users.select(F.col("id").alias("user_id"), "username")
    top = (log.select("id", "date_time", "user_id").join(named, "user_id")
           .orderBy(F.desc("date_time"), F.desc("id")).limit(limit).select("id", "username"))
    return log.join(F.broadcast(top), "id").orderBy(F.desc("date_time"), F.desc("id"))


def recent_errors(log: DataFrame, users: DataFrame, limit: int = 100) -> DataFrame:
    """T2 + P10 + J8: latest ``limit`` calls with status >= 400, with username."""
    j = _latest_with_user(log.filter(F.col("response_status_code") >= 400), users, limit)
    return (j.select("id", "date_time", "username", "api_route", "response_status_code",
                    "error_message", json_text(F.col("request_payload")).alias("request_payload")))


def payload_preview(c: Column, max_chars: int = K.PAYLOAD_PREVIEW_CHARS) -> Column:
    """Parsed payload as compact JSON when it has at most ``max_chars``
    characters; null when longer, empty or unparsable."""
    js = F.to_json(F.try_parse_json(c))
    return F.when(F.length(js) <= max_chars, js)


def recent_logs(log: DataFrame, users: DataFrame, limit: int = 10) -> DataFrame:
    """T2 + P18 + P20: latest ``limit`` calls with username, payload previews and
    the timestamp rendered as text."""
    j = _latest_with_user(log, users, limit)
    return (j.select("id", F.date_format("date_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date_time"),
                    "username", "api_route", "response_status_code", "response_time_ms", "error_message",
                    payload_preview(F.col("request_payload")).alias("request_payload"),
                    payload_preview(F.col("response_payload")).alias("response_payload")))


def keep_recent(df: DataFrame, col: str, as_of=None, days: int = K.LOG_RETENTION_DAYS) -> DataFrame:
    """Drop rows strictly older than ``as_of - days``; null timestamps stay."""
    cutoff = _as_of(as_of) - F.make_dt_interval(F.lit(days))
    return df.filter(~F.coalesce(F.col(col) < cutoff, F.lit(False)))


def retention_report(df: DataFrame, col: str, as_of=None, days: int = K.LOG_RETENTION_DAYS) -> DataFrame:
    """Rows kept and deleted by :func:`keep_recent`, in one pass."""
    cutoff = _as_of(as_of) - F.make_dt_interval(F.lit(days))
    old = F.coalesce(F.col(col) < cutoff, F.lit(False))
    return df.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("deleted"))


def list_users(users: DataFrame, active_only: bool = False) -> DataFrame:
    """P15 + T3: users (optionally active only), newest first."""
    u = users.filter(F.col("is_active")) if active_only else users
    return (u.select("id", "username", "created_at", "updated_at", "is_active", "is_admin")
            .orderBy(F.desc_nulls_last("created_at"), "id"))


def user_count(users: DataFrame) -> DataFrame:
    """A13."""
    return users.agg(F.count(F.lit(1)).alias("user_count"))


def hash_keys(users: DataFrame, key_col: str = "api_key") -> DataFrame:
    """Replace the secret column by its SHA-256 hex digest."""
    return users.withColumn(key_col + "_hash", F.sha2(F.col(key_col), 256)).drop(key_col)


def set_user_active(users: DataFrame, changes: DataFrame, now=None) -> DataFrame:
    """Apply (username, is_active) changes; every matched row gets ``updated_at = now``, as the
    table's update trigger does, even if its value stays. Of several changes for one user
    the deactivation wins; a null flag changes nothing."""
    ch = (changes.filter(F.col("is_active").isNotNull()).groupBy("username")
          .agg(F.min("is_active").alias("_new")))
    j = users.join(ch, "username", "left")
    matched = F.col("_new").isNotNull()
    return j.select(*[F.when(matched, F.col("_new")).otherwise(F.col("is_active")).alias(c) if c == "is_active"
                      else F.when(matched, _as_of(now)).otherwise(F.col("updated_at")).alias(c)
                      if c == "updated_at" else F.col(c) for c in users.columns])


def purge_users(log: DataFrame, users: DataFrame, purge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete the log rows of the users in ``purge`` (by username), then the
    users. Returns (remaining log, remaining users); both are anti-joins."""
    ids = users.join(purge.select("username"), "username", "left_semi").select(F.col("id").alias("user_id"))
    return (log.join(ids, "user_id", "left_anti"),
            users.join(purge.select("username"), "username", "left_anti"))


def usage_hourly(log: DataFrame) -> DataFrame:
    """R2 (batch twin): calls, distinct users, errors and average latency per
    hour (tumbling window on date_time)."""
    return (log.groupBy(F.window("date_time", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.countDistinct("user_id").alias("active_users"),
                 F.count_if(F.col("response_status_code") >= 400).alias("error_count"),
                 exact_avg(F.col("response_time_ms")).alias("avg_response_time"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "calls", "active_users", "error_count", "avg_response_time"))
