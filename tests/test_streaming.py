import uuid

from pyspark.sql import functions as F

from giftlens.operators import usage as U
from giftlens.session import ensure_checkpoint_dir
from giftlens.sources import fixtures as FX
from giftlens.streaming.jobs import read_hourly_usage, start_hourly_usage

SF = "/root/testdata/sf0.001"


def test_hourly_usage_stream_equals_batch(spark):
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/t-{uuid.uuid4().hex}"
    q = start_hourly_usage(spark, SF, f"{base}/out", f"{base}/ckpt", file_glob="events.parquet")
    q.awaitTermination()
    stream = {r.window_start: (r.calls, r.error_count, r.active_users) for r in read_hourly_usage(spark, f"{base}/out").collect()}
    batch = {r.window_start: (r.calls, r.error_count, r.active_users) for r in U.usage_hourly(FX.api_log(spark, SF)).collect()}
    assert stream.keys() == batch.keys()
    assert stream == batch


def test_files_in_any_order_over_many_batches_lose_nothing(spark):
    """250 files, newest events first, 20 files a batch: every call counts."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/t-{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{SF}/events.parquet")
    n = ev.count()
    rows = ev.orderBy(F.desc("ts"), "event_id").collect()
    import pyarrow as pa
    import pyarrow.parquet as pq
    import os
    folder = base.removeprefix("file://").removeprefix("file:") + "/in"
    os.makedirs(folder)
    table = pa.Table.from_pylist([r.asDict() for r in rows]).cast(pa.schema([
        ("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()),
        ("value", pa.float64()), ("props", pa.string())]))
    step = -(-n // 250)
    for k in range(0, n, step):
        path = f"{folder}/events-{k // step:04d}.parquet"
        pq.write_table(table.slice(k, step), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # read in this order
    q = start_hourly_usage(spark, folder, f"{base}/out", f"{base}/ckpt", files_per_batch=20)
    q.awaitTermination()
    as_rows = lambda df: {tuple(r) for r in df.select("window_start", "window_end", "calls", "active_users", "error_count", "avg_response_time").collect()}
    got = as_rows(read_hourly_usage(spark, f"{base}/out"))
    assert sum(r[2] for r in got) == n
    assert got == as_rows(U.usage_hourly(FX.api_log(spark, SF)))  # distinct users too, over 13 batches in reverse order
