import datetime as dt
import uuid

from giftlens.operators import products as P
from giftlens.session import ensure_checkpoint_dir
from giftlens.streaming.jobs import apply_replies, latest_version, published, start_classification, write_first_version

GOOD = ('{"itemMainCategory": "Home", "itemSubCategory": "Mug", "color": "blue", "brand": "B", "vendor": "V", '
        '"valuePrice": 10.5, "targetDemographic": "unisex", "utilityType": "practical", "durability": "durable", '
        '"usageType": "individual"}')


SCHEMA = ", ".join(f"{c} {'bigint' if c == 'id' else 'double' if c == 'value_price' else 'timestamp_ntz' if c == 'classified_at' else 'string'}"
                   for c in P.PRESENT_COLUMNS)
REPLY = "present_hash string, thread_id string, run_id string, reply string"
NOW = "2024-02-01 00:00:00"


def new_table(spark, hashes):
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/cls-{uuid.uuid4().hex}"
    rows = [(k, h, "a", None, "m", "1") + (None,) * 12 + (dt.datetime(2024, 1, 1), "pending_classification") for k, h in enumerate(hashes)]
    write_first_version(spark.createDataFrame(rows, SCHEMA), f"{base}/table")
    return base


def statuses(spark, base):
    return {r.present_hash: r.classification_status for r in latest_version(spark, f"{base}/table").collect()}


def test_replies_in_several_batches_all_count(spark):
    base = new_table(spark, ["H1", "H2", "H3"])
    for k, h in enumerate(["H1", "H2"]):
        spark.createDataFrame([(h, f"t{k}", "r", GOOD)], REPLY).coalesce(1).write.mode("append").parquet(f"{base}/replies")
    q = start_classification(spark, f"{base}/replies", spark.read.parquet(f"{base}/replies").schema, f"{base}/table",
                             f"{base}/ckpt", now=NOW, files_per_batch=1)
    q.awaitTermination()
    assert statuses(spark, base) == {"H1": "success", "H2": "success", "H3": "pending_classification"}
    # a new query with a checkpoint of its own continues from the newest version
    spark.createDataFrame([("H3", "t9", "r", GOOD)], REPLY).coalesce(1).write.parquet(f"{base}/more")
    start_classification(spark, f"{base}/more", spark.read.parquet(f"{base}/more").schema, f"{base}/table", f"{base}/ckpt2",
                         now=NOW).awaitTermination()
    assert set(statuses(spark, base).values()) == {"success"}


def test_a_replayed_batch_changes_nothing(spark):
    base = new_table(spark, ["H1", "H2"])
    batch = spark.createDataFrame([("H1", "t1", "r1", GOOD)], REPLY)
    apply_replies(batch, 0, f"{base}/table", "q", NOW)
    once = sorted(map(tuple, latest_version(spark, f"{base}/table").collect()), key=str)
    apply_replies(batch, 0, f"{base}/table", "q", NOW)
    assert published(spark, f"{base}/table").count() == 2
    assert sorted(map(tuple, latest_version(spark, f"{base}/table").collect()), key=str) == once
    apply_replies(spark.createDataFrame([("H2", "t1", "r1", None)], REPLY), 1, f"{base}/table", "q", NOW)
    assert statuses(spark, base) == {"H1": "success", "H2": "error_processing_failed"}
