import random
import uuid

import pytest

from giftlens.session import ensure_checkpoint_dir
from giftlens.streaming.jobs import apply_replies, latest_version, write_first_version
from giftlens.streaming.keyed_table import KeyedTable

ROW = "k string, part long, value long"


def folder(spark):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/keyed-{uuid.uuid4().hex}"


def contents(table):
    got = [tuple(r) for r in table.rows().collect()]
    assert len(got) == len(set(got))
    return {r[:2]: r[2] for r in got}


def test_random_changes_equal_a_dictionary(spark):
    rng = random.Random(1)
    want = {(f"k{i % 40}", i): i for i in range(60)} | {(None, 1): 5, ("x", None): 6}
    table = KeyedTable.create(spark.createDataFrame([(*k, v) for k, v in want.items()], ROW), folder(spark), ["k", "part"], 4)
    assert contents(table) == want
    for step in range(7):
        change = {(f"k{rng.randrange(50)}", rng.randrange(70)): rng.randrange(10**6) for _ in range(rng.choice([0, 1, 5, 20]))}
        change |= {(None, 1): step} if step % 2 else {}
        table.upsert(spark.createDataFrame([(*k, v) for k, v in change.items()], ROW), "q", step)
        want |= change
        if step == 3:
            assert table.compact(2) and table.compact(2) == []
        if step == 5:
            table.vacuum()
            table.vacuum()
            assert table.is_done("q", 5) and not table.is_done("q", 6)
        table.upsert(spark.createDataFrame([("replayed", 0, 0)], ROW), "q", step)  # published: does nothing
        table = KeyedTable(spark, table.path)
        assert contents(table) == want
    some = [0, 2]
    kept = {tuple(r) for r in table.rows(some).collect()}
    assert kept == {tuple(r) for r in table.rows().where(table.bucket_of().isin(some)).collect()}


def test_an_unpublished_try_is_not_read_and_is_written_over(spark):
    table = KeyedTable.create(spark.createDataFrame([("a", 1, 1)], ROW), folder(spark), ["k"], 2)
    spark.createDataFrame([("a", 9, 9, 0), ("z", 9, 9, 1)], ROW + ", bucket int").write.partitionBy("bucket").parquet(f"{table.path}/v=1")
    assert contents(table) == {("a", 1): 1}
    table.upsert(spark.createDataFrame([("b", 2, 2)], ROW))
    assert contents(table) == {("a", 1): 1, ("b", 2): 2}


def test_empty_and_missing_tables(spark):
    path = folder(spark)
    with pytest.raises(ValueError, match="no keyed table"):
        KeyedTable(spark, path)
    table = KeyedTable.create(spark.createDataFrame([], ROW), path, ["k"], 3)
    assert contents(table) == {}
    table.vacuum()
    table.upsert(spark.createDataFrame([("a", 1, 1)], ROW), "q", 0)
    assert contents(KeyedTable(spark, path)) == {("a", 1): 1} and table.compact() == []


def test_a_batch_of_replies_touches_only_its_buckets(spark):
    """40 products in 16 buckets: a batch of two replies writes at most two files, whatever the table's size."""
    from tests.test_streaming_classification import GOOD, NOW, REPLY, SCHEMA
    import datetime as dt
    base = folder(spark)
    rows = [(k, f"H{k}", "a", None, "m", "1") + (None,) * 12 + (dt.datetime(2024, 1, 1), "pending_classification") for k in range(40)]
    write_first_version(spark.createDataFrame(rows, SCHEMA), base, 16)
    table = KeyedTable(spark, base)
    before = {r.present_hash: tuple(r) for r in latest_version(spark, base).collect()}
    for batch in range(10):
        asked = [f"H{batch}", f"H{batch + 20}", "no such product"]
        apply_replies(spark.createDataFrame([(h, "t", "r", GOOD) for h in asked], REPLY), batch, base, "q", NOW)
        newest = [r for r in table.published().where(f"query_key = 'q' and batch_id = {batch}").collect()]
        assert len(newest) <= 2 and {r.kind for r in newest} == {"delta"}
        files = [f for r in newest for f in table._names(f"v={r.version}/bucket={r.bucket}") if f.endswith(".parquet")]
        assert len(files) <= 2
        touched = {r.bucket for r in newest}
        assert touched == set(table.buckets_of(spark.createDataFrame([(h,) for h in asked[:2]], "present_hash string")))
    table.compact(1)
    table.vacuum()
    after = {r.present_hash: tuple(r) for r in latest_version(spark, base).collect()}
    done = {f"H{k}" for k in range(10)} | {f"H{k + 20}" for k in range(10)}
    assert {h for h in after if after[h][-1] == "success"} == done
    assert all(after[h] == before[h] for h in before if h not in done)
    assert sum(1 for n in table._names() if n.startswith("v=")) <= 2
