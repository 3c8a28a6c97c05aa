"""Keyed Parquet tables that micro-batches change: bucketed delta files, merged on read, folded by compaction.

Layout of ``<path>``:

* ``_table``: one row with the key columns, the number of buckets and the schema;
* ``v=<n>/bucket=<b>/``: rows that version ``n`` wrote, dealt by the hash of their key;
* ``_published/<n>/``: which buckets version ``n`` wrote, written last. What is not published does not exist.

A ``base`` file holds every row of its bucket, a ``delta`` file whole rows that replace
those of the same key. A batch writes deltas of the buckets it touches and nothing else; a read takes
of each bucket the newest base and the deltas after it; ``compact`` folds buckets with many deltas;
``vacuum`` deletes files that no reader needs. One writer at a time; steps are named by (query, batch), and a
replayed step finds itself published.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 1_000_000
FOLD_AFTER = 8
BASE, DELTA, NOTHING = "base", "delta", "nothing"
_PUBLISHED = "version long, bucket int, kind string, query_key string, batch_id long"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            about = spark.read.parquet(f"{self.path}/_table").first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raise ValueError(f"{path} is no keyed table: create it with KeyedTable.create") from e
        self.keys, self.buckets = list(about["keys"]), about["buckets"]
        self.schema = T.StructType.fromJson(json.loads(about["schema"]))

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> "KeyedTable":
        """Store ``rows`` (one per key) as version 0; by default a bucket for every million rows."""
        spark = rows.sparkSession
        if buckets is None:
            buckets = max(1, -(-rows.count() // ROWS_PER_BUCKET))
        about = spark.createDataFrame([(list(keys), buckets, rows.schema.json())], "keys array<string>, buckets int, schema string")
        about.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_table")
        table = cls(spark, path)
        table._write(rows, 0, BASE)
        return table

    # ---- files -------------------------------------------------------------

    def _folder(self, sub: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}" if sub else self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, sub: str = "") -> list[str]:
        fs, where = self._folder(sub)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _delete(self, sub: str) -> None:
        fs, where = self._folder(sub)
        fs.delete(where, True)

    # ---- versions ----------------------------------------------------------

    def published(self) -> DataFrame:
        """What each version wrote: (version, bucket, kind, query_key, batch_id)."""
        return self.spark.read.schema(_PUBLISHED).parquet(f"{self.path}/_published/*")

    def newest(self) -> int:
        return self.published().agg(F.max("version")).first()[0]

    def is_done(self, query_key: str, batch_id: int) -> bool:
        """Whether this step, or a later one of the same query, is published."""
        return not self.published().where((F.col("query_key") == query_key) & (F.col("batch_id") >= batch_id)).isEmpty()

    def _live(self, buckets: list[int] | None = None) -> list[tuple[int, int, str]]:
        """(version, bucket, kind) of the files that a read needs: metadata, at most ``FOLD_AFTER`` deltas a bucket where batches compact."""
        seen = self.published().where(F.col("kind") != NOTHING)
        if buckets is not None:
            seen = seen.where(F.col("bucket").isin(buckets))
        base = seen.groupBy("bucket").agg(F.coalesce(F.max(F.when(F.col("kind") == BASE, F.col("version"))), F.lit(-1)).alias("base"))
        live = seen.join(base, "bucket").where("version >= base").select("version", "bucket", "kind").distinct()
        return [tuple(r) for r in live.collect()]

    def bucket_of(self, *keys) -> F.Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that the keys fall in, at most the table's number of them."""
        return sorted(r[0] for r in keys.select(self.bucket_of().alias("b")).distinct().collect())

    def _files(self, live) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.schema).withColumn("v", F.lit(0).cast("long"))
        schema = T.StructType([*self.schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
        return (self.spark.read.schema(schema).option("basePath", self.path)
                .parquet(*[f"{self.path}/v={v}/bucket={b}" for v, b, _ in live]).drop("bucket"))

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets: base rows without a newer delta, and the newest deltas."""
        live = self._live(buckets)
        base = self._files([x for x in live if x[2] == BASE]).select(*self.schema.names)
        deltas = [x for x in live if x[2] == DELTA]
        if not deltas:
            return base
        newest = (self._files(deltas).groupBy(*self.keys)
                  .agg(F.max_by(F.struct(*self.schema.names), "v").alias("row")).select("row.*"))
        changed = newest.select(*[F.col(k).alias(f"__{k}") for k in self.keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys])
        return base.join(changed, same, "left_anti").unionByName(newest)

    # ---- changes -----------------------------------------------------------

    def _write(self, rows: DataFrame, version: int, kind: str, query_key: str = "", batch_id: int = -1) -> None:
        keyed = rows.select(*self.schema.names).withColumn("bucket", self.bucket_of())
        self._delete(f"v={version}")  # what an unpublished try left
        keyed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/v={version}")
        wrote = sorted(int(n.split("=")[1]) for n in self._names(f"v={version}") if n.startswith("bucket="))
        self._publish(version, [(b, kind) for b in wrote], query_key, batch_id)

    def _publish(self, version: int, wrote: list[tuple[int, str]], query_key: str, batch_id: int) -> None:
        rows = [(version, b, kind, query_key, batch_id) for b, kind in wrote] or [(version, -1, NOTHING, query_key, batch_id)]
        self.spark.createDataFrame(rows, _PUBLISHED).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_published/{version}")

    def upsert(self, rows: DataFrame, query_key: str = "", batch_id: int = -1) -> None:
        """Replace or add whole rows by key (one row per key); a step that is published already does nothing."""
        if batch_id >= 0 and self.is_done(query_key, batch_id):
            return
        self._write(rows, self.newest() + 1, DELTA, query_key, batch_id)

    def compact(self, fold_after: int = FOLD_AFTER) -> list[int]:
        """Fold the deltas of every bucket that has at least ``fold_after`` of them into a new base; the buckets folded."""
        deltas: dict[int, int] = {}
        for _, bucket, kind in self._live():
            deltas[bucket] = deltas.get(bucket, 0) + (kind == DELTA)
        full = sorted(b for b, n in deltas.items() if n >= fold_after)
        if full:
            self._write(self.rows(full), self.newest() + 1, BASE)
        return full

    def vacuum(self) -> None:
        """Delete files of rows that newer ones replace; only for times without readers of older versions.

        The list of what is published is written anew as one entry, which keeps each query's newest step."""
        live = self._live()
        now = self.newest()
        steps = (self.published().where("batch_id >= 0").groupBy("query_key").agg(F.max("batch_id").alias("batch_id"))
                 .select(F.lit(now).cast("long").alias("version"), F.lit(-1).alias("bucket"), F.lit(NOTHING).alias("kind"), "query_key", "batch_id"))
        files = self.spark.createDataFrame([(v, b, k, "", -1) for v, b, k in live] or [(now, -1, NOTHING, "", -1)], _PUBLISHED)
        entry, old = f"{now}-all", self._names("_published")
        if entry not in old:  # else the last call broke off here
            files.unionByName(steps).coalesce(1).write.parquet(f"{self.path}/_published/{entry}")
        for name in old:
            if name != entry:
                self._delete(f"_published/{name}")
        needed = {(v, b) for v, b, _ in live}
        for name in self._names():
            if not name.startswith("v="):
                continue
            v = int(name[2:])
            kept = False
            for part in self._names(name):
                if part.startswith("bucket="):
                    if (v, int(part[7:])) in needed:
                        kept = True
                    else:
                        self._delete(f"{name}/{part}")
            if not kept:
                self._delete(name)
