"""Leakage-free splits: company holdout, company folds, shop-grouped repeats.

Companies are ordered by ``md5(key || ':' || seed), key`` — a reproducible
shuffle that gives the same order in any engine. Ranks are computed without a
single-partition window: a range-partitioned sort, per-partition counts and
their running offsets (one row per partition) give each row its global index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.session import cut_lineage


def hashed_order(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def global_rank(df: DataFrame, order_cols: list, name: str = "rank",
                total: str = "n") -> DataFrame:
    """0-based dense position of each row in ``order_cols`` order (ties broken by
    the listed columns; make them unique), plus the row count ``total``.
    Distributed: no task sees more than one range partition; the only global
    step runs over one row per partition."""
    sorted_df = df.orderBy(*order_cols).withColumn("_pid", F.spark_partition_id())
    sorted_df = cut_lineage(sorted_df)  # fixes partition contents for both uses below
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias(total))
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    ranked = sorted_df.join(F.broadcast(offsets), "_pid")  # one row per partition
    ranked = (ranked.withColumn(name, (F.row_number().over(w) - 1 + F.col("_off")).cast("long"))
              .drop("_pid", "_off"))
    # materialise: consumers (train / validation sides, folds) read the ranks
    # instead of re-deriving the offsets for every reference
    return cut_lineage(ranked)


def ranked_keys(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys with their hashed-order rank and the key count ``n``."""
    keys = df.select(key).distinct().withColumn("_h", hashed_order(key, seed))
    return global_rank(keys, [F.col("_h"), F.col(key)]).drop("_h")


def company_split(df: DataFrame, seed: int = K.SPLIT_SEED,
                  validation_share: float = K.VALIDATION_SHARE) -> DataFrame:
    """W7 + M4: company_cvr -> 'train' / 'validation'; the first
    ceil(share · n) companies in hashed order are validation."""
    r = ranked_keys(df, "company_cvr", seed)
    val = F.col("rank") < F.ceil(F.col("n") * F.lit(validation_share))
    return r.select("company_cvr", F.when(val, "validation").otherwise("train").alias("split"))


def apply_split(df: DataFrame, split: DataFrame, which: str) -> DataFrame:
    """Rows of companies in one side of the split (semi-join)."""
    side = split.filter(F.col("split") == which).select("company_cvr")
    return df.join(side, "company_cvr", "left_semi")


def cv_folds(df: DataFrame, folds: int = K.CV_FOLDS, seed: int = K.SPLIT_SEED) -> DataFrame:
    """M5: company_cvr -> fold in 0..folds-1; fold size n div folds, the
    remainder goes to the last fold."""
    r = ranked_keys(df, "company_cvr", seed)
    size = F.floor(F.col("n") / folds)
    fold = F.when(size == 0, F.lit(folds - 1)).otherwise(
        F.least(F.floor(F.col("rank") / size), F.lit(folds - 1)))
    return r.select("company_cvr", fold.cast("int").alias("fold"))


def fold_parts(df: DataFrame, folds_df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """O3: (train, validation) of fold ``k`` — the complement and the fold."""
    tagged = df.join(folds_df, "company_cvr")
    return (tagged.filter(F.col("fold") != k).drop("fold"),
            tagged.filter(F.col("fold") == k).drop("fold"))


def shop_split(df: DataFrame, repeats: int = 5, test_share: float = 0.2,
               seed: int = K.SPLIT_SEED) -> DataFrame:
    """M6: shop-grouped shuffle splits; for each repeat the first
    ceil(share · shops) shops in that repeat's hashed order are test."""
    shops = df.select("shop_id").distinct()
    runs = shops.withColumn("repeat", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
    runs = runs.withColumn("_h", F.md5(F.concat(F.col("shop_id"), F.lit(":"), (F.lit(seed) + F.col("repeat")).cast("string"))))
    # one rank over (repeat, hash, shop); every repeat holds the same number of shops
    r = global_rank(runs, [F.col("repeat"), F.col("_h"), F.col("shop_id")])
    size = F.col("n") / repeats
    test = F.col("rank") - F.col("repeat") * size < F.ceil(size * F.lit(test_share))
    return r.select("repeat", "shop_id", F.when(test, "test").otherwise("train").alias("split"))


def split_overlap(train: DataFrame, validation: DataFrame) -> DataFrame:
    """O2 / Q6: companies on each side and in both (must be 0)."""
    t = train.select("company_cvr").distinct().withColumn("_t", F.lit(True))
    v = validation.select("company_cvr").distinct().withColumn("_v", F.lit(True))
    j = t.join(v, "company_cvr", "full")
    return j.agg(F.count_if(F.col("_t").isNotNull()).cast("long").alias("train_companies"),
                 F.count_if(F.col("_v").isNotNull()).cast("long").alias("validation_companies"),
                 F.count_if(F.col("_t").isNotNull() & F.col("_v").isNotNull()).cast("long")
                 .alias("overlap_companies"))


def check_no_overlap(train: DataFrame, validation: DataFrame) -> None:
    """Raise when a company is on both sides of a split."""
    n = split_overlap(train, validation).first()["overlap_companies"]
    if n:
        raise ValueError(f"company leakage: {n} companies in both train and validation")


def stratified_split(df: DataFrame, stratum: str, key: str = "company_cvr", seed: int = K.SPLIT_SEED,
                     validation_share: float = K.VALIDATION_SHARE) -> DataFrame:
    """Holdout per stratum — in every stratum the first ceil(share · n_s)
    keys in hashed order are validation. One global rank over (stratum, hash,
    key); a stratum's first rank and size come from small aggregates (one row
    per stratum), so a large stratum is never ranked inside one task."""
    keys = (df.groupBy(key).agg(F.min(stratum).alias(stratum))   # one stratum per key
            .withColumn("_h", hashed_order(key, seed)))
    r = global_rank(keys, [F.col(stratum), F.col("_h"), F.col(key)], name="_g", total="_n")
    per = r.groupBy(stratum).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_size"))
    j = r.join(per, stratum)
    val = (F.col("_g") - F.col("_first")) < F.ceil(F.col("_size") * F.lit(validation_share))
    return j.select(key, stratum, F.when(val, "validation").otherwise("train").alias("split"))
