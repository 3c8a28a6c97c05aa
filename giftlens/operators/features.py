"""Company- and shop-level features, feature matrix, rate summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giftlens import constants as K
from giftlens.functions.cleaning import lenient_double
from giftlens.functions.numeric import exact_sum

COMPANY_NUMERIC = ["company_main_category_diversity", "company_brand_diversity",
                   "company_utility_type_diversity", "company_total_selections"]


def top_by_count(df: DataFrame, key: str, value: str, count: str) -> DataFrame:
    """Per ``key`` the ``value`` with the largest ``count``; ties go to the
    smallest value. One aggregate (partial + final), no window."""
    order = F.struct((-F.col(count)).alias("neg"), F.col(value).alias("v"))
    return df.groupBy(key).agg(F.min_by(F.col(value), order).alias(value))


def company_category_counts(source: DataFrame) -> DataFrame:
    """A5: selections per (company, main category), selected rows only."""
    return (source.filter(F.col("selection_count") > 0)
            .groupBy("company_cvr", "product_main_category")
            .agg(F.sum("selection_count").cast("long").alias("selection_count")))


def company_stats(source: DataFrame) -> DataFrame:
    """A4 + W1 + J7: diversity of selected categories / brands / utility types,
    total selections and the most frequent main category per company.

    Selections are first counted per (company, category, brand, utility type): both results
    come from this one aggregate, whose exchange Spark reuses, so ``source`` runs once."""
    cell = (source.filter(F.col("selection_count") > 0)
            .groupBy("company_cvr", "product_main_category", "product_brand", "product_utility_type")
            .agg(F.sum("selection_count").cast("long").alias("selection_count")))
    stats = cell.groupBy("company_cvr").agg(
        F.countDistinct("product_main_category").cast("long").alias("company_main_category_diversity"),
        F.countDistinct("product_brand").cast("long").alias("company_brand_diversity"),
        F.countDistinct("product_utility_type").cast("long").alias("company_utility_type_diversity"),
        F.sum("selection_count").cast("long").alias("company_total_selections"),
    )
    top = (top_by_count(company_category_counts(cell), "company_cvr",
                        "product_main_category", "selection_count")
           .withColumnRenamed("product_main_category", "company_most_frequent_main_category"))
    return (stats.join(top, "company_cvr", "left")
            .select("company_cvr", *COMPANY_NUMERIC,
                    F.coalesce("company_most_frequent_main_category", F.lit(K.MISSING))
                    .alias("company_most_frequent_main_category")))


def company_features(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """M2: ``df`` plus company features computed from ``source`` (``df`` itself
    for training rows; the training part for validation rows, so nothing leaks).
    Companies without statistics get 0 / ``NONE``."""
    stats = company_stats(df if source is None else source)  # one row per company
    j = df.join(stats, "company_cvr", "left")
    filled = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COMPANY_NUMERIC]
    top = F.coalesce(F.col("company_most_frequent_main_category"), F.lit(K.MISSING))
    return j.select(*df.columns, *filled, top.alias("company_most_frequent_main_category"),
                    (F.col("product_main_category") == top).cast("int")
                    .alias("is_company_most_frequent_main_category"))


def rate_summary(tf: DataFrame) -> DataFrame:
    """A2 + A3: mean, sample std, min, max of selection_rate, and the overall
    rate Σ selections / Σ exposure (0 without exposure)."""
    r = F.col("selection_rate")
    agg = tf.agg(
        F.count(F.lit(1)).alias("n_rows"),
        exact_sum(r, 12).cast("double").alias("_s"),
        exact_sum(r * r, 12).cast("double").alias("_ss"),
        F.min(r).alias("rate_min"), F.max(r).alias("rate_max"),
        F.sum("selection_count").cast("long").alias("total_selections"),
        exact_sum(F.col("exposure"), 6).cast("double").alias("total_exposure"),
    )
    n = F.col("n_rows")
    # exact sums: the same numbers however the rows are partitioned
    var = F.when(n > 1, (F.col("_ss") - F.col("_s") * F.col("_s") / n) / (n - 1))
    return agg.select(
        "n_rows", (F.col("_s") / n).alias("rate_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("rate_std"),
        "rate_min", "rate_max", "total_selections", "total_exposure",
        F.when(F.col("total_exposure") > 0, F.col("total_selections") / F.col("total_exposure"))
        .otherwise(F.lit(0.0)).alias("overall_rate"))


def feature_matrix(featured: DataFrame) -> DataFrame:
    """M3: the model features present in ``featured`` (categoricals as strings,
    null -> ``NONE``; numerics parsed, bad -> 0), target ``label`` (bad -> 0)
    and ``exposure`` (bad -> 1)."""
    cols = [c for c in K.FEATURE_COLUMNS if c in featured.columns]
    x = [F.coalesce(F.col(c).cast("string"), F.lit(K.MISSING)).alias(c) if c in K.CATEGORICAL_FEATURES
         else lenient_double(F.col(c)).alias(c) for c in cols]
    return featured.select(*x, lenient_double(F.col("selection_rate"), 0.0).alias("label"),
                           lenient_double(F.col("exposure"), 1.0).alias("exposure"))


def log_exposure(df: DataFrame, eps: float = 1e-8) -> DataFrame:
    """ln(exposure + eps) offset column."""
    return df.withColumn("log_exposure", F.log(F.col("exposure") + F.lit(eps)))


def temporal_features(df: DataFrame, ts: str) -> DataFrame:
    """Year, month, quarter, ISO week, day of week of a timestamp column."""
    t = F.col(ts)
    return df.select("*", F.year(t).alias("year"), F.month(t).alias("month"),
                     F.quarter(t).alias("quarter"), F.weekofyear(t).alias("week"),
                     F.dayofweek(t).alias("day_of_week"))


def shop_features(tf: DataFrame) -> DataFrame:
    """Per (shop, gift) selection counts with rank and share of the product
    and of its brand in the shop, the shop's unique product combinations,
    diversity of categories / brands / utility / durability and its most
    frequent main category and brand. All from selected rows."""
    pos = tf.filter(F.col("selection_count") > 0)
    prod = (pos.groupBy("shop_id", "gift_id")
            .agg(F.sum("selection_count").cast("long").alias("product_selections"),
                 F.min("product_brand").alias("product_brand"),
                 F.min("product_main_category").alias("product_main_category")))
    brand = (pos.groupBy("shop_id", "product_brand")
             .agg(F.sum("selection_count").cast("long").alias("brand_selections")))
    shop = pos.groupBy("shop_id").agg(
        F.sum("selection_count").cast("long").alias("shop_selections"),
        F.countDistinct("gift_id").cast("long").alias("shop_unique_products"),
        F.countDistinct(*K.PRODUCT_COLUMNS).cast("long").alias("unique_product_combinations"),
        F.countDistinct("product_main_category").cast("long").alias("shop_main_category_diversity"),
        F.countDistinct("product_brand").cast("long").alias("shop_brand_diversity"),
        F.countDistinct("product_utility_type").cast("long").alias("shop_utility_type_diversity"),
        F.countDistinct("product_durability").cast("long").alias("shop_durability_diversity"),
    )
    cat_counts = (pos.groupBy("shop_id", "product_main_category")
                  .agg(F.sum("selection_count").alias("n")))
    top_cat = (top_by_count(cat_counts, "shop_id", "product_main_category", "n")
               .withColumnRenamed("product_main_category", "shop_most_frequent_main_category"))
    top_brand = (top_by_count(brand.withColumnRenamed("brand_selections", "n"), "shop_id", "product_brand", "n")
                 .withColumnRenamed("product_brand", "shop_most_frequent_brand"))
    shop = shop.join(top_cat, "shop_id").join(top_brand, "shop_id")
    j = prod.join(brand, ["shop_id", "product_brand"]).join(shop, "shop_id")
    return j.select(
        "shop_id", "gift_id", "product_brand", "product_selections", "brand_selections",
        (F.col("product_selections") / F.col("shop_selections")).alias("product_share_in_shop"),
        (F.col("brand_selections") / F.col("shop_selections")).alias("brand_share_in_shop"),
        "shop_unique_products", "unique_product_combinations", "shop_main_category_diversity",
        "shop_brand_diversity", "shop_utility_type_diversity", "shop_durability_diversity",
        "shop_most_frequent_main_category", "shop_most_frequent_brand",
    )


def shop_ranks(shop_feat: DataFrame) -> DataFrame:
    """Rank of each product and of its brand inside its shop (1 = most selected), over ranges of
    (shop, selections): no task holds a shop as a whole."""
    from giftlens.operators.ranges import prefix_sums, ranks_within
    keyed = shop_feat.withColumns({"_less": -F.col("product_selections"), "_brand_less": -F.col("brand_selections"), "_one": F.lit(1)})
    keyed = prefix_sums(keyed, ["shop_id"], ["_less", "gift_id"], ["_one"])  # (shop, gift) is unique: no ties
    keyed = ranks_within(keyed, ["shop_id"], ["_brand_less"], dense="brand_rank_in_shop")
    return keyed.select(*shop_feat.columns, (F.col("_one_before") + 1).cast("int").alias("product_rank_in_shop"), "brand_rank_in_shop")


FOLD_KINDS = {"shop_unique_products": "gift_id", "shop_main_category_diversity": "product_main_category",
              "shop_brand_diversity": "product_brand", "shop_utility_type_diversity": "product_utility_type"}


def fold_shop_features(tf: DataFrame, folds: DataFrame, n_folds: int = K.CV_FOLDS) -> DataFrame:
    """M5: per shop and fold the shop's statistics over the *other* folds (the fold's training part), from one
    pass over the frame: selections are the total minus the fold; a distinct value counts
    unless the fold alone holds it (a bit per fold and value says so). Every shop with a selected row has a
    row for each fold, at most 31 of them."""
    if not 0 < n_folds < 32:
        raise ValueError("folds are kept as bits: 1 to 31 of them")
    from giftlens.session import cut_lineage
    pos = tf.filter(F.col("selection_count") > 0).join(folds, "company_cvr")
    cell = cut_lineage(pos.groupBy("shop_id", "fold", *FOLD_KINDS.values()).agg(F.sum("selection_count").cast("long").alias("n")))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in FOLD_KINDS.items()]))
    bit = F.bit_or(F.expr("shiftleft(1, fold)"))
    held = cell.select("shop_id", "fold", kinds.alias("x")).where("x.value is not null").groupBy("shop_id", "x.kind", "x.value").agg(bit.alias("held"))
    counts = held.groupBy("shop_id").agg(*[F.count_if((F.col("kind") == kind) & (F.col("held") != F.lit(1 << k))).alias(f"{kind}_{k}")
                                           for kind in FOLD_KINDS for k in range(n_folds)])
    sums = cell.groupBy("shop_id").agg(*[F.coalesce(F.sum(F.when(F.col("fold") != k, F.col("n"))), F.lit(0)).alias(f"shop_selections_{k}")
                                         for k in range(n_folds)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), *[F.coalesce(f"{c}_{k}", F.lit(0)).cast("long").alias(c) for c in ("shop_selections", *FOLD_KINDS)])
                               for k in range(n_folds)]))
    return sums.join(counts, "shop_id", "left").select("shop_id", rows.alias("x")).select("shop_id", "x.*")


#: Rows of a range of the hashed order: one task's work.
RANGE_ROWS = 100_000
#: Sums are exact: labels are whole numbers and parts of 1e-12, added apart.
PARTS = 10 ** 12


def ordered_target_stats(df: DataFrame, cats: list[str], label: str, keys: list[str], seed: int = K.SPLIT_SEED,
                         prior: float = 0.5, range_rows: int = RANGE_ROWS, stored: bool = False) -> DataFrame:
    """M7 + G1: ``<cat>_ts`` = (sum of labels before + prior) / (rows before + 1), "before" being the rows of the
    same category that come earlier in a hashed order of ``keys`` (unique per row; rows that share keys get the largest
    of theirs). No row's statistic holds its own label, or a label that comes after it. Sums are exact to 12 digits; a
    null category is a category, a null label counts as a row of label 0.

    The hash is uniform, so its leading digits cut the order into ranges of about ``range_rows`` rows, whatever the
    categories are. Every category's sums over earlier ranges enter its range as one row. Rows are
    stored once in narrow columns (``stored``: they are already), shuffled and sorted once, for all columns together."""
    from giftlens.session import cut_lineage
    rows = df if stored else cut_lineage(df)
    ranges = max(1, -(-rows.count() // range_rows))
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit(K.MISSING)) for k in keys], F.lit(str(seed))))
    y = F.coalesce(F.col(label).cast("decimal(38,12)"), F.lit(0).cast("decimal(38,12)"))
    at = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")
    types = dict(df.dtypes)
    held = [c if types[c] == "string" else f"_cat{i}" for i, c in enumerate(cats)]  # the columns with the categories as texts
    own = rows.select("*", *[F.col(c).cast("string").alias(h) for c, h in zip(cats, held) if c != h], at.alias("_range"),
                      F.unhex(key).alias("_h"), y.cast("long").alias("_whole"), ((y % 1) * PARTS).cast("long").alias("_part"))  # % keeps all digits, - would not
    sums = "_range int, of int, value string, whole long, part long, n long"
    total = (own.select("_range", "_whole", "_part", *[F.col(h).alias(f"v{i}") for i, h in enumerate(held)])
             .mapInArrow(_counted(len(held), sums), sums).repartition("of", "value").groupBy("_range", "of", "value")
             .agg(F.sum("whole").alias("whole"), F.sum("part").alias("part"), F.sum("n").alias("n"))
             .select("_range", "of", "value", (F.col("whole") + F.expr(f"part div {PARTS}")).alias("whole"), (F.col("part") % PARTS).alias("part"), "n"))
    earlier = Window.partitionBy("of", "value").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select("_range", "of", "value", *[F.sum(c).over(earlier).alias(c) for c in ("whole", "part", "n")]).where("n is not null")
    # the one shuffle and sort: a range's rows in hashed order, those that share keys under one number
    ordered = own.withColumn("_same", F.dense_rank().over(Window.partitionBy("_range").orderBy("_h", *keys))).drop("_h")
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_ts", T.DoubleType()) for c in cats]])
    place = _placed(df.columns, held, [f"{c}_ts" for c in cats], prior)
    return ordered.groupBy("_range").cogroup(carried.groupBy("_range")).applyInArrow(place, schema)


def _counted(cats: int, schema: str):
    """Sums of each batch of rows per (range, column, category)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def sums(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at, whole, part = (table.column(i).to_numpy() for i in range(3))
        ranges = 1 + int(at.max())
        small = max(int(whole.max()), -int(whole.min())) * len(whole) < 1 << 53  # then sums of doubles are exact
        for i in range(cats):
            code = table.column(3 + i).combine_chunks().dictionary_encode(null_encoding="encode")
            key = code.indices.to_numpy().astype(np.int64) * ranges + at
            if small and len(code.dictionary) * ranges <= 4 * len(key):
                n = np.bincount(key)
                cell = np.flatnonzero(n)
                w, high, low = (np.bincount(key, x)[cell].astype(np.int64) for x in (whole, part >> 20, part & ((1 << 20) - 1)))
                n, w, p = n[cell], w, (high << 20) + low
            else:
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                cell, n = key[order][first], np.diff(first, append=len(key))
                w, p = (np.add.reduceat(x[order], first) for x in (whole, part))
            yield pa.RecordBatch.from_arrays([pa.array((cell % ranges).astype(np.int32)), pa.array(np.full(len(cell), i, np.int32)),
                                              code.dictionary.take(pa.array(cell // ranges)), pa.array(w), pa.array(p), pa.array(n)], names=names)

    def count(batches):
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= RANGE_ROWS:
                yield from sums(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if rows:
            yield from sums(pa.Table.from_batches(waiting))

    return count


def _placed(columns: list[str], held: list[str], names: list[str], prior: float):
    """A range's rows, in hashed order, with the statistics of their categories."""

    def before(code: np.ndarray, x: np.ndarray, entered: np.ndarray) -> np.ndarray:
        """Per row the sum of ``x`` over earlier rows of its code, and what the code entered the range with."""
        order = np.argsort(code, kind="stable")
        c, upto = code[order], x[order].cumsum() - x[order]
        first = np.flatnonzero(np.diff(c, prepend=-1))
        out = np.empty_like(upto)
        out[order] = upto - np.repeat(upto[first], np.diff(first, append=len(c))) + entered[c]
        return out

    def number(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The nearest doubles of sums."""
        out = (whole * PARTS + part) / PARTS
        many = np.flatnonzero(np.abs(whole) >= (1 << 53) // PARTS - 1)  # their digits do not fit a double: whole numbers divide exactly
        out[many] = [(int(w) * PARTS + int(p)) / PARTS for w, p in zip(whole[many], part[many])]
        return out

    def place(own: pa.Table, ahead: pa.Table) -> pa.Table:
        n = own.num_rows
        if not n:
            return pa.table([*own.select(columns).columns, *[pa.array([], pa.float64())] * len(names)], names=[*columns, *names])
        same = own.column("_same").to_numpy()
        if (np.diff(same) < 0).any():
            order = np.argsort(same, kind="stable")
            own, same = own.take(pa.array(order)), same[order]
        group = same - 1
        first = np.flatnonzero(np.diff(group, prepend=-1))
        whole, part, one = own.column("_whole").to_numpy(), own.column("_part").to_numpy(), np.ones(n, np.int64)
        of = ahead.column("of").to_numpy()
        out = own.select(columns)
        for i, (c, name) in enumerate(zip(held, names)):
            entered = ahead.filter(pa.array(of == i))
            both = pa.chunked_array([*own.column(c).chunks, *entered.column("value").cast(own.column(c).type).chunks], own.column(c).type).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = both.indices.to_numpy().astype(np.int64)
            sums = []
            for x, e in ((whole, "whole"), (part, "part"), (one, "n")):
                start = np.zeros(len(both.dictionary), np.int64)
                start[codes[n:]] = entered.column(e).to_numpy()
                sums.append(before(codes[:n], x, start))
            w, p, m = sums
            stat = (number(w + p // PARTS, p % PARTS) + prior) / (m + 1)
            out = out.append_column(name, pa.array(np.maximum.reduceat(stat, first)[group]))
        return out

    return place
