"""Queries: company features, rate summary, splits and folds, shop features."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.operators import features as FE
from giftlens.operators import split as SP
from giftlens.operators import training as TR
from giftlens.plans.oracle_fixtures import FIXTURES
from giftlens.plans.q_training import training
from giftlens.plans.registry import register
from giftlens.session import cut_lineage
from giftlens.sources import fixtures as FX

FIXTURES["fx_split"] = """
SELECT company_cvr,
       CASE WHEN row_number() OVER (ORDER BY md5(company_cvr || ':42'), company_cvr) - 1
                 < ceil(0.2 * count(*) OVER ()) THEN 'validation' ELSE 'train' END AS split
FROM (SELECT DISTINCT company_cvr FROM fx_training) c"""

FIXTURES["fx_train_part"] = """
SELECT t.* FROM fx_training t JOIN fx_split s ON t.company_cvr = s.company_cvr WHERE s.split = 'train'"""

_STATS = """
SELECT s.company_cvr,
       CAST(s.d1 AS BIGINT) AS company_main_category_diversity, CAST(s.d2 AS BIGINT) AS company_brand_diversity,
       CAST(s.d3 AS BIGINT) AS company_utility_type_diversity, CAST(s.tot AS BIGINT) AS company_total_selections,
       coalesce(t.product_main_category, 'NONE') AS company_most_frequent_main_category
FROM (SELECT company_cvr, COUNT(DISTINCT product_main_category) AS d1, COUNT(DISTINCT product_brand) AS d2,
             COUNT(DISTINCT product_utility_type) AS d3, SUM(selection_count) AS tot
      FROM {src} WHERE selection_count > 0 GROUP BY company_cvr) s
LEFT JOIN (SELECT company_cvr, product_main_category FROM (
             SELECT company_cvr, product_main_category,
                    row_number() OVER (PARTITION BY company_cvr ORDER BY SUM(selection_count) DESC,
                                       product_main_category) AS rn
             FROM {src} WHERE selection_count > 0 GROUP BY company_cvr, product_main_category) x
           WHERE rn = 1) t ON s.company_cvr = t.company_cvr"""

FIXTURES["fx_cstats_train"] = _STATS.format(src="fx_train_part")
FIXTURES["fx_cstats_all"] = _STATS.format(src="fx_training")

FIXTURES["fx_featured"] = """
SELECT t.*,
       CAST(coalesce(c.company_main_category_diversity, 0) AS BIGINT) AS company_main_category_diversity,
       CAST(coalesce(c.company_brand_diversity, 0) AS BIGINT) AS company_brand_diversity,
       CAST(coalesce(c.company_utility_type_diversity, 0) AS BIGINT) AS company_utility_type_diversity,
       CAST(coalesce(c.company_total_selections, 0) AS BIGINT) AS company_total_selections,
       coalesce(c.company_most_frequent_main_category, 'NONE') AS company_most_frequent_main_category,
       CAST(t.product_main_category = coalesce(c.company_most_frequent_main_category, 'NONE') AS INTEGER)
           AS is_company_most_frequent_main_category
FROM fx_training t LEFT JOIN fx_cstats_train c ON t.company_cvr = c.company_cvr"""


def featured(spark, sf):
    """Training frame with company features: training companies from their own
    rows, validation companies from the training part only."""
    companies, selected, zeros = TR.training_parts(FX.selections(spark, sf), FX.catalog(spark, sf), FX.employees(spark, sf))
    split = SP.company_split(companies)
    # statistics need selected rows only, and the training companies' own: one narrow pass over the
    # stored groups; the frame itself is built once, joined once and never stored
    return FE.company_features(selected.unionByName(zeros), source=SP.apply_split(selected, split, "train"))


def selected_rows(spark, sf):
    """The frame's rows with a selection: all that company statistics look at."""
    return TR.training_parts(FX.selections(spark, sf), FX.catalog(spark, sf), FX.employees(spark, sf), materialize=False)[1]


@register("company_stats", sql="SELECT * FROM fx_cstats_all")
def q_company_stats(spark, sf):
    return FE.company_stats(selected_rows(spark, sf))


@register("company_category_counts", sql="""
SELECT company_cvr, product_main_category, CAST(SUM(selection_count) AS BIGINT) AS selection_count
FROM fx_training WHERE selection_count > 0 GROUP BY company_cvr, product_main_category""")
def q_company_category_counts(spark, sf):
    return FE.company_category_counts(selected_rows(spark, sf))


@register("company_split", sql="SELECT * FROM fx_split")
def q_company_split(spark, sf):
    return SP.company_split(TR.training_parts(FX.selections(spark, sf), FX.catalog(spark, sf), FX.employees(spark, sf), products=[])[0])


@register("company_features", sql="SELECT * FROM fx_featured", rounded=["exposure", "selection_rate"])
def q_company_features(spark, sf):
    return featured(spark, sf)


@register("split_overlap", sql="""
SELECT CAST(SUM(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_companies,
       CAST(SUM(CASE WHEN split = 'validation' THEN 1 ELSE 0 END) AS BIGINT) AS validation_companies,
       CAST(0 AS BIGINT) AS overlap_companies
FROM fx_split""")
def q_split_overlap(spark, sf):
    tf = cut_lineage(training(spark, sf, []).select("company_cvr"))  # read three times below
    split = SP.company_split(tf)
    return SP.split_overlap(SP.apply_split(tf, split, "train"), SP.apply_split(tf, split, "validation"))


@register("cv_folds", sql="""
SELECT company_cvr,
       CAST(CASE WHEN floor(n / 3) = 0 THEN 2 ELSE least(floor(rk / floor(n / 3)), 2) END AS INTEGER) AS fold
FROM (SELECT company_cvr, row_number() OVER (ORDER BY md5(company_cvr || ':42'), company_cvr) - 1 AS rk,
             count(*) OVER () AS n
      FROM (SELECT DISTINCT company_cvr FROM fx_training) c) r""")
def q_cv_folds(spark, sf):
    return SP.cv_folds(training(spark, sf, []))


@register("shop_split", sql="""
SELECT CAST(rep AS INTEGER) AS "repeat", shop_id,
       CASE WHEN row_number() OVER (PARTITION BY rep ORDER BY md5(shop_id || ':' || CAST(42 + rep AS VARCHAR)), shop_id) - 1
                 < ceil(0.2 * count(*) OVER (PARTITION BY rep)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT DISTINCT shop_id FROM fx_training) s, range(5) r(rep)""")
def q_shop_split(spark, sf):
    return SP.shop_split(training(spark, sf, []))


@register("rate_summary", sql="""
SELECT n AS n_rows, s / n AS rate_mean,
       CASE WHEN n > 1 THEN sqrt(greatest((ss - s * s / n) / (n - 1), 0.0)) END AS rate_std,
       rate_min, rate_max, total_selections, total_exposure,
       CASE WHEN total_exposure > 0 THEN total_selections / total_exposure ELSE 0.0 END AS overall_rate
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS n,
             CAST(SUM(CAST(selection_rate AS DECIMAL(38,12))) AS DOUBLE) AS s,
             CAST(SUM(CAST(selection_rate * selection_rate AS DECIMAL(38,12))) AS DOUBLE) AS ss,
             MIN(selection_rate) AS rate_min, MAX(selection_rate) AS rate_max,
             CAST(SUM(selection_count) AS BIGINT) AS total_selections,
             CAST(SUM(CAST(exposure AS DECIMAL(38,6))) AS DOUBLE) AS total_exposure
      FROM fx_training) a""", rounded=["rate_mean", "rate_std", "rate_min", "rate_max", "total_exposure", "overall_rate"])
def q_rate_summary(spark, sf):
    return FE.rate_summary(training(spark, sf, []))


_FM_CAT = [c for c in K.FEATURE_COLUMNS if c in K.CATEGORICAL_FEATURES]
_FM_NUM = [c for c in K.FEATURE_COLUMNS if c not in K.CATEGORICAL_FEATURES]


@register("feature_matrix", sql="SELECT " + ", ".join(
    [f"coalesce(CAST({c} AS VARCHAR), 'NONE') AS {c}" for c in _FM_CAT]
    + [f"CAST({c} AS DOUBLE) AS {c}" for c in _FM_NUM]
    + ["CAST(selection_rate AS DOUBLE) AS label", "CAST(exposure AS DOUBLE) AS exposure"])
    + " FROM fx_featured", rounded=_FM_NUM + ["label", "exposure"])
def q_feature_matrix(spark, sf):
    return FE.feature_matrix(featured(spark, sf))


@register("log_exposure", sql="""
SELECT shop_id, company_cvr, gift_id, employee_gender, exposure, ln(exposure + 1e-8) AS log_exposure
FROM fx_training""", rounded=["exposure", "log_exposure"])
def q_log_exposure(spark, sf):
    return FE.log_exposure(training(spark, sf, []).select(*K.GROUP_KEYS, "exposure"))


@register("temporal_features", sql="""
SELECT id, date_time, CAST(year(date_time) AS INTEGER) AS year, CAST(month(date_time) AS INTEGER) AS month,
       CAST(quarter(date_time) AS INTEGER) AS quarter, CAST(weekofyear(date_time) AS INTEGER) AS week,
       CAST(dayofweek(date_time) + 1 AS INTEGER) AS day_of_week
FROM fx_log""")
def q_temporal_features(spark, sf):
    return FE.temporal_features(FX.api_log(spark, sf).select("id", "date_time"), "date_time")


FIXTURES["fx_shop_pos"] = "SELECT * FROM fx_training WHERE selection_count > 0"
FIXTURES["fx_shop_prod"] = """
SELECT shop_id, gift_id, CAST(SUM(selection_count) AS BIGINT) AS product_selections,
       MIN(product_brand) AS product_brand FROM fx_shop_pos GROUP BY shop_id, gift_id"""
FIXTURES["fx_shop_brand"] = """
SELECT shop_id, product_brand, CAST(SUM(selection_count) AS BIGINT) AS brand_selections
FROM fx_shop_pos GROUP BY shop_id, product_brand"""
FIXTURES["fx_shop_tot"] = """
SELECT shop_id, SUM(selection_count) AS shop_selections,
       CAST(COUNT(DISTINCT gift_id) AS BIGINT) AS shop_unique_products,
       CAST(COUNT(DISTINCT (product_main_category, product_sub_category, product_brand, product_color,
                            product_durability, product_target_gender, product_utility_type, product_type)) AS BIGINT)
           AS unique_product_combinations,
       CAST(COUNT(DISTINCT product_main_category) AS BIGINT) AS shop_main_category_diversity,
       CAST(COUNT(DISTINCT product_brand) AS BIGINT) AS shop_brand_diversity,
       CAST(COUNT(DISTINCT product_utility_type) AS BIGINT) AS shop_utility_type_diversity,
       CAST(COUNT(DISTINCT product_durability) AS BIGINT) AS shop_durability_diversity
FROM fx_shop_pos GROUP BY shop_id"""
FIXTURES["fx_shop_topcat"] = """
SELECT shop_id, product_main_category AS shop_most_frequent_main_category FROM (
  SELECT shop_id, product_main_category,
         row_number() OVER (PARTITION BY shop_id ORDER BY SUM(selection_count) DESC, product_main_category) AS rn
  FROM fx_shop_pos GROUP BY shop_id, product_main_category) x WHERE rn = 1"""
FIXTURES["fx_shop_topbrand"] = """
SELECT shop_id, product_brand AS shop_most_frequent_brand FROM (
  SELECT shop_id, product_brand,
         row_number() OVER (PARTITION BY shop_id ORDER BY brand_selections DESC, product_brand) AS rn
  FROM fx_shop_brand) x WHERE rn = 1"""


@register("shop_features", sql="""
SELECT p.shop_id, p.gift_id, p.product_brand, p.product_selections, b.brand_selections,
       p.product_selections / t.shop_selections AS product_share_in_shop,
       b.brand_selections / t.shop_selections AS brand_share_in_shop,
       t.shop_unique_products, t.unique_product_combinations, t.shop_main_category_diversity,
       t.shop_brand_diversity, t.shop_utility_type_diversity, t.shop_durability_diversity,
       c.shop_most_frequent_main_category, m.shop_most_frequent_brand,
       CAST(rank() OVER (PARTITION BY p.shop_id ORDER BY p.product_selections DESC, p.gift_id) AS INTEGER)
           AS product_rank_in_shop,
       CAST(dense_rank() OVER (PARTITION BY p.shop_id ORDER BY b.brand_selections DESC) AS INTEGER)
           AS brand_rank_in_shop
FROM fx_shop_prod p JOIN fx_shop_brand b ON p.shop_id = b.shop_id AND p.product_brand = b.product_brand
JOIN fx_shop_tot t ON p.shop_id = t.shop_id JOIN fx_shop_topcat c ON p.shop_id = c.shop_id
JOIN fx_shop_topbrand m ON p.shop_id = m.shop_id""", rounded=["product_share_in_shop", "brand_share_in_shop"])
def q_shop_features(spark, sf):
    return FE.shop_ranks(FE.shop_features(training(spark, sf)))


@register("training_report", sql="""
SELECT CAST(COUNT(*) AS BIGINT) AS training_records, CAST(COUNT(DISTINCT company_cvr) AS BIGINT) AS training_companies,
       CAST(COUNT(DISTINCT shop_id) AS BIGINT) AS shops, CAST(COUNT(DISTINCT gift_id) AS BIGINT) AS gifts
FROM fx_training""")
def q_training_report(spark, sf):
    tf = training(spark, sf, [])
    return tf.agg(F.count(F.lit(1)).alias("training_records"),
                  F.countDistinct("company_cvr").cast("long").alias("training_companies"),
                  F.countDistinct("shop_id").cast("long").alias("shops"),
                  F.countDistinct("gift_id").cast("long").alias("gifts"))


def _align_sql() -> str:
    have = set(K.GROUP_KEYS + K.PRODUCT_COLUMNS)
    cols = []
    for c in K.FEATURE_COLUMNS:
        if c in K.CATEGORICAL_FEATURES:
            cols.append(f"coalesce(CAST({c} AS VARCHAR), 'NONE') AS {c}" if c in have else f"'NONE' AS {c}")
        else:
            cols.append(f"CAST({c} AS DOUBLE) AS {c}" if c in have else f"CAST(0.0 AS DOUBLE) AS {c}")
    return "SELECT " + ", ".join(cols) + " FROM fx_training"


@register("align_schema", sql=_align_sql(), rounded=_FM_NUM)
def q_align_schema(spark, sf):
    from giftlens.functions.cleaning import align_schema
    return align_schema(training(spark, sf), K.FEATURE_COLUMNS)


@register("stratified_split", sql="""
SELECT company_cvr, branch_code,
       CASE WHEN row_number() OVER (PARTITION BY branch_code ORDER BY md5(company_cvr || ':42'), company_cvr) - 1
                 < ceil(0.2 * count(*) OVER (PARTITION BY branch_code)) THEN 'validation' ELSE 'train' END AS split
FROM (SELECT e.company_cvr, min(e.branch_code) AS branch_code
      FROM fx_emp_clean e WHERE e.company_cvr IN (SELECT company_cvr FROM fx_training) GROUP BY e.company_cvr) c""")
def q_stratified_split(spark, sf):
    from giftlens.functions.cleaning import clean_employees
    tf = training(spark, sf, []).select("company_cvr").distinct()
    emp = clean_employees(FX.employees(spark, sf)).select("company_cvr", "branch_code")
    return SP.stratified_split(emp.join(tf, "company_cvr", "left_semi"), "branch_code")


_TS_CATS = ["product_main_category", "product_brand", "employee_gender"]
_TS_KEYS = ["shop_id", "company_cvr", "gift_id", "employee_gender"]


def _ts_sql() -> str:
    cols = []
    for c in _TS_CATS:
        w = f"PARTITION BY {c} ORDER BY h, {', '.join(_TS_KEYS)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        cols.append(f"(coalesce(CAST(SUM(CAST(selection_rate AS DECIMAL(38,12))) OVER ({w}) AS DOUBLE), 0.0) + 0.5) "
                    f"/ (COUNT(*) OVER ({w}) + 1) AS {c}_ts")
    return f"""
SELECT {', '.join(_TS_KEYS)}, {', '.join(cols)}
FROM (SELECT *, md5(concat_ws('|', {', '.join(f"coalesce({k}, 'NONE')" for k in _TS_KEYS)}, '42')) AS h FROM fx_training) t"""


@register("ordered_target_stats", sql=_ts_sql(), rounded=[f"{c}_ts" for c in _TS_CATS])
def q_ordered_target_stats(spark, sf):
    tf = training(spark, sf, _TS_CATS).select(*dict.fromkeys([*_TS_KEYS, *_TS_CATS]), "selection_rate")
    return FE.ordered_target_stats(tf, _TS_CATS, "selection_rate", _TS_KEYS).select(*_TS_KEYS, *[f"{c}_ts" for c in _TS_CATS])
