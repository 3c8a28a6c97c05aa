"""Queries: data-quality and leakage checks, model-quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.operators import quality as Q
from giftlens.operators import split as SP
from giftlens.plans.oracle_fixtures import FIXTURES
from giftlens.plans.q_products import all_replies
from giftlens.plans.q_scoring import scored
from giftlens.plans.q_training import training
from giftlens.plans.registry import register
from giftlens.session import cut_lineage
from giftlens.sources import fixtures as FX


def es(x: str) -> str:
    """Exact sum as SQL text (twin of ``exact_sum`` at the metric scale)."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(38,{Q.METRIC_SCALE}))) AS DOUBLE)"


def _metrics_sql(src: str, y: str = "y", p: str = "p") -> str:
    return f"""
SELECT n, CASE WHEN syy - sy * sy / n > 0 THEN 1 - sse / (syy - sy * sy / n) END AS r2,
       sae / n AS mae, sqrt(sse / n) AS rmse, sape / n * 100 AS mape,
       CASE WHEN n_nz > 0 THEN sape_nz / n_nz * 100 END AS mape_nonzero
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS n, {es(y)} AS sy, {es(f'{y} * {y}')} AS syy,
             {es(f'({y} - {p}) * ({y} - {p})')} AS sse, {es(f'abs({y} - {p})')} AS sae,
             {es(f'abs({y} - {p}) / ({y} + 1e-8)')} AS sape,
             {es(f'CASE WHEN {y} <> 0 THEN abs({y} - {p}) / {y} END')} AS sape_nz,
             CAST(COUNT(*) FILTER (WHERE {y} <> 0) AS BIGINT) AS n_nz
      FROM {src}) m"""


_MET = ["r2", "mae", "rmse", "mape", "mape_nonzero"]


@register("quality_report", sql="""
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(*) FILTER (WHERE selection_count = 0) AS BIGINT) AS zero_rows,
       COUNT(*) FILTER (WHERE selection_count = 0) * 100.0 / COUNT(*) AS zero_share_pct,
       CAST(COUNT(*) FILTER (WHERE selection_rate < 0 OR selection_rate > 1) AS BIGINT) AS rates_out_of_range,
       CAST(SUM(selection_count) AS BIGINT) AS total_selections
FROM fx_training""", rounded=["zero_share_pct"])
def q_quality_report(spark, sf):
    return Q.quality_report(training(spark, sf, []))


@register("exposure_consistency", sql="""
SELECT company_cvr, employee_gender, CAST(COUNT(DISTINCT exposure) AS BIGINT) AS n_exposures
FROM fx_training_twice GROUP BY company_cvr, employee_gender HAVING COUNT(DISTINCT exposure) > 1""")
def q_exposure_consistency(spark, sf):
    from giftlens.operators import training as TR
    twice = FX.employees_twice(spark, sf)  # companies with two rows: every row's exposure is in the universe
    return Q.exposure_consistency(TR.training_frame(FX.selections(spark, sf), FX.catalog(spark, sf), twice, employees_order="line", products=[]))


@register("exposure_mismatch", sql="""
SELECT coalesce(t.company_cvr, s.company_cvr) AS company_cvr, t.train_male, s.male_count AS source_male,
       t.train_female, s.female_count AS source_female,
       abs(coalesce(t.train_male, 0.0) - coalesce(s.male_count, 0.0))
         + abs(coalesce(t.train_female, 0.0) - coalesce(s.female_count, 0.0)) AS abs_difference
FROM (SELECT company_cvr, MAX(CASE WHEN employee_gender = 'male' THEN exposure END) AS train_male,
             MAX(CASE WHEN employee_gender = 'female' THEN exposure END) AS train_female
      FROM fx_training GROUP BY company_cvr) t
FULL JOIN fx_emp_clean s ON t.company_cvr = s.company_cvr""",
          rounded=["train_male", "source_male", "train_female", "source_female", "abs_difference"])
def q_exposure_mismatch(spark, sf):
    from giftlens.functions.cleaning import clean_employees
    return Q.exposure_mismatch(training(spark, sf, []), clean_employees(FX.employees(spark, sf)))


@register("key_violations", sql="""
SELECT 'present_hash_unique' AS "check", CAST(COUNT(*) AS BIGINT) AS violations
FROM (SELECT present_hash FROM fx_presents GROUP BY present_hash HAVING COUNT(*) > 1) a
UNION ALL SELECT 'username_unique', CAST(COUNT(*) AS BIGINT)
FROM (SELECT username FROM fx_users GROUP BY username HAVING COUNT(*) > 1) b
UNION ALL SELECT 'api_key_unique', CAST(COUNT(*) AS BIGINT)
FROM (SELECT api_key FROM fx_users GROUP BY api_key HAVING COUNT(*) > 1) c
UNION ALL SELECT 'log_user_fk', CAST(COUNT(*) AS BIGINT)
FROM fx_log l WHERE NOT EXISTS (SELECT 1 FROM fx_users u WHERE u.id = l.user_id)""")
def q_key_violations(spark, sf):
    return Q.key_violations(FX.presents(spark, sf), FX.users(spark, sf), FX.api_log(spark, sf))


@register("data_profile", sql=f"""
SELECT column_name, CAST(SUM(n) AS BIGINT) AS n_rows,
       CAST(coalesce(SUM(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS n_missing,
       coalesce(SUM(n) FILTER (WHERE value IS NULL), 0) / SUM(n) AS missing_ratio,
       CAST(COUNT(value) AS BIGINT) AS n_distinct,
       CAST(MIN(n) FILTER (WHERE value IS NOT NULL) AS BIGINT) AS min_category_count,
       coalesce(SUM(n) FILTER (WHERE value IS NULL), 0) / SUM(n) <= 0.3 AS missing_ok,
       COUNT(value) <= 100 AS cardinality_ok,
       MIN(n) FILTER (WHERE value IS NOT NULL) >= 5 AS min_records_ok
FROM (SELECT column_name, value, COUNT(*) AS n FROM (
        {" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM fx_selections"
                            for c in K.SELECTION_COLUMNS)}) s GROUP BY column_name, value) v
GROUP BY column_name""", rounded=["missing_ratio"])
def q_data_profile(spark, sf):
    return Q.data_profile(FX.selections(spark, sf), K.SELECTION_COLUMNS)


@register("outlier_report", sql="""
SELECT 'response_time_ms' AS column_name, q1, q3,
       CAST(COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS iqr_outliers,
       CAST(COUNT(*) FILTER (WHERE sd > 0 AND abs(x - mu) > 3.0 * sd) AS BIGINT) AS zscore_outliers
FROM (SELECT CAST(response_time_ms AS DOUBLE) AS x FROM fx_log WHERE response_time_ms IS NOT NULL) v,
     (SELECT quantile_cont(CAST(response_time_ms AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(response_time_ms AS DOUBLE), 0.75) AS q3,
             s / n AS mu, sqrt(greatest((ss - s * s / n) / n, 0.0)) AS sd
      FROM fx_log, (SELECT COUNT(response_time_ms) AS n,
                           CAST(SUM(CAST(response_time_ms AS DECIMAL(38,12))) AS DOUBLE) AS s,
                           CAST(SUM(CAST(CAST(response_time_ms AS DOUBLE) * response_time_ms AS DECIMAL(38,12))) AS DOUBLE) AS ss FROM fx_log) m
      GROUP BY s, n, ss) q
GROUP BY q1, q3""", rounded=["q1", "q3"])
def q_outlier_report(spark, sf):
    return Q.outlier_report(FX.api_log(spark, sf), "response_time_ms")


FIXTURES["fx_pred_vs_actual"] = """
SELECT s.cvr, s.product_id, CAST(coalesce(a.order_count, 0) AS DOUBLE) AS y, s.expected_qty AS p
FROM fx_scored s LEFT JOIN fx_actuals a ON s.cvr = a.cvr AND s.product_id = a.product_id"""


def pred_vs_actual(spark, sf):
    j = scored(spark, sf).select("cvr", "product_id", "expected_qty").join(FX.actuals(spark, sf),
                                                                         ["cvr", "product_id"], "left")
    return j.select("cvr", "product_id", F.coalesce(F.col("order_count"), F.lit(0)).cast("double").alias("y"),
                    F.col("expected_qty").alias("p"))


@register("regression_metrics", sql=_metrics_sql("fx_pred_vs_actual"), rounded=_MET)
def q_regression_metrics(spark, sf):
    return Q.regression_metrics(pred_vs_actual(spark, sf))


@register("poisson_deviance", sql=f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n, {es('t')} * 2 AS deviance, {es('t')} * 2 / COUNT(*) AS mean_deviance
FROM (SELECT CASE WHEN y > 0 THEN y * ln(y / greatest(p, 1e-8)) ELSE 0.0 END - (y - greatest(p, 1e-8)) AS t
      FROM fx_pred_vs_actual) d""", rounded=["deviance", "mean_deviance"])
def q_poisson_deviance(spark, sf):
    return Q.poisson_deviance(pred_vs_actual(spark, sf), "y", "p")


@register("impute", sql="""
SELECT present_hash, coalesce(value_price,
       (SELECT CAST(SUM(CAST(value_price AS DECIMAL(38,6))) AS DOUBLE) / COUNT(value_price) FROM fx_parsed)) AS value_price
FROM fx_parsed""", rounded=["value_price"])
def q_impute(spark, sf):
    from giftlens.operators.products import parse_attributes
    df = parse_attributes(all_replies(spark, sf), "reply").select("present_hash", "value_price")
    return Q.impute(df, ["value_price"], "mean")


FIXTURES["fx_folds"] = """
SELECT company_cvr,
       CAST(CASE WHEN floor(n / 3) = 0 THEN 2 ELSE least(floor(rk / floor(n / 3)), 2) END AS INTEGER) AS fold
FROM (SELECT company_cvr, row_number() OVER (ORDER BY md5(company_cvr || ':42'), company_cvr) - 1 AS rk,
             count(*) OVER () AS n
      FROM (SELECT DISTINCT company_cvr FROM fx_training) c) r"""
FIXTURES["fx_tf_folds"] = "SELECT t.*, f.fold FROM fx_training t JOIN fx_folds f ON t.company_cvr = f.company_cvr"


def _fold_sql(k: int) -> str:
    mean = f"{es('selection_rate')} / COUNT(selection_rate)"
    src = f"""(SELECT v.selection_rate AS y,
                 coalesce(m.m, (SELECT {mean} FROM fx_tf_folds WHERE fold <> {k})) AS p
          FROM fx_tf_folds v LEFT JOIN (SELECT gift_id, employee_gender, {mean} AS m FROM fx_tf_folds
                                        WHERE fold <> {k} GROUP BY gift_id, employee_gender) m
               ON v.gift_id = m.gift_id AND v.employee_gender = m.employee_gender
          WHERE v.fold = {k}) s{k}"""
    return f"SELECT {k} AS fold, n, r2 FROM ({_metrics_sql(src)}) x WHERE n > 0"


FIXTURES["fx_fold_metrics"] = " UNION ALL ".join(_fold_sql(k) for k in range(K.CV_FOLDS))


def fold_metrics(spark, sf):
    tf = cut_lineage(training(spark, sf, []).select("company_cvr", "gift_id", "employee_gender", "selection_rate"))  # for the folds and their metrics
    return Q.cv_fold_metrics(tf, SP.cv_folds(tf))


@register("cv_fold_metrics", sql="SELECT CAST(fold AS INTEGER) AS fold, n, r2 FROM fx_fold_metrics", rounded=["r2"])
def q_cv_fold_metrics(spark, sf):
    return fold_metrics(spark, sf)


@register("cv_summary", sql="""
SELECT AVG(r2) AS cv_r2_mean, STDDEV_POP(r2) AS cv_r2_std, CAST(COUNT(*) AS BIGINT) AS cv_folds
FROM fx_fold_metrics""", rounded=["cv_r2_mean", "cv_r2_std"])
def q_cv_summary(spark, sf):
    return Q.cv_summary(fold_metrics(spark, sf))


def _fold_shop_sql() -> str:
    parts = [f"""
SELECT s.shop_id, {k} AS fold, CAST(coalesce(SUM(t.selection_count), 0) AS BIGINT) AS shop_selections,
       COUNT(DISTINCT t.gift_id) AS shop_unique_products, COUNT(DISTINCT t.product_main_category) AS shop_main_category_diversity,
       COUNT(DISTINCT t.product_brand) AS shop_brand_diversity, COUNT(DISTINCT t.product_utility_type) AS shop_utility_type_diversity
FROM (SELECT DISTINCT shop_id FROM fx_tf_folds WHERE selection_count > 0) s
LEFT JOIN fx_tf_folds t ON t.shop_id = s.shop_id AND t.selection_count > 0 AND t.fold <> {k} GROUP BY s.shop_id"""
             for k in range(K.CV_FOLDS)]
    return " UNION ALL ".join(parts)


@register("fold_shop_features", sql=_fold_shop_sql())
def q_fold_shop_features(spark, sf):
    from giftlens.operators import features as FE
    tf = cut_lineage(training(spark, sf, list(FE.FOLD_KINDS.values())).select("company_cvr", "shop_id", "selection_count", *FE.FOLD_KINDS.values()))  # for the folds and their features
    return FE.fold_shop_features(tf, SP.cv_folds(tf))
