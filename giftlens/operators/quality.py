"""Data-quality, leakage and model-quality reports (one row per check or group).

Sums behind metrics are exact decimals (``exact_sum``), so a report gives the
same numbers however the data is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.functions.numeric import exact_sum
from giftlens.operators.ranges import quantiles
from giftlens.session import cut_lineage

METRIC_SCALE = 12


def _esum(c: Column) -> Column:
    return exact_sum(c, METRIC_SCALE).cast("double")


def quality_report(tf: DataFrame) -> DataFrame:
    """Q2 + Q3 + A23: rows, zero-selection rows and their share (%), rates
    outside [0, 1], total selections."""
    rate = F.col("selection_rate")
    return tf.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col("selection_count") == 0).alias("zero_rows"),
                  (F.count_if(F.col("selection_count") == 0) * 100.0 / F.count(F.lit(1))).alias("zero_share_pct"),
                  F.count_if((rate < 0) | (rate > 1)).alias("rates_out_of_range"),
                  F.sum("selection_count").cast("long").alias("total_selections"))


def exposure_consistency(tf: DataFrame) -> DataFrame:
    """Q4: (company, gender) groups whose exposure is not constant."""
    return (tf.groupBy("company_cvr", "employee_gender")
            .agg(F.countDistinct("exposure").alias("n_exposures"))
            .filter(F.col("n_exposures") > 1))


def exposure_mismatch(tf: DataFrame, employees: DataFrame) -> DataFrame:
    """Q5 + J16: exposure in the training frame vs the source head counts per
    company (full outer join; absent sides count as 0)."""
    from giftlens.operators.training import first_employee_row
    t = tf.groupBy("company_cvr").agg(
        F.max(F.when(F.col("employee_gender") == "male", F.col("exposure"))).alias("train_male"),
        F.max(F.when(F.col("employee_gender") == "female", F.col("exposure"))).alias("train_female"))
    s = first_employee_row(employees).select("company_cvr", F.col("male_count").alias("source_male"),
                                             F.col("female_count").alias("source_female"))
    j = t.join(s, "company_cvr", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.select("company_cvr", "train_male", "source_male", "train_female", "source_female",
                    (F.abs(z("train_male") - z("source_male")) + F.abs(z("train_female") - z("source_female")))
                    .alias("abs_difference"))


def key_violations(presents: DataFrame, users: DataFrame, log: DataFrame) -> DataFrame:
    """Q9: unique keys (present_hash, username, api_key) and the log -> user
    foreign key; one row per check with the number of violating keys / rows."""
    def dups(df, key, name):
        return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                .agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations"))
    orphans = (log.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti")
               .agg(F.count(F.lit(1)).alias("violations"))
               .select(F.lit("log_user_fk").alias("check"), "violations"))
    return (dups(presents, "present_hash", "present_hash_unique")
            .unionByName(dups(users, "username", "username_unique"))
            .unionByName(dups(users, "api_key", "api_key_unique"))
            .unionByName(orphans))


def data_profile(df: DataFrame, cols: list[str], max_missing: float = 0.3, max_cardinality: int = 100,
                 min_records: int = 5) -> DataFrame:
    """Q10: per column rows, missing values and ratio, distinct values, the
    smallest category size, and the three configured checks. Columns are
    stacked into (column, value) so one aggregation profiles all of them;
    a hot value only grows its partial-aggregate count."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_kv"))
    per_value = long.groupBy("_kv.column_name", "_kv.value").agg(F.count(F.lit(1)).alias("n"))
    per_col = per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.min(F.when(F.col("value").isNotNull(), F.col("n"))).alias("min_category_count"))
    ratio = F.col("n_missing") / F.col("n_rows")
    return per_col.select("column_name", "n_rows", "n_missing", ratio.alias("missing_ratio"), "n_distinct",
                          "min_category_count", (ratio <= max_missing).alias("missing_ok"),
                          (F.col("n_distinct") <= max_cardinality).alias("cardinality_ok"),
                          (F.col("min_category_count") >= min_records).alias("min_records_ok"))


def outlier_report(df: DataFrame, col: str, iqr_factor: float = 1.5, z: float = 3.0) -> DataFrame:
    """Q10 (outliers): values outside the IQR fences and beyond |z| standard
    deviations. The quartiles are exact (``ranges.order_statistics``: a few passes of range
    counts run when the report is asked for). Null and NaN values are neither counted nor
    outliers; infinite ones lie outside the fences. Mean and deviation are exact sums over finite
    values, joined as one row. Without values: null quartiles and no outliers."""
    q1, q3 = quantiles(df, col, [0.25, 0.75])
    x = F.col("x")
    values = df.select(F.col(col).cast("double").alias("x")).where(x.isNotNull() & ~F.isnan(x))
    finite = F.when(F.abs(x) < F.lit(float("inf")), x)
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    sums = (values.agg(F.count(finite).alias("n"), _esum(finite).alias("s"), _esum(finite * finite).alias("ss"))
            .select((s / F.nullif(n, F.lit(0))).alias("mu"),
                    F.sqrt(F.greatest((ss - s * s / F.nullif(n, F.lit(0))) / F.nullif(n, F.lit(0)), F.lit(0.0))).alias("sd")))
    far = (F.col("sd") > 0) & (F.abs(x - F.col("mu")) > z * F.col("sd"))
    if q1 is None:
        fences = F.lit(False)
    else:
        fences = (x < q1 - iqr_factor * (q3 - q1)) | (x > q3 + iqr_factor * (q3 - q1))
    return (values.join(F.broadcast(sums))  # one row
            .agg(F.lit(col).alias("column_name"), F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3"),
                 F.count_if(fences).alias("iqr_outliers"), F.count_if(far).alias("zscore_outliers")))


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """A20 + G7 + D7: R², MAE, RMSE, MAPE = mean(|y-p| / (y + 1e-8)) * 100, and
    MAPE over non-zero targets. One aggregate, exact sums."""
    yc, pc = F.col(y).cast("double"), F.col(p).cast("double")
    err = yc - pc
    agg = df.agg(F.count(F.lit(1)).alias("n"), _esum(yc).alias("sy"), _esum(yc * yc).alias("syy"),
                 _esum(err * err).alias("sse"), _esum(F.abs(err)).alias("sae"),
                 _esum(F.abs(err) / (yc + 1e-8)).alias("sape"),
                 _esum(F.when(yc != 0, F.abs(err) / yc)).alias("sape_nz"),
                 F.count_if(yc != 0).alias("n_nz"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return agg.select(
        "n",
        F.when(sst > 0, 1 - F.col("sse") / sst).alias("r2"),
        (F.col("sae") / F.col("n")).alias("mae"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sape") / F.col("n") * 100).alias("mape"),
        F.when(F.col("n_nz") > 0, F.col("sape_nz") / F.col("n_nz") * 100).alias("mape_nonzero"))


def poisson_deviance(df: DataFrame, y: str = "y", mu: str = "mu", eps: float = 1e-8) -> DataFrame:
    """Poisson deviance 2·Σ(y·ln(y/μ) − (y − μ)) and its mean (μ floored at
    ``eps``; y·ln(y/μ) is 0 for y = 0)."""
    yc = F.col(y).cast("double")
    m = F.greatest(F.col(mu).cast("double"), F.lit(eps))
    term = F.when(yc > 0, yc * F.log(yc / m)).otherwise(F.lit(0.0)) - (yc - m)
    agg = df.agg(F.count(F.lit(1)).alias("n"), _esum(term).alias("s"))
    return agg.select("n", (F.col("s") * 2).alias("deviance"), (F.col("s") * 2 / F.col("n")).alias("mean_deviance"))


def impute(df: DataFrame, cols: list[str], strategy: str = "mean") -> DataFrame:
    """Fill missing numeric values with the column mean / median (MLlib
    ``Imputer``); strategy ``drop`` removes rows with missing values."""
    if strategy == "drop":
        return df.na.drop(subset=cols)
    if strategy == "mean":
        # exact mean per column (one aggregate, scalars only reach the driver)
        from giftlens.functions.numeric import exact_avg
        means = df.agg(*[exact_avg(F.col(c)).alias(c) for c in cols]).first().asDict()
        return df.fillna({c: v for c, v in means.items() if v is not None})
    from pyspark.ml.feature import Imputer
    casted = df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
    model = Imputer(inputCols=cols, outputCols=cols, strategy=strategy).fit(casted)
    return model.transform(casted)


def feature_signature(spark, features: list[str], categorical: list[str]) -> DataFrame:
    """Count and md5 of the sorted, '|'-joined names, for the feature list
    and the categorical list (schema-level: the names are the input)."""
    rows = [("features", f) for f in features] + [("categorical", c) for c in categorical]
    df = spark.createDataFrame(rows, "kind string, name string")
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"),
                                  F.md5(F.array_join(F.array_sort(F.collect_list("name")), "|")).alias("signature"))


def baseline_predict(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Reference predictor for fold metrics: mean training rate per (gift,
    gender), the global training mean for unseen pairs. Exact averages."""
    rate = F.col("selection_rate")
    m = train.groupBy("gift_id", "employee_gender").agg(
        (_esum(rate) / F.count(rate)).alias("_m"))
    g = train.agg((_esum(rate) / F.count(rate)).alias("_g"))
    return (rows.join(m, ["gift_id", "employee_gender"], "left").join(F.broadcast(g))  # one row
            .withColumn("prediction", F.coalesce("_m", "_g")).drop("_m", "_g"))


def cv_fold_metrics(tf: DataFrame, folds: DataFrame) -> DataFrame:
    """M5 metrics: per fold the R² of ``baseline_predict`` fitted on the other folds and
    scored on the fold; empty folds have no row.

    One pass over the frame: counts, sums and sums of squares per (gift, gender, fold). What a fold's
    training part holds is the total minus the fold, and the errors of a constant prediction
    follow from the same three numbers."""
    y = F.col("selection_rate").cast("double")
    # as decimals, so that totals minus folds stay exact
    cell = cut_lineage(tf.join(folds, "company_cvr").groupBy("gift_id", "employee_gender", "fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count(y).alias("n"), exact_sum(y, METRIC_SCALE).alias("s"), exact_sum(y * y, METRIC_SCALE).alias("ss")))
    sums = [F.sum(c).alias(f"all_{c}") for c in ("n", "s")]
    whole = cell.groupBy("gift_id", "employee_gender").agg(*sums)
    per_fold = cell.groupBy("fold").agg(F.sum("n").alias("f_n"), F.sum("s").alias("f_s"))
    every = cell.agg(F.sum("n").alias("t_n"), F.sum("s").alias("t_s"))
    rest_n, rest_s = F.col("all_n") - F.col("n"), F.col("all_s") - F.coalesce("s", F.lit(0))
    others = per_fold.join(F.broadcast(every)).select(  # one row
        "fold", ((F.col("t_s") - F.coalesce("f_s", F.lit(0))).cast("double") / F.nullif(F.col("t_n") - F.col("f_n"), F.lit(0))).alias("g"))
    p = F.coalesce(rest_s.cast("double") / F.nullif(rest_n, F.lit(0)), "g")
    s, ss, n = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "ss", "n"))
    same = (F.col("gift_id").eqNullSafe(F.col("_gift"))) & (F.col("employee_gender").eqNullSafe(F.col("_gender")))
    whole = whole.select(F.col("gift_id").alias("_gift"), F.col("employee_gender").alias("_gender"), "all_n", "all_s")
    scored = (cell.join(whole, same).join(F.broadcast(others), "fold")  # one row per fold
              .select("fold", "rows", "n", "s", "ss", p.alias("p"))
              .select("fold", "rows", "n", "s", "ss", _cell_error(s, ss, n).alias("e")))
    per = scored.groupBy("fold").agg(F.sum("rows").alias("n"), F.sum("n").alias("_m"), F.sum("s").cast("double").alias("_s"),
                                     F.sum("ss").cast("double").alias("_ss"), _esum(F.col("e")).alias("_e"))
    spread = F.col("_ss") - F.col("_s") * F.col("_s") / F.nullif(F.col("_m"), F.lit(0))
    return per.select(F.col("fold").cast("int").alias("fold"), "n", F.when(spread > 0, 1 - F.col("_e") / spread).alias("r2"))


def _cell_error(s: Column, ss: Column, n: Column) -> Column:
    """Sum of (y - p)^2 over rows with count n, sum s and sum of squares ss."""
    return ss - 2 * F.col("p") * s + n * F.col("p") * F.col("p")


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and population std of the fold R², number of folds."""
    return fold_metrics.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
                            F.count(F.lit(1)).alias("cv_folds"))
