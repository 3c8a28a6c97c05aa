"""Prediction requests: validation, gift description rules, rule-based scoring,
roll-ups and business checks.

Requests arrive exploded: one row per (request_id, cvr, male_count,
female_count, product_id, description). Scoring is a pure projection — both
genders are computed as columns of the same row, so no shuffle is needed; the
roll-ups group by request or company only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.functions.cleaning import WHITESPACE
from giftlens.functions.numeric import exact_avg, exact_sum, round_half_even
from giftlens.functions.text import md5_mod


# ---------------------------------------------------------------- validation

def validate_requests(req: DataFrame) -> DataFrame:
    """P16 + M11: per request the failed rules (comma-separated, empty when
    valid): cvr of exactly 8 digits after stripping, counts given and 0..10000, total
    1..10000, 1..100 presents, non-empty gift ids and descriptions."""
    per = req.groupBy("request_id").agg(
        F.min("cvr").alias("cvr"), F.min("male_count").alias("male_count"),
        F.min("female_count").alias("female_count"),
        F.count("product_id").alias("n_presents"),
        F.count_if(F.col("product_id").isNull() | (F.col("product_id") == "")
                   | F.col("description").isNull() | (F.col("description") == "")).alias("_bad_items"))
    cvr = F.btrim(F.col("cvr"), F.lit(WHITESPACE))
    m, f = F.col("male_count"), F.col("female_count")
    rules = [
        ((m.isNull() | f.isNull()), "count_missing"),
        (cvr.isNull() | (cvr == ""), "cvr_empty"),
        (~F.coalesce(cvr.rlike(f"\\A[0-9]{{{K.CVR_DIGITS}}}\\z"), F.lit(False)), "cvr_format"),
        ((m < 0) | (f < 0), "count_negative"),
        ((m > K.MAX_EMPLOYEES) | (f > K.MAX_EMPLOYEES), "count_too_high"),
        ((m + f) == 0, "total_zero"),
        ((m + f) > K.MAX_EMPLOYEES, "total_too_high"),
        (F.col("n_presents") < 1, "no_presents"),
        (F.col("n_presents") > K.MAX_PRESENTS, "too_many_presents"),
        (F.col("_bad_items") > 0, "bad_present"),
    ]
    errs = F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]), lambda x: x.isNotNull())
    return per.select("request_id", cvr.alias("cvr"), "male_count", "female_count", "n_presents",
                      F.array_join(errs, ",").alias("errors"), (F.size(errs) == 0).alias("is_valid"))


# ---------------------------------------------------------------- description rules

def classify_description(desc: Column, rules=K.DESCRIPTION_RULES) -> Column:
    """First rule whose keyword occurs in the lower-cased description
    (substring match); the last rule is the default. Returns a struct of the
    eight product columns."""
    d = F.lower(F.coalesce(desc, F.lit("")))

    def as_struct(attrs):
        return F.struct(*[F.lit(attrs[c]).alias(c) for c in K.PRODUCT_COLUMNS])

    *matchers, (_, default) = rules
    out = as_struct(default)
    for words, attrs in reversed(matchers):
        cond = None
        for w in words:
            c = d.contains(w)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, as_struct(attrs)).otherwise(out)
    return out


# ---------------------------------------------------------------- rule-based rate

def _rule_parts(category: Column, target: Column, gender: Column | str) -> tuple[Column, Column, Column]:
    g = F.lit(gender) if isinstance(gender, str) else gender
    base = F.lit(K.RULE_BASE_RATE)
    for cat, r in reversed(list(K.RULE_CATEGORY_RATES.items())):
        base = F.when(category == cat, F.lit(r)).otherwise(base)
    factor = (F.when(target == g, F.lit(K.RULE_SAME_GENDER_FACTOR))
              .when(target == "unisex", F.lit(K.RULE_UNISEX_FACTOR))
              .otherwise(F.lit(K.RULE_OTHER_GENDER_FACTOR)))
    return base, factor, md5_mod(F.concat(category, g, target), 100)


def _raw_rate(base: Column, factor: Column, h: Column) -> Column:
    noise = (h / 100.0 - 0.5) * K.RULE_NOISE_SPAN
    return F.greatest(F.lit(K.RULE_RATE_MIN), F.least(F.lit(K.RULE_RATE_MAX), base * factor + noise))


def rule_rate(category: Column, target: Column, gender: Column | str) -> Column:
    """X5 + X6: base rate by category x gender factor + deterministic md5 noise,
    clamped to [0.1, 1], rounded to 3 digits (single expression; see
    :func:`with_rule_rate` for the staged form used on large frames)."""
    return round_half_even(_raw_rate(*_rule_parts(category, target, gender)), 3)


def with_rule_rate(df: DataFrame, name: str, category: str, target: str, gender: str) -> DataFrame:
    """Add ``name`` = rule rate, computed in stages (hash, raw rate, rounding)
    so each expensive sub-expression is evaluated once per row: the rounding
    refers to its input several times inside conditionals, where common
    sub-expression elimination does not reach."""
    base, factor, h = _rule_parts(F.col(category), F.col(target), gender)
    df = df.withColumn(f"_{name}_h", h)
    df = df.withColumn(f"_{name}_raw", _raw_rate(base, factor, F.col(f"_{name}_h")))
    return df.withColumn(name, round_half_even(F.col(f"_{name}_raw"), 3)).drop(f"_{name}_h", f"_{name}_raw")


def confidence_raw(rates: list[Column]) -> Column:
    """A17 before rounding: min(0.95, 0.5 + 2 * mean of positive rates), 0.5 if none."""
    n = sum((F.when(r > 0, 1).otherwise(0) for r in rates), F.lit(0))
    s = sum((F.when(r > 0, r).otherwise(0.0) for r in rates), F.lit(0.0))
    avg = F.when(n > 0, s / n)
    conf = F.least(F.lit(K.CONFIDENCE_CAP), F.lit(K.CONFIDENCE_BASE) + avg * K.CONFIDENCE_SLOPE)
    return F.coalesce(conf, F.lit(K.CONFIDENCE_BASE))


def confidence(rates: list[Column]) -> Column:
    """A17, rounded to 2 digits."""
    return round_half_even(confidence_raw(rates), 2)


def score_fallback(req: DataFrame) -> DataFrame:
    """M9 (+ P17, X5, X6, A16, A17, P19): expected quantity per requested gift
    without a model, with the breakdown by gender as a map. A gender with no employees
    gets rate 0 and exposure 0. A gift that cannot be scored (no gift id, or a count is
    missing) keeps its row with quantity 0, confidence 0 and the reason in ``error``.

    Requests are dealt by their id first: the costly projections then run in as many tasks as the
    session's shuffle partitions, however few files or joined partitions the requests come from, and
    the roll-ups per request find their rows together."""
    req = req.repartition(int(req.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_id")
    error = (F.when(F.coalesce(F.col("product_id"), F.lit("")) == "", F.lit("missing gift id"))
             .when(F.col("male_count").isNull() | F.col("female_count").isNull(), F.lit("missing employee count")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    df = req.select("request_id", "cvr", "product_id", zero("male_count"), zero("female_count"), error.alias("error"),
                    classify_description(F.col("description")).alias("_a"))
    df = df.select("*", F.col("_a.product_main_category").alias("product_main_category"),
                   F.col("_a.product_target_gender").alias("product_target_gender")).drop("_a")
    df = with_rule_rate(df, "_m_rule", "product_main_category", "product_target_gender", "male")
    df = with_rule_rate(df, "_f_rule", "product_main_category", "product_target_gender", "female")
    df = df.select("*", F.when(F.col("male_count") == 0, F.lit(0.0)).otherwise(F.col("_m_rule")).alias("male_rate"),
                   F.when(F.col("female_count") == 0, F.lit(0.0)).otherwise(F.col("_f_rule")).alias("female_rate"))
    df = df.select("*", (F.col("male_rate") * F.col("male_count")).alias("male_expected"),
                   (F.col("female_rate") * F.col("female_count")).alias("female_expected"))
    df = df.withColumn("_qty", F.col("male_expected") + F.col("female_expected"))
    df = df.withColumn("_conf", confidence_raw([F.col("male_rate"), F.col("female_rate")]))
    ok = F.col("error").isNull()
    return df.select(
        "request_id", "cvr", "product_id", "product_main_category", "product_target_gender",
        "male_rate", "male_expected", "female_rate", "female_expected",
        F.when(ok, round_half_even(F.col("_qty"), 2)).otherwise(0.0).alias("expected_qty"),
        F.when(ok, round_half_even(F.col("_conf"), 2)).otherwise(0.0).alias("confidence_score"),
        (F.col("male_count") + F.col("female_count")).alias("total_exposure"),
        gender_breakdown(df).alias("gender_breakdown"), "error")


def bounded_counts(qty: Column, low: float = 0.0, high: float = float(K.MAX_EMPLOYEES)) -> Column:
    """Predicted quantities as whole numbers (half to even) within [``low``, ``high``]."""
    return round_half_even(F.greatest(F.lit(low), F.least(F.lit(high), qty)), 0).cast("long")


def gender_breakdown(scored: DataFrame) -> Column:
    """Response shape: map gender -> {predicted_rate, expected_count, exposure}."""
    def entry(g):
        return F.struct(F.col(f"{g}_rate").alias("predicted_rate"), F.col(f"{g}_expected").alias("expected_count"),
                        F.col(f"{g}_count").alias("exposure"))
    return F.create_map(F.lit("male"), entry("male"), F.lit("female"), entry("female"))


# ---------------------------------------------------------------- roll-ups

def request_summary(req: DataFrame) -> DataFrame:
    """Per request cvr, total / male / female employees, number of gifts."""
    return (req.groupBy("request_id")
            .agg(F.min("cvr").alias("cvr"), F.min("male_count").alias("male_count"),
                 F.min("female_count").alias("female_count"), F.count(F.lit(1)).alias("num_gifts"))
            .withColumn("total_employees", F.col("male_count") + F.col("female_count")))


def shop_map_from_selections(selections: DataFrame) -> DataFrame:
    """Company -> its most selected shop (ties: smallest shop id)."""
    from giftlens.operators.features import top_by_count
    counts = selections.groupBy("company_cvr", "shop_id").agg(F.count(F.lit(1)).alias("n"))
    return top_by_count(counts, "company_cvr", "shop_id", "n").withColumnRenamed("company_cvr", "cvr")


def map_company_shop(companies: DataFrame, mapping: DataFrame | None = None,
                     default: str = K.UNKNOWN_SHOP) -> DataFrame:
    """Cvr -> shop_id via a mapping table (fixed map when none is given),
    unknown companies -> ``shop_unknown``."""
    if mapping is None:
        mapping = companies.sparkSession.createDataFrame(sorted(K.COMPANY_SHOP_MAP.items()), "cvr string, shop_id string")
    j = companies.join(mapping, "cvr", "left")
    return j.withColumn("shop_id", F.coalesce(F.col("shop_id"), F.lit(default)))


def enrich_industry(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """Cvr -> industry code from a registry table; empty codes -> null."""
    reg = registry.select("cvr", F.nullif(F.col("industry_code"), F.lit("")).cast("string").alias("industry_code"))
    return companies.join(reg, "cvr", "left")


def business_validation(scored: DataFrame, low: float = 0.3, high: float = 1.2,
                        key: str = "cvr") -> DataFrame:
    """Per company predicted selections vs employees; verdict in [low, high]."""
    per = scored.groupBy(key).agg(exact_sum(F.col("expected_qty")).cast("double").alias("total_predicted_selections"),
                                  F.max("total_exposure").alias("total_employees"))
    rate = F.when(F.col("total_employees") > 0, F.col("total_predicted_selections") / F.col("total_employees"))
    verdict = (F.when(rate.isNull(), F.lit("no_employees")).when(rate < low, F.lit("low"))
               .when(rate > high, F.lit("high")).otherwise(F.lit("ok")))
    return per.select(key, "total_predicted_selections", "total_employees",
                      rate.alias("overall_selection_rate"), verdict.alias("rate_validation"))


def prediction_summary(scored: DataFrame, zero_warn_pct: float = 80.0) -> DataFrame:
    """Per request count, total, avg per gift / employee, min, max,
    distinct values, zero share (%) and a warning when it exceeds 80 %."""
    q = F.col("expected_qty")
    per = scored.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_predictions"), exact_sum(q).cast("double").alias("total_qty"),
        F.max("total_exposure").alias("total_employees"), F.min(q).alias("min_qty"), F.max(q).alias("max_qty"),
        F.countDistinct(q).alias("distinct_values"), F.count_if(q == 0).alias("zero_count"))
    zero_pct = F.col("zero_count") * 100.0 / F.col("n_predictions")
    return per.select("request_id", "n_predictions", "total_qty",
                      (F.col("total_qty") / F.col("n_predictions")).alias("avg_per_gift"),
                      F.when(F.col("total_employees") > 0, F.col("total_qty") / F.col("total_employees"))
                      .alias("avg_per_employee"),
                      "min_qty", "max_qty", "distinct_values", zero_pct.alias("zero_share_pct"),
                      (zero_pct > zero_warn_pct).alias("zero_warning"))


def top_predictions(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest predictions of each request (ties by product id).
    The window is per request, whose size validation caps at 100 gifts."""
    w = Window.partitionBy("request_id").orderBy(F.desc("expected_qty"), "product_id")
    return (scored.select("request_id", "cvr", "product_id", "expected_qty", F.row_number().over(w).alias("rank"))
            .filter(F.col("rank") <= k))


def prediction_accuracy(scored: DataFrame, actuals: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """J15 + A26: per company the share of gifts predicted within ±20 % of the
    actual quantity, and the mean absolute error (gifts without history count
    as actual 0)."""
    j = scored.select("cvr", "product_id", "expected_qty").join(actuals, ["cvr", "product_id"], "left")
    a = F.coalesce(F.col("order_count"), F.lit(0)).cast("double")
    err = F.abs(F.col("expected_qty") - a)
    return j.groupBy("cvr").agg(F.count(F.lit(1)).alias("n_items"),
                                F.avg(F.when(err <= a * tolerance, 1.0).otherwise(0.0)).alias("within_tolerance_share"),
                                exact_avg(err).alias("mean_abs_error"))


def prediction_checks(scored: DataFrame) -> DataFrame:
    """Q7: rule violations per request — negative quantities, quantities above
    the head count, missing fields, confidence outside [0.5, 0.95], total above
    the head count."""
    q = F.col("expected_qty")
    per = scored.groupBy("request_id").agg(
        F.count_if(q < 0).alias("negative_qty"),
        F.count_if(q > F.col("total_exposure")).alias("qty_above_employees"),
        F.count_if(F.col("product_id").isNull() | q.isNull() | F.col("confidence_score").isNull())
        .alias("missing_fields"),
        F.count_if((F.col("confidence_score") < 0.5) | (F.col("confidence_score") > 0.95)).alias("confidence_out_of_range"),
        exact_sum(q).cast("double").alias("total_qty"), F.max("total_exposure").alias("total_employees"))
    return per.withColumn("total_above_employees", F.col("total_qty") > F.col("total_employees"))
