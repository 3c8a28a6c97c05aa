"""Queries: request validation, rule-based scoring and its roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.functions.numeric import round_half_even_sql as rnd
from giftlens.operators import scoring as S
from giftlens.plans.oracle_fixtures import FIXTURES
from giftlens.plans.registry import register
from giftlens.sources import fixtures as FX


def scored(spark, sf):
    return S.score_fallback(FX.requests(spark, sf))


def requests_with_faults(spark, sf):
    """All requests, and one request per company and gift that breaks one rule (or, kind 0, none after stripping)."""
    r = FX.requests(spark, sf)
    kind = F.col("product_id").cast("long") % 8
    null = lambda t: F.lit(None).cast(t)
    male = F.col("male_count")
    bad = r.select(
        F.concat(F.lit("fault-"), F.col("cvr"), F.lit("-"), F.col("product_id")).alias("request_id"),
        F.when(kind == 0, F.concat(F.lit(" \t"), F.col("cvr"), F.lit("\n"))).when(kind == 1, F.lit("1234567"))
        .otherwise(F.col("cvr")).alias("cvr"),
        F.when(kind == 2, null("int")).when(kind == 3, F.lit(-1)).when(kind == 4, F.lit(20000)).when(kind == 5, F.lit(0))
        .otherwise(male).alias("male_count"),
        F.when(kind == 5, F.lit(0)).otherwise(F.col("female_count")).alias("female_count"),
        F.when(kind == 6, F.lit("")).otherwise(F.col("product_id")).alias("product_id"),
        F.when(kind == 7, null("string")).otherwise(F.col("description")).alias("description"))
    return r.unionByName(bad)


FIXTURES["fx_faulty"] = """
SELECT request_id, cvr, male_count, female_count, product_id, description FROM fx_requests
UNION ALL
SELECT 'fault-' || cvr || '-' || product_id,
       CASE CAST(product_id AS BIGINT) % 8 WHEN 0 THEN ' ' || chr(9) || cvr || chr(10) WHEN 1 THEN '1234567' ELSE cvr END,
       CASE CAST(product_id AS BIGINT) % 8 WHEN 2 THEN NULL WHEN 3 THEN -1 WHEN 4 THEN 20000 WHEN 5 THEN 0 ELSE male_count END,
       CASE CAST(product_id AS BIGINT) % 8 WHEN 5 THEN 0 ELSE female_count END,
       CASE CAST(product_id AS BIGINT) % 8 WHEN 6 THEN '' ELSE product_id END,
       CASE CAST(product_id AS BIGINT) % 8 WHEN 7 THEN NULL ELSE description END
FROM fx_requests"""
_WS = "||".join(f"chr({i})" for i in range(0x3001) if chr(i).isspace())


def with_breakdown(df):
    """The emitted breakdown map, flattened so that its values are compared."""
    cells = [F.col("gender_breakdown")[g][k].alias(f"{g}_{n}") for g in ("male", "female")
             for k, n in (("predicted_rate", "map_rate"), ("expected_count", "map_expected"), ("exposure", "map_exposure"))]
    return df.select(*[c for c in df.columns if c != "gender_breakdown"], *cells)


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _rule_attr(col: str) -> str:
    *matchers, (_, default) = K.DESCRIPTION_RULES
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(coalesce(description, '')), '{w}')" for w in words)
        + f" THEN '{attrs[col]}'" for words, attrs in matchers)
    return f"CASE {whens} ELSE '{default[col]}' END"


def _rate(g: str) -> str:
    base = "CASE " + " ".join(f"WHEN cat = '{c}' THEN {_d(r)}" for c, r in K.RULE_CATEGORY_RATES.items()) \
        + f" ELSE {_d(K.RULE_BASE_RATE)} END"
    factor = (f"CASE WHEN tgt = '{g}' THEN {_d(K.RULE_SAME_GENDER_FACTOR)} WHEN tgt = 'unisex' "
              f"THEN {_d(K.RULE_UNISEX_FACTOR)} ELSE {_d(K.RULE_OTHER_GENDER_FACTOR)} END")
    h = f"md5(cat || '{g}' || tgt)"
    ch = [f"(('0x' || substring({h}, {1 + 8 * i}, 8))::BIGINT % 100)" for i in range(4)]
    h100 = f"(({ch[0]} * 36 + {ch[1]} * 16 + {ch[2]} * 96 + {ch[3]}) % 100)"
    noise = f"((CAST({h100} AS DOUBLE) / {_d(100.0)} - {_d(0.5)}) * {_d(K.RULE_NOISE_SPAN)})"
    raw = f"greatest({_d(K.RULE_RATE_MIN)}, least({_d(K.RULE_RATE_MAX)}, ({base}) * ({factor}) + {noise}))"
    return rnd(raw, 3)


FIXTURES["fx_scored_base"] = f"""
SELECT request_id, cvr, product_id, male_count, female_count, description,
       {_rule_attr('product_main_category')} AS cat, {_rule_attr('product_target_gender')} AS tgt
FROM fx_requests"""

FIXTURES["fx_scored_rates"] = f"""
SELECT *, CASE WHEN male_count = 0 THEN {_d(0.0)} ELSE {_rate('male')} END AS male_rate,
          CASE WHEN female_count = 0 THEN {_d(0.0)} ELSE {_rate('female')} END AS female_rate
FROM fx_scored_base"""

_npos = "(CASE WHEN male_rate > 0 THEN 1 ELSE 0 END + CASE WHEN female_rate > 0 THEN 1 ELSE 0 END)"
_spos = "(CASE WHEN male_rate > 0 THEN male_rate ELSE 0.0 END + CASE WHEN female_rate > 0 THEN female_rate ELSE 0.0 END)"
_conf = (f"coalesce(least({_d(K.CONFIDENCE_CAP)}, {_d(K.CONFIDENCE_BASE)} + "
         f"(CASE WHEN {_npos} > 0 THEN {_spos} / {_npos} END) * {_d(K.CONFIDENCE_SLOPE)}), {_d(K.CONFIDENCE_BASE)})")

FIXTURES["fx_scored_counts"] = f"""
SELECT request_id, cvr, product_id, cat AS product_main_category, tgt AS product_target_gender,
       male_rate, male_rate * male_count AS male_expected, female_rate, female_rate * female_count AS female_expected,
       {rnd('male_rate * male_count + female_rate * female_count', 2)} AS expected_qty,
       {rnd(_conf, 2)} AS confidence_score, male_count + female_count AS total_exposure,
       male_count AS male_map_exposure, female_count AS female_map_exposure
FROM fx_scored_rates"""

FIXTURES["fx_scored"] = f"""
SELECT request_id, cvr, product_id, cat AS product_main_category, tgt AS product_target_gender,
       male_rate, male_rate * male_count AS male_expected, female_rate, female_rate * female_count AS female_expected,
       {rnd('male_rate * male_count + female_rate * female_count', 2)} AS expected_qty,
       {rnd(_conf, 2)} AS confidence_score, male_count + female_count AS total_exposure
FROM fx_scored_rates"""

_SCORED_D = ["male_rate", "male_expected", "female_rate", "female_expected", "expected_qty", "confidence_score"]


@register("validate_requests", sql=f"""
SELECT request_id, trim(cvr) AS cvr, male_count, female_count, n_presents,
       array_to_string(list_filter([
         CASE WHEN male_count IS NULL OR female_count IS NULL THEN 'count_missing' END,
         CASE WHEN cvr IS NULL OR trim(cvr) = '' THEN 'cvr_empty' END,
         CASE WHEN NOT coalesce(regexp_full_match(trim(cvr), '[0-9]{{{K.CVR_DIGITS}}}'), false) THEN 'cvr_format' END,
         CASE WHEN male_count < 0 OR female_count < 0 THEN 'count_negative' END,
         CASE WHEN male_count > {K.MAX_EMPLOYEES} OR female_count > {K.MAX_EMPLOYEES} THEN 'count_too_high' END,
         CASE WHEN male_count + female_count = 0 THEN 'total_zero' END,
         CASE WHEN male_count + female_count > {K.MAX_EMPLOYEES} THEN 'total_too_high' END,
         CASE WHEN n_presents < 1 THEN 'no_presents' END,
         CASE WHEN n_presents > {K.MAX_PRESENTS} THEN 'too_many_presents' END,
         CASE WHEN bad > 0 THEN 'bad_present' END], lambda x: x IS NOT NULL), ',') AS errors,
       len(list_filter([
         CASE WHEN male_count IS NULL OR female_count IS NULL THEN 1 END,
         CASE WHEN cvr IS NULL OR trim(cvr) = '' THEN 1 END,
         CASE WHEN NOT coalesce(regexp_full_match(trim(cvr), '[0-9]{{{K.CVR_DIGITS}}}'), false) THEN 1 END,
         CASE WHEN male_count < 0 OR female_count < 0 THEN 1 END,
         CASE WHEN male_count > {K.MAX_EMPLOYEES} OR female_count > {K.MAX_EMPLOYEES} THEN 1 END,
         CASE WHEN male_count + female_count = 0 THEN 1 END,
         CASE WHEN male_count + female_count > {K.MAX_EMPLOYEES} THEN 1 END,
         CASE WHEN n_presents < 1 THEN 1 END, CASE WHEN n_presents > {K.MAX_PRESENTS} THEN 1 END,
         CASE WHEN bad > 0 THEN 1 END], lambda x: x IS NOT NULL)) = 0 AS is_valid
FROM (SELECT request_id, min(cvr) AS cvr, min(male_count) AS male_count, min(female_count) AS female_count,
             CAST(count(product_id) AS BIGINT) AS n_presents,
             count(*) FILTER (WHERE product_id IS NULL OR product_id = '' OR description IS NULL OR description = '') AS bad
      FROM fx_faulty GROUP BY request_id) r""".replace("trim(cvr)", f"trim(cvr, {_WS})"))
def q_validate_requests(spark, sf):
    return S.validate_requests(requests_with_faults(spark, sf))


@register("classify_description", sql="SELECT request_id, product_id, description, " + ", ".join(
    f"{_rule_attr(c)} AS {c}" for c in K.PRODUCT_COLUMNS) + " FROM fx_requests")
def q_classify_description(spark, sf):
    r = FX.requests(spark, sf)
    return r.select("request_id", "product_id", "description",
                    S.classify_description(F.col("description")).alias("_a")).select(
        "request_id", "product_id", "description", "_a.*")


@register("score_fallback", sql="""
SELECT s.*, CAST(NULL AS VARCHAR) AS error, male_rate AS male_map_rate, male_expected AS male_map_expected,
       female_rate AS female_map_rate, female_expected AS female_map_expected
FROM fx_scored_counts s""", rounded=_SCORED_D + ["male_map_rate", "male_map_expected", "female_map_rate", "female_map_expected"])
def q_score_fallback(spark, sf):
    return with_breakdown(scored(spark, sf))


@register("request_summary", sql="""
SELECT request_id, min(cvr) AS cvr, min(male_count) AS male_count, min(female_count) AS female_count,
       CAST(COUNT(*) AS BIGINT) AS num_gifts, min(male_count) + min(female_count) AS total_employees
FROM fx_requests GROUP BY request_id""")
def q_request_summary(spark, sf):
    return S.request_summary(FX.requests(spark, sf))


@register("map_company_shop", sql="""
SELECT r.cvr, coalesce(m.shop_id, 'shop_unknown') AS shop_id
FROM (SELECT DISTINCT cvr FROM fx_requests) r
LEFT JOIN (SELECT company_cvr AS cvr, shop_id FROM (
             SELECT company_cvr, shop_id, row_number() OVER (PARTITION BY company_cvr ORDER BY COUNT(*) DESC, shop_id) AS rn
             FROM fx_sel_clean GROUP BY company_cvr, shop_id) x WHERE rn = 1) m ON r.cvr = m.cvr""")
def q_map_company_shop(spark, sf):
    from giftlens.functions.cleaning import clean_selections
    companies = FX.requests(spark, sf).select("cvr").distinct()
    mapping = S.shop_map_from_selections(clean_selections(FX.selections(spark, sf)))
    return S.map_company_shop(companies, mapping)


@register("enrich_industry", sql="""
SELECT r.cvr, CAST(nullif(g.industry_code, '') AS VARCHAR) AS industry_code
FROM (SELECT DISTINCT cvr FROM fx_requests) r LEFT JOIN fx_registry g ON r.cvr = g.cvr""")
def q_enrich_industry(spark, sf):
    return S.enrich_industry(FX.requests(spark, sf).select("cvr").distinct(), FX.registry(spark, sf))


@register("business_validation", sql="""
SELECT cvr, tp AS total_predicted_selections, te AS total_employees,
       CASE WHEN te > 0 THEN tp / te END AS overall_selection_rate,
       CASE WHEN te IS NULL OR te <= 0 THEN 'no_employees' WHEN tp / te < 0.3 THEN 'low'
            WHEN tp / te > 1.2 THEN 'high' ELSE 'ok' END AS rate_validation
FROM (SELECT cvr, CAST(SUM(CAST(expected_qty AS DECIMAL(38,6))) AS DOUBLE) AS tp, MAX(total_exposure) AS te FROM fx_scored GROUP BY cvr) s""",
          rounded=["total_predicted_selections", "overall_selection_rate"])
def q_business_validation(spark, sf):
    return S.business_validation(scored(spark, sf))


@register("prediction_summary", sql="""
SELECT request_id, n AS n_predictions, tq AS total_qty, tq / n AS avg_per_gift,
       CASE WHEN te > 0 THEN tq / te END AS avg_per_employee, mn AS min_qty, mx AS max_qty,
       dv AS distinct_values, zc * 100.0 / n AS zero_share_pct, zc * 100.0 / n > 80.0 AS zero_warning
FROM (SELECT request_id, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(expected_qty AS DECIMAL(38,6))) AS DOUBLE) AS tq, MAX(total_exposure) AS te,
             MIN(expected_qty) AS mn, MAX(expected_qty) AS mx, CAST(COUNT(DISTINCT expected_qty) AS BIGINT) AS dv,
             CAST(COUNT(*) FILTER (WHERE expected_qty = 0) AS BIGINT) AS zc
      FROM fx_scored GROUP BY request_id) s""",
          rounded=["total_qty", "avg_per_gift", "avg_per_employee", "min_qty", "max_qty", "zero_share_pct"])
def q_prediction_summary(spark, sf):
    return S.prediction_summary(scored(spark, sf))


@register("top_predictions", sql="""
SELECT request_id, cvr, product_id, expected_qty, rank FROM (
  SELECT request_id, cvr, product_id, expected_qty,
         CAST(row_number() OVER (PARTITION BY request_id ORDER BY expected_qty DESC, product_id) AS INTEGER) AS rank
  FROM fx_scored) x WHERE rank <= 10""", rounded=["expected_qty"])
def q_top_predictions(spark, sf):
    return S.top_predictions(scored(spark, sf))


@register("prediction_accuracy", sql="""
SELECT s.cvr, CAST(COUNT(*) AS BIGINT) AS n_items,
       AVG(CASE WHEN abs(s.expected_qty - CAST(coalesce(a.order_count, 0) AS DOUBLE))
                     <= CAST(coalesce(a.order_count, 0) AS DOUBLE) * 0.2 THEN 1.0 ELSE 0.0 END) AS within_tolerance_share,
       CAST(SUM(CAST(abs(s.expected_qty - CAST(coalesce(a.order_count, 0) AS DOUBLE)) AS DECIMAL(38,6))) AS DOUBLE) / COUNT(*) AS mean_abs_error
FROM fx_scored s LEFT JOIN fx_actuals a ON s.cvr = a.cvr AND s.product_id = a.product_id GROUP BY s.cvr""",
          rounded=["within_tolerance_share", "mean_abs_error"])
def q_prediction_accuracy(spark, sf):
    return S.prediction_accuracy(scored(spark, sf), FX.actuals(spark, sf))


@register("prediction_checks", sql="""
SELECT request_id, CAST(COUNT(*) FILTER (WHERE expected_qty < 0) AS BIGINT) AS negative_qty,
       CAST(COUNT(*) FILTER (WHERE expected_qty > total_exposure) AS BIGINT) AS qty_above_employees,
       CAST(COUNT(*) FILTER (WHERE product_id IS NULL OR expected_qty IS NULL OR confidence_score IS NULL) AS BIGINT)
           AS missing_fields,
       CAST(COUNT(*) FILTER (WHERE confidence_score < 0.5 OR confidence_score > 0.95) AS BIGINT) AS confidence_out_of_range,
       CAST(SUM(CAST(expected_qty AS DECIMAL(38,6))) AS DOUBLE) AS total_qty, MAX(total_exposure) AS total_employees,
       CAST(SUM(CAST(expected_qty AS DECIMAL(38,6))) AS DOUBLE) > MAX(total_exposure) AS total_above_employees
FROM fx_scored GROUP BY request_id""", rounded=["total_qty"])
def q_prediction_checks(spark, sf):
    return S.prediction_checks(scored(spark, sf))


def _halves(spark, sf):
    """(calibration, new) rows of predicted and actual quantities, by a hash of the gift."""
    from giftlens.plans.q_quality import pred_vs_actual
    from giftlens.session import cut_lineage
    # both halves read the scores, several times each: stored, they are computed once, and the long scoring
    # expressions are not copied into every use
    rows = cut_lineage(pred_vs_actual(spark, sf))
    even = F.pmod(F.conv(F.substring(F.md5("product_id"), 1, 4), 16, 10).cast("int"), F.lit(2)) == 0
    return rows.where(even), rows.where(~even)


FIXTURES["fx_calibration"] = """
SELECT *, CAST('0x' || substring(md5(product_id), 1, 4) AS INTEGER) % 2 = 0 AS known FROM fx_pred_vs_actual"""
FIXTURES["fx_widths"] = """
SELECT g, r AS width FROM (
  SELECT g, r, row_number() OVER (PARTITION BY g ORDER BY r) AS k, COUNT(*) OVER (PARTITION BY g) AS n
  FROM (SELECT cvr AS g, abs(y - p) AS r FROM fx_calibration WHERE known UNION ALL
        SELECT 'all of them', abs(y - p) FROM fx_calibration WHERE known) x) y
WHERE k = ceil((n + 1) * 0.95::DECIMAL(10,9))"""


@register("prediction_intervals", sql=f"""
SELECT c.cvr, c.product_id, CAST({rnd('greatest(0.0, least(10000.0, c.p))', 0)} AS BIGINT) AS quantity,
       CAST(floor(greatest(0.0, least(10000.0, c.p - coalesce(w.width, a.width)))) AS BIGINT) AS interval_low,
       CAST(ceil(greatest(0.0, least(10000.0, c.p + coalesce(w.width, a.width)))) AS BIGINT) AS interval_high,
       w.width IS NULL AS pooled
FROM fx_calibration c LEFT JOIN fx_widths w ON w.g = c.cvr LEFT JOIN fx_widths a ON a.g = 'all of them'
WHERE NOT c.known""")
def q_prediction_intervals(spark, sf):
    from giftlens.operators.intervals import conformal_widths, with_intervals
    known, new = _halves(spark, sf)
    out = with_intervals(new, conformal_widths(known, "cvr"), "cvr")
    return out.select("cvr", "product_id", "quantity", "interval_low", "interval_high", "pooled")
