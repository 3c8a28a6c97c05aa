"""Queries: name normalisation, gender classification, exposure from names."""

from __future__ import annotations

from giftlens import constants as K
from giftlens.operators import names as N
from giftlens.plans.oracle_fixtures import FIXTURES
from giftlens.plans.registry import register
from giftlens.sources import fixtures as FX

_WS = "||".join(f"chr({i})" for i in range(0x3001) if chr(i).isspace())
_CAP = "lambda x: upper(substring(x, 1, 1)) || lower(substring(x, 2))"


def _norm(c: str) -> str:
    s = f"trim({c}, {_WS})"
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {s} = '' THEN '' "
            f"WHEN contains({s}, '-') THEN array_to_string(list_transform(list_filter(string_split({s}, '-'), "
            f"lambda x: x <> ''), {_CAP}), '-') "
            f"ELSE array_to_string(list_transform(list_filter(regexp_split_to_array({s}, '\\s+'), "
            f"lambda x: x <> ''), {_CAP}), ' ') END")


FIXTURES["fx_names_norm"] = f"""
SELECT employee_id, company_cvr, name, {_norm('fn')} AS normalized_name, lower(trim(fn)) AS first_name_lower
FROM (SELECT *, coalesce(list_filter(regexp_split_to_array(nn, '\\s+'), lambda x: x <> '')[1], nn) AS fn
      FROM (SELECT *, {_norm('name')} AS nn FROM fx_names) a) b"""

FIXTURES["fx_builtin_names"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in sorted(K.BUILTIN_NAMES.items())) + ") t(name_lower, builtin)"

FIXTURES["fx_gender"] = """
SELECT n.employee_id, n.company_cvr, n.name,
       CASE WHEN n.name IS NULL OR n.name = '' THEN '' ELSE n.normalized_name END AS normalized_name,
       CASE WHEN n.name IS NULL OR n.name = '' THEN 'unisex'
            WHEN g.label IN ('male', 'female') THEN g.label
            WHEN b.builtin IS NOT NULL THEN b.builtin
            WHEN c.label IN ('male', 'female') THEN c.label
            WHEN g.label IN ('mostly_male', 'andy') THEN 'male'
            WHEN g.label = 'mostly_female' THEN 'female' ELSE 'unisex' END AS gender,
       CASE WHEN n.name IS NULL OR n.name = '' THEN 'low'
            WHEN g.label IN ('male', 'female') OR b.builtin IS NOT NULL THEN 'high'
            WHEN c.label IN ('male', 'female') THEN 'medium' ELSE 'low' END AS confidence,
       CASE WHEN n.name IS NULL OR n.name = '' THEN 'fallback'
            WHEN g.label IN ('male', 'female') THEN 'gender_guesser'
            WHEN b.builtin IS NOT NULL THEN 'danish_dict'
            WHEN c.label IN ('male', 'female') OR g.label IN ('mostly_male', 'andy', 'mostly_female')
                 THEN 'gender_guesser'
            ELSE 'fallback' END AS method
FROM fx_names_norm n
LEFT JOIN (SELECT name, min(label) AS label FROM fx_general_names WHERE country = 'any' GROUP BY name) g
       ON n.normalized_name = g.name
LEFT JOIN (SELECT name, min(label) AS label FROM fx_general_names WHERE country = 'denmark' GROUP BY name) c
       ON n.normalized_name = c.name
LEFT JOIN fx_builtin_names b ON n.first_name_lower = b.name_lower"""


@register("normalize_name", sql="SELECT employee_id, name, normalized_name, first_name_lower FROM fx_names_norm")
def q_normalize_name(spark, sf):
    return N.normalize_names(FX.names(spark, sf)).select("employee_id", "name", "normalized_name",
                                                          "first_name_lower")


@register("classify_gender", sql="SELECT * FROM fx_gender")
def q_classify_gender(spark, sf):
    return N.classify_gender(FX.names(spark, sf), FX.general_names(spark))


@register("validate_name_requests", sql="""
SELECT request_id, n_names, errors, errors = '' AS is_valid FROM (
  SELECT request_id, COUNT(name) AS n_names,
         CASE WHEN COUNT(name) = 0 THEN 'names_empty' WHEN COUNT(name) > 1000 THEN 'too_many_names' ELSE '' END AS errors
  FROM fx_name_requests GROUP BY request_id) r""")
def q_validate_name_requests(spark, sf):
    return N.validate_name_requests(FX.name_requests(spark, sf))


@register("gender_counts", sql="""
SELECT company_cvr, CAST(COUNT(*) FILTER (WHERE gender = 'male') AS BIGINT) AS male_count,
       CAST(COUNT(*) FILTER (WHERE gender = 'female') AS BIGINT) AS female_count,
       CAST(COUNT(*) FILTER (WHERE gender = 'unisex') AS BIGINT) AS unclassified_count,
       CAST(COUNT(*) AS BIGINT) AS total_names
FROM fx_gender GROUP BY company_cvr""")
def q_gender_counts(spark, sf):
    return N.gender_counts(N.classify_gender(FX.names(spark, sf), FX.general_names(spark)))


@register("gender_confidence", sql="""
SELECT CAST(COUNT(*) FILTER (WHERE confidence = 'high') AS BIGINT) AS high,
       CAST(COUNT(*) FILTER (WHERE confidence = 'medium') AS BIGINT) AS medium,
       CAST(COUNT(*) FILTER (WHERE confidence = 'low') AS BIGINT) AS low
FROM fx_gender""")
def q_gender_confidence(spark, sf):
    return N.gender_confidence(N.classify_gender(FX.names(spark, sf), FX.general_names(spark)))


@register("legacy_to_exposure", sql="""
SELECT company_cvr, CAST(COUNT(*) FILTER (WHERE gender = 'male') AS BIGINT) AS male_count,
       CAST(COUNT(*) FILTER (WHERE gender = 'female') AS BIGINT) AS female_count,
       CAST(COUNT(*) AS BIGINT) AS total_names,
       CASE WHEN COUNT(*) FILTER (WHERE gender = 'unisex') > 0
            THEN CAST(COUNT(*) FILTER (WHERE gender = 'unisex') AS VARCHAR) || ' names could not be classified'
       END AS warning
FROM fx_gender GROUP BY company_cvr""")
def q_legacy_to_exposure(spark, sf):
    return N.legacy_to_exposure(FX.names(spark, sf), FX.general_names(spark))
