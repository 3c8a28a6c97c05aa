"""the key expressions as SQL functions (``CREATE TEMPORARY FUNCTION ...
RETURN expr``), for users who write Spark SQL. SQL functions are inlined by
the analyzer, so they run as native expressions like their DataFrame twins in
``giftlens.functions`` and ``giftlens.operators``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from giftlens import constants as K
from giftlens.functions.cleaning import WHITESPACE

_WS_LIT = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"
_WS_RE = "'[" + "".join(f"\\\\u{ord(c):04x}" for c in WHITESPACE) + "]+'"
_CAP = "w -> concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))"


def _md5_mod100(t: str) -> str:
    chunks = [f"pmod(CAST(conv(substring(md5({t}), {1 + 8 * i}, 8), 16, 10) AS BIGINT), 100)" for i in range(4)]
    w = [pow(2, 96, 100), pow(2, 64, 100), pow(2, 32, 100), 1]
    return "(" + " + ".join(f"{c} * {k}" for c, k in zip(chunks, w)) + ") % 100"


def _normalize(x: str) -> str:
    s = f"btrim({x}, {_WS_LIT})"
    hy = f"array_join(transform(filter(split({s}, '-'), p -> p != ''), {_CAP}), '-')"
    words = f"array_join(transform(filter(split({s}, {_WS_RE}), p -> p != ''), {_CAP}), ' ')"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {s} = '' THEN '' "
            f"WHEN contains({s}, '-') THEN {hy} ELSE {words} END")


def _rule_rate(cat: str, tgt: str, g: str) -> str:
    base = "CASE " + " ".join(f"WHEN {cat} = '{c}' THEN {r}D" for c, r in K.RULE_CATEGORY_RATES.items()) \
        + f" ELSE {K.RULE_BASE_RATE}D END"
    factor = (f"CASE WHEN {tgt} = {g} THEN {K.RULE_SAME_GENDER_FACTOR}D WHEN {tgt} = 'unisex' "
              f"THEN {K.RULE_UNISEX_FACTOR}D ELSE {K.RULE_OTHER_GENDER_FACTOR}D END")
    noise = f"((md5_mod100(concat({cat}, {g}, {tgt})) / 100.0D - 0.5D) * {K.RULE_NOISE_SPAN}D)"
    raw = f"greatest({K.RULE_RATE_MIN}D, least({K.RULE_RATE_MAX}D, ({base}) * ({factor}) + {noise}))"
    # half-even on the binary value, as in giftlens.functions.numeric.round_half_even
    r = f"({raw}) * 1000.0D"
    return (f"(floor({r}) + CASE WHEN {r} - floor({r}) > 0.5D THEN 1 WHEN {r} - floor({r}) < 0.5D THEN 0 "
            f"WHEN pmod(floor({r}), 2) = 0 THEN 0 ELSE 1 END) / 1000.0D")


FUNCTIONS = {
    "md5_mod100": ("t STRING", "BIGINT", _md5_mod100("t")),
    "present_hash": ("name STRING, model STRING, model_no STRING, vendor STRING", "STRING",
                     "upper(md5(concat(coalesce(name, 'None'), ' - ', coalesce(model, 'None'), ' - ', "
                     "coalesce(model_no, 'None'), '.', CASE WHEN vendor IS NOT NULL AND vendor != '' AND "
                     f"lower(vendor) != '{K.HOUSE_VENDOR}' THEN concat(' Vendor ', vendor) ELSE '' END)))"),
    "normalize_name": ("name STRING", "STRING", _normalize("name")),
    "first_name": ("name STRING", "STRING",
                   f"coalesce(try_element_at(filter(split(normalize_name(name), {_WS_RE}), p -> p != ''), 1), "
                   "normalize_name(name))"),
    "rule_rate": ("category STRING, target STRING, gender STRING", "DOUBLE",
                  _rule_rate("category", "target", "gender")),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
