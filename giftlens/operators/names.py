"""Employee-name gender classification and per-company exposure counts.

The cascade (first match wins):
  1. general name table, label male/female        -> high,   'gender_guesser'
  2. built-in first-name list                      -> high,   'danish_dict'
  3. country name table (``country``), male/female -> medium, 'gender_guesser'
  4. general table label mostly_male/andy -> male, mostly_female -> female; low
  5. otherwise unisex, low, 'fallback'
Empty names are unisex/low/fallback. Name tables are joined, not called per row:
they are dictionaries of bounded size, so they are broadcast behind a count
check; the (possibly skewed) name column is never shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.functions.text import first_name, normalize_name


def builtin_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(K.BUILTIN_NAMES.items()), "name_lower string, builtin string")


def normalize_names(names: DataFrame, col: str = "name") -> DataFrame:
    """X2 + X3: adds ``normalized_name`` (normalised first name) and
    ``first_name_lower``."""
    fn = first_name(F.col(col))
    return names.select("*", normalize_name(fn).alias("normalized_name"),
                        F.lower(F.btrim(fn)).alias("first_name_lower"))


def classify_gender(names: DataFrame, name_table: DataFrame | None = None, col: str = "name",
                    country: str = "denmark") -> DataFrame:
    """X4 + J14: adds ``normalized_name``, ``gender``, ``confidence``, ``method``.
    ``name_table`` has (name, country, label); country ``any`` is the general
    table. With no table only the built-in list applies."""
    spark = names.sparkSession
    n = normalize_names(names, col)
    if name_table is None:
        name_table = spark.createDataFrame([], "name string, country string, label string")
    # no hints: AQE broadcasts a dictionary by its measured bytes and splits hot names otherwise
    general = (name_table.filter(F.col("country") == "any")
               .groupBy(F.col("name").alias("g_name")).agg(F.min("label").alias("g_label")))
    local = (name_table.filter(F.col("country") == country)
             .groupBy(F.col("name").alias("c_name")).agg(F.min("label").alias("c_label")))
    builtin = F.broadcast(builtin_names(spark))  # fixed 32 rows
    j = (n.join(general, F.col("normalized_name") == F.col("g_name"), "left")
         .join(local, F.col("normalized_name") == F.col("c_name"), "left")
         .join(builtin, F.col("first_name_lower") == F.col("name_lower"), "left"))
    g, c, b = F.col("g_label"), F.col("c_label"), F.col("builtin")
    empty = F.col(col).isNull() | (F.col(col) == "")
    res = (F.when(empty, F.struct(F.lit("unisex").alias("gender"), F.lit("low").alias("confidence"),
                                  F.lit("fallback").alias("method")))
           .when(g.isin("male", "female"), F.struct(g.alias("gender"), F.lit("high").alias("confidence"),
                                                    F.lit("gender_guesser").alias("method")))
           .when(b.isNotNull(), F.struct(b.alias("gender"), F.lit("high").alias("confidence"),
                                         F.lit("danish_dict").alias("method")))
           .when(c.isin("male", "female"), F.struct(c.alias("gender"), F.lit("medium").alias("confidence"),
                                                    F.lit("gender_guesser").alias("method")))
           .when(g.isin("mostly_male", "andy"), F.struct(F.lit("male").alias("gender"),
                                                         F.lit("low").alias("confidence"),
                                                         F.lit("gender_guesser").alias("method")))
           .when(g == "mostly_female", F.struct(F.lit("female").alias("gender"), F.lit("low").alias("confidence"),
                                                F.lit("gender_guesser").alias("method")))
           .otherwise(F.struct(F.lit("unisex").alias("gender"), F.lit("low").alias("confidence"),
                               F.lit("fallback").alias("method"))))
    out = j.withColumn("_r", res)
    return out.select(*names.columns,
                      F.when(empty, F.lit("")).otherwise(F.col("normalized_name")).alias("normalized_name"),
                      "_r.gender", "_r.confidence", "_r.method")


def validate_name_requests(requests: DataFrame, limit: int = K.MAX_NAMES) -> DataFrame:
    """Per request of names (request_id, name) the number of names and the failed rules: no name at all, or
    more than ``limit``. A null name is no name; an empty one counts (it classifies as unisex)."""
    per = requests.groupBy("request_id").agg(F.count("name").alias("n_names"))
    errors = F.when(F.col("n_names") == 0, "names_empty").when(F.col("n_names") > limit, "too_many_names").otherwise("")
    return per.select("request_id", "n_names", errors.alias("errors"), (errors == "").alias("is_valid"))


def gender_counts(classified: DataFrame, key: str = "company_cvr") -> DataFrame:
    """Male / female / unisex counts per key (one aggregate)."""
    g = F.col("gender")
    return classified.groupBy(key).agg(F.count_if(g == "male").alias("male_count"),
                                       F.count_if(g == "female").alias("female_count"),
                                       F.count_if(g == "unisex").alias("unclassified_count"),
                                       F.count(F.lit(1)).alias("total_names"))


def gender_confidence(classified: DataFrame) -> DataFrame:
    """Confidence histogram high / medium / low (zeros included)."""
    c = F.col("confidence")
    return classified.agg(F.count_if(c == "high").alias("high"), F.count_if(c == "medium").alias("medium"),
                          F.count_if(c == "low").alias("low"))


def legacy_to_exposure(names: DataFrame, name_table: DataFrame | None = None,
                       key: str = "company_cvr") -> DataFrame:
    """Employee names -> per-company exposure (male/female counts) with a
    warning when some names stay unclassified."""
    counts = gender_counts(classify_gender(names, name_table), key)
    warn = F.when(F.col("unclassified_count") > 0,
                  F.concat(F.col("unclassified_count").cast("string"), F.lit(" names could not be classified")))
    return counts.select(key, "male_count", "female_count", "total_names", warn.alias("warning"))
