"""Registry of named queries: a Spark plan over the test tables of one scale
factor, and its DuckDB SQL twin for the correctness oracle.

Doubles are rounded to 6 digits on both sides so value hashes compare equal;
``Entry.rounded`` names the columns the SQL side rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giftlens.plans.oracle_fixtures import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None = None
    rounded: list[str] = field(default_factory=list)
    extra_ctes: dict[str, str] = field(default_factory=dict)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, rounded: list[str] | None = None,
             extra_ctes: dict[str, str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Entry(fn, sql, list(rounded or []), dict(extra_ctes or {}))
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # floor(x * 10^d + 0.5) / 10^d: the same IEEE steps in every engine
            # (decimal-text HALF_UP rounding and binary rounding disagree on ties)
            scale = float(10 ** digits)
            x = F.col(f.name).cast("double")
            cols.append((F.floor(x * scale + 0.5).cast("double") / scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def spark_query(name: str) -> QueryFn:
    fn = REGISTRY[name].fn

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(spark, sf_dir))
    run.__name__ = name
    return run


def oracle_query(name: str) -> str | None:
    e = REGISTRY[name]
    if e.sql is None:
        return None
    body = with_fixtures(e.sql.strip(), e.extra_ctes)
    if not e.rounded:
        return body
    repl = ", ".join(f"CAST(floor(CAST({c} AS DOUBLE) * 1000000.0 + 0.5) AS DOUBLE) / 1000000.0 AS {c}"
                     for c in e.rounded)
    return f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) q"


def load_all() -> None:
    # Importing the plan modules fills REGISTRY.
    from giftlens.plans import (  # noqa: F401
        q_training, q_features, q_usage, q_products, q_names, q_scoring, q_quality, q_model, q_sources,
    )
