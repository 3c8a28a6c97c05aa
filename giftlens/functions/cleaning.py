"""Column-level cleaning: quote/space stripping, missing tokens, lenient numbers,
schema alignment. All native expressions (stay inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giftlens import constants as K


# Characters Python's str.strip() removes (everything str.isspace() accepts).
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip_text(c: Column) -> Column:
    """Strip double quotes from both ends, then surrounding whitespace.

    A text of one line whose first and last characters are printable ASCII other than a quote has nothing to
    strip: one look at it costs half of trimming by sets of characters."""
    stripped = F.btrim(F.btrim(c, F.lit('"')), F.lit(WHITESPACE))
    return F.when(c.rlike(r"\A[!#-~](?:.*[!#-~])?\z"), c).otherwise(stripped)


def na_to_null(c: Column, tokens: Iterable[str] = K.NA_TOKENS) -> Column:
    """CSV missing-value tokens become null."""
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def lenient_double(c: Column, default: float = 0.0) -> Column:
    """Parse a number; unparsable, NaN or null values become ``default``."""
    d = c.try_cast("double")
    return F.coalesce(F.nanvl(d, F.lit(None).cast("double")), F.lit(float(default)))


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clean_strings(df: DataFrame, missing: str | None = K.MISSING,
                  lower: Iterable[str] = ()) -> DataFrame:
    """Strip every string column, lower-case the given ones, fill nulls."""
    lower = set(lower)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = strip_text(c)
            if f.name in lower:
                c = F.lower(c)
            if missing is not None:
                c = F.coalesce(c, F.lit(missing))
        out.append(c.alias(f.name))
    return df.select(*out)


def clean_selections(df: DataFrame, missing: str = K.MISSING) -> DataFrame:
    return clean_strings(df, missing, K.LOWERCASE_COLUMNS)


def clean_catalog(df: DataFrame, missing: str = K.MISSING) -> DataFrame:
    return clean_strings(df, missing)


def clean_employees(df: DataFrame) -> DataFrame:
    """Strip text columns; employee counts become doubles, bad values 0."""
    counts = {"male_count", "female_count"}
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in counts:
            c = lenient_double(c, 0.0)
        elif isinstance(f.dataType, T.StringType):
            c = strip_text(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def align_schema(df: DataFrame, columns: Iterable[str],
                 categorical: Iterable[str] = K.CATEGORICAL_FEATURES,
                 defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Project ``df`` onto ``columns`` in that order: missing categoricals become
    ``NONE``, missing numerics 0 (or ``defaults``); categoricals are cast to string,
    numerics parsed leniently; extra columns are dropped."""
    categorical = set(categorical)
    defaults = dict(defaults or {})
    have = set(df.columns)
    out = []
    for name in columns:
        if name in categorical:
            c = F.col(name).cast("string") if name in have else F.lit(defaults.get(name, K.MISSING))
            out.append(F.coalesce(c, F.lit(K.MISSING)).alias(name))
        else:
            c = lenient_double(F.col(name)) if name in have else F.lit(float(defaults.get(name, 0)))
            out.append(c.cast("double").alias(name))
    return df.select(*out)
