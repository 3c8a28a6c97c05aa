"""Prediction intervals from residuals (split conformal prediction).

The residuals |actual - predicted| of rows that the model was not fitted on give, per group, the
half width that covers a wanted share of new rows: the ceil((n + 1) * level)-th smallest of n. Groups with
fewer rows than that needs are pooled. Ranks run over ranges (``ranges.prefix_sums``), so that no group
is held in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.operators.ranges import prefix_sums
from giftlens.operators.scoring import bounded_counts
from giftlens.session import cut_lineage


def least_rows(level: float) -> int:
    """Rows that a group needs for an own interval: the smallest n with ceil((n + 1) * level) <= n."""
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    n = 1
    while math.ceil(round((n + 1) * level, 9)) > n:
        n += 1
    return n


def conformal_widths(calibration: DataFrame, group: str, y: str = "y", p: str = "p", level: float = K.CONFIDENCE_LEVEL) -> DataFrame:
    """(group, width, n) of each group with enough calibration rows, and of the pool of all rows under a null group.

    Rows without actual or predicted value are left out, and a null group counts in the pool alone. Without enough rows
    even the pool's width is null: no interval can promise the level.
    """
    r = cut_lineage(calibration.select(F.col(group).cast("string").alias("g"), F.abs(F.col(y).cast("double") - F.col(p).cast("double")).alias("r")))
    r = r.where(F.col("r").isNotNull() & ~F.isnan("r"))
    keyed = F.explode(F.array(F.struct(F.lit(False).alias("pool"), F.col("g")), F.struct(F.lit(True).alias("pool"), F.lit(None).cast("string").alias("g"))))
    rows = r.select(keyed.alias("k"), "r").select("k.pool", "k.g", "r").where("pool or g is not null")
    cells = prefix_sums(rows.groupBy("pool", "g", "r").agg(F.count(F.lit(1)).alias("c")), ["pool", "g"], ["r"], ["c"])
    size = cells.groupBy("pool", "g").agg(F.sum("c").alias("n")).select(F.col("pool").alias("_pool"), F.col("g").alias("_g"), "n")
    # decimal steps: binary fractions of the level must not push a whole number over its ceiling
    place = F.ceil((F.col("n") + 1) * F.lit(f"{level:.9f}").cast("decimal(10,9)"))
    hit = (F.col("c_before") < place) & (place <= F.col("c_before") + F.col("c"))
    found = (cells.join(size, (F.col("pool") == F.col("_pool")) & F.col("g").eqNullSafe(F.col("_g")))
             .groupBy("pool", "g").agg(F.min(F.when(hit, F.col("r"))).alias("width"), F.first("n").alias("n")))
    return found.where("pool or width is not null").select(F.col("g").alias(group), "width", "n")


def with_intervals(rows: DataFrame, widths: DataFrame, group: str, p: str = "p", low: float = 0.0, high: float = float(K.MAX_EMPLOYEES)) -> DataFrame:
    """``rows`` with ``quantity`` (the prediction as a whole number within bounds), ``interval_low``, ``interval_high``
    (whole numbers within bounds that hold the interval) and ``pooled`` (its group had too few rows). Every row keeps its
    place; without any width the interval is null."""
    own = widths.where(F.col(group).isNotNull()).select(F.col(group), F.col("width").alias("_own"))
    pool = widths.where(F.col(group).isNull()).select(F.col("width").alias("_pool"))
    pool = pool.agg(F.max("_pool").alias("_pool"))  # one row, also without any
    w = F.coalesce("_own", "_pool")
    x = F.col(p).cast("double")
    bounded = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    return (rows.join(own, group, "left").join(F.broadcast(pool))  # one row
            .select(*rows.columns, bounded_counts(x, low, high).alias("quantity"),
                    F.when(w.isNotNull(), F.floor(bounded(x - w))).alias("interval_low"),
                    F.when(w.isNotNull(), F.ceil(bounded(x + w))).alias("interval_high"), F.col("_own").isNull().alias("pooled")))
