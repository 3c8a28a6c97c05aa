"""Work inside groups of any size by ranges: prefix sums, ranks, order statistics.

A window partitioned by a group holds the whole group in one task. Here rows are
sorted by (group, order) into ranges; a range is one task's work whatever its groups are,
and a group that crosses range borders carries its sums over them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from giftlens.session import cut_lineage

#: Ranges that one pass of a selection counts, and rows that are small enough to sort on the driver.
RANGES = 4096
FEW = 4096


def prefix_sums(df: DataFrame, group: list[str], order: list[str], measures: list[str]) -> DataFrame:
    """``df`` (one row per (group, order); columns kept) with ``<measure>_before``: the measure's sum over
    the rows of the same group that come earlier in ascending ``order``, 0 for the first.

    Null groups are a group, null order values come first. Only one number per range border and measure leaves
    its task.
    """
    ranged = cut_lineage(df.orderBy(*group, *order).withColumn("_range", F.spark_partition_id()))
    total = ranged.groupBy("_range", *group).agg(*[F.sum(m).alias(m) for m in measures])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a border is crossed by one group at most: fewer rows than there are ranges
    carried = total.select(F.col("_range").alias("_to"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                           *[F.sum(m).over(earlier).alias(f"_c{i}") for i, m in enumerate(measures)]).where(
        reduce(lambda a, b: a | b, [F.col(f"_c{i}").isNotNull() for i in range(len(measures))]))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_range") == F.col("_to"))
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.sum(m).over(inside).alias(f"_i{i}") for i, m in enumerate(measures)])
    zero = F.lit(0)
    return own.join(F.broadcast(carried), same, "left").select(
        *df.columns, *[(F.coalesce(f"_i{i}", zero) + F.coalesce(f"_c{i}", zero)).alias(f"{m}_before") for i, m in enumerate(measures)])


def ranks_within(df: DataFrame, group: list[str], order: list[str], rank: str | None = None, dense: str | None = None) -> DataFrame:
    """``df`` with the rank and the dense rank (from 1, ties share one) of each row in its group, ascending ``order``.

    Ties are counted before the ranges are cut, so a run of ties never crosses a border.
    """
    keys = df.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_keys", F.lit(1).cast("long"))
    found = prefix_sums(keys, group, order, ["_rows", "_keys"])
    names = [*group, *order]
    found = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)],
                         *([(F.col("_rows_before") + 1).cast("int").alias(rank)] if rank else []),
                         *([(F.col("_keys_before") + 1).cast("int").alias(dense)] if dense else []))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)])
    return df.join(found, same).drop(*[f"_k{i}" for i in range(len(names))])


def order_statistics(df: DataFrame, col: str, ranks: list[int]) -> list[float]:
    """The values at the given places (from 0) of the column's finite values in ascending order, exactly.

    One pass counts the values in ``RANGES`` equal ranges; the range that holds the place is cut
    again, until it holds one value or few rows. Every pass is one aggregate with at most ``RANGES`` rows,
    and each cuts off both ends of its range, so a few passes do, whatever the values are.
    """
    values = df.select(F.col(col).cast("double").alias("x")).where(_finite(F.col("x")))
    top = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).first()
    found: dict[int, float] = {}
    cuts: dict[tuple[float, float], list] = {}  # ranges that several places share are counted once

    def place(rank: int) -> float:
        lo, hi, n, k = top["lo"], top["hi"], top["n"], rank
        while lo < hi:
            if (lo, hi) not in cuts:
                inside = values.where((F.col("x") >= F.lit(lo)) & (F.col("x") <= F.lit(hi)))
                if n <= FEW:
                    cuts[lo, hi] = sorted((r["x"], r["x"], r["n"]) for r in inside.groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect())
                else:
                    # halves keep the width of the largest doubles finite; rounding keeps the order
                    share = (F.col("x") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
                    cut = F.least(F.floor(share * RANGES), F.lit(RANGES - 1))
                    cuts[lo, hi] = sorted((r["lo"], r["hi"], r["n"]) for r in inside.groupBy(cut.alias("c")).agg(
                        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).collect())
            for lo, hi, n in cuts[lo, hi]:  # noqa: B007  the range that holds the place stays
                if k < n:
                    break
                k -= n
        return lo

    for rank in ranks:
        if not 0 <= rank < top["n"]:
            raise ValueError(f"place {rank} of {top['n']} values")
        found[rank] = place(rank)
    return [found[r] for r in ranks]


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of the column's finite values, linear between neighbours; None without values."""
    n = df.where(_finite(F.col(col).cast("double"))).count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    places = sorted({p for a in at for p in (math.floor(a), math.ceil(a))})
    value = dict(zip(places, order_statistics(df, col, places)))
    return [value[math.floor(a)] + (value[math.ceil(a)] - value[math.floor(a)]) * (a - math.floor(a)) for a in at]
