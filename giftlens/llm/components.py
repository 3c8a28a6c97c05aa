"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import written


def _mins(links: DataFrame) -> DataFrame:
    """For each node ``n`` the smallest of itself and its partners ``m``; partial aggregates keep hubs cheap."""
    return links.groupBy("n").agg(F.min("m").alias("least")).select(
        F.col("n").alias("k"), F.least("n", "least").alias("least"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every linked node and the smallest node reachable from it.

    Links need no direction; repeated links, links of a node with itself and
    links with a null end do no harm (the last are left out). Each round is
    written to the shared folder; only two numbers come back to the driver.
    """
    e = (links.select(F.greatest(a, b).alias("n"), F.least(a, b).alias("m"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("n") != F.col("m"))).distinct())
    e = written(e)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("m").alias("n"), F.col("n").alias("m")))
        large = (both.join(_mins(both), F.col("n") == F.col("k")).where(F.col("m") > F.col("n"))
                 .select(F.col("m").alias("n"), F.col("least").alias("m")).distinct())
        small = large.join(_mins(large), F.col("n") == F.col("k"))
        e = written(small.select(F.col("m").alias("n"), F.col("least").alias("m"))
                    .unionByName(small.select("n", F.col("least").alias("m")))
                    .where(F.col("n") != F.col("m")).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("n", "m"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = e.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return e.select(F.col("n").alias("node"), F.col("m").alias("component")).unionByName(roots)
