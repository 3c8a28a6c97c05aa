"""Feature selection by mutual information with the label and little redundancy among the chosen.

Tasks count the value buckets of all pairs of columns; the joint counts are one aggregate of the tasks' cells,
at most buckets x buckets a pair and task. What reaches the driver is one number per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.operators.ranges import quantiles
from giftlens.session import cut_lineage

BUCKETS = 32
LABEL = "label"


def bucket(c: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a value's text: its md5 modulo ``buckets`` (null counts as ``NONE``)."""
    text = F.coalesce(c.cast("string"), F.lit(K.MISSING))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int"), F.lit(buckets))


def _pair_counts(columns: int, width: int):
    """A task's rows per (column a, later column b, value of a, value of b), of vectors ``v`` of numbers below ``width``."""
    pairs = [(a, b) for a in range(columns) for b in range(a + 1, columns)]

    def count(batches):
        total = np.zeros((len(pairs), width * width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, columns).T.astype(np.int64)
            for k, (a, b) in enumerate(pairs):
                total[k] += np.bincount(v[a] * width + v[b], minlength=width * width)
        k, cell = np.nonzero(total)
        a, b = np.array(pairs, np.int32).reshape(-1, 2)[k].T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array((cell // width).astype(np.int32)), pa.array((cell % width).astype(np.int32)),
                                          pa.array(total[k, cell])], names=["a", "b", "x", "y", "n"])

    return count


def pair_information(frame: DataFrame, columns: list[str], label: str = LABEL, bins: int = 8, buckets: int = BUCKETS) -> DataFrame:
    """(feature, other, mutual_information, n): natural-log mutual information of every unordered pair of columns, by their
    buckets, and of every column with the label (``other`` = ``label``), cut at its exact quantiles.

    Rows without a label are left out. Columns are named in the order given. The buckets and the label are stored once;
    tasks count all pairs of their rows in numpy, so that at most buckets x buckets cells a pair and task are shuffled.
    """
    y = F.col(label).cast("double")
    rows = cut_lineage(frame.where(F.col(label).isNotNull() & ~F.isnan(y)).select(
        F.array(*[bucket(F.col(c), buckets).cast("int") for c in columns]).alias("_buckets"), y.alias(label)))
    cuts = sorted({q for q in quantiles(rows, label, [k / bins for k in range(1, bins)]) if q is not None})
    names = [*columns, LABEL]
    of_label = sum([(F.col(label).cast("double") > c).cast("int") for c in cuts], F.lit(0))
    counted = (rows.select(F.concat("_buckets", F.array(of_label)).alias("v"))
               .mapInArrow(_pair_counts(len(names), max(buckets, len(cuts) + 1)), "a int, b int, x int, y int, n long"))
    joint = counted.groupBy("a", "b", "x", "y").agg(F.sum("n").cast("double").alias("n_xy"))
    by_x = joint.groupBy("a", "b", "x").agg(F.sum("n_xy").alias("n_x"))
    by_y = joint.groupBy("a", "b", "y").agg(F.sum("n_xy").alias("n_y"))
    total = joint.groupBy("a", "b").agg(F.sum("n_xy").alias("n"))
    j = joint.join(by_x, ["a", "b", "x"]).join(by_y, ["a", "b", "y"]).join(total, ["a", "b"])
    part = F.col("n_xy") / F.col("n") * F.log(F.col("n_xy") * F.col("n") / (F.col("n_x") * F.col("n_y")))
    # as decimals: the same sum however the cells are added
    per = j.groupBy("a", "b").agg(F.sum(part.cast("decimal(38,15)")).cast("double").alias("mutual_information"), F.max("n").cast("long").alias("n"))
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in names]), F.col(c) + 1)
    return per.select(name("a").alias("feature"), name("b").alias("other"), "mutual_information", "n")


def choose(pairs: list[tuple[str, str, float]], columns: list[str], k: int) -> list[tuple[str, float]]:
    """At most ``k`` columns with their scores, best first: each step takes the column whose information on the label exceeds
    its mean information on those already taken by most (ties: the order of ``columns``)."""
    shared = {frozenset((a, b)): v for a, b, v in pairs}
    taken: list[tuple[str, float]] = []
    rest = list(columns)
    while rest and len(taken) < k:
        def score(c: str) -> float:
            own = shared.get(frozenset((c, LABEL)), 0.0)
            return own - (sum(shared.get(frozenset((c, t)), 0.0) for t, _ in taken) / len(taken) if taken else 0.0)
        best = max(rest, key=lambda c: (score(c), -columns.index(c)))
        taken.append((best, score(best)))
        rest.remove(best)
    return taken


def select_features(frame: DataFrame, columns: list[str], k: int, label: str = LABEL, **options) -> list[str]:
    """The names of at most ``k`` columns, best first."""
    found = pair_information(frame, columns, label, **options).collect()  # one number per pair
    return [c for c, _ in choose([(r["feature"], r["other"], r["mutual_information"]) for r in found], columns, k)]
