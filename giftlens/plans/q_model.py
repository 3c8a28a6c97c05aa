"""Queries: model training, persistence and model-based scoring (rows-only
checks: boosted-tree values have no SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.operators import features as FE
from giftlens.operators import model as M
from giftlens.operators import quality as Q
from giftlens.operators import split as SP
from giftlens.plans.registry import register
from giftlens.plans.q_training import training
from giftlens.session import cut_lineage
from giftlens.sources import fixtures as FX


def _fit(spark, sf):
    tf = cut_lineage(training(spark, sf))
    split = SP.company_split(tf)
    train = SP.apply_split(tf, split, "train")
    val = SP.apply_split(tf, split, "validation")
    train_f = FE.company_features(train)
    val_f = FE.company_features(val, source=train)
    model, preds = M.train_model(train_f, val_f)
    return model, preds, train


@register("train_metrics")
def q_train_metrics(spark, sf):
    model, preds, _ = _fit(spark, sf)
    return Q.regression_metrics(preds.select(F.col("label").alias("y"), F.col("predicted_rate").alias("p")))


@register("score_model")
def q_score_model(spark, sf):
    from giftlens.functions.cleaning import clean_selections
    from giftlens.operators.scoring import shop_map_from_selections
    model, _, train = _fit(spark, sf)
    stats = FE.company_stats(train)
    shop_map = shop_map_from_selections(clean_selections(FX.selections(spark, sf)))
    return M.score_requests(FX.requests(spark, sf), model, stats, shop_map)


_PAIR_COLUMNS = ["shop_id", "employee_gender", *K.PRODUCT_COLUMNS]


def _pair_sql() -> str:
    cells = [f"CAST('0x' || substring(md5(coalesce({c}, 'NONE')), 1, 6) AS INTEGER) % 32 AS v{i}" for i, c in enumerate(_PAIR_COLUMNS)]
    cuts = [f"(SELECT quantile_cont(selection_rate, {k / 8}) FROM fx_training)" for k in range(1, 8)]
    label = "(SELECT list_sort(list_distinct([" + ", ".join(cuts) + "])))"
    names = [*_PAIR_COLUMNS, "label"]
    last = len(_PAIR_COLUMNS)
    parts = [f"SELECT '{names[a]}' AS feature, '{names[b]}' AS other, v{a} AS x, v{b} AS y FROM cells"
             for a in range(len(names)) for b in range(a + 1, len(names))]
    return f"""
SELECT feature, other, SUM(c / n * ln(c * n / (cx * cy))) AS mutual_information, CAST(MAX(n) AS BIGINT) AS n
FROM (SELECT feature, other, c, SUM(c) OVER (PARTITION BY feature, other) AS n, SUM(c) OVER (PARTITION BY feature, other, x) AS cx,
             SUM(c) OVER (PARTITION BY feature, other, y) AS cy
      FROM (SELECT feature, other, x, y, CAST(COUNT(*) AS DOUBLE) AS c
            FROM (WITH cells AS MATERIALIZED (SELECT {', '.join(cells)}, len(list_filter(q, lambda z: z < selection_rate)) AS v{last}
                                FROM fx_training, (SELECT {label} AS q) l) {' UNION ALL '.join(parts)}) p GROUP BY feature, other, x, y) g) h
GROUP BY feature, other"""


@register("feature_redundancy", sql=_pair_sql(), rounded=["mutual_information"])
def q_feature_redundancy(spark, sf):
    from giftlens.operators.selection import pair_information
    return pair_information(training(spark, sf).select(*_PAIR_COLUMNS, "selection_rate"), _PAIR_COLUMNS, "selection_rate")
