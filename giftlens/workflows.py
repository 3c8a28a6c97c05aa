"""End-to-end flows built from the operators.

train_from_files: three CSV files -> training frame -> company holdout split
(leakage check) -> company features (validation from the training part) ->
boosted trees -> validation metrics -> saved model + metadata.

predict_from_files: JSON requests -> validation (rejected requests reported,
not scored) -> model scoring, or the rules when no model is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.operators import features as FE
from giftlens.operators import model as M
from giftlens.operators import quality as Q
from giftlens.operators import scoring as S
from giftlens.operators import split as SP
from giftlens.operators import training as TR
from giftlens.session import cut_lineage
from giftlens.sources import files


def train_from_files(spark: SparkSession, selections: str, catalog: str, employees: str, model_path: str,
                     links: DataFrame | None = None, **model_params) -> DataFrame:
    """Returns a one-row report: records, companies, validation metrics."""
    sel, cat, emp = files.load_three_files(spark, selections, catalog, employees)
    tf = cut_lineage(TR.training_frame(sel, cat, emp, links=links))
    split = SP.company_split(tf)
    train = SP.apply_split(tf, split, "train")
    val = SP.apply_split(tf, split, "validation")
    SP.check_no_overlap(train, val)
    train_f = FE.company_features(train)
    val_f = FE.company_features(val, source=train)
    model, preds = M.train_model(train_f, val_f, **model_params)
    metrics = Q.regression_metrics(preds.select(F.col("label").alias("y"), F.col("predicted_rate").alias("p")))
    m = metrics.first().asDict()
    feats = [c for c in K.FEATURE_COLUMNS if c in train_f.columns]
    M.save_model(model, model_path, m, feats, [c for c in feats if c in K.CATEGORICAL_FEATURES], spark)
    FE.company_stats(train).write.mode("overwrite").parquet(f"{model_path}/company_stats")
    report = tf.agg(F.count(F.lit(1)).alias("training_records"),
                    F.countDistinct("company_cvr").alias("training_companies"))
    return report.select("*", *[F.lit(v).alias(k) for k, v in m.items()])


def predict_from_files(spark: SparkSession, requests_path: str, model_path: str | None = None,
                       multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns (predictions for valid requests, validation result per request)."""
    req = files.read_requests(spark, requests_path, multiline=multiline)
    checked = S.validate_requests(req)
    valid = req.join(checked.filter("is_valid").select("request_id"), "request_id", "left_semi")
    model, stats = None, None
    if model_path:
        model, _ = M.load_model(model_path, spark)
        if model is not None:
            try:
                stats = spark.read.parquet(f"{model_path}/company_stats")
            except Exception:  # statistics are optional; defaults apply
                stats = None
    return M.score_requests(valid, model, stats), checked
