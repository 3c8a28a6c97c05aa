"""Selection-rate model: MLlib pipeline training, persistence and scoring.

The regressor is boosted symmetric trees with a leaf penalty and early stopping with
patience (``boosting``); ``engine="mllib"`` takes MLlib's ``GBTRegressor`` in a pipeline with scaling, selection
and interactions instead. Both fit RMSE on ``selection_rate``. High-cardinality categoricals (gift ids, companies) are
target-encoded on the training part only, by an aggregate and joins: the table of
encodings is a DataFrame with one row per (column, value), stored beside the pipeline, and
no list of values ever reaches the driver. (The ``onehot`` and ``label`` encodings
index values on the driver and are for columns of few values.) Training rows get ordered
encodings, in which no row sees its own label; validation and scoring rows get those of all
training rows. MLlib's own early stopping, through ``validationIndicatorCol``, has no patience counter.
"""

from __future__ import annotations

import datetime as _dt
import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from dataclasses import dataclass

from pyspark.ml.feature import (FeatureHasher, MinMaxScaler, OneHotEncoder, RobustScaler, StandardScaler,
                                StringIndexer, UnivariateFeatureSelector, VectorAssembler)
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from giftlens import constants as K
from giftlens.functions.numeric import round_half_even
from giftlens.operators import boosting
from giftlens.operators.boosting import BoostedTrees

TARGET = "selection_rate"


def model_stages(categorical: list[str], numeric: list[str], encoding: str = "target",
                   scaling: str | None = None, max_features: int | None = None,
                   interaction_features: int = 0, max_iter: int = K.GBT_ITERATIONS,
                   step_size: float = K.GBT_LEARNING_RATE, max_depth: int = K.GBT_DEPTH,
                   seed: int = K.GBT_SEED, validation_tol: float = 0.01,
                   validation_col: str | None = "is_validation") -> Pipeline:
    """M7 + G1 (encoding: target / onehot / label) + G2 (scaling: standard /
    minmax / robust) + G3 (``max_features`` by F-test) + G5 (hashed
    pairwise interactions of the categoricals, ``interaction_features`` buckets; the frame
    holds one column per pair, see :func:`with_pairs`)."""
    stages = []
    if encoding == "target":
        enc = [f"{c}__te" for c in categorical]  # joined by TargetEncodings before the pipeline
    else:
        idx = [f"{c}__idx" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep"))
        enc = idx
        if encoding == "onehot":
            enc = [f"{c}__oh" for c in categorical]
            stages.append(OneHotEncoder(inputCols=idx, outputCols=enc, handleInvalid="keep"))
    inputs = enc + numeric
    if interaction_features:
        stages.append(FeatureHasher(inputCols=pair_columns(categorical), outputCol="interactions",
                                    numFeatures=interaction_features))
        inputs = inputs + ["interactions"]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw_features", handleInvalid="keep"))
    feat = "raw_features"
    if scaling:
        scaler = {"standard": StandardScaler, "minmax": MinMaxScaler, "robust": RobustScaler}[scaling]
        stages.append(scaler(inputCol=feat, outputCol="scaled_features"))
        feat = "scaled_features"
    if max_features:
        stages.append(UnivariateFeatureSelector(featuresCol=feat, outputCol="selected_features", labelCol="label",
                                                selectionMode="numTopFeatures")
                      .setFeatureType("continuous").setLabelType("continuous")
                      .setSelectionThreshold(max_features))
        feat = "selected_features"
    gbt = GBTRegressor(featuresCol=feat, labelCol="label", maxIter=max_iter, stepSize=step_size,
                       maxDepth=max_depth, seed=seed, lossType="squared", maxBins=64,
                       validationTol=validation_tol, checkpointInterval=10)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    stages.append(gbt)
    return Pipeline(stages=stages)


def pair_columns(categorical: list[str]) -> list[str]:
    return [f"{a}__x__{b}" for i, a in enumerate(categorical) for b in categorical[i + 1:]]


def with_pairs(df: DataFrame, categorical: list[str]) -> DataFrame:
    """One text column for every pair of categorical columns."""
    return df.withColumns({f"{a}__x__{b}": F.concat_ws("\u0001", F.col(a), F.col(b))
                           for i, a in enumerate(categorical) for b in categorical[i + 1:]})


@dataclass
class TargetEncodings:
    """Smoothed mean label per (column, value), as a table; values not seen in training get the overall mean."""

    table: DataFrame  # column_name, value, encoded
    prior: float

    @staticmethod
    def fit(train: DataFrame, categorical: list[str], smoothing: float = 10.0) -> "TargetEncodings":
        from giftlens.session import cut_lineage
        prior = train.agg(F.avg("label")).first()[0] or 0.0  # one number
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in categorical]))
        table = (train.select("label", cells.alias("x")).groupBy("x.column_name", "x.value")
                 .agg(F.sum("label").alias("s"), F.count("label").alias("n"))
                 .select("column_name", "value", ((F.col("s") + prior * smoothing) / (F.col("n") + smoothing)).alias("encoded")))
        return TargetEncodings(cut_lineage(table), prior)

    def apply(self, df: DataFrame, categorical: list[str]) -> DataFrame:
        """Adds ``<column>__te`` to every row: one equi-join per column (AQE broadcasts the small ones)."""
        for c in categorical:
            t = self.table.filter(F.col("column_name") == c).select(F.col("value").alias(c), F.col("encoded").alias(f"{c}__te"))
            df = df.join(t, c, "left").withColumn(f"{c}__te", F.coalesce(f"{c}__te", F.lit(self.prior)))
        return df


@dataclass
class RateModel:
    """A fitted pipeline with the encodings that its input needs."""

    pipeline: PipelineModel | BoostedTrees
    categorical: list[str]
    encodings: TargetEncodings | None
    pairs: bool = False

    def transform(self, frame: DataFrame) -> DataFrame:
        if self.pairs:
            frame = with_pairs(frame, self.categorical)
        if self.encodings is not None:
            frame = self.encodings.apply(frame, self.categorical)
        return self.pipeline.transform(frame)


def typed_features(df: DataFrame, cols: list[str]) -> list:
    """P5: categoricals as strings (null -> NONE), numerics parsed (bad -> 0)."""
    from giftlens.functions.cleaning import lenient_double
    return [F.coalesce(F.col(c).cast("string"), F.lit(K.MISSING)).alias(c) if c in K.CATEGORICAL_FEATURES
            else lenient_double(F.col(c)).alias(c) for c in cols]


def model_frame(featured: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """M3: the feature columns present, typed; ``label`` = selection rate."""
    from giftlens.functions.cleaning import lenient_double
    cols = [c for c in K.FEATURE_COLUMNS if c in featured.columns]
    cat = [c for c in cols if c in K.CATEGORICAL_FEATURES]
    num = [c for c in cols if c not in K.CATEGORICAL_FEATURES]
    keep = [c for c in ("is_validation",) if c in featured.columns]
    out = featured.select(*typed_features(featured, cols),
                          lenient_double(F.col(TARGET)).alias("label"),
                          lenient_double(F.col("exposure"), 1.0).alias("exposure"), *keep)
    return out, cat, num


#: Parameters that only the MLlib pipeline has: naming one selects it.
MLLIB_ONLY = {"encoding", "scaling", "max_features", "interaction_features", "max_iter", "step_size", "max_depth", "seed", "validation_tol",
              "validation_col"}


def train_model(train: DataFrame, validation: DataFrame, engine: str | None = None, **params) -> tuple[RateModel, DataFrame]:
    """M7: fit on ``train`` with early stopping on ``validation``; returns the
    model and the validation predictions (clamped to [0, 1]). ``engine`` is ``trees`` (parameters of
    :func:`boosting.fit`) or ``mllib`` (those of :func:`model_stages`); by default what the parameters belong to."""
    from giftlens.session import cut_lineage
    if engine is None:
        engine = "mllib" if MLLIB_ONLY & set(params) else "trees"
    if engine == "trees":
        return _train_trees(train, validation, **params)
    t = train.withColumn("is_validation", F.lit(False))
    v = validation.withColumn("is_validation", F.lit(True))
    data, cat, num = model_frame(t.unionByName(v))
    data = cut_lineage(data)  # the encodings, the fit and the predictions read it
    pairs = bool(params.get("interaction_features"))
    encodings = None
    if params.get("encoding", "target") == "target":
        encodings = TargetEncodings.fit(data.filter(~F.col("is_validation")), cat)
    encoded = with_pairs(data, cat) if pairs else data
    encoded = cut_lineage(encodings.apply(encoded, cat)) if encodings else encoded
    model = RateModel(model_stages(cat, num, **params).fit(encoded), cat, encodings, pairs)
    preds = predict(model, data.filter(F.col("is_validation")))
    return model, preds


def _train_trees(train: DataFrame, validation: DataFrame, keep_features: int | None = None, **params) -> tuple[RateModel, DataFrame]:
    """With ``keep_features``, only that many columns are used, chosen on training rows (G3, ``selection``)."""
    from giftlens.operators.features import ordered_target_stats
    from giftlens.operators.selection import select_features
    from giftlens.session import cut_lineage
    both = train.withColumn("is_validation", F.lit(False)).unionByName(validation.withColumn("is_validation", F.lit(True)))
    data, cat, num = model_frame(both)
    data = cut_lineage(data.withColumn("_row", F.monotonically_increasing_id()))  # stored: the number stays the row's own
    fitted, held = data.filter(~F.col("is_validation")), data.filter(F.col("is_validation"))
    if keep_features:
        kept = select_features(fitted, cat + num, keep_features)
        cat, num = [c for c in cat if c in kept], [c for c in num if c in kept]
    encodings = TargetEncodings.fit(fitted, cat, smoothing=1.0) if cat else TargetEncodings(fitted.sparkSession.createDataFrame(
        [], "column_name string, value string, encoded double"), 0.0)
    ordered = ordered_target_stats(fitted, cat, "label", ["_row"], prior=encodings.prior, stored=True) if cat else fitted
    columns = [f"{c}__te" for c in cat] + num
    own = ordered.select(*[F.col(f"{c}_ts").alias(f"{c}__te") for c in cat], *num, "label", "is_validation")
    rows = own.unionByName(encodings.apply(held, cat).select(*own.columns))
    model = RateModel(boosting.fit(cut_lineage(rows), columns, **params), cat, encodings)
    return model, predict(model, held.drop("_row"))


def predict(model: RateModel, frame: DataFrame) -> DataFrame:
    """M8 core: model rate clamped to [0, 1] (P19) and the expected count."""
    out = model.transform(frame)
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    return out.withColumn("predicted_rate", rate).withColumn("expected_count", rate * F.col("exposure"))


def save_model(model: RateModel, path: str, metrics: dict, features: list[str],
               categorical: list[str], spark: SparkSession) -> None:
    """Pipeline + one-row JSON metadata (type, target, loss, time,
    features, categoricals, metrics)."""
    trees = isinstance(model.pipeline, BoostedTrees)
    if trees:
        model.pipeline.save(f"{path}/model", spark)
    else:
        model.pipeline.write().overwrite().save(f"{path}/model")
    if model.encodings is not None:
        model.encodings.table.write.mode("overwrite").parquet(f"{path}/encodings")
    meta = {"model_type": "boosted symmetric trees (RMSE)" if trees else "GBTRegressor (RMSE)", "engine": "trees" if trees else "mllib", "target": TARGET, "loss_function": "RMSE",
            "architecture": "target-encoded categoricals, boosted trees (squared loss) on selection rate",
            "training_timestamp": _dt.datetime.now(_dt.timezone.utc).isoformat(),
            "features_used": features, "categorical_features": categorical,
            "model_columns": model.categorical, "pairs": model.pairs,
            "prior": model.encodings.prior if model.encodings is not None else None,
            "performance_metrics": json.dumps(metrics)}
    spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str, spark: SparkSession) -> tuple[RateModel | None, dict]:
    """(model, metadata); (None, {}) when nothing is stored — callers then
    score with the rules (M9)."""
    try:
        meta = spark.read.json(f"{path}/metadata").first().asDict()
        if meta.get("engine") == "trees":
            pipeline = BoostedTrees.load(f"{path}/model", spark)
        else:
            pipeline = PipelineModel.load(f"{path}/model")
    except (AnalysisException, Py4JJavaError) as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "Input path does not exist", "does not exist")):
            raise  # a stored but broken model is an error, not a reason to fall back
        return None, {}
    encodings = None
    if meta.get("prior") is not None:
        encodings = TargetEncodings(spark.read.parquet(f"{path}/encodings"), float(meta["prior"]))
    return RateModel(pipeline, list(meta["model_columns"]), encodings, bool(meta.get("pairs"))), meta


def model_info(spark: SparkSession, model: RateModel | None, meta: dict) -> DataFrame:
    """One-row summary of the loaded model."""
    row = {"model_loaded": model is not None, "model_type": meta.get("model_type", "rules"),
           "target": meta.get("target", TARGET), "training_timestamp": meta.get("training_timestamp", "Unknown"),
           "architecture": meta.get("architecture", "boosted trees on selection rate" if model is not None else "rules"),
           "num_features": len(meta.get("features_used", []) or []),
           "num_categorical_features": len(meta.get("categorical_features", []) or [])}
    return spark.createDataFrame([row])


def score_requests(requests: DataFrame, model: RateModel | None, company_stats: DataFrame | None = None,
                   shop_map: DataFrame | None = None) -> DataFrame:
    """M8 + M10 + J12: per requested gift and gender build the feature row
    (gift attributes from its description, company features from stored
    statistics with defaults for unseen companies), predict the rate, clamp,
    multiply by the head count and sum over genders. Falls back to the rules
    (M9) without a model."""
    from giftlens.operators.scoring import classify_description, confidence, map_company_shop, score_fallback
    if model is None:
        return score_fallback(requests)
    # a request may list a gift twice: each line keeps its own row through this number
    r = requests.withColumn("_line", F.monotonically_increasing_id()).withColumn(
        "_a", classify_description(F.col("description")))
    r = map_company_shop(r, shop_map)
    rows = r.withColumn("employee_gender", F.explode(F.array(F.lit("male"), F.lit("female"))))
    rows = rows.withColumn("exposure", F.when(F.col("employee_gender") == "male", F.col("male_count"))
                           .otherwise(F.col("female_count")).cast("double"))
    rows = rows.select("*", *[F.col("_a." + c).alias(c) for c in K.PRODUCT_COLUMNS],
                       F.col("cvr").alias("company_cvr"), F.col("product_id").alias("gift_id"))
    if company_stats is not None:
        rows = rows.join(company_stats, "company_cvr", "left")
    for c, v in K.DEFAULT_COMPANY_FEATURES.items():
        if c in rows.columns:
            rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
        else:
            rows = rows.withColumn(c, F.lit(v))
    rows = rows.withColumn("is_company_most_frequent_main_category",
                           (F.col("product_main_category") == F.col("company_most_frequent_main_category")).cast("int"))
    frame = rows.select("_line", "request_id", "cvr", "product_id", "male_count", "female_count", "exposure",
                        *typed_features(rows, K.FEATURE_COLUMNS))
    p = predict(model, frame.withColumn("label", F.lit(0.0)))
    rate = F.when(F.col("exposure") == 0, F.lit(0.0)).otherwise(F.col("predicted_rate"))
    p = p.withColumn("rate", rate).withColumn("expected", F.col("rate") * F.col("exposure"))
    agg = p.groupBy("_line", "request_id", "cvr", "product_id").agg(
        F.max(F.when(F.col("employee_gender") == "male", F.col("rate"))).alias("male_rate"),
        F.max(F.when(F.col("employee_gender") == "female", F.col("rate"))).alias("female_rate"),
        F.sum("expected").alias("_qty"), F.sum("exposure").alias("total_exposure"))
    return agg.select("request_id", "cvr", "product_id", "male_rate", "female_rate",
                      round_half_even(F.col("_qty"), 2).alias("expected_qty"),
                      confidence([F.col("male_rate"), F.col("female_rate")]).alias("confidence_score"),
                      F.col("total_exposure").cast("long").alias("total_exposure"))


def grid_search(featured: DataFrame, folds: DataFrame, grid: list[dict], n_folds: int = K.CV_FOLDS,
                **fixed) -> DataFrame:
    """Mean validation R² per parameter set over the company folds (train
    on the other folds, score the fold). The loops run over the small grid and
    fold count on the driver; every fit and metric is a Spark job. Company
    features are recomputed per fold from its training part (no leakage)."""
    from giftlens.operators.features import company_features
    from giftlens.operators.quality import regression_metrics
    spark = featured.sparkSession
    base = featured.drop(*[c for c in K.COMPANY_FEATURE_COLUMNS if c in featured.columns]).join(folds, "company_cvr")
    rows = []
    for i, params in enumerate(grid):
        for k in range(n_folds):
            train = base.filter(F.col("fold") != k).drop("fold")
            val = base.filter(F.col("fold") == k).drop("fold")
            if val.limit(1).count() == 0:
                continue
            _, preds = train_model(company_features(train), company_features(val, source=train),
                                   **{**fixed, **params})
            r2 = regression_metrics(preds.select(F.col("label").alias("y"),
                                                 F.col("predicted_rate").alias("p"))).first()["r2"]
            rows.append((i, json.dumps(params, sort_keys=True), k, r2))
    df = spark.createDataFrame(rows, "grid_index int, params string, fold int, r2 double")
    return df.groupBy("grid_index", "params").agg(F.avg("r2").alias("cv_r2_mean"), F.count(F.lit(1)).alias("folds"))


def cross_validate(featured: DataFrame, folds: DataFrame, n_folds: int = K.CV_FOLDS, **params) -> DataFrame:
    """M5 + A21: per company fold the metrics of the model trained on the other
    folds, with company features recomputed from those alone. The loop is over
    the few folds; every fit and metric is a Spark job. Empty folds are skipped."""
    from giftlens.operators.features import company_features
    from giftlens.operators.quality import regression_metrics
    base = featured.drop(*[c for c in K.COMPANY_FEATURE_COLUMNS if c in featured.columns]).join(folds, "company_cvr")
    out = None
    for k in range(n_folds):
        train = base.filter(F.col("fold") != k).drop("fold")
        val = base.filter(F.col("fold") == k).drop("fold")
        if not val.limit(1).count():
            continue
        _, preds = train_model(company_features(train), company_features(val, source=train), **params)
        m = regression_metrics(preds.select(F.col("label").alias("y"), F.col("predicted_rate").alias("p")))
        m = m.select(F.lit(k).alias("fold"), *m.columns)
        out = m if out is None else out.unionByName(m)
    return out


def fit_poisson(train: DataFrame, validation: DataFrame, reg_param: float = 0.1, max_iter: int = 25,
                eps: float = 1e-8):
    """Poisson regression of the selection count with ln(exposure) as offset, on log target
    encodings. Returns (model, encodings, validation rows with ``label`` (count) and ``expected_count``)."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    from giftlens.operators.features import log_exposure
    from giftlens.session import cut_lineage
    both = train.withColumn("is_validation", F.lit(False)).unionByName(validation.withColumn("is_validation", F.lit(True)))
    data, cat, num = model_frame(both)
    data = data.withColumn("rate", F.col("label")).withColumn("label", F.round(F.col("rate") * F.col("exposure")))
    # without exposure there is nothing to count
    data = cut_lineage(log_exposure(data.filter(F.col("exposure") > 0), eps))
    encodings = TargetEncodings.fit(data.filter(~F.col("is_validation")).withColumn("label", F.col("rate")), cat)
    data = encodings.apply(data, cat)
    # log rates are linear in log encodings: the link's own scale
    data = data.withColumns({f"{c}__te": F.log(F.greatest(F.col(f"{c}__te"), F.lit(1e-3))) for c in cat})
    inputs = [f"{c}__te" for c in cat]
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol="label",
                                      offsetCol="log_exposure", regParam=reg_param, maxIter=max_iter)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="raw_features", handleInvalid="keep"),
                                StandardScaler(inputCol="raw_features", outputCol="features"), glm])
    model = pipeline.fit(data.filter(~F.col("is_validation")))
    scored = model.transform(data.filter(F.col("is_validation"))).withColumn("expected_count", F.col("prediction"))
    return model, encodings, scored


def feature_scores(frame: DataFrame, columns: list[str], label: str = "label", bins: int = 8) -> DataFrame:
    """Chi-square and mutual information (natural log) between each categorical column and the label cut at its
    quantiles: (feature, chi2, mutual_information, n). Counts per (feature, value, bin) are one aggregate over
    all columns; the cut points are the only numbers that come back."""
    cuts = sorted(set(frame.approxQuantile(label, [k / bins for k in range(1, bins)], 0.001)))
    y = sum([(F.col(label) > c).cast("int") for c in cuts], F.lit(0))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(K.MISSING))
                                         .alias("value")) for c in columns]))
    joint = (frame.select(y.alias("bin"), cells.alias("x")).groupBy("x.feature", "x.value", "bin")
             .agg(F.count(F.lit(1)).cast("double").alias("n_xy")))
    by_value = joint.groupBy("feature", "value").agg(F.sum("n_xy").alias("n_x"))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n_xy").alias("n_y"))
    total = joint.groupBy("feature").agg(F.sum("n_xy").alias("n"))
    j = joint.join(by_value, ["feature", "value"]).join(by_bin, ["feature", "bin"]).join(total, "feature")
    expected = F.col("n_x") * F.col("n_y") / F.col("n")
    # cells without rows add their expected count: sum over all cells of (o - e)^2 / e = sum over o of o^2 / e, minus n
    return (j.groupBy("feature").agg((F.sum(F.col("n_xy") * F.col("n_xy") / expected) - F.max("n")).alias("chi2"),
                                     F.sum(F.col("n_xy") / F.col("n") * F.log(F.col("n_xy") / expected))
                                     .alias("mutual_information"), F.max("n").cast("long").alias("n")))
