"""Training, prediction, importances and persistence with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PACKAGE_FEATURES
from .aggregates import class_weights
from .boosting import train_boosting
from .features import assemble_features


# The models that train_package_models fits unless told which.
KINDS = ("random_forest", "gradient_boosting", "logistic_regression")


def train_package_models(
    df: DataFrame,
    features: Sequence[str] = tuple(PACKAGE_FEATURES),
    label: str = "label",
    seed: int = 42,
    trees: int = 100,
    rounds: int = 100,
    iterations: int = 1000,
    kinds: Sequence[str] = KINDS,
) -> dict[str, object]:
    """Random forest, gradient boosting and logistic regression on rows labelled 0 or 1.

    Only the models named in ``kinds`` are fitted.
    Gradient boosting has trees of depth 3, sees 0.7 of the rows and 0.4 of the features per tree and
    has L1 and L2 penalties of 0.2 (``boosting``); the others are Spark's.
    """
    train = assemble_features(df.filter(F.col(label).isin(0, 1)), features).select(
        "features", F.col(label).cast("double").alias("label")
    )
    models = {
        "random_forest": RandomForestClassifier(numTrees=trees, seed=seed),
        "logistic_regression": LogisticRegression(maxIter=iterations),
    }
    fit = {name: model.fit for name, model in models.items()}
    fit["gradient_boosting"] = lambda rows: train_boosting(rows, rounds, depth=3, rows=0.7, columns=0.4, seed=seed)
    # Every estimator passes over the rows several times; the features are computed once.
    train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {name: fit[name](train) for name in kinds}
    finally:
        train.unpersist()


def train_code_classifier(
    df: DataFrame,
    tokens: str = "tokens",
    label: str = "label_idx",
    buckets: int = 1 << 16,
    iterations: int = 50,
    weighted: bool = True,
) -> PipelineModel:
    """Multiclass code classifier over hashed tokens; rare classes weigh more.

    The weights, one per class, are a map that the plan reads as a scalar; the token rows are not joined.
    """
    train = df.withColumn("label", F.col(label).cast("double"))
    if weighted:
        weights = class_weights(df, label).agg(F.map_from_entries(F.collect_list(F.struct("label", "weight")))).scalar()
        train = train.withColumn("weight", F.element_at(weights, F.col(label)))
    model = Pipeline(
        stages=[
            HashingTF(inputCol=tokens, outputCol="features", numFeatures=buckets),
            LogisticRegression(maxIter=iterations, **({"weightCol": "weight"} if weighted else {})),
        ]
    )
    return model.fit(train)


def predict(
    df: DataFrame, model: object, out: str = "is_malicious", confidence: str = "confidence"
) -> DataFrame:
    """0/1 (or class index) prediction with the probability of the predicted class."""
    scored = model.transform(df)
    best = F.array_max(vector_to_array("probability"))
    return scored.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("prediction").cast("int").alias(out),
        best.alias(confidence),
    )


def predict_packages(
    df: DataFrame,
    model: object,
    features: Sequence[str] = tuple(PACKAGE_FEATURES),
    out: str = "is_malicious",
    confidence: str = "xgboost_confidence",
) -> DataFrame:
    return predict(assemble_features(df, features), model, out, confidence).drop("features")


def feature_importance(
    df: DataFrame, model: object, features: Sequence[str] = tuple(PACKAGE_FEATURES)
) -> DataFrame:
    """Importance per feature, largest first; one row per feature of the fitted model."""
    values = [(name, float(v)) for name, v in zip(features, model.featureImportances.toArray())]
    rows = df.sparkSession.createDataFrame(values, "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel | object, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type, path: str) -> object:
    """Load a fitted model of class ``kind``, e.g. ``PipelineModel``."""
    return kind.load(path)

