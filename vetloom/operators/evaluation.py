"""Confusion counts and classification report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(
    df: DataFrame, n_classes: int, truth: str = "truth", prediction: str = "prediction"
) -> DataFrame:
    """``(truth, prediction, n)`` for every pair of classes, absent pairs with 0.

    The zero cells come from a range of ``n_classes`` squared numbers, so nothing is cross-joined.
    """
    cell = F.col("id")
    grid = df.sparkSession.range(n_classes * n_classes).select(
        F.floor(cell / F.lit(n_classes)).cast("int").alias("truth"),
        F.pmod(cell, F.lit(n_classes)).cast("int").alias("prediction"),
        F.lit(0).cast("bigint").alias("n"),
    )
    counts = df.groupBy(
        F.col(truth).cast("int").alias("truth"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count("*").alias("n"))
    return grid.unionByName(counts).groupBy("truth", "prediction").agg(F.sum("n").alias("n"))


def confusion_table(
    df: DataFrame, n_classes: int, truth: str = "truth", prediction: str = "prediction"
) -> DataFrame:
    """The matrix with one column ``p<i>`` per predicted class."""
    cells = confusion_matrix(df, n_classes, truth, prediction)
    columns = [
        F.sum(F.when(F.col("prediction") == i, F.col("n"))).alias(f"p{i}")
        for i in range(n_classes)
    ]
    return cells.groupBy("truth").agg(*columns)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(
    df: DataFrame, truth: str = "truth", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, and the three overall rows.

    Rows are counted once; everything after that works on at most one row per pair of classes.
    """
    counts = df.groupBy(F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    roles = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("t").cast("string").alias("label"), F.col("n").alias("support"),
                    zero.alias("predicted"), hit.alias("tp"),
                ),
                F.struct(
                    F.col("p").cast("string").alias("label"), zero.alias("support"),
                    F.col("n").alias("predicted"), zero.alias("tp"),
                ),
            )
        )
    )
    classes = roles.groupBy("label").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("tp").alias("tp"),
    )
    classes = classes.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("predicted")),
            "recall": _ratio(F.col("tp"), F.col("support")),
        }
    ).withColumn(
        "f1",
        _ratio(
            2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
        ),
    )
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    accuracy = _ratio(F.sum("tp"), total)
    overall = classes.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"), *[accuracy.alias(m) for m in measures],
                total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in measures],
                total.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *[_ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in measures],
                total.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return classes.select("label", *measures, "support").unionByName(overall)


def label_names(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Replace class indexes in ``column`` by their names."""
    literal = F.array(*map(F.lit, names))
    return df.withColumn(column, F.get(literal, F.col(column).cast("int")))
