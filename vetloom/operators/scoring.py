"""From window scores to file verdicts.

Window tables have ``file_id, chunk_idx`` and either one ``prob`` or ``class_idx, prob``. One file
may hold a large part of all windows: every aggregate here combines map-side, and the only join on
``file_id`` against the window table is spread over blocks of the window index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BENIGN_ALIASES, CLEAN_INDEX
from ..functions.vectors import softmax

# Windows of one file that share a join key in ``with_chunk_count``.
BLOCK = 65_536


def with_chunk_count(
    df: DataFrame, key: str = "file_id", idx: str = "chunk_idx", block: int = BLOCK
) -> DataFrame:
    """Add ``n_chunks``, the number of windows of the file.

    A table that already carries it is returned as it is. Otherwise the counts are joined back on
    ``(file, idx div block)``: window indexes are dense, so the block needs no salt lookup, a file
    of any size is spread over many keys, and an ordinary file has exactly one.
    """
    if "n_chunks" in df.columns:
        return df
    counts = df.groupBy(key).agg(F.count("*").alias("n_chunks"), F.max(idx).alias("_last"))
    blocks = counts.select(
        key,
        F.col("n_chunks").cast("int").alias("n_chunks"),
        F.explode(
            F.sequence(F.lit(0), F.floor(F.col("_last") / F.lit(block)).cast("int"))
        ).alias("_block"),
    )
    keyed = df.withColumn("_block", F.floor(F.col(idx) / F.lit(block)).cast("int"))
    return keyed.join(blocks, [key, "_block"]).drop("_block")


def triangular_weight(idx: str = "chunk_idx", n: str = "n_chunks") -> str:
    """SQL text: 1 at the middle window, falling to 0 at both ends, at least 0.1."""
    centre = f"(({n} - 1) / 2D)"
    return f"greatest(0.1D, 1D - abs({idx} - {centre}) / if({n} > 1, {centre}, 1D))"


def exponential_weight(idx: str = "chunk_idx", n: str = "n_chunks") -> str:
    return f"exp(-0.1D * abs({idx} - {n} / 2D))"


def chunk_position_weights(df: DataFrame, key: str = "file_id") -> DataFrame:
    """Index, count and both position weights of every window."""
    df = with_chunk_count(df, key)
    return df.withColumns(
        {"w_triangular": F.expr(triangular_weight()), "w_exponential": F.expr(exponential_weight())}
    )


def agg_triangular(
    df: DataFrame, key: str = "file_id", probs: Sequence[str] = ("prob",)
) -> DataFrame:
    """0.7 of the centre-weighted mean and 0.3 of the maximum, for each probability column."""
    w = triangular_weight()
    scores = [
        F.expr(
            f"0.7D * sum({p} * {w}) / greatest(sum({w}), 1e-8D) + 0.3D * max({p})"
        ).alias(p)
        for p in probs
    ]
    return with_chunk_count(df, key).groupBy(key).agg(*scores)


def agg_exponential(df: DataFrame, key: str = "file_id") -> DataFrame:
    """Per class: 0.6 of the weighted mean and 0.4 of the maximum; need not sum to 1."""
    w = exponential_weight()
    score = F.expr(f"0.6D * sum(prob * {w}) / sum({w}) + 0.4D * max(prob)")
    return with_chunk_count(df, key).groupBy(key, "class_idx").agg(score.alias("prob"))


def agg_max(df: DataFrame, key: str = "file_id", files: DataFrame | None = None) -> DataFrame:
    """Maximum over windows; with ``files``, a file without windows gets 0."""
    scores = df.groupBy(key).agg(F.max("prob").alias("prob"))
    if files is None:
        return scores
    return files.select(key).join(scores, key, "left").withColumn(
        "prob", F.coalesce("prob", F.lit(0.0))
    )


def agg_mean_logits(df: DataFrame, key: str = "file_id") -> DataFrame:
    """Mean logit per class over the windows, then softmax and the best class.

    After the first aggregate a file has one row per class, so the second one gathers a class list
    and never a window list.
    """
    means = df.groupBy(key, "class_idx").agg(F.avg("logit").alias("logit"))
    rows = means.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("class_idx", "logit")))["logit"].alias("logits")
    )
    best = F.array_max(
        F.transform("probs", lambda p, i: F.struct(p.alias("prob"), (-i).alias("neg")))
    )
    return (
        rows.select(key, softmax(F.col("logits")).alias("probs"))
        .withColumn("_best", best)
        .select(key, (-F.col("_best.neg")).alias("top_class"), F.col("_best.prob").alias("top_prob"), "probs")
    )


def verdict(
    df: DataFrame,
    threshold: float = 0.5,
    strict: bool = True,
    positive: str = "Vulnerable",
    negative: str = "Safe",
    prob: str = "prob",
) -> DataFrame:
    """``flagged`` and ``status``: above the threshold, or at least it when not ``strict``."""
    p = F.col(prob)
    flag = (p > threshold) if strict else (p >= threshold)
    return df.withColumns(
        {"flagged": flag, "status": F.when(flag, positive).otherwise(negative)}
    )


def vulnerability_probability(
    df: DataFrame, key: str = "file_id", clean: int = CLEAN_INDEX
) -> DataFrame:
    """1 - P(clean), or the best class probability where there is no clean class."""
    is_clean = F.col("class_idx") == clean
    return df.groupBy(key).agg(
        F.coalesce(1.0 - F.max(F.when(is_clean, F.col("prob"))), F.max("prob")).alias("prob")
    )


def rank_in_class(df: DataFrame, key: str = "file_id") -> DataFrame:
    """Rank of each class within its file; a file has at most one row per class."""
    order = Window.partitionBy(key).orderBy(F.desc("prob"), "class_idx")
    return df.withColumn("class_rank", F.row_number().over(order))


def top_k_classes(df: DataFrame, k: int = 3, key: str = "file_id") -> DataFrame:
    """The ``k`` best classes, best first, as one array of (class_idx, prob)."""
    best = rank_in_class(df, key).filter(F.col("class_rank") <= k)
    entry = F.struct("class_rank", "class_idx", "prob")
    rows = best.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("top"))
    return rows.withColumn(
        "top", F.transform("top", lambda e: F.struct(e["class_idx"], e["prob"]))
    )


def top_cwe(df: DataFrame, key: str = "file_id", clean: int = CLEAN_INDEX) -> DataFrame:
    """Best class, or the runner-up where the clean class leads.

    Both cases are the best class among the others, so one map-side combining aggregate suffices;
    a file that has only the clean class keeps it.
    """
    entry = F.struct(F.col("prob"), (-F.col("class_idx")).alias("neg"))
    other = F.max(F.when(F.col("class_idx") != clean, entry))
    rows = df.groupBy(key).agg(F.coalesce(other, F.max(entry)).alias("e"))
    return rows.select(
        key, (-F.col("e.neg")).alias("class_idx"), F.col("e.prob").alias("class_prob")
    )


def label_vulnerable(flagged: Column, name: Column, otherwise: str = "Benign") -> Column:
    """A class name only for flagged files."""
    return F.when(flagged & name.isNotNull(), name).otherwise(otherwise)


def decode_labels(
    df: DataFrame, labels: DataFrame | None, config: DataFrame | None = None
) -> DataFrame:
    """Add ``class_name``: from the label file, else the model's list, else ``class_<i>``."""
    names = []
    for i, source in enumerate((labels, config)):
        if source is not None:
            dim = source.select("class_idx", F.col("name").alias(f"_name{i}"))
            df = df.join(dim, "class_idx", "left")
            names.append(f"_name{i}")
    fallback = F.concat(F.lit("class_"), F.col("class_idx").cast("string"))
    return df.withColumn("class_name", F.coalesce(*map(F.col, names), fallback)).drop(*names)


def two_stage_cwe(
    binary: DataFrame,
    multi: DataFrame | Callable[[DataFrame], DataFrame],
    key: str = "file_id",
    safe: str = "Safe",
) -> DataFrame:
    """Class label from the second model, asked only about what the first one flags.

    ``binary`` has ``flagged``; ``multi`` gives ``(key, cwe_label)``, as a table or as a scorer
    that receives the flagged rows.
    """
    flagged = binary.filter("flagged")
    second = multi(flagged) if callable(multi) else multi.join(flagged.select(key), key, "left_semi")
    labels = second.select(key, F.col("cwe_label").alias("_cwe"))
    out = binary.join(labels, key, "left")
    return out.withColumn(
        "cwe_label", F.when(F.col("flagged"), F.coalesce("_cwe", F.lit(safe))).otherwise(safe)
    ).drop("_cwe")


def benign_alias(col: Column) -> Column:
    return F.coalesce(col.cast("string").isin(BENIGN_ALIASES), F.lit(False))


def analyze_files(df: DataFrame, mode: str = "both", key: str = "file_id") -> DataFrame:
    """Nested verdicts; the side not asked for is false, ``is_safe`` means neither.

    Needs ``vul_flag, vul_prob, cwe_label`` and ``mal_flag, mal_prob``.
    """
    if mode not in ("both", "vul", "mal"):
        raise ValueError(f"unknown mode: {mode}")
    vul_on, mal_on = mode in ("both", "vul"), mode in ("both", "mal")

    def side(on: bool, flag: str, name: str, columns: dict[str, Column]) -> Column:
        hit = F.coalesce(F.col(flag), F.lit(False)) if on else F.lit(False)
        shown = [(c if on else F.lit(None).cast("string")).alias(n) for n, c in columns.items()]
        return F.struct(hit.alias(name), *shown)

    vul = side(
        vul_on, "vul_flag", "is_vulnerable",
        {
            "vulnerability_probability": F.col("vul_prob"),
            "vulnerability_status": F.when(F.col("vul_flag"), "Vulnerable").otherwise("Safe"),
            "cwe_label": F.when(F.col("vul_flag"), F.col("cwe_label")).otherwise("Safe"),
        },
    )
    mal = side(
        mal_on, "mal_flag", "is_malicious",
        {
            "malicious_probability": F.col("mal_prob"),
            "malicious_status": F.when(F.col("mal_flag"), "malicious").otherwise("Safe"),
        },
    )
    out = df.withColumns({"vulnerability_analysis": vul, "malicious_analysis": mal})
    return out.withColumn(
        "is_safe",
        ~(
            F.col("vulnerability_analysis.is_vulnerable")
            | F.col("malicious_analysis.is_malicious")
        ),
    )


def error_status(
    code: Column,
    n_tokens: Column,
    model_ready: Column,
    n_known: Column,
    label: Column,
    failed: Column | None = None,
) -> Column:
    """Reason why a package could not be scored, or null when it could."""
    ladder = (
        F.when(F.coalesce(F.regexp_replace(code, r"\s+", ""), F.lit("")) == "", "Empty Code")
        .when(F.coalesce(n_tokens, F.lit(0)) == 0, "parsing_error")
        .when(~F.coalesce(model_ready, F.lit(False)), "model_error")
        .when(F.coalesce(n_known, F.lit(0)) == 0, "embedding_error")
    )
    if failed is not None:
        ladder = ladder.when(F.coalesce(failed, F.lit(False)), "analysis_error")
    return ladder.when(label.isNull(), "label_decode_error")


def with_error_status(df: DataFrame, reason: str = "error_reason") -> DataFrame:
    """Rows with a reason stay, as ``Error`` with confidence 0 (kept for a failed label decode)."""
    bad = F.col(reason).isNotNull()
    keep = ~bad | (F.col(reason) == "label_decode_error")
    return df.withColumns(
        {
            "vulnerability_status": F.when(bad, "Error").otherwise(F.col("vulnerability_status")),
            "cwe_label": F.when(bad, F.col(reason)).otherwise(F.col("cwe_label")),
            "confidence": F.when(keep, F.col("confidence")).otherwise(0.0),
        }
    )


def positive_index(labels: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """One row: first class whose name holds a keyword, else 0, 1 or the last by class count."""
    name = F.lower("name")
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | F.contains(name, F.lit(keyword))
    n = F.count("*")
    last = F.when(n == 0, 1).when(n == 1, 0).otherwise(n - 1)
    return labels.agg(
        F.coalesce(F.min(F.when(hit, F.col("class_idx"))), last).cast("int").alias("positive_index")
    )


def class_prob_map(df: DataFrame, key: str = "file_id") -> DataFrame:
    """Top label, its probability and a class-to-probability map per file."""
    best = F.max(F.struct(F.col("prob"), (-F.col("class_idx")).alias("neg"), F.col("class_name")))
    rows = df.groupBy(key).agg(
        best.alias("b"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("class_name", "prob")))
        ).alias("probs"),
    )
    return rows.select(
        key, F.col("b.class_name").alias("label"), F.col("b.prob").alias("prob"), "probs"
    )


def score_windows(
    df: DataFrame,
    model: PipelineModel | Callable[[pd.Series], pd.Series],
    text: str = "text",
    prob: str = "prob",
    positive: int = 1,
) -> DataFrame:
    """Add a probability per window, from a fitted Spark ML model or from a batch function.

    A function receives one Arrow batch of texts; batches are sized by
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    if hasattr(model, "transform"):
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(df)
        return scored.select(
            *df.columns, vector_to_array("probability")[positive].alias(prob)
        )
    schema = T.StructType([*df.schema.fields, T.StructField(prob, T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{prob: model(batch[text]).astype("float64")})

    return df.mapInPandas(score, schema)
