"""Sampling, splits, training and evaluation."""

from pyspark.sql import functions as F

from vetloom.operators import boosting
from vetloom.operators import evaluation as ev
from vetloom.operators import models as ml
from vetloom.operators import sampling as op
from vetloom.operators.features import add_noise, package_features
from vetloom.operators.joins import join_code_verdicts
from vetloom.operators.tokens import word_tokens
from vetloom.session import scratch_dir, spread

from .registry import query

HASH = "md5(concat('42:', CAST({key} AS VARCHAR)))"
BY_QUALITY = f"row_number() OVER (PARTITION BY quality ORDER BY {HASH.format(key='doc_id')}, doc_id)"


@query("balanced_sample", f"""
WITH r AS (SELECT *, {BY_QUALITY} AS r FROM labels)
SELECT doc_id, quality, toxic FROM r
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def balanced_sample(t):
    return op.balanced_sample(t.labels, "quality", "doc_id")


@query("balanced_sample_events", f"""
WITH r AS (SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY {HASH.format(key='event_id')}, event_id) AS r
  FROM events)
SELECT event_id, event_type FROM r
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))""")
def balanced_sample_events(t):
    return op.balanced_sample(t.events.select("event_id", "event_type"), "event_type", "event_id")


@query("shuffle_rows", f"""
SELECT * FROM labels ORDER BY {HASH.format(key='doc_id')}, doc_id""")
def shuffle_rows(t):
    return op.shuffle_rows(t.labels, "doc_id")


@query("random_split", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {HASH.format(key='o_orderkey')}, o_orderkey)
  <= floor(count(*) OVER () * 8e-1 + 1e-9) THEN 'train' ELSE 'test' END AS part FROM orders""")
def random_split(t):
    return op.random_split(t.orders.select("o_orderkey"), "o_orderkey", 0.8)


@query("stratified_split", f"""
WITH r AS (SELECT *, {BY_QUALITY} AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, toxic, CASE WHEN r <= floor(n * 8e-1 + 1e-9) THEN 'train'
  WHEN r <= floor(n * 9e-1 + 1e-9) THEN 'val' ELSE 'test' END AS part FROM r""")
def stratified_split(t):
    return op.stratified_split(t.labels, "quality", "doc_id")


@query("stratified_split_fallback", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {HASH.format(key='doc_id')}, doc_id) AS r,
  count(*) OVER () AS n FROM labels)
SELECT doc_id, quality, toxic, CASE WHEN r <= floor(n * 8e-1 + 1e-9) THEN 'train'
  WHEN r <= floor(n * 9e-1 + 1e-9) THEN 'val' ELSE 'test' END AS part FROM r""")
def stratified_split_fallback(t):
    """No class is ever large enough, so the table is split as a whole."""
    return op.stratified_split(t.labels, "quality", "doc_id", min_per_class=1 << 60)


def _judged(t):
    return t.labels.select(
        F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("prediction")
    )


JUDGED = "j AS (SELECT quality AS truth, 1 - toxic AS prediction FROM labels)"


@query("confusion_matrix", f"""
WITH {JUDGED}, g AS (SELECT CAST(a.r AS INTEGER) AS truth, CAST(b.r AS INTEGER) AS prediction
  FROM (SELECT unnest(range(3)) AS r) a, (SELECT unnest(range(3)) AS r) b)
SELECT g.truth, g.prediction, count(j.truth) AS n FROM g LEFT JOIN j
  ON g.truth = j.truth AND g.prediction = j.prediction GROUP BY 1, 2""")
def confusion_matrix(t):
    return ev.confusion_matrix(_judged(t), 3)


@query("confusion_table", f"""
WITH {JUDGED} SELECT CAST(c AS INTEGER) AS truth,
  count(truth) FILTER (prediction = 0) AS p0, count(truth) FILTER (prediction = 1) AS p1,
  count(truth) FILTER (prediction = 2) AS p2
FROM (SELECT unnest(range(3)) AS c) LEFT JOIN j ON c = truth GROUP BY 1""")
def confusion_table(t):
    return ev.confusion_table(_judged(t), 3)


@query("classification_report", f"""
WITH {JUDGED}, c AS (SELECT unnest([0, 1]) AS k),
s AS (SELECT k, CAST(k AS VARCHAR) AS label, count(*) FILTER (truth = k) AS support,
    count(*) FILTER (prediction = k) AS predicted, count(*) FILTER (truth = k AND prediction = k) AS tp
  FROM c, j GROUP BY 1),
m AS (SELECT label, coalesce(tp / CAST(nullif(predicted, 0) AS DOUBLE), 0e0) AS precision,
    coalesce(tp / CAST(nullif(support, 0) AS DOUBLE), 0e0) AS recall, support, tp FROM s),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0e0), 0e0) AS f1 FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
  round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(t):
    return ev.classification_report(_judged(t))


def training_packages(t):
    """Packages with all features and a planted label the features can explain."""
    df = join_code_verdicts(package_features(t.packages, t.popular), t.verdicts)
    df = df.drop(
        "vulnerability_status_noisy", "cwe_label_noisy", "threat_level_noisy", "download_log_noisy"
    ).withColumns(
        {
            "vulnerability_status": F.col("vulnerability_status_numeric"),
            "cwe_label": F.col("cwe_label_numeric"),
            "threat_level": F.col("vulnerability_status_numeric") + F.col("cwe_label_numeric"),
            "label": (F.col("is_typo_like") | F.col("summary_low_entropy")).cast("int"),
        }
    )
    return add_noise(df, ["vulnerability_status", "cwe_label", "download_log", "threat_level"], ["name"])


def _package_models(t, kinds=ml.KINDS):
    """The packages with their ``part`` and the models fitted on the training part alone."""
    path, df = scratch_dir(t.spark, "packages"), training_packages(t)
    # The split, the fit and the predictions read the rows again; behind joins they would be worked out each time.
    df.write.parquet(path)
    df = t.spark.read.schema(df.schema).parquet(path)
    df = op.stratified_split(df, "label", "name", (0.8, 0.2), ("train", "test"))
    return df, ml.train_package_models(df.filter("part = 'train'"), kinds=kinds)


@query("train_package_models")
def train_package_models(t):
    """One row per model and held-out package: the predictions of all three fitted models."""
    df, models = _package_models(t)
    df = df.filter("part = 'test'")
    for name, model in models.items():
        df = ml.predict_packages(df, model, out=name, confidence=f"{name}_confidence")
    return df.unpivot(["name", "label"], list(models), "model", "prediction")


@query("predict")
def predict(t):
    df, models = _package_models(t, ["gradient_boosting"])
    return ml.predict_packages(df.filter("part = 'test'"), models["gradient_boosting"]).select(
        "name", "is_malicious", "xgboost_confidence"
    )


@query("feature_importance")
def feature_importance(t):
    df, models = _package_models(t, ["gradient_boosting"])
    return ml.feature_importance(df, models["gradient_boosting"])


@query("train_code_classifier")
def train_code_classifier(t):
    """Language of a held-out text from its tokens, standing in for the class of a file."""
    languages = F.array(*map(F.lit, ["en", "fr", "de", "es"]))
    docs = spread(t.documents).select(
        "doc_id",
        "text",
        F.greatest(F.array_position(languages, F.col("lang")) - 1, F.lit(0)).alias("label_idx"),
    )
    docs = op.stratified_split(docs, "label_idx", "doc_id", (0.8, 0.2), ("train", "test"))
    docs = docs.withColumn("tokens", word_tokens(F.col("text")))
    model = ml.train_code_classifier(docs.filter("part = 'train'"))
    return ml.predict(docs.filter("part = 'test'"), model, "predicted").select("doc_id", "label_idx", "predicted")


@query("split_gains", """
WITH cells AS (
  SELECT 5e-1 - CAST(l_returnflag = 'R' AS INTEGER) AS g, unnest([0, 1, 2]) AS feature,
    unnest([CAST(l_quantity AS INTEGER), CAST(round(l_discount * 100) AS INTEGER), CAST(round(l_tax * 100) AS INTEGER)]) AS bin
  FROM lineitem),
sums AS (SELECT feature, bin, sum(g) AS g, count(*) * 25e-2 AS h FROM cells GROUP BY 1, 2),
upto AS (
  SELECT feature, bin, max(bin) OVER f AS last, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER f AS ga, sum(h) OVER f AS ha
  FROM sums WINDOW f AS (PARTITION BY feature), u AS (PARTITION BY feature ORDER BY bin)),
sides AS (SELECT feature, bin, unnest([gl, ga - gl, ga]) AS g, unnest([hl, ha - hl, ha]) AS h, unnest([1, 1, -1]) AS s FROM upto WHERE bin < last)
SELECT feature, bin, round(sum(s * pow(greatest(abs(g) - 2e-1, 0), 2) / (h + 2e-1)), 6) AS gain FROM sides GROUP BY 1, 2""")
def split_gains(t):
    """Gains of all first splits of boosting for returned line items by quantity, discount and tax."""
    cell = lambda x: F.round(x).cast("int")
    rows = t.lineitem.select(
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        F.array(F.col("l_quantity").cast("int"), cell(F.col("l_discount") * 100), cell(F.col("l_tax") * 100)).alias("bins"))
    sums = boosting.gradient_sums(rows, "0D", "1", range(3))
    return boosting.split_gains(sums).select("feature", "bin", "gain")
