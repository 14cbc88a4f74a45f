"""Scoring and score aggregation."""

import pandas as pd
from pyspark.sql import functions as F

from vetloom.constants import BENIGN_ALIASES, CLEAN_INDEX, CWE_CLASSES
from vetloom.functions.vectors import logits_to_probs
from vetloom.operators import scoring as op
from vetloom.operators.sampling import stratified_split
from vetloom.operators.windows import char_windows
from vetloom.plans.analysis import score_files_in_place
from vetloom.session import spread

from .registry import (
    CHUNKS,
    FILE_CLASSES,
    RESULTS,
    TRIANGULAR,
    WINDOWS,
    VUL_SQL,
    query,
    vul_score,
)

NAMES = "[" + ", ".join(f"'{c}'" for c in CWE_CLASSES) + "]"
RANKED = FILE_CLASSES + """,
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, class_idx)
  AS INTEGER) AS class_rank FROM file_class)"""


@query("logits_to_probs", """
WITH l AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, CAST(k AS INTEGER) AS class_idx,
  round(exp(x[k + 1]) / list_sum(list_transform(x, lambda v: exp(v))), 6) AS prob
FROM (SELECT *, unnest(range(len(x))) AS k FROM l)""")
def softmax(t):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select(
        "vec_id", F.posexplode(logits_to_probs(logits)).alias("class_idx", "prob")
    )


@query("logits_to_probs_single", """
SELECT vec_id, CAST(k AS INTEGER) AS i, round(1e0 / (1e0 + exp(-CAST(embedding[k + 1] AS DOUBLE))), 6) AS prob
FROM (SELECT *, unnest(range(len(embedding))) AS k FROM embeddings)""")
def sigmoid(t):
    logits = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    single = logits_to_probs(F.array(F.col("x").cast("double")))
    return logits.select("vec_id", "i", single[0].alias("prob"))


@query("agg_triangular", f"""
WITH {CHUNKS} SELECT file_id, round({TRIANGULAR}, 6) AS prob FROM chunk_probs GROUP BY 1""")
def agg_triangular(t):
    return op.agg_triangular(t.chunk_probs)


@query("agg_triangular_counted", f"""
WITH {CHUNKS} SELECT file_id, round({TRIANGULAR}, 6) AS prob FROM chunk_probs GROUP BY 1""")
def agg_triangular_counted(t):
    """The window counts are not given and have to be found."""
    return op.agg_triangular(t.chunk_probs.drop("n_chunks"))


@query("score_files_in_place", f"""
WITH {CHUNKS} SELECT file_id, round({TRIANGULAR}, 6) AS prob FROM chunk_probs GROUP BY 1""")
def in_place(t):
    files = spread(t.files.select("file_id", "content"))
    return score_files_in_place(files, {"prob": vul_score}).select("file_id", "prob")


@query("agg_exponential", f"""
WITH {FILE_CLASSES} SELECT file_id, class_idx, round(prob, 6) AS prob FROM file_class""")
def agg_exponential(t):
    return op.agg_exponential(t.class_probs)


@query("agg_max", f"""
WITH {CHUNKS} SELECT f.file_id, round(coalesce(max(prob), 0e0), 6) AS prob FROM files f
LEFT JOIN (SELECT * FROM chunk_probs WHERE n_chunks > 1) c ON f.file_id = c.file_id GROUP BY 1""")
def agg_max(t):
    return op.agg_max(t.chunk_probs.filter("n_chunks > 1"), files=t.files)


@query("agg_mean_logits", """
WITH l AS (SELECT label AS file_id, unnest(range(len(embedding))) AS k, embedding FROM embeddings),
m AS (SELECT file_id, k, avg(CAST(embedding[k + 1] AS DOUBLE)) AS logit FROM l GROUP BY 1, 2),
p AS (SELECT file_id, k, exp(logit) / sum(exp(logit)) OVER (PARTITION BY file_id) AS prob FROM m)
SELECT file_id, CAST(k AS INTEGER) AS top_class, round(prob, 6) AS top_prob FROM p
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, k) = 1""")
def agg_mean_logits(t):
    logits = t.embeddings.select(
        F.col("label").alias("file_id"),
        F.posexplode("embedding").alias("class_idx", "logit"),
    ).withColumn("logit", F.col("logit").cast("double"))
    return op.agg_mean_logits(logits).drop("probs")


def _scores(t):
    return op.agg_triangular(t.chunk_probs)


SCORES = CHUNKS + f", scores AS (SELECT file_id, {TRIANGULAR} AS prob FROM chunk_probs GROUP BY 1)"


@query("verdict_strict", f"""
WITH {SCORES} SELECT file_id, round(prob, 6) AS prob, prob > 5e-1 AS flagged,
  CASE WHEN prob > 5e-1 THEN 'Vulnerable' ELSE 'Safe' END AS status FROM scores""")
def verdict_strict(t):
    return op.verdict(_scores(t))


@query("verdict_inclusive", f"""
WITH {SCORES} SELECT file_id, round(prob, 6) AS prob, prob >= 55e-2 AS flagged,
  CASE WHEN prob >= 55e-2 THEN 'malicious' ELSE 'benign' END AS status FROM scores""")
def verdict_inclusive(t):
    return op.verdict(_scores(t), 0.55, strict=False, positive="malicious", negative="benign")


@query("vulnerability_probability", f"""
WITH {FILE_CLASSES} SELECT file_id, round(1e0 - max(prob) FILTER (class_idx = 7), 6) AS prob
FROM file_class GROUP BY 1""")
def vulnerability_probability(t):
    return op.vulnerability_probability(op.agg_exponential(t.class_probs))


@query("vulnerability_probability_no_clean", f"""
WITH {FILE_CLASSES} SELECT file_id, round(max(prob), 6) AS prob
FROM file_class WHERE class_idx < 7 GROUP BY 1""")
def vulnerability_probability_no_clean(t):
    return op.vulnerability_probability(
        op.agg_exponential(t.class_probs).filter(F.col("class_idx") < CLEAN_INDEX)
    )


@query("rank_in_class", f"""
WITH {RANKED} SELECT file_id, class_idx, round(prob, 6) AS prob, class_rank FROM ranked""")
def rank_in_class(t):
    return op.rank_in_class(op.agg_exponential(t.class_probs))


@query("top_k_classes", f"""
WITH {RANKED} SELECT file_id, string_agg(CAST(class_idx AS VARCHAR), ',' ORDER BY class_rank) AS top,
  round(max(prob), 6) AS best FROM ranked WHERE class_rank <= 3 GROUP BY 1""")
def top_k_classes(t):
    df = op.top_k_classes(op.agg_exponential(t.class_probs), 3)
    ids = F.transform("top", lambda e: e["class_idx"].cast("string"))
    return df.select(
        "file_id", F.array_join(ids, ",").alias("top"), F.col("top")[0]["prob"].alias("best")
    )


@query("top_cwe", f"""
WITH {RANKED}, first AS (SELECT file_id, max(class_idx) FILTER (class_rank = 1) AS c1,
    max(class_idx) FILTER (class_rank = 2) AS c2, max(prob) FILTER (class_rank = 1) AS p1,
    max(prob) FILTER (class_rank = 2) AS p2, 1 - max(prob) FILTER (class_idx = 7) AS vul
  FROM ranked GROUP BY 1)
SELECT file_id, CASE WHEN c1 = 7 THEN c2 ELSE c1 END AS class_idx,
  round(CASE WHEN c1 = 7 THEN p2 ELSE p1 END, 6) AS class_prob,
  CASE WHEN vul >= 94e-2 THEN {NAMES}[CASE WHEN c1 = 7 THEN c2 ELSE c1 END + 1] ELSE 'Benign' END
    AS cwe_label FROM first""")
def top_cwe(t):
    scores = op.agg_exponential(t.class_probs)
    best = op.top_cwe(scores)
    judged = op.verdict(op.vulnerability_probability(scores), 0.94, strict=False)
    name = F.get(F.array(*map(F.lit, CWE_CLASSES)), F.col("class_idx"))
    return best.join(judged, "file_id").select(
        "file_id", "class_idx", "class_prob",
        op.label_vulnerable(F.col("flagged"), name).alias("cwe_label"),
    )


DIMS = """labels_a AS (SELECT n_nationkey AS class_idx, n_name AS name FROM nation WHERE n_nationkey % 3 = 0),
labels_b AS (SELECT n_nationkey AS class_idx, concat('cfg-', n_name) AS name FROM nation WHERE n_nationkey % 2 = 0)"""


@query("decode_labels", f"""
WITH {DIMS}
SELECT c_custkey, c_nationkey AS class_idx,
  coalesce(a.name, b.name, concat('class_', c_nationkey)) AS class_name
FROM customer LEFT JOIN labels_a a ON a.class_idx = c_nationkey
LEFT JOIN labels_b b ON b.class_idx = c_nationkey""")
def decode_labels(t):
    names = t.nation.select(F.col("n_nationkey").alias("class_idx"), F.col("n_name").alias("name"))
    config = names.filter("class_idx % 2 = 0").withColumn(
        "name", F.concat(F.lit("cfg-"), "name")
    )
    df = t.customer.select("c_custkey", F.col("c_nationkey").alias("class_idx"))
    return op.decode_labels(df, names.filter("class_idx % 3 = 0"), config)


BOTH = FILE_CLASSES + f""",
chunk_probs AS (SELECT file_id, chunk_idx, n_chunks, {VUL_SQL} AS prob FROM windows),
scores AS (SELECT file_id, {TRIANGULAR} AS prob FROM chunk_probs GROUP BY 1),
best AS (SELECT file_id, class_idx FROM file_class WHERE class_idx < 7
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY prob DESC, class_idx) = 1)"""


@query("two_stage_cwe", f"""
WITH {BOTH}
SELECT file_id, round(prob, 6) AS prob, prob > 5e-1 AS flagged,
  CASE WHEN prob > 5e-1 THEN 'Vulnerable' ELSE 'Safe' END AS status,
  CASE WHEN prob > 5e-1 THEN {NAMES}[class_idx + 1] ELSE 'Safe' END AS cwe_label
FROM scores JOIN best USING (file_id)""")
def two_stage_cwe(t):
    def second(flagged):
        mine = t.class_probs.join(flagged.select("file_id"), "file_id", "left_semi")
        name = F.get(F.array(*map(F.lit, CWE_CLASSES)), F.col("class_idx"))
        return op.top_cwe(op.agg_exponential(mine)).select("file_id", name.alias("cwe_label"))

    return op.two_stage_cwe(op.verdict(_scores(t)), second)


@query("benign_alias", f"""
SELECT doc_id, label IN ('Benign', 'benign', 'Not Vulnerable', 'Normal', 'Safe', '0') AS benign
FROM (SELECT doc_id, ['Benign', 'benign', 'Not Vulnerable', 'Normal', 'Safe', '0', 'CWE-79', 'safe'][
  CAST(doc_id % 8 + 1 AS INTEGER)] AS label FROM documents)""")
def benign_alias(t):
    words = F.array(*map(F.lit, [*BENIGN_ALIASES, "CWE-79", "safe"]))
    label = F.get(words, (F.col("doc_id") % 8).cast("int"))
    return t.documents.select("doc_id", op.benign_alias(label).alias("benign"))


def _analyzed(t, mode):
    df = t.results.select(
        "file_id",
        F.col("is_vulnerable").alias("vul_flag"),
        "vul_prob",
        "cwe_label",
        F.col("is_malicious").alias("mal_flag"),
        "mal_prob",
    )
    out = op.analyze_files(df, mode)
    return out.select(
        "file_id",
        F.col("vulnerability_analysis.is_vulnerable"),
        F.coalesce("vulnerability_analysis.cwe_label", F.lit("-")).alias("cwe"),
        F.col("malicious_analysis.is_malicious"),
        F.coalesce("malicious_analysis.malicious_status", F.lit("-")).alias("status"),
        "is_safe",
    )


def analyzed_sql(vul: bool, mal: bool) -> str:
    v = "coalesce(is_vulnerable, false)" if vul else "false"
    m = "coalesce(is_malicious, false)" if mal else "false"
    cwe = f"CASE WHEN {v} THEN cwe_label ELSE 'Safe' END" if vul else "'-'"
    status = f"CASE WHEN {m} THEN 'malicious' ELSE 'Safe' END" if mal else "'-'"
    return f"""WITH {RESULTS} SELECT file_id, {v} AS is_vulnerable, {cwe} AS cwe,
      {m} AS is_malicious, {status} AS status, NOT ({v} OR {m}) AS is_safe FROM results"""


@query("analyze_files_both", analyzed_sql(True, True))
def analyze_both(t):
    return _analyzed(t, "both")


@query("analyze_files_vul", analyzed_sql(True, False))
def analyze_vul(t):
    return _analyzed(t, "vul")


@query("analyze_files_mal", analyzed_sql(False, True))
def analyze_mal(t):
    return _analyzed(t, "mal")


@query("error_status", """
WITH r AS (SELECT l_orderkey, l_linenumber, CASE
    WHEN l_linenumber = 1 THEN 'Empty Code'
    WHEN l_quantity < 10 THEN 'parsing_error' WHEN l_returnflag = 'A' THEN 'model_error'
    WHEN l_discount < 2e-2 THEN 'embedding_error' WHEN l_tax < 1e-2 THEN 'analysis_error'
    WHEN l_linestatus = 'O' THEN 'label_decode_error' END AS reason, l_discount FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN reason IS NULL THEN 'Vulnerable' ELSE 'Error' END
    AS vulnerability_status, coalesce(reason, 'CWE-79') AS cwe_label,
  CASE WHEN reason IS NULL OR reason = 'label_decode_error' THEN l_discount ELSE 0e0 END
    AS confidence FROM r""")
def error_status(t):
    reason = op.error_status(
        F.when(F.col("l_linenumber") == 1, " \n").otherwise("x"),
        F.when(F.col("l_quantity") >= 10, 5).otherwise(0),
        F.col("l_returnflag") != "A",
        F.when(F.col("l_discount") >= 0.02, 3),
        F.when(F.col("l_linestatus") != "O", "CWE-79"),
        F.col("l_tax") < 0.01,
    )
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", reason.alias("error_reason"),
        F.lit("Vulnerable").alias("vulnerability_status"), F.lit("CWE-79").alias("cwe_label"),
        F.col("l_discount").alias("confidence"),
    )
    return op.with_error_status(df).drop("error_reason")


@query("positive_index", """
WITH d AS (SELECT n_nationkey AS class_idx, lower(n_name) AS name FROM nation)
SELECT CAST(coalesce(min(class_idx) FILTER (contains(name, 'mal') OR contains(name, '_1')),
  count(*) - 1) AS INTEGER) AS positive_index FROM d""")
def positive_index(t):
    names = t.nation.select(F.col("n_nationkey").alias("class_idx"), F.col("n_name").alias("name"))
    return op.positive_index(names, ["mal", "_1"])


@query("positive_index_fallback", """
SELECT CAST(CASE WHEN count(*) = 1 THEN 0 ELSE count(*) - 1 END AS INTEGER) AS positive_index
FROM nation""")
def positive_index_fallback(t):
    names = t.nation.select(F.col("n_nationkey").alias("class_idx"), F.col("n_name").alias("name"))
    return op.positive_index(names, ["no such word"])


@query("score_windows_function", f"""
WITH {WINDOWS} SELECT file_id, chunk_idx, n_chunks, round({VUL_SQL}, 6) AS prob FROM windows""")
def score_windows_function(t):
    def share(texts: pd.Series) -> pd.Series:
        hits = texts.str.count("[aeiou]") * 1.25
        return (hits / texts.str.len().clip(lower=1)).clip(upper=1.0)

    return op.score_windows(t.windows, share).drop("text")


@query("score_windows_model")
def score_windows_model(t):
    """Windows of the files that the model was not fitted on."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    tail = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 16),
        LogisticRegression(maxIter=50),
    ]
    labels = stratified_split(t.labels, "toxic", "doc_id", (0.8, 0.2), ("train", "test"))
    fitted = labels.filter("part = 'train'").select(F.col("doc_id").alias("file_id"), "toxic")
    train = t.files.join(fitted, "file_id").select(
        F.col("content").alias("text"), F.col("toxic").cast("double").alias("label")
    )
    model = Pipeline(stages=tail).fit(train)
    held_out = t.files.select("file_id", "content").join(fitted, "file_id", "left_anti")
    return op.score_windows(char_windows(spread(held_out)), model).drop("text")


@query("class_prob_map", f"""
WITH {RANKED} SELECT file_id, {NAMES}[max(class_idx) FILTER (class_rank = 1) + 1] AS label,
  round(max(prob), 6) AS prob, 8 AS n_classes, round(max(prob) FILTER (class_idx = 4), 6) AS p_cwe_79
FROM ranked GROUP BY 1""")
def class_prob_map(t):
    names = F.get(F.array(*map(F.lit, CWE_CLASSES)), F.col("class_idx"))
    df = op.class_prob_map(op.agg_exponential(t.class_probs).withColumn("class_name", names))
    return df.select(
        "file_id", "label", "prob", F.size("probs").alias("n_classes"),
        F.col("probs")["CWE-79"].alias("p_cwe_79"),
    )


@query("chunk_position_weights", f"""
WITH {CHUNKS} SELECT file_id, chunk_idx, n_chunks, round(greatest(1e-1, 1e0 - abs(chunk_idx
    - (n_chunks - 1) / 2e0) / CASE WHEN n_chunks > 1 THEN (n_chunks - 1) / 2e0 ELSE 1e0 END), 6)
    AS w_triangular, round(exp(-1e-1 * abs(chunk_idx - n_chunks / 2e0)), 6) AS w_exponential
FROM chunk_probs""")
def chunk_position_weights(t):
    return op.chunk_position_weights(t.chunk_probs.drop("n_chunks", "prob"))
