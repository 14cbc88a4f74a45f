"""Registration of queries and the tables they start from.

Every derived table below exists twice: as a DataFrame over the given tables and as the SQL text of
the same derivation, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.operators.windows import char_windows
from vetloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; doubles are rounded to six decimals on both sides."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def round_doubles(df: DataFrame) -> DataFrame:
    rounded = {c: F.round(f"`{c}`", 6) for c, t in df.dtypes if t == "double"}
    return df.withColumns(rounded) if rounded else df


def share_of(text: Column, letters: str, factor: float) -> Column:
    """Stand-in score of a text: share of some letters, scaled and cut at 1."""
    hits = F.length(text) - F.length(F.translate(text, letters, ""))
    # An empty text has no letters either, so its length may count as 1.
    return F.least(F.lit(1.0), hits * factor / F.greatest(F.length(text), F.lit(1)))


def share_sql(text: str, letters: str, factor: str) -> str:
    return (
        f"coalesce(least(1e0, (length({text}) - length(translate({text}, '{letters}', '')))"
        f" * {factor} / CAST(nullif(length({text}), 0) AS DOUBLE)), 0e0)"
    )


VUL = ("aeiou", 1.25)
MAL = ("nrt", 2.0)
CLASS_LETTERS = ["a", "c", "e", "g", "i", "l", "n", "o"]


def vul_score(text: Column) -> Column:
    return share_of(text, *VUL)


def mal_score(text: Column) -> Column:
    return share_of(text, *MAL)


VUL_SQL = share_sql("text", "aeiou", "1.25e0")
MAL_SQL = share_sql("text", "nrt", "2e0")

FILES = """files AS (
  SELECT doc_id AS file_id, source AS session_id,
         concat(source, '/', lang, '/', doc_id, '.py') AS path,
         concat(doc_id, '.py') AS name, text AS content, n_chars AS size
  FROM documents)"""

WINDOWS = FILES + """,
counted AS (
  SELECT *, CAST(CASE WHEN length(content) <= 512 THEN 1
                      ELSE ceil(length(content) / 448e0) END AS INTEGER) AS n_chunks FROM files),
windows AS (
  SELECT file_id, CAST(i AS INTEGER) AS chunk_idx, n_chunks,
         substring(content, CAST(i * 448 + 1 AS BIGINT), 512) AS text
  FROM (SELECT *, unnest(range(n_chunks)) AS i FROM counted))"""

CHUNKS = WINDOWS + f""",
chunk_probs AS (SELECT file_id, chunk_idx, n_chunks, {VUL_SQL} AS prob FROM windows),
mal_probs AS (SELECT file_id, chunk_idx, n_chunks, {MAL_SQL} AS prob FROM windows)"""

_COUNTS = ", ".join(
    f"length(text) - length(replace(text, '{g}', '')) + 1e0" for g in CLASS_LETTERS
)
CLASS_CHUNKS = WINDOWS + f""",
class_counts AS (SELECT file_id, chunk_idx, n_chunks, [{_COUNTS}] AS c FROM windows),
class_probs AS (
  SELECT file_id, chunk_idx, n_chunks, CAST(k AS INTEGER) AS class_idx,
         c[k + 1] / list_sum(c) AS prob
  FROM (SELECT *, unnest(range(8)) AS k FROM class_counts))"""

# Per class score of a file: exponential weights.
FILE_CLASSES = CLASS_CHUNKS + """,
file_class AS (
  SELECT file_id, class_idx,
         6e-1 * sum(prob * exp(-1e-1 * abs(chunk_idx - n_chunks / 2e0)))
              / sum(exp(-1e-1 * abs(chunk_idx - n_chunks / 2e0))) + 4e-1 * max(prob) AS prob
  FROM class_probs GROUP BY 1, 2)"""

TRIANGULAR = """7e-1 * sum(prob * greatest(1e-1, 1e0 - abs(chunk_idx - (n_chunks - 1) / 2e0)
        / CASE WHEN n_chunks > 1 THEN (n_chunks - 1) / 2e0 ELSE 1e0 END))
      / greatest(1e-8, sum(greatest(1e-1, 1e0 - abs(chunk_idx - (n_chunks - 1) / 2e0)
        / CASE WHEN n_chunks > 1 THEN (n_chunks - 1) / 2e0 ELSE 1e0 END)))
      + 3e-1 * max(prob)"""

# Every file with both of its label-derived verdicts; unlabelled files were not scored.
RESULTS = FILES + """,
results AS (
  SELECT f.session_id, f.file_id, f.path AS file_path, f.name AS file_name, f.size AS file_size,
         l.quality = 0 AS is_vulnerable, l.toxic = 1 AS is_malicious,
         (f.file_id % 100) / 1e2 AS vul_prob, (f.file_id % 10) / 1e1 AS mal_prob,
         CASE WHEN l.quality = 0 THEN concat('CWE-', f.file_id % 7) END AS cwe_label,
         f.size / 1e3 AS analysis_time
  FROM files f LEFT JOIN labels l ON f.file_id = l.doc_id)"""

LOG = RESULTS + """,
counts AS (
  SELECT session_id, count(*) AS input_files,
    count(*) FILTER (is_vulnerable IS NOT NULL) AS total_files,
    count(*) FILTER (is_vulnerable IS NOT NULL AND NOT is_vulnerable AND NOT is_malicious)
      AS safe_files,
    count(*) FILTER (is_vulnerable) AS vulnerable_files,
    count(*) FILTER (is_malicious) AS malicious_files,
    coalesce(sum(analysis_time) FILTER (is_vulnerable IS NOT NULL), 0e0) AS analysis_duration
  FROM results GROUP BY 1),
log AS (
  SELECT *, input_files - total_files AS skipped_files, 'Integrated LSTM' AS analysis_model,
    vulnerable_files > 0 AS vul_flag, malicious_files > 0 AS mal_flag, false AS is_bert,
    false AS is_mal, false AS is_ml, vulnerable_files = 0 AND malicious_files = 0 AS is_safe
  FROM counts)"""

ROUTED = RESULTS + """,
routed AS (
  SELECT session_id, file_path, file_name, file_size, analysis_time, 'lstm' AS engine,
         'vul' AS task,
         CASE is_vulnerable WHEN true THEN 'vul' WHEN false THEN 'vul_safe' ELSE 'vul_error' END AS verdict,
         is_vulnerable AS flagged,
         CASE is_vulnerable WHEN true THEN 'Vulnerable' WHEN false THEN 'Safe' ELSE 'Error' END AS status,
         vul_prob AS probability,
         CASE WHEN coalesce(is_vulnerable, false) THEN 'Vulnerable' END AS label,
         coalesce(cwe_label, CASE is_vulnerable WHEN true THEN '' WHEN false THEN 'Safe' ELSE 'Error' END)
           AS cwe_label
  FROM results
  UNION ALL
  SELECT session_id, file_path, file_name, file_size, analysis_time, 'lstm', 'mal',
         CASE is_malicious WHEN true THEN 'mal' WHEN false THEN 'mal_safe' ELSE 'mal_error' END,
         is_malicious,
         CASE is_malicious WHEN true THEN 'malicious' WHEN false THEN 'Safe' ELSE 'Error' END,
         mal_prob, CASE WHEN coalesce(is_malicious, false) THEN 'malicious' END, NULL
  FROM results)"""

PACKAGES = """misspelt AS (
  SELECT *, CASE p_partkey % 7
    WHEN 0 THEN concat(substring(p_name, 1, 1), substring(p_name, 3))
    WHEN 1 THEN concat(substring(p_name, 1, 2), 'x', substring(p_name, 4))
    WHEN 2 THEN concat(substring(p_name, 1, 1), 'q', substring(p_name, 2))
    ELSE p_name END AS m
  FROM part),
packages AS (
  SELECT p_partkey, concat(replace(m, ' ', '-'), '-', p_partkey) AS name,
    CASE p_size % 10 WHEN 0 THEN NULL WHEN 1 THEN 'short'
      WHEN 2 THEN repeat(concat(p_name, ' ', p_brand, '; '), 20)
      WHEN 3 THEN repeat('ab', 12)
      ELSE concat(p_name, ', a ', lower(p_type), ' part of ', p_brand) END AS summary,
    CASE p_size % 4 WHEN 0 THEN concat(p_size, '.', p_partkey % 10, '.0')
      WHEN 1 THEN concat(' ', p_size, '.0.1 ') WHEN 2 THEN concat(p_size, '.1') END AS version,
    CASE p_size % 3 WHEN 0 THEN concat('a', p_partkey, '@', lower(p_type), '.org')
      WHEN 1 THEN NULL ELSE 'no-mail' END AS author_email,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 100) AS BIGINT) END
      AS download
  FROM misspelt),
popular AS (SELECT DISTINCT replace(p_name, ' ', '_') AS project FROM part)"""

VERDICTS = PACKAGES + """,
verdicts AS (
  SELECT p.name AS package,
    CASE WHEN l.doc_id % 11 = 0 THEN 'Error' WHEN l.quality = 0 THEN 'Vulnerable'
         ELSE 'Not Vulnerable' END AS vulnerability_status,
    CASE WHEN l.doc_id % 11 = 0 THEN 'parsing_error' WHEN l.toxic = 1 THEN 'CWE-79'
         ELSE 'Benign' END AS cwe_label,
    (l.doc_id % 100) / 1e2 AS confidence
  FROM packages p JOIN labels l ON p.p_partkey = l.doc_id)"""

# Packages as stored rows, one session per brand.
PKG_ROWS = """pkg_rows AS (
  SELECT p_brand AS session_id, concat(p_name, '-', p_partkey) AS package_name,
    p_size % 6 = 0 AS final_malicious_status,
    CASE WHEN p_size % 4 = 0 THEN 'Vulnerable' WHEN p_size % 4 = 1 THEN 'Not Vulnerable' END
      AS lstm_vulnerability_status,
    CASE WHEN p_size % 6 = 0 THEN 1 ELSE 0 END AS xgboost_prediction,
    p_size % 3 AS threat_level, p_size / 1e1 AS analysis_time
  FROM part)"""

EVENTS = """status_events AS (
  SELECT user_id AS session_id, ts, event_id, props AS payload,
    CASE event_type WHEN 'signup' THEN 'analysis_started' WHEN 'purchase' THEN 'analysis_complete'
      WHEN 'error' THEN 'analysis_failed' ELSE event_type END AS event
  FROM events)"""


class Tables:
    """The given tables and what the queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.__dict__[name] = df
        return df

    @cached_property
    def files(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("file_id"),
            F.col("source").alias("session_id"),
            F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".py")).alias(
                "path"
            ),
            F.concat("doc_id", F.lit(".py")).alias("name"),
            F.col("text").alias("content"),
            F.col("n_chars").alias("size"),
        )

    @cached_property
    def windows(self) -> DataFrame:
        return char_windows(spread(self.files.select("file_id", "content")))

    @cached_property
    def chunk_probs(self) -> DataFrame:
        return self.windows.select(
            "file_id", "chunk_idx", "n_chunks", vul_score(F.col("text")).alias("prob")
        )

    @cached_property
    def class_probs(self) -> DataFrame:
        text = F.col("text")
        counts = {
            f"c{i}": F.length(text) - F.length(F.replace(text, F.lit(g), F.lit(""))) + F.lit(1.0)
            for i, g in enumerate(CLASS_LETTERS)
        }
        total = reduce(lambda a, b: a + b, map(F.col, counts))
        probs = F.array(*[F.col(c) / F.col("total") for c in counts])
        return (
            self.windows.withColumns(counts)
            .withColumn("total", total)
            .select(
                "file_id", "chunk_idx", "n_chunks", F.posexplode(probs).alias("class_idx", "prob")
            )
        )

    @cached_property
    def results(self) -> DataFrame:
        labels = self.labels.withColumnRenamed("doc_id", "file_id")
        files = self.files.drop("content").join(labels, "file_id", "left")
        return files.select(
            "session_id",
            "file_id",
            F.col("path").alias("file_path"),
            F.col("name").alias("file_name"),
            F.col("size").alias("file_size"),
            (F.col("quality") == 0).alias("is_vulnerable"),
            (F.col("toxic") == 1).alias("is_malicious"),
            ((F.col("file_id") % 100) / F.lit(1e2)).alias("vul_prob"),
            ((F.col("file_id") % 10) / F.lit(1e1)).alias("mal_prob"),
            F.when(
                F.col("quality") == 0,
                F.concat(F.lit("CWE-"), (F.col("file_id") % 7).cast("string")),
            ).alias("cwe_label"),
            (F.col("size") / F.lit(1e3)).alias("analysis_time"),
        )

    @cached_property
    def packages(self) -> DataFrame:
        key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
        tail = lambda i: F.substring(name, i, F.length(name))
        head = lambda n: F.substring(name, 1, n)
        misspelt = (
            F.when(key % 7 == 0, F.concat(head(1), tail(3)))
            .when(key % 7 == 1, F.concat(head(2), F.lit("x"), tail(4)))
            .when(key % 7 == 2, F.concat(head(1), F.lit("q"), tail(2)))
            .otherwise(name)
        )
        text = lambda c: c.cast("string")
        return self.part.select(
            key,
            F.concat(F.replace(misspelt, F.lit(" "), F.lit("-")), F.lit("-"), text(key)).alias(
                "name"
            ),
            F.when(size % 10 == 0, None)
            .when(size % 10 == 1, "short")
            .when(size % 10 == 2, F.repeat(F.concat(name, F.lit(" "), "p_brand", F.lit("; ")), 20))
            .when(size % 10 == 3, F.repeat(F.lit("ab"), 12))
            .otherwise(
                F.concat(name, F.lit(", a "), F.lower("p_type"), F.lit(" part of "), "p_brand")
            )
            .alias("summary"),
            F.when(size % 4 == 0, F.concat(text(size), F.lit("."), text(key % 10), F.lit(".0")))
            .when(size % 4 == 1, F.concat(F.lit(" "), text(size), F.lit(".0.1 ")))
            .when(size % 4 == 2, F.concat(text(size), F.lit(".1")))
            .alias("version"),
            F.when(
                size % 3 == 0,
                F.concat(F.lit("a"), text(key), F.lit("@"), F.lower("p_type"), F.lit(".org")),
            )
            .when(size % 3 == 2, "no-mail")
            .alias("author_email"),
            F.when(
                size % 5 != 0, F.floor(F.col("p_retailprice") * 100).cast("bigint")
            ).alias("download"),
        )

    @cached_property
    def popular(self) -> DataFrame:
        return self.part.select(
            F.replace("p_name", F.lit(" "), F.lit("_")).alias("project")
        ).distinct()

    @cached_property
    def verdicts(self) -> DataFrame:
        joined = self.packages.join(self.labels, F.col("p_partkey") == F.col("doc_id"))
        broken = F.col("doc_id") % 11 == 0
        return joined.select(
            F.col("name").alias("package"),
            F.when(broken, "Error")
            .when(F.col("quality") == 0, "Vulnerable")
            .otherwise("Not Vulnerable")
            .alias("vulnerability_status"),
            F.when(broken, "parsing_error")
            .when(F.col("toxic") == 1, "CWE-79")
            .otherwise("Benign")
            .alias("cwe_label"),
            ((F.col("doc_id") % 100) / F.lit(1e2)).alias("confidence"),
        )

    @cached_property
    def pkg_rows(self) -> DataFrame:
        size = F.col("p_size")
        return self.part.select(
            F.col("p_brand").alias("session_id"),
            F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("package_name"),
            (size % 6 == 0).alias("final_malicious_status"),
            F.when(size % 4 == 0, "Vulnerable")
            .when(size % 4 == 1, "Not Vulnerable")
            .alias("lstm_vulnerability_status"),
            F.when(size % 6 == 0, 1).otherwise(0).alias("xgboost_prediction"),
            (size % 3).alias("threat_level"),
            (size / F.lit(1e1)).alias("analysis_time"),
        )

    @cached_property
    def status_events(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("session_id"),
            "ts",
            "event_id",
            F.col("props").alias("payload"),
            F.when(F.col("event_type") == "signup", "analysis_started")
            .when(F.col("event_type") == "purchase", "analysis_complete")
            .when(F.col("event_type") == "error", "analysis_failed")
            .otherwise(F.col("event_type"))
            .alias("event"),
        )
