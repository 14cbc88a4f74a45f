"""Package features."""

from pyspark.sql import functions as F

from vetloom.functions.text import shannon_entropy
from vetloom.operators import features as op
from vetloom.operators.similarity import typosquat_flag, typosquat_pairs

from .registry import PACKAGES, VERDICTS, query

ENTROPY = """chars AS (
  SELECT {key}, c, count(*) AS k FROM (
    SELECT {key}, unnest(string_split({text}, '')) AS c FROM {table} WHERE length({text}) > 0)
  WHERE c <> '' GROUP BY 1, 2),
entropy AS (
  SELECT {key}, -sum(k / n * log2(k / n)) AS bits
  FROM (SELECT *, CAST(sum(k) OVER (PARTITION BY {key}) AS DOUBLE) AS n FROM chars) GROUP BY 1)"""

CORES = """pc AS (SELECT DISTINCT regexp_extract(lower(name), '^[^-_.]*') AS core FROM packages),
qc AS (SELECT DISTINCT regexp_extract(lower(project), '^[^-_.]*') AS popular_core FROM popular),
pairs AS (SELECT * FROM pc JOIN qc ON levenshtein(core, popular_core) = 1)"""

LOGGED = "logged AS (SELECT *, ln(1e0 + coalesce(download, 0)) AS download_log FROM packages)"


@query("summary_features", f"""
WITH {PACKAGES} SELECT p_partkey, coalesce(summary, '') AS summary,
  CAST(length(coalesce(summary, '')) AS INTEGER) AS summary_length,
  length(coalesce(summary, '')) < 10 AS summary_too_short,
  length(coalesce(summary, '')) > 300 AS summary_too_long FROM packages""")
def summary_features(t):
    return op.summary_features(t.packages.select("p_partkey", "summary"))


@query("shannon_entropy", "WITH " + PACKAGES + ", s AS (SELECT p_partkey, coalesce(summary, '') "
    "AS s FROM packages), " + ENTROPY.format(key="p_partkey", text="s", table="s") + """
SELECT p_partkey, round(coalesce(bits, 0e0), 6) AS summary_entropy,
  coalesce(bits, 0e0) < 3.5e0 AS summary_low_entropy FROM s LEFT JOIN entropy USING (p_partkey)""")
def entropy(t):
    df = op.entropy_features(t.packages.select("p_partkey", "summary"))
    return df.select("p_partkey", "summary_entropy", "summary_low_entropy")


@query("shannon_entropy_text", "WITH "
    + ENTROPY.format(key="doc_id", text="text", table="documents")
    + " SELECT doc_id, round(bits, 6) AS bits FROM entropy")
def entropy_text(t):
    from vetloom.session import spread

    docs = spread(t.documents.select("doc_id", "text"))
    return docs.select("doc_id", shannon_entropy(F.col("text")).alias("bits"))


@query("download_log", f"""
WITH {PACKAGES} SELECT p_partkey, round(ln(1e0 + coalesce(download, 0)), 6) AS download_log,
  CAST(coalesce(download, 0) AS DOUBLE) AS download_raw FROM packages""")
def download_log(t):
    return t.packages.select(
        "p_partkey",
        op.download_log(F.col("download")).alias("download_log"),
        op.download_log(F.col("download"), raw=True).alias("download_raw"),
    )


@query("standard_scale", """
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ())
  / stddev_pop(o_totalprice) OVER (), 6) AS scaled FROM orders""")
def standard_scale(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    return op.standard_scale(df, "o_totalprice", "scaled").select("o_orderkey", "scaled")


@query("minmax_inverted", """
SELECT o_orderkey, round(1e0 - (o_totalprice - min(o_totalprice) OVER ())
  / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS scaled FROM orders""")
def minmax_inverted(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    return op.minmax_inverted(df, "o_totalprice", "scaled").select("o_orderkey", "scaled")


@query("quantile_flags", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 5e-2) AS lo, quantile_cont(l_extendedprice, 95e-2) AS hi
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice < lo AS too_low, l_extendedprice > hi AS too_high
FROM lineitem, q""")
def quantile_flags(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return op.quantile_flags(df, "l_extendedprice", "too_low", "too_high").drop("l_extendedprice")


@query("typosquat_flag", f"""
WITH {PACKAGES}, {CORES}
SELECT p_partkey, name, regexp_extract(lower(name), '^[^-_.]*') IN (SELECT core FROM pairs)
  AS is_typo_like FROM packages""")
def typo_flag(t):
    return typosquat_flag(t.packages, t.popular).select("p_partkey", "name", "is_typo_like")


@query("typosquat_pairs", f"""
WITH {PACKAGES}, {CORES}
SELECT name, core, popular_core FROM packages p JOIN pairs
  ON regexp_extract(lower(p.name), '^[^-_.]*') = core""")
def typo_pairs(t):
    return typosquat_pairs(t.packages, t.popular).select("name", "core", "popular_core")


@query("disposable_email_flag", f"""
WITH {PACKAGES}, listed AS (
  SELECT DISTINCT lower(concat(c_mktsegment, '.org')) AS d FROM customer
  UNION SELECT DISTINCT lower(concat(p_type, '.org')) FROM part WHERE p_size > 40 AND p_type < 'M')
SELECT p_partkey, coalesce(lower(regexp_extract(author_email, '@(.+)', 1)) IN (SELECT d FROM listed),
  false) AS is_disposable FROM packages""")
def disposable_email(t):
    segments = t.customer.select(F.concat("c_mktsegment", F.lit(".org")).alias("domain"))
    types = t.part.filter("p_size > 40 AND p_type < 'M'").select(
        F.concat("p_type", F.lit(".org")).alias("domain")
    )
    df = op.disposable_email_flag(t.packages, segments.union(types))
    return df.select("p_partkey", "is_disposable")


@query("disposable_email_flag_default", f"""
WITH {PACKAGES} SELECT p_partkey, false AS is_disposable FROM packages""")
def disposable_email_default(t):
    return op.disposable_email_flag(t.packages).select("p_partkey", "is_disposable")


@query("threat_level", """
SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 2 WHEN quality = 0 OR toxic = 1 THEN 1
  ELSE 0 END AS threat_level FROM labels""")
def threat_level(t):
    level = op.threat_level(1 - F.col("quality"), F.col("toxic"))
    return t.labels.select("doc_id", level.alias("threat_level"))


def _noise_sql(column: str, seed: int) -> str:
    digest = f"md5(concat(doc_id, '|{seed}'))"
    u, v = (f"((CAST('0x' || substr({digest}, {i}, 12) AS BIGINT) + 5e-1) / 281474976710656e0)" for i in (1, 13))
    return f"{column} + 5e-2 * (sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


@query("add_noise", f"""
SELECT doc_id, quality, toxic, round({_noise_sql("quality", 42)}, 6) AS quality_noisy,
  round({_noise_sql("toxic", 43)}, 6) AS toxic_noisy FROM labels""")
def add_noise(t):
    return op.add_noise(t.labels, ["quality", "toxic"], ["doc_id"])


@query("add_noise_copy", """
SELECT *, CAST(quality AS DOUBLE) AS quality_noisy, CAST(toxic AS DOUBLE) AS toxic_noisy FROM labels""")
def add_noise_copy(t):
    return op.add_noise(t.labels, ["quality", "toxic"], ["doc_id"], sd=0)


@query("assemble_features", """
SELECT l_orderkey, l_linenumber, round(CAST(l_linenumber AS DOUBLE), 6) AS f0,
  round(l_quantity, 6) AS f1, 0e0 AS f2, CAST(l_returnflag = 'R' AS DOUBLE) AS f3 FROM lineitem""")
def assemble_features(t):
    from pyspark.ml.functions import vector_to_array

    df = t.lineitem.withColumn("returned", F.col("l_returnflag") == "R")
    out = op.assemble_features(df, ["l_linenumber", "l_quantity", "not_there", "returned"])
    vector = vector_to_array("features")
    return out.select(
        "l_orderkey", "l_linenumber", *[vector[i].alias(f"f{i}") for i in range(4)]
    )


@query("low_download_typo_score", """
SELECT p_partkey, round((1e0 - (1e0 - (p_retailprice - min(p_retailprice) OVER ())
  / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())))
  * CAST(p_size % 2 = 0 AS INTEGER), 6) AS score FROM part""")
def low_download_typo_score(t):
    df = op.minmax_inverted(t.part, "p_retailprice", "scaled")
    score = op.low_download_typo_score(F.col("scaled"), F.col("p_size") % 2 == 0)
    return df.select("p_partkey", score.alias("score"))


FEATURES = (
    VERDICTS + f""", {LOGGED}, {CORES},
s AS (SELECT p_partkey, coalesce(summary, '') AS s FROM packages), """
    + ENTROPY.format(key="p_partkey", text="s", table="s")
    + """,
q AS (SELECT quantile_cont(download_log, 5e-2) AS lo, quantile_cont(download_log, 95e-2) AS hi,
  avg(download_log) AS mean, stddev_pop(download_log) AS sd, min(download_log) AS mn,
  max(download_log) AS mx FROM logged),
features AS (
  SELECT p_partkey, name, version, author_email, coalesce(download, 0) AS download, s.s AS summary,
    download_log, (download_log - mean) / sd AS download_scaled,
    CAST(length(s.s) AS INTEGER) AS summary_length, length(s.s) < 10 AS summary_too_short,
    length(s.s) > 300 AS summary_too_long, coalesce(bits, 0e0) AS summary_entropy,
    coalesce(bits, 0e0) < 3.5e0 AS summary_low_entropy,
    coalesce(regexp_matches(trim(version), '^[0-9]+\\.[0-9]+\\.[0-9]+$'), false) AS version_valid,
    regexp_extract(lower(name), '^[^-_.]*') IN (SELECT core FROM pairs) AS is_typo_like,
    download_log < lo AS download_too_low, download_log > hi AS download_too_high,
    false AS is_disposable, 1e0 - (download_log - mn) / (mx - mn) AS download_log_scaled
  FROM logged JOIN s USING (p_partkey) LEFT JOIN entropy USING (p_partkey), q)"""
)
FEATURE_LIST = """p_partkey, name, version, author_email, download, summary,
  round(download_log, 6) AS download_log, round(download_scaled, 6) AS download_scaled,
  summary_length, summary_too_short, summary_too_long, round(summary_entropy, 6) AS summary_entropy,
  summary_low_entropy, version_valid, is_typo_like, download_too_low, download_too_high,
  is_disposable, round(download_log_scaled, 6) AS download_log_scaled"""


@query("package_features", f"WITH {FEATURES} SELECT {FEATURE_LIST} FROM features")
def package_features(t):
    return op.package_features(t.packages, t.popular)
