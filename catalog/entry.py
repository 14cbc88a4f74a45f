"""The way in: given rows written as trees, archives, metadata files and models, and read back."""

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import functions as F

from vetloom.operators import models as ml
from vetloom.operators.features import assemble_features
from vetloom.plans.analysis import file_verdicts, score_files, store_rows
from vetloom.session import scratch_dir, spread
from vetloom.sources import archives, scans, sinks
from vetloom.streaming.analyze import stream_analyze as analyze_uploads

from .registry import CHUNKS, TRIANGULAR, mal_score, query, vul_score

FILE_SQL = """concat(source, '/', lang, '/', doc_id, '.py') AS path, concat(doc_id, '.py') AS name,
  md5(coalesce(text, '')) AS content, length(coalesce(text, '')) AS size FROM documents"""


def _file_columns(files):
    return files.select("path", "name", F.md5("content").alias("content"), "size")


@query("scan_source_files", f"SELECT {FILE_SQL} WHERE length(text) > 0")
def scan_source_files(t):
    """Every text as a file of its own in folders; Spark's scan leaves out files of no bytes."""
    root = scratch_dir(t.spark, "tree")
    archives.write_tree(spread(t.files.select("path", "content")), root).count()
    return _file_columns(scans.scan_source_files(t.spark, root))


@query("scan_archives", f"SELECT {FILE_SQL}")
def scan_archives(t):
    """The texts as members of ZIP archives, one per partition."""
    root = scratch_dir(t.spark, "zips")
    archives.write_archives(spread(t.files.select("path", "content")), root).count()
    return _file_columns(scans.scan_archives(t.spark, f"{root}/*.zip"))


@query("scan_package_metadata", """
SELECT concat(p_partkey, '.txt') AS file_name, concat(p_name, '-', p_partkey) AS name, concat(p_size, '.0.1') AS version,
  concat(p_brand, ': ', p_type) AS summary, lower(p_type) AS author FROM part""")
def scan_package_metadata(t):
    """A metadata file for every part, with lines that do not count and a key that comes twice."""
    root, key = scratch_dir(t.spark, "metadata"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("Metadata-Version: 2.1\nName: "), "p_name", F.lit("-"), key, F.lit("\nVersion: 0\nVERSION:  "), F.col("p_size").cast("string"),
        F.lit(".0.1 \r\nno key\nSummary: "), "p_brand", F.lit(": "), "p_type", F.lit("\nAuthor: "), F.lower("p_type"), F.lit("\n"))
    archives.write_tree(spread(t.part).select(F.concat(key, F.lit(".txt")).alias("path"), text.alias("content")), root).count()
    return scans.scan_package_metadata(t.spark, root).select("file_name", "name", "version", "summary", "author")


@query("save_load_model", """
SELECT l_orderkey, l_linenumber, true AS same FROM lineitem""")
def save_load_model(t):
    """A model that was saved and loaded gives every row the prediction and confidence it gave before."""
    columns, path = ["l_quantity", "l_discount", "l_tax"], scratch_dir(t.spark, "model")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *columns, (F.col("l_returnflag") == "R").cast("double").alias("label"))
    train = assemble_features(rows, columns)
    fitted = LogisticRegression(maxIter=5).fit(train)
    ml.save_model(fitted, path)
    loaded = ml.load_model(LogisticRegressionModel, path)
    both = ml.predict(ml.predict(train, fitted, "before", "sure_before"), loaded, "after", "sure_after")
    same = (F.col("before") == F.col("after")) & (F.col("sure_before") == F.col("sure_after"))
    return both.select("l_orderkey", "l_linenumber", same.alias("same"))


@query("stream_analyze", f"""
WITH {CHUNKS},
scores AS (
  SELECT file_id, 'vul' AS task, {TRIANGULAR} AS p FROM chunk_probs GROUP BY 1
  UNION ALL SELECT file_id, 'mal', {TRIANGULAR} FROM mal_probs GROUP BY 1)
SELECT path AS file_path, name AS file_name, CAST(size AS BIGINT) AS file_size, task,
  concat(task, CASE WHEN p > 5e-1 THEN '' ELSE '_safe' END) AS verdict, round(p, 6) AS probability
FROM files JOIN scores USING (file_id) WHERE length(content) > 0""")
def stream_analyze(t):
    """Uploaded archives, analysed as they arrive; the verdicts that readers of the store see in the end."""
    uploads, root = scratch_dir(t.spark, "uploads"), scratch_dir(t.spark, "store")
    archives.write_archives(spread(t.files.select("path", "content")), uploads).count()
    text = F.col("text")

    def analyze(files):
        files = files.withColumn("file_id", F.concat_ws("/", "session_id", "path"))
        scores = score_files(files, lambda w: w.withColumns({"vul_prob": vul_score(text), "mal_prob": mal_score(text)}))
        return store_rows(file_verdicts(files, scores), "bert")

    analyze_uploads(
        t.spark, uploads, root, analyze, scratch_dir(t.spark, "check"), is_bert=True, max_files=100
    ).awaitTermination()
    found = sinks.read_results(t.spark, root)
    return found.select("file_path", "file_name", "file_size", "task", "verdict", "probability")
