"""Registered queries of this package over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, language, mixing, negatives, packing, phrases, simhash, suffixes, topk, urls, warc
from .common import keep, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    found = language.predict(docs, model)
    return found.select(
        F.col("doc").alias("doc_id"), language.held_out(F.col("doc")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query("op7_simhash_dedup")
def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_dedup(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w
  FROM sized GROUP BY source),
rounds AS (
  SELECT 0 AS r, source, s, w, false AS stopped FROM sources
  UNION ALL
  SELECT r + 1, source, s, w,
         stopped OR ((SELECT sum(s) FROM sources) - sum(CASE WHEN stopped THEN 3 * s ELSE 0 END) OVER ()) * w
                    > 3 * s * sum(CASE WHEN stopped THEN 0 ELSE w END) OVER ()
  FROM rounds WHERE r < (SELECT count(*) FROM sources)),
targets AS (
  SELECT source, s, CASE WHEN stopped THEN 3 * s
         ELSE ((SELECT sum(s) FROM sources) - sum(CASE WHEN stopped THEN 3 * s ELSE 0 END) OVER ()) * w
              / sum(CASE WHEN stopped THEN 0 ELSE w END) OVER () END AS target
  FROM rounds WHERE r = (SELECT count(*) FROM sources)),
goals AS (
  SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), 3) ELSE 0 END AS whole FROM targets),
hashes AS (SELECT source, h, sum(size) AS size FROM sized GROUP BY source, h),
running AS (
  SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
cuts AS (
  SELECT g.source, max(CASE WHEN upto - budget < budget - upto + r.size THEN h ELSE h - 1 END) AS cut
  FROM (SELECT *, target - whole * s AS budget FROM goals) g
  JOIN running r ON g.source IS NOT DISTINCT FROM r.source
  WHERE upto > budget AND upto - r.size <= budget AND budget > 0 GROUP BY g.source)
SELECT d.doc_id, d.size, CAST(g.s AS BIGINT) AS source_size, g.target,
       CAST(d.size * (g.whole + CASE WHEN d.h <= c.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""


@query("op10_mixing", MIX_SQL)
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


@query("op3_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("doc").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@query("op8_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), match=50)
    return found.select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


#: Steps of 384 tokens and 256 of history: a budget of 1024.
CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
counted AS (
  SELECT *, 4 + len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]')) AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM rows),
turns AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens AS before,
         pos = 1 AND role = 'system' AS kept,
         length('<|im_start|>') + length('<|im_end|>') + 2
         + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n|'))
         + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars
  FROM counted),
own AS (SELECT *, before // 384 AS w FROM turns),
starts AS (SELECT conv_id, w, min(before) AS start FROM own GROUP BY conv_id, w),
shown AS (
  SELECT conv_id, chars FROM own
  UNION ALL
  SELECT o.conv_id, o.chars FROM own o JOIN starts s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE s.w > o.w AND (o.kept OR s.start <= o.before + 256))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST((SELECT sum(chars) FROM shown s WHERE s.conv_id IS NOT DISTINCT FROM t.conv_id) AS BIGINT) AS formatted_chars
FROM turns t GROUP BY conv_id
"""


@query("op5_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    windows = chat.format_chats(rows.unionByName(own), budget=1024, history=256)
    return chat.digests(keep(windows, "chats")).withColumnRenamed("conv", "conv_id")


@query("op6_warc")
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.warc_round_trip(table(spark, sf_dir, "pages"), revisit_from=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_embedding_dedup")
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op4_top_k", TOP_SQL)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


URL_SQL = r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS day,
         rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS path
  FROM pages),
named AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END AS address, string_split(host, '.') AS labels FROM captures),
listed AS (
  SELECT DISTINCT 'block' AS list, 'domain' AS kind, host AS pattern, [0, 45, 120] AS steps FROM named WHERE host <> ''
  UNION ALL SELECT DISTINCT 'allow', 'domain', array_to_string(labels[-2:], '.'), [150] FROM named WHERE host <> ''
  UNION ALL SELECT DISTINCT 'block', 'url', address, [0, 30] FROM named WHERE host <> '' AND contains(path, '?')),
dated AS (
  SELECT list, kind, pattern, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) % 200 AS INTEGER) AS d, steps
  FROM listed),
spans AS (
  SELECT list, kind, pattern, CAST(d + steps[1] AS DATE) AS since, CAST(d + steps[2] AS DATE) AS until FROM dated
  UNION ALL SELECT list, kind, pattern, CAST(d + steps[3] AS DATE), NULL FROM dated WHERE len(steps) > 2),
asked AS (
  SELECT page_id, day, 'url' AS kind, address AS pattern, 1000 AS depth FROM named WHERE host <> ''
  UNION ALL
  SELECT page_id, day, 'domain', array_to_string(labels[-n:], '.'), n
  FROM (SELECT page_id, day, labels, unnest(range(1, len(labels) + 1)) AS n FROM named WHERE host <> '')),
best AS (
  SELECT page_id, list, pattern, since,
         row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, list DESC, since DESC) AS r
  FROM asked JOIN spans USING (kind, pattern) WHERE since <= day AND (until IS NULL OR day < until))
SELECT c.page_id, c.day, coalesce(b.list = 'block', false) AS blocked, b.list AS by_list, b.pattern AS by_pattern, b.since
FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND b.r = 1
"""


def url_lists(pages: DataFrame) -> DataFrame:
    """Dated entries for every host, every registered domain and every address with a query string of ``pages``."""
    host, address = urls.host_of(F.col("url")), urls.address_of(F.col("url"))
    named = pages.select(host.alias("host"), address.alias("address")).where("host <> ''")
    domain = F.array_join(F.slice(F.split("host", r"\."), F.greatest(-F.size(F.split("host", r"\.")), F.lit(-2)), 2), ".")

    def entries(rows, kind, pattern, name, steps):
        start = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 4), 16, 10).cast("int") % 200
        listed = rows.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern")).distinct()
        dated = listed.withColumn("s", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(a).alias("action")) for d, a in steps])))
        return dated.select("list", "kind", "pattern", F.date_add(F.to_date(F.lit("2024-01-01")), start + F.col("s.d")).alias("day"), "s.action")

    hosts = entries(named, "domain", F.col("host"), "block", [(0, "add"), (45, "remove"), (120, "add")])
    domains = entries(named, "domain", domain, "allow", [(150, "add")])
    tagged = entries(named.where(F.contains(F.col("address"), F.lit("?"))), "url", F.col("address"), "block", [(0, "add"), (30, "remove")])
    return hosts.unionByName(domains).unionByName(tagged)


@query("op9_url_filter", URL_SQL)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 366).cast("int")))
    return urls.judge(captures, url_lists(pages)).select("page_id", "day", "blocked", "by_list", "by_pattern", "since")


@query("op13_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = packing.pack_texts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=1,
        limits=packing.Limits(tokens=2048, segments=256, loss=2048))
    return found.select(
        F.col("example").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset")


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0, positives=5, negatives=3, share=(50, 95), scale=256.0)


PHRASES_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 6) t(k))),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= 100),
cuts AS (
  SELECT o.lang, o.k, o.phrase, o.f AS a, j, array_to_string(string_split(o.phrase, ' ')[:j], ' ') AS x,
         array_to_string(string_split(o.phrase, ' ')[j + 1 :], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM often WHERE k > 1) o),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, l.f AS l, r.f AS r, n,
         CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN often l ON l.lang = c.lang AND l.phrase = c.x JOIN often r ON r.lang = c.lang AND r.phrase = c.y
  JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM often o WHERE o.lang = s.lang AND o.k > s.k AND 100 * o.f >= 100 * s.a
      AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM kept
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""


@query("op11_phrases", PHRASES_SQL)
def phrases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, first=2000)
