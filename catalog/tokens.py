"""Tokens, windows and embedded sequences."""

from pyspark.sql import functions as F

from vetloom.functions.vectors import array_sum
from vetloom.constants import PYTHON_KEYWORDS
from vetloom.operators import tokens as op
from vetloom.operators.windows import char_windows, token_windows
from vetloom.session import spread

from .registry import FILES, ORACLES, WINDOWS, query

TOKENS = FILES + """,
tokens AS (SELECT file_id, regexp_extract_all(content, '[\\p{L}\\p{N}_]+') AS tokens FROM files),
exploded AS (SELECT file_id, unnest(tokens) AS token,
  CAST(generate_subscripts(tokens, 1) - 1 AS INTEGER) AS pos FROM tokens)"""

# A vector id as a short word; the words of the first vectors occur in the texts.
TOKEN_SQL = """concat(chr(CAST(97 + vec_id % 26 AS INTEGER)), chr(CAST(97 + vec_id // 26 % 26 AS INTEGER)),
  CASE WHEN vec_id >= 676 THEN CAST(vec_id // 676 AS VARCHAR) ELSE '' END)"""
VECTORS = f"vectors AS (SELECT vec_id, {TOKEN_SQL} AS token, embedding AS vector FROM embeddings)"
DIM = 64


def vectors(t):
    v = F.col("vec_id")
    letter = lambda n: F.char(F.lit(97) + n)
    tail = F.when(v >= 676, F.floor(v / F.lit(676)).cast("string")).otherwise("")
    token = F.concat(letter(v % 26), letter(F.floor(v / F.lit(26)) % 26), tail)
    return t.embeddings.select("vec_id", token.alias("token"), F.col("embedding").alias("vector"))


def tokens(t):
    files = spread(t.files.select("file_id", "content"))
    return files.select("file_id", op.word_tokens(F.col("content")).alias("tokens"))


@query("word_tokens", f"""
WITH {TOKENS} SELECT file_id, CAST(len(tokens) AS INTEGER) AS n,
  md5(array_to_string(tokens, ' ')) AS tokens FROM tokens""")
def word_tokens(t):
    joined = F.md5(F.array_join("tokens", " ")).alias("tokens")
    return tokens(t).select("file_id", F.size("tokens").alias("n"), joined)


_LEXEME = op.LEXEME.replace("*+", "*").replace("'", "''")
_WIDE = op.WIDE.replace("'", "''")


@query("lexical_tokens", f"""
WITH lexemes AS (
  SELECT doc_id AS file_id, regexp_extract_all(concat(chr(10), text, chr(10)), '{_LEXEME}') AS l
  FROM documents WHERE text IS NOT NULL),
rows AS (
  SELECT file_id, unnest(range(len(l))) AS k, unnest(l) AS token FROM lexemes),
kept AS (
  SELECT *, regexp_matches(token, '^\r?\n') AS is_end FROM rows
  WHERE token[1] <> '#' AND NOT regexp_matches(token, '^[\\\\]\r?\n')),
ends AS (
  SELECT *, lead(is_end) OVER (PARTITION BY file_id ORDER BY k) AS follows FROM kept),
lined AS (
  SELECT *, sum(CAST(is_end AS INTEGER)) OVER f AS line, follows IS NULL AS is_last,
    sum(CASE WHEN token IN ('(', '[', '{{') THEN 1 WHEN token IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER f AS depth,
    regexp_replace(token, '[\r\n\f]', '', 'g') AS margin
  FROM ends WHERE NOT is_end OR coalesce(NOT follows, true)
  WINDOW f AS (PARTITION BY file_id ORDER BY k)),
starts AS (
  SELECT file_id, list(line ORDER BY k) AS lines, list(k ORDER BY k) AS ks,
    list(8 * len(regexp_extract_all(margin, ' {{0,7}}\t| {{8}}')) + length(regexp_replace(margin, ' {{0,7}}\t| {{8}}', '', 'g')) ORDER BY k) AS ws
  FROM lined WHERE is_end AND NOT is_last AND depth <= 0 GROUP BY 1),
stacks AS (
  SELECT file_id, unnest(lines) AS line, unnest(ks) AS k, unnest(list_transform(range(1, len(ws) + 1), lambda i:
      len(list_distinct(list_transform(list_filter(range(1, i + 1),
        lambda j: ws[j] > 0 AND ws[j] = list_min(ws[j:i])), lambda j: ws[j]))))) AS level,
    unnest(list_transform(range(1, len(ws) + 1), lambda i: i > 1 AND ws[i] > 0 AND ws[i] < ws[i - 1]
      AND len(list_filter(range(1, i), lambda j: ws[j] = ws[i] AND list_min(ws[j:i]) = ws[i])) = 0)) AS broken
  FROM starts),
marks AS (
  SELECT *, level - lag(level, 1, 0) OVER (PARTITION BY file_id ORDER BY line) AS mark FROM stacks),
cuts AS (
  SELECT file_id, coalesce(min(line) FILTER (broken), 9000000000) AS cut, max_by(level, line) AS level FROM marks GROUP BY 1),
told AS (
  SELECT file_id, k, 0 AS part, token FROM lined JOIN cuts USING (file_id)
  WHERE NOT is_end AND line < cut AND NOT regexp_matches(token, '{_WIDE}')
  UNION ALL
  SELECT file_id, k, 0, '<EOL>' FROM lined JOIN cuts USING (file_id) WHERE is_end AND depth <= 0 AND line > 1 AND line <= cut
  UNION ALL
  SELECT file_id, k, unnest(range(1, abs(mark) + 1)), CASE WHEN mark > 0 THEN '<INDENT>' ELSE '<DEDENT>' END
  FROM marks JOIN cuts USING (file_id) WHERE line < cut AND mark <> 0
  UNION ALL
  SELECT file_id, k, unnest(range(1, level + 1)), '<DEDENT>'
  FROM lined JOIN cuts USING (file_id) WHERE is_last AND is_end AND depth <= 0 AND cut = 9000000000)
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY k, part) - 1 AS INTEGER) AS pos, token FROM told""")
def lexical_tokens(t):
    return op.lexical_tokens(spread(t.files.select("file_id", "content")))


@query("char_windows", f"""
WITH {WINDOWS} SELECT file_id, chunk_idx, n_chunks, md5(text) AS text FROM windows""")
def char_windows_query(t):
    df = char_windows(spread(t.files.select("file_id", "content")))
    return df.withColumn("text", F.md5("text"))


def token_window_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
WITH {TOKENS}, counted AS (
  SELECT *, CAST(CASE WHEN len(tokens) = 0 THEN 0 WHEN len(tokens) <= {size} THEN 1
    ELSE 1 + ceil((len(tokens) - {size}) / {step}e0) END AS INTEGER) AS n_chunks FROM tokens)
SELECT file_id, CAST(i AS INTEGER) AS chunk_idx, n_chunks,
  md5(array_to_string(tokens[CAST(i * {step} + 1 AS INTEGER) : CAST(i * {step} + {size} AS INTEGER)], ' ')) AS tokens
FROM (SELECT *, unnest(range(n_chunks)) AS i FROM counted)"""


def token_window_query(size: int, overlap: int):
    @query(f"token_windows_{size}_{overlap}", token_window_sql(size, overlap))
    def run(t):
        df = token_windows(tokens(t), size, overlap)
        return df.withColumn("tokens", F.md5(F.array_join("tokens", " ")))


for _size, _overlap in ((512, 64), (512, 128), (512, 102), (512, 256)):
    token_window_query(_size, _overlap)


@query("vocabulary", f"""
WITH {TOKENS} SELECT token, count(*) AS n FROM exploded GROUP BY 1 HAVING count(*) >= 10""")
def vocabulary(t):
    return op.vocabulary(tokens(t))


@query("train_word2vec")
def train_word2vec(t):
    return op.model_vectors(op.train_word2vec(tokens(t)))


@query("similar_tokens", f"""
WITH {VECTORS}, q AS (SELECT vector AS v FROM vectors WHERE token = 'on')
SELECT token, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(v AS DOUBLE[])), 6)
  AS similarity FROM vectors, q WHERE token <> 'on'
ORDER BY list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(v AS DOUBLE[])) DESC, token LIMIT 5""")
def similar_tokens(t):
    return op.similar_tokens(vectors(t).select("token", "vector"), "on", 5)


def _digest(df):
    """Both ends of each vector, so that rows can be compared."""
    ends = F.get("vector", F.lit(0)).cast("double") + F.get("vector", F.lit(DIM - 1)).cast("double")
    return df.select("file_id", "pos", "token", ends.alias("ends"), F.size("vector").alias("dim"))


ENDS = "CAST(vector[1] AS DOUBLE) + CAST(vector[64] AS DOUBLE)"


@query("embed_tokens_drop", f"""
WITH {TOKENS}, {VECTORS}
SELECT file_id, pos, e.token, round({ENDS}, 6) AS ends, 64 AS dim
FROM exploded e JOIN vectors v ON e.token = v.token""")
def embed_tokens_drop(t):
    rows = op.explode_tokens(tokens(t))
    return _digest(op.embed_tokens(rows, vectors(t).drop("vec_id"), "drop", DIM))


@query("embed_tokens_zero", f"""
WITH {TOKENS}, {VECTORS}
SELECT file_id, pos, e.token, round(coalesce({ENDS}, 0e0), 6) AS ends, 64 AS dim
FROM exploded e LEFT JOIN vectors v ON e.token = v.token""")
def embed_tokens_zero(t):
    rows = op.explode_tokens(tokens(t))
    return _digest(op.embed_tokens(rows, vectors(t).drop("vec_id"), "zero", DIM))


def _sequence_digest(df, *more):
    weighted = F.transform(
        "sequence", lambda v, i: (i + 1) * array_sum(F.transform(v, lambda x: x.cast("double")))
    )
    return df.select(
        "file_id", "n_known", F.size("sequence").alias("length"), array_sum(weighted).alias("total"), *more
    )


@query("fix_length_drop", f"""
WITH {TOKENS}, {VECTORS}, known AS (
  SELECT file_id, list_sum(CAST(vector AS DOUBLE[])) AS s,
    row_number() OVER (PARTITION BY file_id ORDER BY pos) AS r
  FROM exploded e JOIN vectors v ON e.token = v.token)
SELECT file_id, CAST(count(*) AS INTEGER) AS n_known, 100 AS length, round(sum(r * s), 6) AS total
FROM known WHERE r <= 100 GROUP BY 1""")
def fix_length_drop(t):
    rows = op.explode_tokens(tokens(t))
    return _sequence_digest(op.fix_length(rows, vectors(t).drop("vec_id"), 100, "drop", DIM))


@query("fix_length_zero", f"""
WITH {TOKENS}, {VECTORS}
SELECT file_id, CAST(count(*) AS INTEGER) AS n_known, 100 AS length,
  round(sum((pos + 1) * coalesce(list_sum(CAST(vector AS DOUBLE[])), 0e0)), 6) AS total
FROM exploded e LEFT JOIN vectors v ON e.token = v.token WHERE pos < 100 GROUP BY 1""")
def fix_length_zero(t):
    rows = op.explode_tokens(tokens(t))
    return _sequence_digest(op.fix_length(rows, vectors(t).drop("vec_id"), 100, "zero", DIM))


def every_file_sql(oov: str) -> str:
    """The rows of ``fix_length_<oov>`` and an error row for each file that has none."""
    return f"""
WITH s AS ({ORACLES[f"fix_length_{oov}"]})
SELECT d.doc_id AS file_id, coalesce(n_known, 0) AS n_known, 100 AS length, coalesce(total, 0e0) AS total,
  CASE WHEN n_known IS NULL THEN 'Error' ELSE 'OK' END AS status
FROM documents d LEFT JOIN s ON d.doc_id = s.file_id"""


def every_file_query(oov: str):
    @query(f"fix_length_{oov}_every_file", every_file_sql(oov))
    def run(t):
        rows, files = op.explode_tokens(tokens(t)), t.files.select("file_id")
        out = op.fix_length(rows, vectors(t).drop("vec_id"), 100, oov, DIM, files=files)
        return _sequence_digest(out, "status")


for _oov in ("drop", "zero"):
    every_file_query(_oov)


@query("first_appearance_rank", f"""
WITH {TOKENS}, firsts AS (SELECT file_id, token, min(pos) AS p FROM exploded GROUP BY 1, 2)
SELECT file_id, token, CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY p) AS INTEGER)
  AS appearance FROM firsts""")
def first_appearance_rank(t):
    return op.first_appearance_rank(tokens(t))


_KEYWORDS = ", ".join(f"'{w.lower()}'" for w in PYTHON_KEYWORDS)


@query("canonicalize_identifiers", f"""
WITH lowered AS (
  SELECT doc_id AS file_id, replace(lower(text), ':', concat(':', chr(1))) AS code FROM documents WHERE text IS NOT NULL),
cut AS (
  SELECT file_id, string_split_regex(code, '(^|[^\\p{{L}}\\p{{N}}_])(if|while|for)[\x09-\x0D\x20]+[^:]+:') AS texts,
    regexp_extract_all(code, '(^|[^\\p{{L}}\\p{{N}}_])(if|while|for)[\x09-\x0D\x20]+[^:]+:', 1) AS pre,
    regexp_extract_all(code, '(^|[^\\p{{L}}\\p{{N}}_])(if|while|for)[\x09-\x0D\x20]+[^:]+:', 2) AS heads
  FROM lowered),
flat AS (
  SELECT file_id, trim(regexp_replace(replace(array_to_string(list_transform(range(1, len(texts) + 1),
    lambda i: concat(texts[i], pre[i], CASE WHEN i <= len(heads) THEN concat(heads[i], ' cond', i, ':') END)), ''), chr(1), ''),
    '[\x09-\x0D\x1c-\x20]+', ' ', 'g')) AS code FROM cut),
pieces AS (
  SELECT file_id, string_split_regex(code, '[\\p{{L}}\\p{{N}}_]+') AS gaps, regexp_extract_all(code, '[\\p{{L}}\\p{{N}}_]+') AS words FROM flat),
placed AS (
  SELECT file_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word, unnest(gaps[2:]) AS gap FROM pieces),
firsts AS (
  SELECT file_id, word, min(pos) AS p FROM placed
  WHERE regexp_full_match(word, '[a-z_][a-z0-9_]*') AND word[1:4] <> 'cond' AND word NOT IN ({_KEYWORDS}) GROUP BY 1, 2),
names AS (SELECT file_id, word, concat('a', row_number() OVER (PARTITION BY file_id ORDER BY p)) AS name FROM firsts),
joined AS (
  SELECT file_id, string_agg(concat(coalesce(name, word), gap), '' ORDER BY pos) AS tail
  FROM placed LEFT JOIN names USING (file_id, word) GROUP BY 1)
SELECT file_id, concat(gaps[1], tail) AS code FROM pieces LEFT JOIN joined USING (file_id)""")
def canonicalize_identifiers(t):
    return op.canonicalize_identifiers(spread(t.files.select("file_id", "content")))


@query("corpus_stats", """
SELECT CAST(sum(length(t)) AS BIGINT) AS n_chars,
  CAST(sum(length(t) - length(replace(t, ' ', ''))) AS BIGINT) AS n_spaces
FROM (SELECT replace(lower(text), chr(10), ' ') AS t FROM documents)""")
def corpus_stats(t):
    return op.corpus_stats(t.files)


@query("sentences")
def sentences(t):
    df = op.sentences(t.files)
    return df.select("file_id", "sentence_idx", F.size("words").alias("n_words"))
