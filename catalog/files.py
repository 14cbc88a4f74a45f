"""Projections, filters and string functions."""

from pyspark.sql import functions as F

from vetloom.constants import CWE_CLASSES, STATUS_CODES, CWE_CODES, TRAINING_CWE_CODES
from vetloom.functions import text as fn
from vetloom.operators import files as op
from vetloom.session import spread

from .registry import FILES, PACKAGES, RESULTS, query

CLASS_SQL = "[" + ", ".join(f"'{c}'" for c in CWE_CLASSES) + "]"

METADATA = """blocks AS (
  SELECT s_suppkey, concat('Name: ', s_name, chr(10), 'Summary: nation: ', s_nationkey, chr(10),
    'Home-page: none', chr(10), 'no separator', chr(10), 'VERSION : ', s_nationkey, '.0', chr(10),
    CASE s_suppkey % 4
      WHEN 0 THEN concat('Author-email: ', s_name, ' <s', s_suppkey, '@x.org>', chr(10))
      WHEN 1 THEN concat('Maintainer: M', s_suppkey, chr(10), 'Maintainer-email: m@y.org', chr(10))
      WHEN 2 THEN concat('Author:  ', chr(10), 'Author-email: plain@z.org', chr(10))
      ELSE concat('Author: First', chr(10), 'author: Second', chr(10)) END) AS text
  FROM supplier)"""

_KEYS = ["name", "summary", "author", "author-email", "version", "maintainer", "maintainer-email"]
PARSED = METADATA + """,
lines AS (
  SELECT s_suppkey, i, trim(lower(split_part(line, ':', 1))) AS key,
         trim(regexp_replace(line, '^[^:]*:', '')) AS value
  FROM (SELECT s_suppkey, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM blocks)
  WHERE contains(line, ':')),
parsed AS (
  SELECT s_suppkey, """ + ", ".join(
    f"""max_by(value, i) FILTER (key = '{k}') AS "{k}\"""" for k in _KEYS
) + " FROM lines GROUP BY 1)"


def metadata(t):
    key = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    tail = (
        F.when(key % 4 == 0, F.concat(F.lit("Author-email: "), "s_name", F.lit(" <s"), text(key),
                                      F.lit("@x.org>\n")))
        .when(key % 4 == 1, F.concat(F.lit("Maintainer: M"), text(key),
                                     F.lit("\nMaintainer-email: m@y.org\n")))
        .when(key % 4 == 2, "Author:  \nAuthor-email: plain@z.org\n")
        .otherwise("Author: First\nauthor: Second\n")
    )
    return t.supplier.select(
        key,
        F.concat(
            F.lit("Name: "), "s_name", F.lit("\nSummary: nation: "), text(F.col("s_nationkey")),
            F.lit("\nHome-page: none\nno separator\nVERSION : "), text(F.col("s_nationkey")),
            F.lit(".0\n"), tail,
        ).alias("text"),
    )


@query("admit_uploads", """
SELECT page_id, admitted, reject_reason FROM (
  SELECT page_id, CASE WHEN lower(regexp_extract(url, '(\\.[^.]*)$', 1)) NOT IN ('.zip', '.py')
    AND page_id % 3 <> 0 THEN 'extension'
    WHEN length(html) > 2000 THEN 'size' END AS reject_reason,
    reject_reason IS NULL AS admitted FROM pages)""")
def admit_uploads(t):
    named = t.pages.select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".ZIP"))).otherwise(
            F.col("url")
        ).alias("name"),
        F.length("html").alias("size"),
    )
    out = op.admit_uploads(named, [".py", ".zip"], max_bytes=2000)
    return out.select("page_id", "admitted", "reject_reason")


@query("drop_empty_content", f"""
WITH {FILES}, holed AS (SELECT file_id, CASE file_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL
  ELSE content END AS content FROM files)
SELECT file_id, CAST(length(content) AS INTEGER) AS n FROM holed WHERE length(content) > 0""")
def drop_empty_content(t):
    content = F.when(F.col("file_id") % 5 == 0, "").when(F.col("file_id") % 5 > 1, F.col("content"))
    df = t.files.select("file_id", content.alias("content"))
    return op.drop_empty_content(df).select("file_id", F.length("content").alias("n"))


@query("strip_comments", f"""
WITH {FILES}, marked AS (SELECT file_id, concat('x = 1 # ', chr(39), chr(39), chr(39), content,
    chr(39), chr(39), chr(39), ' y', chr(10), repeat('"', 3), name, repeat('"', 3), chr(10), content)
    AS c FROM files)
SELECT file_id, md5(regexp_replace(regexp_replace(regexp_replace(c, '(?s)''''''.*?''''''', '', 'g'),
  '(?s)\"\"\".*?\"\"\"', '', 'g'), '#[^\n]*', '', 'g')) AS code FROM marked""")
def strip_comments(t):
    quotes, doubles = F.lit("'''"), F.lit('"""')
    marked = F.concat(
        F.lit("x = 1 # "), quotes, "content", quotes, F.lit(" y\n"), doubles, "name", doubles,
        F.lit("\n"), "content",
    )
    files = spread(t.files.select("file_id", "name", "content"))
    return files.select("file_id", F.md5(fn.strip_comments(marked)).alias("code"))


@query("normalize_code", """
SELECT doc_id, md5(replace(replace(replace(replace(text, ' ', chr(9)), chr(9), '    '),
  concat(chr(13), chr(10)), chr(10)), chr(13), chr(10))) AS code FROM documents""")
def normalize_code(t):
    tabbed = F.replace("text", F.lit(" "), F.lit("\t"))
    return t.documents.select("doc_id", F.md5(fn.normalize_code(tabbed)).alias("code"))


@query("clean_code_text", """
SELECT doc_id, md5(replace(coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL
  ELSE concat(text, chr(0)) END, ''), chr(0), ' ')) AS code FROM documents""")
def clean_code_text(t):
    holed = F.when(F.col("doc_id") % 9 != 0, F.concat("text", F.lit("\x00")))
    return t.documents.select("doc_id", F.md5(fn.clean_code_text(holed)).alias("code"))


@query("parse_metadata", f"WITH {PARSED} SELECT * FROM parsed")
def parse_metadata(t):
    return op.parse_metadata(metadata(t))


@query("fill_author", f"""
WITH {PARSED}, split AS (
  SELECT *, coalesce(trim(author), '') = '' AND regexp_matches("author-email", '^(.*)<(.*@.*)>') AS s
  FROM parsed),
first AS (
  SELECT s_suppkey, maintainer, "maintainer-email" AS m,
    CASE WHEN s THEN trim(regexp_extract("author-email", '^(.*)<(.*@.*)>', 1)) ELSE author END AS a,
    CASE WHEN s THEN trim(regexp_extract("author-email", '^(.*)<(.*@.*)>', 2))
         ELSE "author-email" END AS e FROM split)
SELECT s_suppkey, CASE WHEN coalesce(trim(a), '') = '' AND coalesce(trim(maintainer), '') <> ''
    THEN maintainer ELSE a END AS author,
  CASE WHEN coalesce(trim(e), '') = '' AND coalesce(trim(m), '') <> '' THEN m ELSE e END
    AS author_email FROM first""")
def fill_author(t):
    df = op.fill_author(op.parse_metadata(metadata(t)))
    return df.select("s_suppkey", "author", F.col("`author-email`").alias("author_email"))


MAIL = "concat(c_name, ' <', c_custkey, '@', lower(c_mktsegment), '.org>')"


def mail(t):
    return t.customer.select(
        "c_custkey",
        F.when(
            F.col("c_custkey") % 4 != 0,
            F.concat("c_name", F.lit(" <"), F.col("c_custkey").cast("string"), F.lit("@"),
                     F.lower("c_mktsegment"), F.lit(".org>")),
        ).otherwise(F.col("c_name")).alias("mail"),
    )


@query("parse_name_email", f"""
WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN {MAIL} ELSE c_name END AS mail
  FROM customer)
SELECT c_custkey,
  CASE WHEN regexp_matches(mail, '^(.*)<(.*@.*)>')
       THEN trim(regexp_extract(mail, '^(.*)<(.*@.*)>', 1)) END AS author,
  CASE WHEN regexp_matches(mail, '^(.*)<(.*@.*)>')
       THEN trim(regexp_extract(mail, '^(.*)<(.*@.*)>', 2)) END AS email FROM m""")
def parse_name_email(t):
    name, email = fn.parse_name_email(F.col("mail"))
    return mail(t).select("c_custkey", name.alias("author"), email.alias("email"))


@query("email_domain", f"""
WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN {MAIL} ELSE c_name END AS mail
  FROM customer)
SELECT c_custkey, nullif(regexp_extract(mail, '@(.+)', 1), '') AS domain FROM m""")
def email_domain(t):
    return mail(t).select("c_custkey", fn.email_domain(F.col("mail")).alias("domain"))


@query("core_name", f"""
WITH {PACKAGES} SELECT name, regexp_extract(lower(name), '^[^-_.]*') AS core FROM packages""")
def core_name(t):
    return t.packages.select("name", fn.core_name(F.col("name")).alias("core"))


@query("path_parts", f"""
WITH {FILES}, p AS (SELECT file_id, CASE file_id % 3 WHEN 0 THEN concat('source/', path)
  WHEN 1 THEN replace(path, '/', '\\') ELSE path END AS path FROM files),
u AS (SELECT file_id, replace(path, '\\', '/') AS rel_path FROM p)
SELECT file_id, rel_path, regexp_extract(rel_path, '[^/]*$') AS base_name,
  split_part(regexp_replace(rel_path, '^source/', ''), '/', 1) AS package FROM u""")
def path_parts(t):
    path = (
        F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("source/"), "path"))
        .when(F.col("file_id") % 3 == 1, F.replace("path", F.lit("/"), F.lit("\\")))
        .otherwise(F.col("path"))
    )
    df = op.path_parts(t.files.select("file_id", path.alias("path")))
    return df.select("file_id", "rel_path", "base_name", "package")


@query("find_source", f"""
WITH {FILES}, asked AS (
  SELECT session_id, CASE file_id % 3 WHEN 0 THEN path WHEN 1 THEN concat('lost/', name)
    ELSE substring(name, 2, 100) END AS wanted FROM files),
hits AS (
  SELECT a.session_id, a.wanted, f.path,
    CASE WHEN f.path = a.wanted THEN 0
         WHEN f.name = regexp_extract(a.wanted, '[^/]*$') THEN 1 ELSE 2 END AS match_kind
  FROM (SELECT DISTINCT * FROM asked) a JOIN files f
    ON a.session_id = f.session_id AND ends_with(f.name, regexp_extract(a.wanted, '[^/]*$')))
SELECT session_id, wanted, match_kind, path FROM hits
QUALIFY row_number() OVER (PARTITION BY session_id, wanted ORDER BY match_kind, path) = 1""")
def find_source(t):
    wanted = (
        F.when(F.col("file_id") % 3 == 0, F.col("path"))
        .when(F.col("file_id") % 3 == 1, F.concat(F.lit("lost/"), "name"))
        .otherwise(F.substring("name", 2, 100))
    )
    return op.find_sources(t.files, t.files.select("session_id", wanted.alias("wanted")))


@query("is_valid_version", f"""
WITH {PACKAGES} SELECT p_partkey,
  coalesce(regexp_matches(trim(version), '^[0-9]+\\.[0-9]+\\.[0-9]+$'), false) AS version_valid
FROM packages""")
def is_valid_version(t):
    return t.packages.select(
        "p_partkey", fn.is_valid_version(F.col("version")).alias("version_valid")
    )


@query("reorder_columns", f"""
WITH {PACKAGES} SELECT name, summary, version, download, p_partkey, author_email FROM packages""")
def reorder_columns(t):
    return op.reorder_columns(t.packages)


@query("preview_text", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 100), '...')
  ELSE text END AS preview FROM documents""")
def preview_text(t):
    return t.documents.select("doc_id", fn.preview_text(F.col("text")).alias("preview"))


@query("lower_flatten", """
SELECT page_id, md5(replace(lower(html), chr(10), ' ')) AS flat FROM pages""")
def lower_flatten(t):
    return t.pages.select("page_id", F.md5(fn.lower_flatten(F.col("html"))).alias("flat"))


@query("map_labels", f"""
WITH {RESULTS}, s AS (
  SELECT file_id, CASE WHEN is_vulnerable IS NULL THEN 'Error' WHEN is_vulnerable THEN 'Vulnerable'
    ELSE 'Not Vulnerable' END AS status,
    CASE WHEN is_vulnerable IS NULL THEN 'parsing_error' WHEN is_vulnerable THEN cwe_label
    ELSE 'Benign' END AS cwe FROM results)
SELECT file_id, CASE status WHEN 'Vulnerable' THEN 1 WHEN 'Not Vulnerable' THEN 0 ELSE -1 END
    AS status_code,
  CASE WHEN cwe = 'Benign' THEN 0 WHEN cwe = 'parsing_error' THEN -1 ELSE 1 END AS cwe_code,
  CASE WHEN file_id % 2 = 0 THEN CASE WHEN status = 'Error' THEN '' WHEN file_id % 4 = 0 THEN '1'
    ELSE '0' END ELSE '' END AS training_code FROM s""")
def map_labels(t):
    vulnerable = F.col("is_vulnerable")
    status = (
        F.when(vulnerable.isNull(), "Error").when(vulnerable, "Vulnerable").otherwise("Not Vulnerable")
    )
    cwe = (
        F.when(vulnerable.isNull(), "parsing_error").when(vulnerable, F.col("cwe_label"))
        .otherwise("Benign")
    )
    word = F.when(vulnerable.isNull(), "Error").when(F.col("file_id") % 4 == 0, "malicious").when(
        F.col("file_id") % 2 == 0, "benign"
    )
    return t.results.select(
        "file_id",
        fn.map_labels(status, STATUS_CODES).alias("status_code"),
        fn.map_labels(cwe, CWE_CODES, 1).alias("cwe_code"),
        F.coalesce(fn.map_labels(word, TRAINING_CWE_CODES).cast("string"), F.lit("")).alias(
            "training_code"
        ),
    )


@query("normalize_class", f"""
WITH raw AS (SELECT doc_id, CASE doc_id % 12 WHEN 8 THEN '0' WHEN 9 THEN ' CWE-89 '
    WHEN 10 THEN 'CWE-1' WHEN 11 THEN 'CLEAN' ELSE {CLASS_SQL}[CAST(doc_id % 12 + 1 AS INTEGER)] END
    AS cwe FROM documents),
n AS (SELECT doc_id, CASE WHEN list_contains({CLASS_SQL}, trim(cwe)) THEN trim(cwe) ELSE 'CLEAN' END
    AS label FROM raw)
SELECT doc_id, label, CAST(list_position({CLASS_SQL}, label) - 1 AS INTEGER) AS class_idx FROM n""")
def normalize_class(t):
    k = (F.col("doc_id") % 12).cast("int")
    raw = (
        F.when(k == 8, "0").when(k == 9, " CWE-89 ").when(k == 10, "CWE-1").when(k == 11, "CLEAN")
        .otherwise(F.get(F.array(*map(F.lit, CWE_CLASSES)), k))
    )
    df = t.documents.select("doc_id", fn.normalize_class(raw).alias("label"))
    return df.withColumn("class_idx", fn.class_index(F.col("label")))


def _holed(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic")


_HOLED = "h AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query("null_policy_fill", f"""
WITH {_HOLED} SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM h""")
def null_policy_fill(t):
    return op.null_policy(_holed(t), "fill", -1)


@query("null_policy_fill_zero", f"""
WITH {_HOLED} SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM h""")
def null_policy_fill_zero(t):
    return op.null_policy(_holed(t), "fill", 0)


@query("null_policy_fill_each", f"""
WITH {_HOLED} SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic FROM h""")
def null_policy_fill_each(t):
    return op.null_policy(_holed(t), "fill_each", values={"quality": 0, "toxic": -1})


@query("null_policy_drop_any", f"""
WITH {_HOLED} SELECT * FROM h WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def null_policy_drop_any(t):
    return op.null_policy(_holed(t), "drop_any")


@query("null_policy_drop_subset", f"WITH {_HOLED} SELECT * FROM h WHERE toxic IS NOT NULL")
def null_policy_drop_subset(t):
    return op.null_policy(_holed(t), "drop_subset", columns=["toxic"])


@query("read_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def read_columns(t):
    return op.read_columns(t.orders, 3)


@query("evolve_schema", """
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS o_orderpriority,
  false AS is_ml, '' AS package_name FROM orders""")
def evolve_schema(t):
    old = t.orders.select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority")
    )
    defaults = {"o_orderpriority": "none", "is_ml": False, "package_name": ""}
    return op.evolve_schema(old, defaults)
