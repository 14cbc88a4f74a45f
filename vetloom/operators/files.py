"""Projections and filters over files and package metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_UPLOAD_BYTES, METADATA_KEYS, PRIORITY_COLUMNS
from ..functions.text import (
    base_name,
    package_directory,
    parse_name_email,
    strip_whitespace,
    unix_path,
)
from .skew import salted_join


def admit_uploads(
    df: DataFrame,
    extensions: Sequence[str],
    max_bytes: int = MAX_UPLOAD_BYTES,
    name: str = "name",
    size: str = "size",
) -> DataFrame:
    """Add ``admitted`` and ``reject_reason``; the extension test ignores case."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    reason = F.when(~suffix.isin([e.lower() for e in extensions]), "extension").when(
        F.col(size) > max_bytes, "size"
    )
    return df.withColumn("reject_reason", reason).withColumn(
        "admitted", F.col("reject_reason").isNull()
    )


def drop_empty_content(df: DataFrame, content: str = "content") -> DataFrame:
    return df.filter(F.length(content) > 0)


def parse_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """``Key: value`` lines to one nullable column per kept key; the last duplicate wins.

    A row that holds none of the keys is dropped.
    """
    lines = F.split(F.col(text), r"\r\n|\r|\n")
    pairs = F.transform(
        F.filter(lines, lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(
            F.lower(strip_whitespace(F.substring_index(line, ":", 1))).alias("key"),
            strip_whitespace(F.regexp_replace(line, "^[^:]*:", "")).alias("value"),
        ),
    )
    known = F.filter(pairs, lambda p: p["key"].isin(METADATA_KEYS))
    last = lambda key: F.try_element_at(
        F.filter("_pairs", lambda p: p["key"] == key), F.lit(-1)
    )["value"]
    rest = [c for c in df.columns if c != text]
    return (
        df.withColumn("_pairs", known)
        .filter(F.size("_pairs") > 0)
        .select(*rest, *[last(key).alias(key) for key in METADATA_KEYS])
    )


def fill_author(df: DataFrame) -> DataFrame:
    """Ordered fallback for author and mail; blank counts as missing."""
    blank = lambda c: F.coalesce(strip_whitespace(c) == "", F.lit(True))
    author, email = F.col("author"), F.col("`author-email`")
    name, address = parse_name_email(email)
    both = blank(author) & ~blank(name) & ~blank(address)
    split = df.withColumns(
        {
            "author": F.when(both, name).otherwise(author),
            "author-email": F.when(both, address).otherwise(email),
        }
    )
    maintainer, maintainer_email = F.col("maintainer"), F.col("`maintainer-email`")
    return split.withColumns(
        {
            "author-email": F.when(blank(email) & ~blank(maintainer_email), maintainer_email)
            .otherwise(email),
            "author": F.when(blank(author) & ~blank(maintainer), maintainer).otherwise(author),
        }
    )


def path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add forward-slash ``rel_path``, ``base_name`` and ``package``."""
    return df.withColumns(
        {
            "rel_path": unix_path(F.col(path)),
            "base_name": base_name(F.col(path)),
            "package": package_directory(F.col(path)),
        }
    )


def find_source(
    files: DataFrame, session: str, path: str, session_col: str = "session_id"
) -> DataFrame:
    """The one best match for ``path``: same path, else same name, else a name ending in it."""
    wanted = path.replace("\\", "/")
    name = wanted.rsplit("/", 1)[-1]
    own = unix_path(F.col("path"))
    kind = (
        F.when(own == wanted, 0)
        .when(base_name(F.col("path")) == name, 1)
        .when(own.endswith(name), 2)
    )
    return (
        files.filter(F.col(session_col) == session)
        .withColumn("match_kind", kind)
        .filter("match_kind IS NOT NULL")
        .orderBy("match_kind", "path")
        .limit(1)
    )


def find_sources(files: DataFrame, requests: DataFrame) -> DataFrame:
    """``find_source`` for a table of ``(session_id, wanted)`` requests.

    All three match kinds are equi-joins on the session and a piece of text: the path, the name, or
    an ending of the name. Files are first reduced to their smallest path per session and text, so
    equal names make one row; and names are cut only to the lengths that the session's unanswered
    requests have, not to all their endings.
    """
    files = files.select(
        "session_id",
        "path",
        unix_path(F.col("path")).alias("_own"),
        base_name(F.col("path")).alias("_name"),
    )
    asked = requests.select(
        "session_id",
        "wanted",
        unix_path(F.col("wanted")).alias("_own"),
        base_name(F.col("wanted")).alias("_name"),
    ).distinct()

    def hits(pairs: DataFrame, kind: int) -> DataFrame:
        return pairs.select("session_id", "wanted", F.lit(kind).alias("match_kind"), "path")

    first = F.min("path").alias("path")
    names = files.groupBy("session_id", "_name").agg(first)
    by_path = hits(asked.join(files.groupBy("session_id", "_own").agg(first), ["session_id", "_own"]), 0)
    by_name = hits(asked.join(names, ["session_id", "_name"]), 1)
    exact = by_path.unionByName(by_name)
    open_requests = asked.drop("_own").join(exact, ["session_id", "wanted"], "left_anti")
    lengths = open_requests.groupBy("session_id").agg(F.collect_set(F.length("_name")).alias("_lengths"))
    fitting = F.filter("_lengths", lambda n: (n > 0) & (n <= F.length("_name")))
    endings = (
        salted_join(names, lengths, "session_id", by=["_name"], measured=files.select("session_id"))
        .withColumn("_n", F.explode(fitting))
        .groupBy("session_id", F.expr("right(_name, _n)").alias("_name"))
        .agg(first)
    )
    by_ending = hits(open_requests.join(endings, ["session_id", "_name"]), 2)
    return (
        exact.unionByName(by_ending)
        .groupBy("session_id", "wanted")
        .agg(F.min(F.struct("match_kind", "path")).alias("hit"))
        .select("session_id", "wanted", "hit.match_kind", "hit.path")
    )


def reorder_columns(df: DataFrame, priority: Sequence[str] = tuple(PRIORITY_COLUMNS)) -> DataFrame:
    """Priority columns that exist come first, the rest keeps its order."""
    first = [c for c in priority if c in df.columns]
    rest = [c for c in df.columns if c not in first]
    return df.select(*[F.col(f"`{c}`") for c in first + rest])


def null_policy(
    df: DataFrame,
    mode: str,
    value: object = -1,
    columns: Sequence[str] | None = None,
    values: Mapping[str, object] | None = None,
) -> DataFrame:
    """``fill`` one value, ``fill_each`` per column, ``drop_any`` null row, ``drop_subset``."""
    if mode == "fill":
        return df.na.fill(value, list(columns) if columns else None)
    if mode == "fill_each":
        return df.na.fill(dict(values or {}))
    if mode == "drop_any":
        return df.na.drop("any")
    if mode == "drop_subset":
        return df.na.drop("any", subset=list(columns or []))
    raise ValueError(f"unknown null policy: {mode}")


def read_columns(df: DataFrame, n_cols: int | None = None, n_rows: int | None = None) -> DataFrame:
    """First ``n_cols`` columns and, as a preview, ``n_rows`` rows; pruning reaches the scan."""
    out = df if n_cols is None else df.select(*[f"`{c}`" for c in df.columns[:n_cols]])
    return out if n_rows is None else out.limit(n_rows)


def evolve_schema(df: DataFrame, defaults: Mapping[str, Column | object]) -> DataFrame:
    """Add missing columns with a default, and fill nulls of the existing ones with it."""
    filled = {}
    for name, default in defaults.items():
        value = default if isinstance(default, Column) else F.lit(default)
        filled[name] = F.coalesce(F.col(name), value) if name in df.columns else value
    return df.withColumns(filled)
