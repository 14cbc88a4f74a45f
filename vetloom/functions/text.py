"""Text clean-up and text features as built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CWE_CLASSES
from .vectors import let

# Text before and after one "name <mail>" pair; a line break ends the match.
NAME_EMAIL = r"^([^\n]*)<([^\n]*@[^\n]*)>"


def strip_whitespace(col: Column) -> Column:
    """Remove every kind of white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def strip_comments(col: Column) -> Column:
    """Remove triple-quoted spans, then ``#`` to the end of the line (also inside strings)."""
    col = F.regexp_replace(col, r"(?s)'''.*?'''", "")
    col = F.regexp_replace(col, r'(?s)""".*?"""', "")
    return F.regexp_replace(col, r"#[^\n]*", "")


def normalize_code(col: Column) -> Column:
    """Tabs to four spaces, every line ending to a line feed."""
    for old, new in (("\t", "    "), ("\r\n", "\n"), ("\r", "\n")):
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def clean_code_text(col: Column, cap: int | None = None) -> Column:
    """Null to empty and NUL to a space. Whole text unless a ``cap`` in characters is asked for."""
    col = F.replace(F.coalesce(col, F.lit("")), F.lit("\x00"), F.lit(" "))
    return col if cap is None else F.substring(col, 1, cap)


def lower_flatten(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit("\n"), F.lit(" "))


def preview_text(col: Column, n: int = 100) -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def parse_name_email(col: Column) -> tuple[Column, Column]:
    """Name and mail address of ``Name <mail>``; both null when the text has another shape."""
    hit = col.rlike(NAME_EMAIL)
    return (
        F.when(hit, strip_whitespace(F.regexp_extract(col, NAME_EMAIL, 1))),
        F.when(hit, strip_whitespace(F.regexp_extract(col, NAME_EMAIL, 2))),
    )


def email_domain(col: Column) -> Column:
    """Text after the first ``@``; null when nothing follows it."""
    return F.nullif(F.regexp_extract(col, r"@([^\n]+)", 1), F.lit(""))


def core_name(col: Column) -> Column:
    """Lower-cased name up to the first ``-``, ``_`` or ``.``."""
    return F.split(F.lower(col), "[-_.]", 2)[0]


def is_valid_version(col: Column) -> Column:
    """Exactly three groups of digits; null is not valid."""
    return F.coalesce(strip_whitespace(col).rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.lit(False))


def map_labels(col: Column, codes: Mapping[str, int], other: int | None = None) -> Column:
    """Label text to number; a label outside ``codes`` gives ``other``, null stays null."""
    literal = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    code = F.try_element_at(literal, col)
    if other is None:
        return code
    return F.when(col.isNotNull(), F.coalesce(code, F.lit(other)))


def normalize_class(col: Column, classes: Sequence[str] = tuple(CWE_CLASSES)) -> Column:
    """Trimmed class name; ``0`` and anything unknown become the last (clean) class."""
    name = strip_whitespace(col)
    return F.when(name.isin(list(classes)), name).otherwise(F.lit(classes[-1]))


def class_index(col: Column, classes: Sequence[str] = tuple(CWE_CLASSES)) -> Column:
    return (F.array_position(F.array(*map(F.lit, classes)), col) - 1).cast("int")


def shannon_entropy(col: Column) -> Column:
    """Bits per character; empty text gives 0.

    One distinct character after the other is removed and counted by the bytes that went, so the
    remaining text shrinks with every step and the row never leaves its place for a shuffle.
    """

    def count_out(acc: Column, ch: Column, n: Column) -> Column:
        return let(
            F.replace(acc["rest"], ch, F.lit("")),
            lambda rest: let(
                (F.octet_length(acc["rest"]) - F.octet_length(rest)) / F.octet_length(ch) / n,
                lambda p: F.struct(
                    rest.alias("rest"),
                    (acc["bits"] - F.when(p > 0, p * F.log2(p)).otherwise(0.0)).alias("bits"),
                ),
            ),
        )

    bits = let(
        F.length(col),
        lambda n: F.aggregate(
            F.array_distinct(F.split(col, "")),
            F.struct(col.alias("rest"), F.lit(0.0).alias("bits")),
            lambda acc, ch: count_out(acc, ch, n),
            lambda acc: acc["bits"],
        ),
    )
    return F.when(F.length(col) > 0, bits).when(F.length(col) == 0, F.lit(0.0))


def base_name(col: Column) -> Column:
    """Last path part; both slash directions separate."""
    return F.element_at(F.split(unix_path(col), "/"), -1)


def unix_path(col: Column) -> Column:
    return F.replace(col, F.lit("\\"), F.lit("/"))


def package_directory(col: Column) -> Column:
    """First directory, or the one below a leading ``source/``."""
    return F.split(F.regexp_replace(unix_path(col), "^source/", ""), "/", 2)[0]
