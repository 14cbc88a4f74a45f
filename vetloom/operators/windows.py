"""Overlapping windows over text and token arrays.

A window table carries ``n_chunks``, the number of windows of its file. It is known where the
windows are made, so the position weights of later aggregates need neither a window function nor a
second pass over the file.

Arrays made by costly expressions are exploded with the ``outer`` variant and a filter on the
position: for the plain one Spark infers a filter that evaluates the same expression once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let


def char_window_count(length: Column, size: int = 512, overlap: int = 64) -> Column:
    """One window up to ``size`` characters, else one per started step."""
    return F.when(length <= size, 1).otherwise(F.ceil(length / F.lit(size - overlap))).cast("int")


def char_window_array(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of one text as an array.

    The text is cut once into blocks of one step, and each window is a block and the head of the
    next one. Taking windows by character offset instead would scan a UTF-8 text from its start for
    every window, which is quadratic in the file size.
    """
    step = size - overlap
    if not 0 < overlap <= step:
        last = char_window_count(F.length(text), size, overlap) - 1
        cut = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size))
        )
        return cut
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    windows = let(blocks, lambda bs: F.transform(
        bs,
        lambda b, i: F.concat(
            b, F.coalesce(F.substring(F.get(bs, i + 1), 1, overlap), F.lit(""))
        ),
    ))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(windows)


def char_windows(
    df: DataFrame, size: int = 512, overlap: int = 64, text: str = "content", key: str = "file_id"
) -> DataFrame:
    """``(key, chunk_idx, n_chunks, text)``; a last window may lie inside the one before it."""
    return (
        df.select(
            key,
            char_window_count(F.length(text), size, overlap).alias("n_chunks"),
            F.posexplode_outer(char_window_array(F.col(text), size, overlap)).alias(
                "chunk_idx", "text"
            ),
        )
        .filter("chunk_idx IS NOT NULL")
        .select(key, "chunk_idx", "n_chunks", "text")
    )


def token_window_count(
    length: Column, size: int, overlap: int, cap: int | None = None
) -> Column:
    """Windows until the end is reached; none for no tokens; ``cap`` only where it is asked for."""
    step = size - overlap if size > overlap else size
    n = F.when(length == 0, 0).when(length <= size, 1).otherwise(
        1 + F.ceil((length - size) / F.lit(step))
    )
    n = n if cap is None else F.least(n, F.lit(cap))
    return n.cast("int")


def token_windows(
    df: DataFrame,
    size: int = 512,
    overlap: int = 64,
    cap: int | None = None,
    tokens: str = "tokens",
    key: str = "file_id",
) -> DataFrame:
    """``(key, chunk_idx, n_chunks, tokens)`` with windows as token arrays."""
    step = size - overlap if size > overlap else size
    n = token_window_count(F.size(tokens), size, overlap, cap)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    windows = F.transform(starts, lambda i: F.slice(F.col(tokens), i * step + 1, F.lit(size)))
    return (
        df.select(
            key, n.alias("n_chunks"), F.posexplode_outer(windows).alias("chunk_idx", "window")
        )
        .filter("chunk_idx IS NOT NULL")
        .select(key, "chunk_idx", "n_chunks", F.col("window").alias("tokens"))
    )
