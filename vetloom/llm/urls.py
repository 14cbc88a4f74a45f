"""URL filters whose lists change: dated entries become intervals, captures are judged as of their fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"
#: Days of one bucket of the interval join.
BUCKET = 32


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), F.lit("."))


def address_of(url: Column) -> Column:
    """Host, path and query, without scheme, user, port and fragment; the path of a bare host is ``/``."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)
    return F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path))


def patterns_of(url: Column) -> Column:
    """What a URL can match, with how specific it is: its address (1000), its host and every parent domain."""
    labels = F.split(host_of(url), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -n, n), ".").alias("pattern"), n.alias("depth")),
    )
    own = F.array(F.struct(F.lit("url").alias("kind"), address_of(url).alias("pattern"), F.lit(1000).alias("depth")))
    return F.when(host_of(url) == "", F.expr("array()").cast("array<struct<kind:string,pattern:string,depth:int>>")).otherwise(
        F.concat(own, parents))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity ``[since, until)`` from dated entries (``list``, ``kind``, ``pattern``, ``day``, ``action``).

    An ``add`` opens a pattern and the next ``remove`` closes it; adding what is open and removing what
    is not change nothing. On one day a removal comes first. ``until`` is null while it is open.
    Entries with a null in any column are left out; repeated entries count once.
    """
    known = entries.select("list", "kind", "pattern", "day", "action").dropna().distinct()
    order = Window.partitionBy("list", "kind", "pattern").orderBy(F.col("day"), F.col("action").desc())
    changes = known.withColumn("last", F.lag("action").over(order)).where("action <> coalesce(last, 'remove')")
    spans = changes.withColumn("until", F.lead("day").over(order)).where("action = 'add'")
    return spans.where("until IS NULL OR until > day").select("list", "kind", "pattern", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with ``blocked`` and the entry that decided: ``by_list``, ``by_pattern``, ``since``.

    Of the entries active on the day of the fetch the most specific decides: the URL itself, then the
    longest parent domain; ``block`` goes before ``allow`` on the same pattern. A capture that no entry
    matches is not blocked, nor is one without a URL, a host or a day. Rows stay as they are, repeated
    ones too; an empty table or an empty list works; columns of the same names are replaced.

    Different URLs and days are judged once. Intervals are cut into buckets of days and joined by
    pattern and bucket, so a popular host with a long history meets only the intervals near its day.
    """
    # Intervals end with the last capture at the latest: nothing asks for them on a later day.
    end = F.lit(captures.agg(F.max(F.unix_date(F.col(day)))).first()[0]).cast("int")
    last = F.least(F.coalesce(F.unix_date("until") - 1, end), end)
    spans = intervals(entries).withColumn("last", last).where(F.unix_date("since") <= F.col("last"))
    span = F.sequence(F.floor(F.unix_date("since") / BUCKET), F.floor(F.col("last") / BUCKET))
    spans = spans.withColumn("bucket", F.explode(span)).select(
        F.col("list").alias("by_list"), F.col("kind").alias("_kind"), F.col("pattern").alias("by_pattern"), "since", "until", "bucket")
    spans = keep(spans, "intervals")
    asked = captures.select(F.col(url).alias("_url"), F.col(day).alias("_day")).dropna().distinct()
    asked = asked.withColumn("p", F.explode(patterns_of(F.col("_url")))).select(
        "_url", "_day", "p.*", F.floor(F.unix_date("_day") / BUCKET).alias("_bucket"))
    active = asked.join(
        spans,
        (asked["kind"] == F.col("_kind")) & (asked["pattern"] == F.col("by_pattern")) & (asked["_bucket"] == F.col("bucket"))
        & (F.col("since") <= F.col("_day")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))),
    )
    found = F.max(F.struct("depth", F.col("by_list"), "by_pattern", "since"))
    chosen = keep(active.groupBy("_url", "_day").agg(found.alias("f")).select("_url", "_day", "f.by_list", "f.by_pattern", "f.since"), "chosen")
    plain = captures.drop("blocked", "by_list", "by_pattern", "since", "_url", "_day")
    told = plain.join(chosen, (plain[url] == chosen._url) & (plain[day] == chosen._day), "left").drop("_url", "_day")
    return told.withColumn("blocked", F.coalesce(F.col("by_list") == "block", F.lit(False)))
