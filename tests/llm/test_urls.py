"""URL filters next to a day-by-day replay of the lists."""

import datetime as dt
import random

from vetloom.llm import urls
from pyspark.sql import functions as F

DAY = dt.date(2024, 1, 1)


def test_matches_replay(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.z.net", "z.net"]
    entries = [(rng.choice(["block", "allow"]), "domain", rng.choice([*hosts, "com"]), DAY + dt.timedelta(rng.randrange(200)), rng.choice(["add", "remove"])) for _ in range(300)]
    entries += [("block", "url", "z.net/p?q=1", DAY + dt.timedelta(d), a) for d, a in ((10, "add"), (20, "add"), (50, "remove"), (50, "add"), (90, "remove"))]
    captures = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'p?q=1', 'p#f'])}", DAY + dt.timedelta(rng.randrange(220))) for i in range(400)]

    def active(entry, day):
        state, name = "remove", entry
        for e in sorted((e for e in entries if e[:3] == name), key=lambda e: (e[3], e[4] == "add")):
            if e[3] <= day:
                state = e[4]
        return state == "add"

    patterns = {e[:3] for e in entries}
    found = urls.judge(spark.createDataFrame(captures, "id long, url string, day date"),
                       spark.createDataFrame(entries, "list string, kind string, pattern string, day date, action string")).collect()
    assert len(found) == len(captures)
    for r in found:
        address = r.url.removeprefix("http://").split("#")[0]
        host = address.split("/")[0]
        labels = host.split(".")
        keys = [("url", address)] + [("domain", ".".join(labels[i:])) for i in range(len(labels))]
        decided = next(((name, p) for kind, p in keys for name in ("block", "allow") if (name, kind, p) in patterns and active((name, kind, p), r.day)), (None, None))
        assert (r.by_list, r.by_pattern) == decided and r.blocked == (decided[0] == "block")


def test_unusual_rows(spark):
    entries = spark.createDataFrame(
        [("block", "domain", "a.com", DAY, "add"), ("block", "domain", "a.com", DAY, "add"), (None, "domain", "b.com", DAY, "add"), ("block", "domain", "b.com", None, "add"),
         ("block", "domain", "c.com", DAY, "remove"), ("block", "domain", "late.com", DAY + dt.timedelta(9), "add"), ("block", "domain", "", DAY, "add")],
        "list string, kind string, pattern string, day date, action string")
    rows = [(1, "HTTP://user@A.com.:80", DAY, 1), (2, None, DAY, 1), (3, "not a url", DAY, 1), (4, "http://a.com/" + "x" * 100_000, DAY, 1), (5, "http://a.com", None, 1),
            (6, "http://b.com", DAY, 1), (7, "http://c.com", DAY, 1), (8, "http://late.com", DAY, 1), (9, "http:///x", DAY, 1), (1, "HTTP://user@A.com.:80", DAY, 1), (10, "http://nota.com", DAY, 1)]
    captures = spark.createDataFrame(rows, "id long, url string, day date, blocked int")
    found = sorted((r.id, r.blocked) for r in urls.judge(captures, entries).collect())
    assert found == sorted([(1, True), (1, True), (4, True)] + [(i, False) for i in (2, 3, 5, 6, 7, 8, 9, 10)])
    assert urls.judge(captures.where("false"), entries).count() == 0
    assert {r.blocked for r in urls.judge(captures, entries.where("false")).collect()} == {False}


def test_addresses(spark):
    rows = [("http://H.com", "h.com/"), ("https://h.com:8/a?b#c", "h.com/a?b"), ("http://u:p@h.com?x", "h.com?x"), ("", "/")]
    got = spark.createDataFrame(rows, "u string, e string").select(urls.address_of(F.col("u")).alias("a"), "e").collect()
    assert all(r.a == r.e for r in got)
