"""Operator 4, URL filters by a temporal list join, in DataFrame functions.

Dated list entries (list, pattern, action, at) become validity intervals; every capture is then joined as of its
fetch time with the intervals of its URL's keys: each host suffix and the URL without scheme, query and fragment.
Intervals are grouped per pattern first, so the join meets one row per key, and both sides are dealt by a key of
their own, so that adaptive execution can split a hot host.

A null or malformed url has no keys and matches nothing. A null fetch time matches nothing. An entry with a null
pattern, time or action is void. Entries of the same pattern and time: ``add`` counts before ``remove``. Repeated
captures (same id) get one row with what any of them met. Empty tables: no entries block nothing; no captures, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import fresh_key


def host(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def url_keys(url: Column) -> Column:
    """All host suffixes of two labels or more, and host with path."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.when(host(url) != "", F.array_distinct(F.array_append(suffixes, F.concat(host(url), path)))).otherwise(F.array().cast("array<string>"))


def pattern_key(pattern: Column) -> Column:
    """A listed pattern as ``url_keys`` has it: the host in lower case, the path as it is."""
    return F.concat(F.lower(F.substring_index(pattern, "/", 1)), F.regexp_extract(pattern, r"(?s)^[^/]*(.*)$", 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to): from an ``add`` to the next ``remove``; null valid_to: still listed."""
    entries = entries.where("pattern is not null and at is not null and action in ('add', 'remove')").select("list", pattern_key(F.col("pattern")).alias("pattern"), "action", "at").distinct()
    history = Window.partitionBy("list", "pattern").orderBy("at", "action")
    changes = entries.withColumn("was", F.lag("action", 1, "remove").over(history)).where("action != was")
    return changes.withColumn("valid_to", F.lead("at").over(history)).where("action = 'add' and (valid_to is null or valid_to > at)").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def match(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per capture (id, url, fetched): id, lists (sorted), n_entries active on it at fetch time, blocked."""
    spans = intervals(entries).groupBy("pattern").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("spans"))
    keys = captures.select("id", "fetched", F.explode(url_keys(F.col("url"))).alias("pattern"))
    keys, spans = keys.withColumn("key", fresh_key(F.col("pattern"))).drop("pattern"), spans.select(fresh_key(F.col("pattern")).alias("key"), "spans", "pattern")
    active = lambda s: (s["valid_from"] <= F.col("fetched")) & F.coalesce(s["valid_to"] > F.col("fetched"), F.lit(True))
    met = keys.join(spans, "key").select("id", "pattern", F.explode(F.filter("spans", active)).alias("span"))
    met = met.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("span.list")), ",").alias("lists"), F.countDistinct("span.list", "pattern", "span.valid_from").alias("n_entries"))
    out = captures.select("id").distinct().join(met, "id", "left")
    return out.select("id", F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce(F.col("n_entries") > 0, F.lit(False)).alias("blocked"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """A dated list made by rule from the hosts of ``pages``: what the query filters by, since the tables bring none.

    The MD5 of a host's last three labels says whether it is listed (first digit 0 to 7), in which list, from which
    day of 2024, for how long, and whether it is listed again a week later.
    """
    domain = F.regexp_extract(host(F.col("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1)
    d = pages.select(domain.alias("pattern")).where("pattern != ''").distinct().withColumn("h", F.md5("pattern"))
    num = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("int")
    d = d.where(num(1, 1) < 8).select("pattern", F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), num(2, 2) % 3 + 1).alias("list"), (num(4, 3) % 366).alias("day"), (num(7, 2) % 120 + 10).alias("span"), (num(9, 1) % 2 == 0).alias("again"))
    event = lambda action, day: F.struct(F.lit(action).alias("action"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(day)).alias("at"))
    first = F.array(event("add", F.col("day")), event("remove", F.col("day") + F.col("span")))
    events = F.when(F.col("again"), F.array_append(first, event("add", F.col("day") + F.col("span") + 7))).otherwise(first)
    return d.select("list", "pattern", F.explode(events).alias("e")).select("list", "pattern", "e.action", "e.at")


def captures_of(pages: DataFrame) -> DataFrame:
    """``pages`` as captures; the fetch time, which the table lacks, is made from the MD5 of the page_id."""
    h = F.md5(F.col("page_id").cast("string"))
    seconds = F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % (366 * 86400)
    return pages.select(F.col("page_id").alias("id"), "url", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=seconds)).alias("fetched"))
