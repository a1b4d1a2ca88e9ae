"""URL filters as a temporal list join, in DataFrame functions only.

A list is a history of dated entries: on a day, a domain or a path prefix is added to a category or
removed from it. Entries become validity intervals - from their day up to the next entry of the
same key and category - and each capture is judged by an as-of join against the
intervals that hold on its fetch day.

A capture looks up every domain its host lies in (``a.b.c``, ``b.c``, ``c``) and every prefix of its path
that ends at a slash boundary. The list side has one row a key, with that key's intervals in an
array of at most days x categories; the captures of a hot host are so joined to one row, and
adaptive execution can split them. Entries of one day are merged before any window, so a
key's history is as long as its days, not its entries.

Defined cases: on one day an addition outweighs a removal; entries without key, day or action are
ignored; a null category is a category; captures without a host or fetch day match nothing;
repeated captures are judged one by one; hosts are compared in lower case, paths as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import written

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL, null without one."""
    found = F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def path(url: Column) -> Column:
    """Path segments of an absolute URL, without empty ones."""
    return F.filter(F.split(F.regexp_extract(url, _SCHEME + r"[^/?#]*(/[^?#]*)", 1), "/"), lambda s: s != "")


def domain_key(domain: Column) -> Column:
    return F.concat(F.lit("d:"), F.lower(domain))


def prefix_key(host: Column, segments: Column) -> Column:
    return F.concat(F.lit("p:"), F.lower(host), F.lit("/"), F.array_join(segments, "/"))


def lookup_keys(url: Column) -> Column:
    """Keys of every domain and path prefix that holds the URL; null without a host."""
    labels, parts = F.split(host(url), r"\."), path(url)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: domain_key(F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    some = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: prefix_key(host(url), F.slice(parts, F.lit(1), i))))
    return F.when(host(url).isNotNull(), F.concat(domains, F.coalesce(some, F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, first, until) from entries (key, category, day, added): valid from ``first`` up to before ``until`` (null: still)."""
    whole = entries.filter("key is not null and day is not null and added is not null")
    days = whole.groupBy("key", "category", "day").agg(F.max("added").alias("added"))
    until = F.lead("day").over(Window.partitionBy("key", "category").orderBy("day"))
    return days.withColumn("until", until).filter("added").select("key", "category", F.col("day").alias("first"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, day_col: str) -> DataFrame:
    """One row per capture: the id, host, blocked, n_active (entries in force), since (the earliest of them) and categories (sorted, distinct)."""
    rows = captures.select(F.monotonically_increasing_id().alias("row"), captures[id_col].alias("id"), captures[day_col].alias("on"),
                           host(captures[url_col]).alias("host"), lookup_keys(captures[url_col]).alias("keys"))
    wanted = rows.select("row", "id", "on", "host", F.explode_outer("keys").alias("key"))
    # written, so that the join's shuffles are its own and a hot key's captures can be split
    lists = written(intervals(entries).groupBy("key").agg(F.collect_list(F.struct("first", "until", "category")).alias("entries")), "lists")
    held = F.filter("entries", lambda e: (e["first"] <= F.col("on")) & (e["until"].isNull() | (F.col("on") < e["until"])))
    met = wanted.join(lists, "key", "left").withColumn("held", held).withColumn("n", F.coalesce(F.size("held"), F.lit(0)))
    n = F.greatest(F.col("n"), F.lit(0))  # the size of null may be -1
    found = met.groupBy("row", "id", "host").agg(
        F.sum(n).alias("n_active"), F.min(F.array_min(F.transform("held", lambda e: e["first"]))).alias("since"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("held", lambda e: e["category"]))))).alias("categories"))
    return found.select(F.col("id").alias(id_col), "host", (F.col("n_active") > 0).alias("blocked"), "n_active", "since", "categories")
