"""URL filters by a temporal join with dated block lists.

Dated entries (a key is listed, or unlisted, at a time) become intervals in
which the key is listed. A capture has a key for each domain that its host
lies in and one for its address; it is blocked if any of them was listed when
it was fetched. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchwork.llm.scratch import stash

_FOREVER = "9999-12-31 00:00:00"


def host(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(?::[0-9]*)?$", ""))


def address(url: Column) -> Column:
    """Host and path, without scheme, query, fragment and final slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)", 1)
    return F.concat(host(url), F.regexp_replace(path, "/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """key, list, since, until from entries (key, list, at, listed): since each listing until the next entry of the same key and list.

    Of entries at one time the unlisting wins; rows with a null key, list or
    time say nothing; a listing of what is listed changes nothing. A key's host
    counts in any case; its path, from the first slash on, as it is written.
    """
    path = F.regexp_extract("key", "(?s)/.*", 0)
    key = F.concat(F.lower(F.substring_index("key", "/", 1)), path)
    known = entries.where(F.col("key").isNotNull() & F.col("list").isNotNull() & F.col("at").isNotNull())
    states = known.groupBy("list", key.alias("key"), "at").agg(F.min(F.coalesce("listed", F.lit(True))).alias("listed"))
    order = Window.partitionBy("list", "key").orderBy("at")
    return (
        states.withColumn("was", F.lag("listed").over(order))
        .where(~F.col("listed").eqNullSafe(F.col("was")))
        .withColumn("until", F.coalesce(F.lead("at").over(order), F.lit(_FOREVER).cast("timestamp")))
        .where("listed").select("key", "list", F.col("at").alias("since"), "until")
    )


def keys(url: Column) -> Column:
    """The domains that the URL's host lies in, itself included, and its address if that has a path."""
    parts = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.array_distinct(F.filter(F.concat(domains, F.array(address(url))), lambda x: x != ""))


def filter_urls(captures: DataFrame, entries: DataFrame, *, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """One row per capture: id, host, fetched, n_lists (lists that had one of its keys when it was fetched), listed_since and blocked.

    listed_since is the earliest start of the intervals that hold. A null or
    relative URL, or a null time, is on no list (host empty for such a URL).
    Null and repeated ids are rows of their own; other columns are ignored; an
    empty table gives an empty result. Keys join by equality, so a host with
    very many captures can be split; the list may be of any size.
    """
    rows = captures.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.coalesce(host(F.col(url_col)), F.lit("")).alias("host"), F.col(time_col).cast("timestamp").alias("fetched"),
        F.coalesce(keys(F.col(url_col)), F.array().cast("array<string>")).alias("keys"),
    )
    rows = stash(rows, "captures")
    spans = stash(intervals(entries), "intervals")
    held = (
        rows.select("row", "fetched", F.explode("keys").alias("key")).join(spans, "key")
        .where("fetched >= since and fetched < until")
        .groupBy("row").agg(F.countDistinct("list").alias("n_lists"), F.min("since").alias("listed_since"))
    )
    lists = F.coalesce("n_lists", F.lit(0))
    return rows.join(held, "row", "left").select(
        F.col("id").alias(id_col), "host", "fetched", lists.alias("n_lists"), "listed_since", (lists > 0).alias("blocked")
    )
