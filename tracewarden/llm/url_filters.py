"""URL filtering against dated lists, in DataFrame expressions alone.

List events (add or remove, with a date) become validity intervals per list and pattern. A capture is matched by the
patterns that cover its URL and were valid when it was fetched: an as-of join, written as an equi-join on pattern keys with
a half-open interval as the rest of the condition. Intervals of a pattern don't overlap, so a capture meets each pattern of
a list at most once.

A decision depends on the URL and the time alone, so captures are reduced to distinct pairs before the join (a map-side
aggregate: a host or URL with a third of all captures is no more than its distinct pairs), and only those that match
anything come back. Lists up to BROADCAST_BYTES, measured, are broadcast; larger ones are shuffled by key, where adaptive
execution splits crowded keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Measured size of the intervals up to which they are broadcast.
BROADCAST_BYTES = 64 << 20

#: Kinds of patterns, most specific first: a whole URL, a path prefix on a host, a host, a domain with all below it.
KINDS = ("url", "prefix", "host", "domain")

_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = "^[^?#]*(\\?[^#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; empty for what is no absolute URL."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, _AUTHORITY, 1), F.lit(""))), "\\.$", "")


def path_parts(url: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit("")), "/"), "")


def url_keys(url: Column) -> Column:
    """Keys under which patterns may cover the URL, as array<struct<kind, pattern>>. None without a host."""
    host, parts = host_of(url), path_parts(url)
    labels = F.array_remove(F.split(host, "\\."), "")
    n, m = F.size(labels), F.size(parts)
    whole = F.concat(host, F.when(m > 0, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(""), F.coalesce(F.regexp_extract(url, _QUERY, 1), F.lit("")))

    def key(kind: str, pattern: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))

    domains = F.transform(F.sequence(F.lit(1), n), lambda i: key("domain", F.array_join(F.slice(labels, i, n), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), m), lambda i: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    return F.when(n > 0, F.concat(domains, F.array(key("host", host), key("url", whole)), F.when(m > 0, prefixes).otherwise(none))).otherwise(none)


def intervals(events: DataFrame) -> DataFrame:
    """(list_name, kind, pattern, action, event, listed_at) -> (list_name, kind, pattern, action, valid_from, valid_to).

    An `add` holds from its date until the pattern's next event in the same list; a `remove` ends it. Of events of one date
    the last in (event descending, action) order counts: an add outlives a remove, block outlives allow. Events without
    list, pattern or date, or of unknown kind, event or action, are ignored.
    """
    e = events.select("list_name", "kind", F.lower(F.trim("pattern")).alias("pattern"), "action", "event", F.col("listed_at").cast("timestamp").alias("listed_at"))
    e = e.where(F.col("kind").isin(*KINDS) & F.col("event").isin("add", "remove") & F.col("action").isin("block", "allow") & F.col("list_name").isNotNull() & F.col("pattern").isNotNull() & F.col("listed_at").isNotNull())
    w = Window.partitionBy("list_name", "kind", "pattern").orderBy("listed_at", F.desc("event"), "action")
    e = e.withColumn("valid_to", F.lead("listed_at").over(w)).where(F.col("event") == "add")
    e = e.where(F.col("valid_to").isNull() | (F.col("listed_at") < F.col("valid_to")))
    return e.select("list_name", "kind", "pattern", "action", F.col("listed_at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, events: DataFrame, row_id: str = "page_id") -> DataFrame:
    """One row per capture: row_id, url, fetched_at, host, n_active, decision, list_name, kind, pattern, kept.

    n_active counts the entries that cover the URL and hold at fetched_at. The most specific of them decides (url, longer
    prefix, host, longer domain; then allow before block, then the first list by name); decision is `none` without any, and
    kept is false only for `block`. list_name, kind and pattern name the deciding entry.

    A null, relative or malformed URL, or a null time, matches nothing and is kept. Repeated captures give repeated rows; an
    empty list or empty captures work. Other columns are ignored.
    """
    c = captures.select(F.col(row_id).alias("_id"), F.col("url").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    valid = intervals(events)
    size = valid.agg(F.coalesce(F.sum(F.length("pattern") + F.length("list_name") + 48), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= BROADCAST_BYTES:
        valid = F.broadcast(valid)
    pairs = c.where("url IS NOT NULL AND fetched_at IS NOT NULL").select("url", "fetched_at").distinct()
    keys = pairs.select("url", "fetched_at", F.explode(url_keys(F.col("url"))).alias("key")).select("url", "fetched_at", "key.kind", "key.pattern")
    active = keys.join(valid, ["kind", "pattern"]).where("valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)")
    level = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = F.struct(level.alias("level"), (-F.length("pattern")).alias("short"), "action", "list_name", "kind", "pattern")
    best = active.groupBy("url", "fetched_at").agg(F.count("*").alias("n_active"), F.min(order).alias("best"))
    out = c.join(best, ["url", "fetched_at"], "left")
    return out.select(
        F.col("_id").alias(row_id),
        "url",
        "fetched_at",
        host_of(F.col("url")).alias("host"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.coalesce("best.action", F.lit("none")).alias("decision"),
        F.col("best.list_name").alias("list_name"),
        F.col("best.kind").alias("kind"),
        F.col("best.pattern").alias("pattern"),
        (F.coalesce("best.action", F.lit("none")) != "block").alias("kept"),
    )
