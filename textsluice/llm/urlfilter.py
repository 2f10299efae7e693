"""URL filtering by a temporal join with dated block lists.

A list (category) is a log of dated entries that add or remove a pattern. Per pattern
and list, each entry holds from its date until the next one, so the log becomes validity
intervals. A capture is looked up under every key its URL can match (the URL, its
host and parent domains, and its path's leading parts with and without host),
and each lookup is an as-of join: of the pattern's intervals, those that cover
the fetch time decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, category, valid_from, valid_to of the stretches in which an entry is active.

    ``entries``: kind (url, domain or path), pattern, action (add or remove), category, at.
    A category is a list of its own: only its own entries end a stretch of it. Of
    entries of a pattern and category with the same date a removal counts last.
    Entries with a null pattern or date are ignored; an open end is null.
    """
    log = entries.filter("kind is not null and pattern is not null and at is not null").distinct()
    turn = Window.partitionBy("kind", "pattern", "category").orderBy("at", (F.col("action") == "remove").cast("int"))
    return (
        log.withColumn("valid_to", F.lead("at").over(turn))
        .filter((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at"))))
        .select("kind", "pattern", "category", F.col("at").alias("valid_from"), "valid_to")
    )


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dots; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"\.*(:[0-9]*)?$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*(/[^?#\s]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def keys_of(url: Column) -> Column:
    """Array of (kind, pattern) that a URL can match: itself without fragment, its host and
    parent domains, and the leading folders of its path."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    folders = F.filter(F.split(F.regexp_replace(path_of(url), r"[^/]*$", ""), "/"), lambda x: x != "")
    paths = F.when(
        F.size(folders) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(folders)),
            lambda i: F.struct(
                F.lit("path").alias("kind"), F.concat(F.lit("/"), F.array_join(F.slice(folders, F.lit(1), i), "/"), F.lit("/")).alias("pattern")
            ),
        ),
    )
    whole = F.array(F.struct(F.lit("url").alias("kind"), F.regexp_replace(url, r"#.*$", "").alias("pattern")))
    none = F.array().cast("array<struct<kind: string, pattern: string>>")
    return F.array_distinct(F.concat(whole, F.coalesce(domains, none), F.coalesce(paths, none)))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """Per capture: id, url, fetch time, host, n_matches, categories (sorted), first_pattern, blocked.

    One row per row of ``captures``, blocked where any entry is active at its fetch
    time (from the entry's date on, before the next one's). A null url or time
    matches nothing. Repeated rows are judged each. Matches are summed by row
    before they meet the captures again, so a popular host costs one row per
    capture; the keys meet the list in an equi-join that Spark can split by skew.
    """
    rows = captures.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(at_col).alias("_at")
    )
    # equal captures have equal answers: the lookup is by distinct (url, time)
    asked = rows.filter("_url is not null and _at is not null").groupBy("_url", "_at").agg(F.lit(1).alias("one"))
    keyed = asked.select("_url", "_at", F.explode(keys_of(F.col("_url"))).alias("k")).select("_url", "_at", "k.kind", "k.pattern")
    active = keyed.join(intervals(entries), ["kind", "pattern"]).filter(
        (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    )
    hits = active.groupBy(F.col("_url").alias("u"), F.col("_at").alias("t")).agg(
        F.count("*").alias("n_matches"),
        F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
        F.min(F.concat_ws(":", "kind", "pattern")).alias("first_pattern"),
    )
    return rows.join(hits, (F.col("_url") == F.col("u")) & (F.col("_at") == F.col("t")), "left").select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_at").alias(at_col),
        host_of(F.col("_url")).alias("host"),
        F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        "first_pattern",
        F.col("n_matches").isNotNull().alias("blocked"),
    )
