"""URL rules by a sort-merge range join.

A host's labels are reversed into a key (`m.example.net` to `net.example.m.`), so that a host with all its subdomains
is an interval of keys. Pages and rules are dealt into the same ranges of keys, a rule to every range its interval
meets, and sorted. A sweep over a range keeps a stack of the rules whose nested intervals hold the current key, and
picks among them by path. The pages of a hot host fill several ranges, in which its rules are repeated.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: What a page without a rule gets.
DEFAULT = "allow"
#: Keys drawn per range to place the ranges' bounds; it moves rows between tasks and no result.
SAMPLE_PER_RANGE = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path of a url; both empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(default: str):
    """Rows sorted by (range, key, rules first) to one row per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[str, dict, set]] = []  # (host key, path -> (rule, verdict), path lengths)
        here, last = None, None
        for batch in batches:
            out = []
            cols = [batch[c].tolist() for c in ("range_no", "key", "page_id", "host", "path", "rule", "verdict")]
            for number, k, page, host, path, rule, verdict in zip(*cols):
                if number != here or k != last:
                    if number != here:
                        stack = []
                    while stack and not k.startswith(stack[-1][0]):
                        stack.pop()
                    here, last = number, k
                if rule is not None:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, {}, set()))
                    stack[-1][1][path] = (rule, verdict)
                    stack[-1][2].add(len(path))
                    continue
                best = (-1, -1, None, default)
                for prefix, paths, lengths in stack:
                    for n in lengths:
                        found = paths.get(path[:n]) if n <= len(path) else None
                        if found:
                            best = max(best, (len(prefix) + n, len(prefix), *found), key=lambda b: b[:2])
                out.append((page, host, path, best[2], best[3]))
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})

    return run


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per row of `pages` (page_id, url).

    `rules` has rule (host, then path from its first slash) and verdict. A rule fits its host and all subdomains where
    the page's path starts with the rule's; the longest wins, of equally long ones that with the longer host. The same
    rule twice blocks if one of them does. Null rules are left out. Null urls and urls without `://` have no host and
    get `default`, as do all pages if there is no rule. Repeated pages are judged each; an empty table gives an empty
    one; further columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", key(F.col("host")))
    known = rules.where(F.col("rule").isNotNull()).select(
        F.translate(F.regexp_extract("rule", r"^[^/]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("path"), "verdict")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", key(F.col("host")))

    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.count()
    share = min(1.0, ranges * SAMPLE_PER_RANGE / max(rows, 1))
    drawn = sorted(r.key for r in urls.select("key").sample(share, seed=1).collect())  # about SAMPLE_PER_RANGE a range
    bounds = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, salt: pd.Series) -> pd.Series:
        """A key that is a bound itself, repeated for a hot host, may lie in any range it touches."""
        firsts = [(bisect_left(bounds, k), bisect_right(bounds, k)) for k in keys]
        return pd.Series([a + s % (b - a + 1) for (a, b), s in zip(firsts, salt)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(keys: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(bounds, k), bisect_right(bounds, k + "\U0010ffff") + 1)) for k in keys])

    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 30))
    none = F.lit(None).cast("string")
    urls = urls.select(range_of("key", salt).alias("range_no"), "key", F.lit(1).alias("kind"), F.col("page_id").cast("long").alias("page_id"), "host", "path", none.alias("rule"), none.alias("verdict"))
    known = known.select(F.explode(ranges_of("key")).alias("range_no"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    dealt = urls.unionByName(known).repartitionById(ranges, F.col("range_no")).sortWithinPartitions("range_no", "key", "kind")
    return dealt.mapInPandas(_sweep(default), "page_id long, host string, path string, rule string, verdict string")


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, verdict string")
