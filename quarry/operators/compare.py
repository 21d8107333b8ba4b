"""Comparing result lists, and picking queries to compare them on."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens


def picked_queries(items: DataFrame, text: str = "name", most: int = 8) -> DataFrame:
    """The most frequent ASCII terms of four characters or more: term and n, ties by the term."""
    rows = items.select(F.explode(tokens(F.col(text))).alias("term")).where(F.col("term").rlike("^[a-z0-9]{4,}$"))
    return rows.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(most)


def list_agreement(base: DataFrame, other: DataFrame, key: str = "query", ids: str = "ids") -> DataFrame:
    """key, jaccard and same_top of two rankings (arrays of ids, best first) for each key; two empty lists agree."""
    both = base.select(key, F.col(ids).alias("a")).join(other.select(key, F.col(ids).alias("b")), key)
    union = F.size(F.array_union("a", "b"))
    jaccard = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union)
    return both.select(key, jaccard.alias("jaccard"), F.get("a", F.lit(0)).eqNullSafe(F.get("b", F.lit(0))).alias("same_top"))


def list_precision(lists: DataFrame, paths: DataFrame, key: str = "query", ids: str = "ids") -> DataFrame:
    """One row, precision: of the items that the lists name, the share with a path that holds the list's query, in any case.

    ``paths``: id and paths (an array). Items that there are not do not count; without any the precision is 1.
    """
    named = lists.select(F.col(key).alias("query"), F.explode(ids).alias("id")).join(paths.select("id", "paths"), "id")
    holds = F.exists("paths", lambda p: F.lower(p).contains(F.lower("query")))
    return named.agg(F.coalesce(F.avg(F.when(holds, 1.0).otherwise(0.0)), F.lit(1.0)).alias("precision"))


def address_matches(address: str, rule: str) -> bool:
    """Whether an IP address is the rule's or inside its network; IPv4 in IPv6 form counts as IPv4, a malformed one never."""
    try:
        own = ipaddress.ip_address(address.strip().strip("[]").split("%")[0])
        own = getattr(own, "ipv4_mapped", None) or own
        network = ipaddress.ip_network(rule.strip(), strict=False)
    except ValueError:
        return False
    return own.version == network.version and own in network
