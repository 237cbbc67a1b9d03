"""URL filters: a sort-merge range join of urls with prefix rules, in DataFrame functions only.

A rule (host, path) covers its host and all subdomains, for paths that start with the rule's path. Hosts are turned
around (``www.example.com`` -> ``com.example.www``), so that a host's ancestors are the prefixes of its labels. Every url
gives one probe for each ancestor that some rule could name; under one ancestor, a rule is the interval of byte strings
that start with its path. Intervals of prefixes nest, so a sweep over the sorted starts, ends and probes needs a stack
of the rules that are open. The sweep is two window functions: the stack's height is a running sum of +1 and -1, and the
top of the stack at height h is the last rule that opened at height h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract words them; both empty for null or where ``://`` is missing."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def match_rules(pairs: DataFrame, rules: DataFrame, *, salts: int = 16) -> DataFrame:
    """(host, path, rule, verdict) for those distinct (host, path) pairs that a rule covers.

    ``rules``: host, path, verdict. The longest rule wins, by the length of host and path together, then by the longer
    host. Of one rule given with two verdicts, the greater string counts (``block`` over ``allow``). ``salts``: a rule's
    host can hold a third of all urls, so its probes are dealt to that many sweeps, each with the host's rules.
    """
    rules = rules.where("host is not null and path is not null and host <> ''").select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")).withColumn("hkey", reversed_host(F.col("rule_host")))
    depth = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    labels = F.reverse(F.split("host", r"\."))
    probes = pairs.withColumn("labels", F.slice(labels, 1, max(depth, 1))).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    probes = probes.withColumn("hkey", F.array_join(F.slice("labels", F.lit(1), F.col("k")), ".")).join(rules.select("hkey").distinct(), "hkey", "left_semi")
    none = F.lit(None).cast("string")
    point = F.encode("path", "UTF-8")
    probes = probes.select("hkey", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"), point.alias("pos"), F.lit(1).alias("kind"), "host", "path", none.alias("rule_host"), none.alias("rule_path"), none.alias("verdict"))
    edges = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    edge = lambda kind, pos: edges.select("hkey", "salt", pos.alias("pos"), F.lit(kind).alias("kind"), none.alias("host"), none.alias("path"), "rule_host", "rule_path", "verdict")
    start = F.encode("rule_path", "UTF-8")
    # 0xFF is in no UTF-8 text: the end sorts behind all that the prefix starts.
    events = probes.unionByName(edge(0, start)).unionByName(edge(2, F.concat(start, F.lit(b"\xff"))))
    rows = W.unboundedPreceding, W.currentRow
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    events = events.withColumn("height", F.sum(step).over(W.partitionBy("hkey", "salt").orderBy("pos", "kind").rowsBetween(*rows)))
    opened = F.when(F.col("kind") == 0, F.struct("rule_host", "rule_path", "verdict"))
    events = events.withColumn("top", F.last(opened, ignorenulls=True).over(W.partitionBy("hkey", "salt", "height").orderBy("pos", "kind").rowsBetween(*rows)))
    found = events.where("kind = 1 and height > 0").select("host", "path", "top.*")
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "verdict"))
    return found.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int = 16) -> DataFrame:
    """One row (id, host, path, rule, verdict) for each page row; other columns of ``pages`` are not looked at.

    Null, empty or malformed urls have an empty host and path, no rule, and the default verdict, as has every url without
    a rule. Repeated rows, null ids and equal urls each give their own row; an empty table gives an empty result.
    """
    host, path = url_parts(F.col(url_col))
    pages = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    matched = match_rules(pages.select("host", "path").where("host <> ''").distinct(), rules, salts=salts)
    # Urls without a host, which may be many, match nothing and would all meet in one task of the join.
    none = F.lit(None).cast("string")
    out = pages.where("host <> ''").join(matched, ["host", "path"], "left").select("_id", "host", "path", "rule", "verdict")
    out = out.unionByName(pages.where("host = ''").select("_id", "host", "path", none.alias("rule"), none.alias("verdict")))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
