"""Joins of file reads and line numbers with ranges of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.objects import let
from .staging import stage

KEYS = ["instance_id", "file_path"]
RANGE = [*KEYS, "start_line", "end_line"]
#: Lines of a bin in joins of ranges.
BIN = 32
#: Sizes of blocks that lines are looked up by: up to 2**32 lines.
LEVELS = 32


def _pairs(reads: DataFrame, nodes: DataFrame, width: int = BIN) -> DataFrame:
    """Distinct read ranges with the node ranges that they touch, both ends included.

    Ranges are cut into bins of lines, and the bin is part of the join key, so a file with many reads and nodes is no single
    key; a pair that meets in several bins counts in the first one. A read is cut to the lines that the file's nodes cover,
    so one of a whole file has as many bins as they do.
    """
    bin_ = lambda c: F.floor(c / width)
    n = nodes.withColumnsRenamed({"start_line": "node_start", "end_line": "node_end"}).withColumn("_low", F.least("node_start", "node_end")).withColumn("_high", F.greatest("node_start", "node_end"))
    extent = n.groupBy(*KEYS).agg(F.min("_low").alias("_first"), F.max("_high").alias("_last"))
    r = reads.select(*KEYS, "start_line", "end_line").distinct().join(extent, KEYS)
    r = r.withColumn("_from", F.greatest(F.least("start_line", "end_line"), "_first")).withColumn("_to", F.least(F.greatest("start_line", "end_line"), "_last")).where("_from <= _to")
    r = r.select(*KEYS, "start_line", "end_line", bin_(F.col("_from")).alias("_r"), F.explode(F.sequence(bin_(F.col("_from")), bin_(F.col("_to")))).alias("_bin"))
    n = n.where("_low is not null").withColumn("_n", bin_(F.col("_low"))).withColumn("_bin", F.explode(F.sequence(bin_(F.col("_low")), bin_(F.col("_high")))))
    met = r.join(n, [*KEYS, "_bin"]).where("start_line <= node_end and end_line >= node_start and _bin = greatest(_r, _n)")
    return met.drop("_r", "_n", "_bin", "_low", "_high")


def read_distances(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """``reads`` with the least ``distance`` of the rewardable nodes that each touches, null without one.

    Reads and nodes with one range are joined once, however many records read it.
    """
    n = nodes.where(F.coalesce("rewardable", F.lit(True))).groupBy(*KEYS, "start_line", "end_line").agg(F.min("normalized_distance").alias("d"))
    least = _pairs(reads, n).groupBy(*KEYS, "start_line", "end_line").agg(F.min("d").alias("distance"))
    return reads.join(least, [*KEYS, "start_line", "end_line"], "left")


def min_distance(reads: DataFrame, nodes: DataFrame, records: DataFrame) -> DataFrame:
    """(record_index, n_reads, n_hit_reads, min_distance) of each record; -1 where none of its reads touches a node."""
    per = read_distances(reads, nodes).groupBy("record_index").agg(F.count("*").alias("n_reads"), F.count("distance").alias("n_hit_reads"), F.min("distance").alias("m"))
    return records.select("record_index").join(per, "record_index", "left").select("record_index", F.coalesce("n_reads", F.lit(0)).alias("n_reads"), F.coalesce("n_hit_reads", F.lit(0)).alias("n_hit_reads"), F.coalesce("m", F.lit(-1.0)).alias("min_distance"))


def hit_nodes(reads: DataFrame, nodes: DataFrame, *, rewardable_only: bool = True) -> DataFrame:
    """Distinct (record_index, node_key, normalized_distance, trace_idx of the first step that reads it)."""
    n = nodes.where(F.coalesce("rewardable", F.lit(True))) if rewardable_only else nodes
    pairs = _pairs(reads, n.select(*KEYS, "start_line", "end_line", "node_key", "normalized_distance"))
    seen = reads.groupBy("record_index", *KEYS, "start_line", "end_line").agg(F.min("trace_idx").alias("trace_idx"))
    return seen.join(pairs, [*KEYS, "start_line", "end_line"]).groupBy("record_index", "node_key").agg(F.min("normalized_distance").alias("normalized_distance"), F.min("trace_idx").alias("trace_idx"))


def _classes(nodes: DataFrame) -> DataFrame:
    """Rewardable nodes of one range and distance, with their number ``n``."""
    return nodes.where(F.coalesce("rewardable", F.lit(True))).groupBy(*KEYS, "start_line", "end_line", "normalized_distance").agg(F.count("*").alias("n"))


def _touched(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(instance_id, range, hits): each distinct read range with an array of the classes that it touches, each under a number of its own."""
    # Numbers have to last, as rows are told apart by them: the classes are written once.
    c = stage(_classes(nodes).withColumn("c", F.monotonically_increasing_id()), "classes")
    return _pairs(reads, c).groupBy(*RANGE).agg(F.collect_list(F.struct("c", F.col("normalized_distance").alias("d"), "n")).alias("hits"))


def _first_of_class(rows: Column) -> Column:
    """The first of array<struct<c, ...>> for each ``c``, by the fields behind it."""
    return let(F.sort_array(rows), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["c"] != x["c"])))


def hit_classes(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(record_index, normalized_distance, trace_idx of the first step that reads it, n): the rewardable nodes that a record hits, as classes.

    A class holds the ``n`` nodes of one range and distance, which any read hits or misses together; so a record has a row for
    each range, not for each node. Nodes have one row each. Reads go to their record with their classes in an array, where the
    first read of each class is found.
    """
    met = reads.select("record_index", *RANGE, "trace_idx").join(_touched(reads, nodes), RANGE)
    per = met.groupBy("record_index").agg(F.collect_list(F.struct("trace_idx", "hits")).alias("x"))
    rows = F.flatten(F.transform("x", lambda r: F.transform(r["hits"], lambda h: F.struct(h["c"].alias("c"), r["trace_idx"].alias("trace_idx"), h["d"].alias("d"), h["n"].alias("n")))))
    seen = per.select("record_index", F.explode(_first_of_class(rows)).alias("h"))
    return seen.select("record_index", F.col("h.d").alias("normalized_distance"), "h.trace_idx", "h.n")


def first_levels(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(record_index, normalized_distance, trace_idx): the first step of each record at each distance; no class is told from another."""
    n = nodes.where(F.coalesce("rewardable", F.lit(True))).groupBy(*KEYS, "start_line", "end_line", "normalized_distance").agg(F.count("*").alias("n"))
    levels = _pairs(reads, n).groupBy(*RANGE).agg(F.collect_set("normalized_distance").alias("levels"))
    met = reads.select("record_index", *RANGE, "trace_idx").join(levels, RANGE)
    rows = met.select("record_index", "trace_idx", F.explode("levels").alias("normalized_distance"))
    return rows.groupBy("record_index", "normalized_distance").agg(F.min("trace_idx").alias("trace_idx"))


def precision_recall(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(record_index, precision, recall, f1) of the records that touch a node: reads that hit, rewardable nodes hit, of all."""
    total = nodes.where(F.coalesce("rewardable", F.lit(True))).groupBy("instance_id").agg(F.countDistinct("node_key").alias("n_nodes"))
    met = reads.select("record_index", *RANGE).join(_touched(reads, nodes), RANGE, "left")
    per = met.groupBy("record_index", "instance_id").agg((F.count("hits") / F.count("*")).alias("precision"), F.collect_list("hits").alias("x"))
    n_hit = F.aggregate(_first_of_class(F.flatten("x")), F.lit(0).cast("long"), lambda acc, h: acc + h["n"])
    out = per.where("size(x) > 0").withColumn("n_hit", n_hit).join(total, "instance_id").withColumn("recall", F.col("n_hit") / F.col("n_nodes"))
    return out.select("record_index", "precision", "recall", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).alias("f1"))


def _blocks(start: Column, end: Column) -> Column:
    """The dyadic blocks that make up the lines from ``start`` to ``end``: array<struct<level, block>>, two of a level at most."""
    begun = F.struct(start.cast("long").alias("l"), (end.cast("long") + 1).alias("r"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        block = lambda at: F.struct(k.cast("int").alias("level"), at.alias("block"))
        l, r, open_ = acc["l"], acc["r"], acc["l"] < acc["r"]  # noqa: E741
        low, high = open_ & (l.bitwiseAND(1) == 1), open_ & (r.bitwiseAND(1) == 1) & (l.bitwiseAND(1) + l < r)
        found = F.filter(F.array(F.when(low, block(l)), F.when(high, block(r - 1))), lambda x: x.isNotNull())
        # A block that ends a range is cut off it; what is left is a range of blocks of twice the size.
        return F.struct(F.shiftright(l + l.bitwiseAND(1), 1).alias("l"), F.shiftright(r, 1).alias("r"), F.concat(acc["out"], found).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), begun, step, lambda acc: acc["out"])


def stab(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct points (``keys``, line_no) with all columns of the ranges (``keys``, start_line, end_line, ...) that hold them.

    A range is cut into dyadic blocks, and a line lies in one block of each size, so that each point meets each of its ranges
    once, in some block, by an equi-join: a file of many points and ranges is many keys. A line is looked up once, however many
    rows have it. Nulls, and ranges that end before they start, hold nothing.
    """
    r = ranges.where("start_line <= end_line").withColumn("_b", F.explode(_blocks(F.col("start_line"), F.col("end_line")))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    used = ranges.where("start_line <= end_line").agg(F.max(F.ceil(F.log2(F.col("end_line").cast("long") - F.col("start_line") + 1)))).first()[0] or 0
    p = points.where("line_no is not null").select(*keys, "line_no").distinct().withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(int(used)))))
    return p.withColumn("_block", F.expr("shiftright(cast(line_no as bigint), _level)")).join(r, [*keys, "_level", "_block"]).drop("_level", "_block")


def in_some_range(points: DataFrame, ranges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``points`` (file_path, line_no, ...) that lie in some range of their file."""
    keys = keys or ["file_path"]
    held = stab(points, ranges.select(*keys, "start_line", "end_line").distinct(), keys).select(*keys, "line_no").distinct()
    return points.join(held, [*keys, "line_no"], "left_semi")


def first_range(points: DataFrame, ranges: DataFrame, place: str, keys: list[str] | None = None) -> DataFrame:
    """``points`` with ``first``, the range (a struct of its other columns) of the least ``place`` that holds each; null for none."""
    keys = keys or ["file_path"]
    own = [c for c in ranges.columns if c not in keys]
    r = ranges.select(*keys, "start_line", "end_line", F.col(place).alias("_place"), F.struct(*own).alias("first"))
    found = stab(points, r, keys).groupBy(*keys, "line_no").agg(F.min_by("first", "_place").alias("first"))
    return points.join(found, [*keys, "line_no"], "left")


def innermost(points: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """For each point of ``key``, the name of the range that holds it: an equal name first, then the shortest, then the one that starts last."""
    r = ranges.select("file_path", "start_line", "end_line", F.col("qualified_name").alias("range_name"))
    held = points.join(stab(points, r, ["file_path"]), ["file_path", "line_no"])
    rank = F.struct((F.col("range_name") != F.col("qualified_name")).cast("int"), F.col("end_line").cast("long") - F.col("start_line"), -F.col("start_line").cast("long"), "range_name")
    return held.groupBy(*key).agg(F.min_by("range_name", rank).alias("callable"))


def with_alias(records: DataFrame, maps: DataFrame, candidates: str) -> DataFrame:
    """Left join of records with maps by the first of their candidate ids (an array column) that has one."""
    c = records.select("record_index", F.posexplode(candidates).alias("place", "map_id"))
    best = c.join(maps, "map_id").withColumn("n", F.row_number().over(W.partitionBy("record_index").orderBy("place"))).where("n = 1").drop("n", "place")
    return records.join(best, "record_index", "left")
