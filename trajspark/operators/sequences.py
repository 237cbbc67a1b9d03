"""Operators over the ordered steps of a record: runs, blocks, first hits, order and credit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _steps(key: str, order: str = "trace_idx") -> W:
    return W.partitionBy(key).orderBy(order)


def purpose_blocks(steps: DataFrame, key: str = "record_index") -> DataFrame:
    """``steps`` with ``block_index``: a new block starts where family or target differ from the step before; null equals null."""
    w = _steps(key)
    new = ~(F.lag("family").over(w).eqNullSafe(F.col("family")) & F.lag("target").over(w).eqNullSafe(F.col("target"))) | (F.row_number().over(w) == 1)
    return steps.withColumn("_new", new.cast("int")).withColumn("block_index", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_new")


def block_rows(steps: DataFrame, key: str = "record_index") -> DataFrame:
    """One row for each block: its family, target, first and last step, length, and whether it loops (three or more steps with one signature)."""
    b = purpose_blocks(steps, key).groupBy(key, "block_index", "family", "target")
    return b.agg(F.count("*").alias("n_steps"), F.min("trace_idx").alias("first_step"), F.max("trace_idx").alias("last_step"), F.countDistinct("signature").alias("s")).withColumn("is_loop", (F.col("n_steps") >= 3) & (F.col("s") == 1)).drop("s")


def block_stats(blocks: DataFrame, key: str = "record_index") -> DataFrame:
    one = lambda c: F.count_if(c)
    return blocks.groupBy(key).agg(F.count("*").alias("n_blocks"), one(F.col("family") == "read").alias("n_read_blocks"), one(F.col("is_loop")).alias("n_loop_blocks"), F.sum(F.when(F.col("family") == "read", F.col("n_steps")).otherwise(0)).alias("n_read_steps"))


def longest_run(steps: DataFrame, flag: Column, key: str = "record_index", order: str | list[str] = "trace_idx") -> DataFrame:
    """(key, longest) of each key with a step: the longest row of steps where ``flag`` holds; null counts as false."""
    order = [order] if isinstance(order, str) else order
    df = steps.select(key, *order, F.coalesce(flag, F.lit(False)).alias("_f"))
    df = df.withColumn("_g", F.row_number().over(W.partitionBy(key).orderBy(*order)) - F.row_number().over(W.partitionBy(key, "_f").orderBy(*order)))
    runs = df.groupBy(key, "_f", "_g").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_f"), F.col("n"))), F.lit(0)).alias("longest"))


def order_score(first_hits: DataFrame, key: str = "record_index") -> DataFrame:
    """(key, order_score): agreement of the order of first hits with falling distance, over pairs without ties on either side.

    Counts of each (step, distance) stand for the nodes, so a record costs the square of its distinct levels, not nodes. A
    column ``n`` says how many nodes a row stands for.
    """
    size = F.sum("n") if "n" in first_hits.columns else F.count("*")
    g = first_hits.groupBy(key, "trace_idx", "normalized_distance").agg(size.alias("n"))
    # A record with one step, or one distance, has no pair.
    ends = [f(c).alias(f"{s}_{c}") for c in ("trace_idx", "normalized_distance") for s, f in (("low", F.min), ("high", F.max))]
    listed = g.groupBy(key).agg(F.collect_list(F.struct("trace_idx", "normalized_distance", "n")).alias("x"), *ends).where("low_trace_idx < high_trace_idx and low_normalized_distance < high_normalized_distance")
    apart = lambda a, b: (a["trace_idx"] < b["trace_idx"]) & (a["normalized_distance"] != b["normalized_distance"])
    sign = lambda a, b: F.signum(a["normalized_distance"] - b["normalized_distance"])

    def total(part) -> Column:
        own = lambda a: lambda acc, b: F.when(apart(a, b), acc + part(a, b)).otherwise(acc)
        return F.aggregate("x", F.lit(0.0), lambda acc, a: acc + F.aggregate("x", F.lit(0.0), own(a)))

    size = lambda a, b: a["n"].cast("double") * b["n"]
    score = total(lambda a, b: sign(a, b) * size(a, b)) / F.nullif(total(size), F.lit(0.0))
    return listed.select(key, F.explode(F.filter(F.array(score), lambda v: v.isNotNull())).alias("order_score"))


def miracles(first_hits: DataFrame, levels: int, key: str = "record_index") -> DataFrame:
    """(key, is_miracle, severity) for each key with hits: the root is read before any level between was. ``levels``: levels between 0 and 1."""
    root = F.min(F.when(F.col("normalized_distance") == 0, F.col("trace_idx"))).alias("root")
    between = F.min(F.when((F.col("normalized_distance") > 0) & (F.col("normalized_distance") < 1), F.col("trace_idx"))).alias("between")
    out = first_hits.groupBy(key).agg(root, between)
    hit = F.col("root").isNotNull() & (F.col("between").isNull() | (F.col("between") > F.col("root")))
    if not levels:
        return out.select(key, F.lit(None).cast("boolean").alias("is_miracle"), F.lit(None).cast("int").alias("severity"))
    return out.select(key, hit.alias("is_miracle"), F.when(hit, levels).otherwise(0).alias("severity"))


def chain_step_hits(reads_with_nodes: DataFrame, key: str = "record_index") -> DataFrame:
    """Per step: whether it reads a chain node, an anchor (distance 1) or a root (distance 0)."""
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    d = F.col("normalized_distance")
    return reads_with_nodes.groupBy(key, "trace_idx").agg(any_(d.isNotNull()).alias("on_chain"), any_(d == 1).alias("on_anchor"), any_(d == 0).alias("on_root"))


def chain_patterns(step_hits: DataFrame, key: str = "record_index") -> DataFrame:
    """Bad patterns of each record, from ``chain_step_hits``."""
    first = lambda c: F.min(F.when(F.col(c), F.col("trace_idx")))
    agg = step_hits.groupBy(key).agg(first("on_anchor").alias("anchor"), first("on_root").alias("root"), F.max(F.when(F.col("on_root"), F.col("trace_idx"))).alias("last_root"), F.count_if("on_chain").alias("on"), F.count_if(~F.col("on_chain")).alias("off"), F.collect_list(F.when(F.col("on_chain"), F.col("trace_idx"))).alias("chain_steps"))
    after = F.size(F.filter("chain_steps", lambda s: s > F.col("anchor")))
    rooted = F.coalesce(F.col("last_root") >= F.col("anchor"), F.lit(False))
    return agg.select(key, F.col("anchor").isNull().alias("missed_anchor"), F.col("root").isNull().alias("missed_root"), F.coalesce(F.col("root") < F.col("anchor"), F.lit(False)).alias("root_before_anchor"), (F.col("anchor").isNotNull() & ~rooted & (after >= 2)).alias("chain_stall"), ((F.col("off") >= 3) & (F.col("off") > F.col("on"))).alias("off_chain_read_spree"))


def mask_spans(rows: DataFrame, key: str, mask: str = "response_mask") -> DataFrame:
    """(key, span_index, start, end) of the maximal rows of ones in an array, the end excluded."""
    ones = rows.select(key, F.posexplode(mask).alias("pos", "m")).where("m = 1")
    ones = ones.withColumn("g", F.col("pos") - F.row_number().over(W.partitionBy(key).orderBy("pos")))
    spans = ones.groupBy(key, "g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return spans.withColumn("span_index", F.row_number().over(W.partitionBy(key).orderBy("start")) - 1).select(key, "span_index", "start", "end")


def reshape_advantages(advantages: Column, mask: Column, spans: Column) -> Column:
    """Each advantage times the product of the multipliers of the spans (array<struct<start, end, multiplier>>) that hold its place, where the mask is 1."""
    factor = lambda i: F.aggregate(F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"])), F.lit(1.0), lambda a, s: a * s["multiplier"])
    return F.transform(advantages, lambda x, i: F.when(F.get(mask, i) == 1, x * factor(i)).otherwise(x))


def masked_sign(advantages: Column, mask: Column) -> Column:
    total = F.aggregate(F.zip_with(advantages, mask, lambda a, m: a * m.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.signum(total)
