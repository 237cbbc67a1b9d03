"""Credit: advantages of token rows multiplied where their reads touch the call graph.

``rows``: record_index, instance_id, advantages, returns (array<double>), response_mask (array<int>). ``spans``: record_index,
trace_idx, block_index (for blocks), response_start, response_end (null: the row's start and end), distance (least distance of
the rewardable nodes that the step's reads touch, null for none), is_read. All is done per row over its own arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.objects import let
from ..functions.text import multiplier, rate
from .staging import stage


def masked_mean_sign(advantages: Column, mask: Column) -> Column:
    """Sign of the mean advantage under the mask; null without a masked token."""
    held = F.filter(F.arrays_zip(advantages.alias("a"), mask.alias("m")), lambda x: x["m"] != 0)
    return F.when(F.size(held) > 0, F.signum(F.aggregate(held, F.lit(0.0), lambda s, x: s + x["a"])).cast("int"))


def _marked(mask: Column, start: Column, end: Column) -> Column:
    """Whether a masked token lies in [start, end)."""
    return F.exists(F.slice(mask, start + 1, F.greatest(end - start, F.lit(0))), lambda m: m != 0)


def _rows(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("n", F.size("response_mask")).withColumn("sign", masked_mean_sign(F.col("advantages"), F.col("response_mask")))
    return out.where("sign is not null")


def _clamped(spans: DataFrame, rows: DataFrame) -> DataFrame:
    s = spans.join(rows.select("record_index", "n", "sign", F.col("response_mask").alias("mask")), "record_index")
    return s.withColumn("start", F.greatest(F.coalesce("response_start", F.lit(0)), F.lit(0))).withColumn("end", F.least(F.coalesce("response_end", "n"), F.col("n")))


def step_factors(rows: DataFrame, spans: DataFrame, m_max: float = 3.0) -> DataFrame:
    """(record_index, parts: array<struct<spans, factor>>): each step with a hit and a masked token in its span."""
    s = _clamped(spans, _rows(rows)).where("distance is not null and end > start").where(_marked(F.col("mask"), F.col("start"), F.col("end")))
    part = F.struct("trace_idx", F.array(F.struct("start", "end")).alias("spans"), multiplier(F.col("distance"), m_max, F.col("sign")).alias("factor"))
    return s.groupBy("record_index").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def block_factors(rows: DataFrame, spans: DataFrame, m_max: float = 3.0) -> DataFrame:
    """(record_index, parts, n_blocks, n_wasted, block_steps): read blocks; one without a hit or without a masked token is wasted."""
    s = _clamped(spans.where("is_read"), _rows(rows)).withColumn("marked", (F.col("end") > F.col("start")) & _marked(F.col("mask"), F.col("start"), F.greatest("start", "end")))
    b = s.groupBy("record_index", "block_index").agg(F.count("*").alias("steps"), F.min("distance").alias("distance"), F.first("sign").alias("sign"), F.bool_or("marked").alias("marked"), F.collect_list(F.when(F.col("end") > F.col("start"), F.struct("start", "end"))).alias("spans"))
    good = F.col("distance").isNotNull() & F.col("marked")
    part = F.when(good, F.struct("block_index", "spans", multiplier(F.col("distance"), m_max, F.col("sign")).alias("factor")))
    return b.groupBy("record_index").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.count("*").alias("n_blocks"), F.count_if(~good).alias("n_wasted"), F.sum("steps").alias("block_steps"))


def _factor(parts: Column, i: Column) -> Column:
    """Product of the factors of the parts that hold a place; spans of one part count once."""
    return F.aggregate(parts, F.lit(1.0), lambda a, p: F.when(F.exists(p["spans"], lambda s: (s["start"] <= i) & (i < s["end"])), a * p["factor"]).otherwise(a))


def _stretches(spans: Column, n: Column) -> Column:
    """The places from 0 to ``n``, cut wherever a span starts or ends: array<struct<start, end>>; no span holds a part of a stretch."""
    ends = F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    inner = F.filter(ends, lambda e: (e > 0) & (e < n))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inner, F.array(n))))
    return let(cuts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.struct(x.alias("start"), c[i + 1].alias("end"))))


def _swept(values: Column, mask: Column, parts: Column) -> Column:
    """``values`` times the factors of the parts that hold their place, where the mask is set.

    The sweep goes from one start or end of a span to the next: the product of factors is made once for each stretch between two,
    in the order of the parts, so a token costs one multiplication and gives what a product of its own would give, to the bit.
    """

    def stretch(s: Column) -> Column:
        own = lambda c: F.slice(c, s["start"] + 1, s["end"] - s["start"])
        return let(_factor(parts, s["start"]), lambda f: F.transform(own(F.arrays_zip(values.alias("x"), F.slice(mask, F.lit(1), F.size(values)).alias("m"))), lambda t: F.when(t["m"] != 0, t["x"] * f).otherwise(t["x"])))

    return F.flatten(F.transform(_stretches(F.flatten(F.transform(parts, lambda p: p["spans"])), F.size(values)), stretch))


def apply(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with advantages and returns multiplied under the mask, and n_reshaped and multiplier_sum; a row without parts stays."""
    j = rows.join(parts.select("record_index", "parts"), "record_index", "left")
    new = lambda c: F.when(F.col("parts").isNull() | (F.size(c) == 0), F.col(c)).otherwise(_swept(F.col(c), F.col("response_mask"), F.col("parts")))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["factor"])
    return j.withColumns({"advantages": new("advantages"), "returns": new("returns"), "n_reshaped": F.coalesce(F.size("parts"), F.lit(0)), "multiplier_sum": F.coalesce(total, F.lit(0.0))}).drop("parts")


def _covered(mask: Column, spans: Column) -> Column:
    """How many masked places lie in some of the spans, each once."""
    held = F.filter(_stretches(spans, F.size(mask)), lambda t: F.exists(spans, lambda s: (s["start"] <= t["start"]) & (t["start"] < s["end"])))
    return F.aggregate(held, F.lit(0), lambda a, t: a + F.size(F.filter(F.slice(mask, t["start"] + 1, t["end"] - t["start"]), lambda m: m != 0)))


def whole_rows(rows: DataFrame, distances: DataFrame, m_max: float = 3.0) -> DataFrame:
    """Parts for rows without steps: one over the whole row, if its reads (record_index, distance) touch the graph."""
    s = _rows(rows).join(distances.where("distance is not null"), "record_index")
    part = F.struct(F.lit(0).alias("trace_idx"), F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))).alias("spans"), multiplier(F.col("distance"), m_max, F.col("sign")).alias("factor"))
    return s.select("record_index", F.array(part).alias("parts"))


def reshape(rows: DataFrame, spans: DataFrame, distances: DataFrame, *, m_max: float = 3.0, by_block: bool = False) -> DataFrame:
    """Rows with steps are reshaped by steps or by blocks, the others as a whole; rows without a masked token stay."""
    with_steps = spans.select("record_index").distinct()
    parts = (block_factors if by_block else step_factors)(rows, spans, m_max).select("record_index", F.col("parts"))
    plain = whole_rows(rows.join(with_steps, "record_index", "left_anti"), distances, m_max)
    one = lambda df: df.select("record_index", F.transform("parts", lambda p: F.struct(p["spans"].alias("spans"), p["factor"].alias("factor"))).alias("parts"))
    return apply(rows, one(parts).unionByName(one(plain)))


def trainer_metrics(reshaped: DataFrame) -> DataFrame:
    """One row: n_reshaped, n_total, reshape_rate and avg_multiplier; an empty denominator counts as one. Spans count, so the rate can exceed one."""
    n, total = F.coalesce(F.sum("n_reshaped"), F.lit(0)), F.count("*")
    sums = F.coalesce(F.sum("multiplier_sum"), F.lit(0.0))
    return reshaped.agg(n.alias("n_reshaped"), total.alias("n_total"), rate(n, F.greatest(total, F.lit(1))).alias("reshape_rate"), rate(sums, F.greatest(n, F.lit(1))).alias("avg_multiplier"))


def block_metrics(blocks: DataFrame, reshaped: DataFrame) -> DataFrame:
    """One row over ``block_factors`` and the reshaped rows: blocks, achieving and wasted ones, mean length, share of reshaped tokens."""
    blocks = stage(blocks, "blocks")
    counts = blocks.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("n_blocks"), F.coalesce(F.sum(F.size("parts")), F.lit(0)).alias("n_achieving"), F.coalesce(F.sum("n_wasted"), F.lit(0)).alias("n_wasted"), F.coalesce(F.sum("block_steps"), F.lit(0)).alias("_steps"))
    held = reshaped.join(blocks.select("record_index", "parts"), "record_index", "left")
    valid = F.size(F.filter("response_mask", lambda m: m != 0))
    touched = F.aggregate("parts", F.lit(0), lambda a, p: a + _covered(F.col("response_mask"), p["spans"]))
    tokens = held.agg(F.coalesce(F.sum(touched), F.lit(0)).alias("_touched"), F.coalesce(F.sum(valid), F.lit(0)).alias("_valid"))
    both = counts.crossJoin(tokens)  # one row each
    return both.select("n_blocks", "n_achieving", "n_wasted", rate(F.col("_steps"), F.greatest("n_blocks", F.lit(1))).alias("mean_len"), rate(F.col("_touched"), F.greatest("_valid", F.lit(1))).alias("reshaped_token_share"))
