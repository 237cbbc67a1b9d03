"""Summaries of score details: rates, groups, trends, histograms, model metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rate

NEAR = 0.5


def with_hits(details: DataFrame, near: float = NEAR) -> DataFrame:
    d = F.col("min_distance")
    return details.withColumns({"hit_call_graph": d >= 0, "hit_ground_truth": d == 0, "hit_near": (d >= 0) & (d <= near)})


def hit_rates(details: DataFrame, *keys: str, near: float = NEAR) -> DataFrame:
    """Counts and rates over all records, or for each group of ``keys``: one pass; a rate without records is null."""
    n = lambda c: F.count_if(c)
    total = F.count("*")
    out = [total.alias("n_records"), n("hit_call_graph").alias("n_hit"), n("hit_ground_truth").alias("n_ground_truth")]
    out += [F.round(rate(n(c), total), 6).alias(f"{c}_rate") for c in ("hit_call_graph", "hit_ground_truth", "hit_near")]
    return with_hits(details, near).groupBy(*keys).agg(*out, F.round(F.avg(F.when(F.col("min_distance") >= 0, F.col("min_distance"))), 6).alias("avg_distance"))


def trends(details: DataFrame, source: str = "data_source", step: str = "run_step") -> DataFrame:
    return hit_rates(details.where(F.col(step).isNotNull()), source, step)


def metric_rows(details: DataFrame, source: str = "data_source", prefix: str = "val") -> DataFrame:
    """(metric, value): one row for each metric of each source, named ``<prefix>/<source>/<metric>``; nulls are left out."""
    wide = hit_rates(details, source)
    cols = [c for c in wide.columns if c != source]
    long = wide.select(F.coalesce(source, F.lit("unknown")).alias("s"), *[F.col(c).cast("double") for c in cols]).unpivot("s", cols, "name", "value")
    return long.where("value is not null").select(F.concat(F.lit(f"{prefix}/"), "s", F.lit("/"), "name").alias("metric"), "value")


def recall_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.format_string("%.1f", F.floor(F.col("recall") * 10) / 10).alias("bucket")).agg(F.count("*").alias("n"))


def model_metrics(cells: DataFrame, key: str = "model_label") -> DataFrame:
    """Counts by status, means over finished cells with turns, ratio of summed tokens, cost."""
    done = (F.col("status") == "done") & F.col("turns").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(done, F.col(c))), 6)
    total = lambda c: F.sum(F.when(done, F.col(c)))
    status = lambda *s: F.count_if(F.col("status").isin(*s))
    return cells.groupBy(key).agg(F.count("*").alias("target"), status("done").alias("done"), status("pending", "running").alias("pending"), status("error").alias("error"), mean("resolved").alias("resolved_rate"), mean("turns").alias("avg_turns"), F.round(rate(F.nullif(total("cache_hit_tokens"), F.lit(0)), total("input_tokens") + total("cache_hit_tokens")), 6).alias("cache_hit_rate"), F.round(F.sum("cost"), 2).alias("total_cost"))


def model_ranking(metrics: DataFrame, key: str = "model_label") -> DataFrame:
    """``metrics`` with a place: better resolved rate first, nulls last, then by label. There are as many rows as models."""
    return metrics.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("resolved_rate"), key)))
