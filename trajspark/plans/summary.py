"""The full summary of score details: counters, rates, averages and distributions, in all or by keys.

Names are fixed values. A rate is null where its denominator is zero; an average is null over no row. All counters, rates
and averages come from one aggregation, which combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rate

PATTERNS = ("missed_anchor", "missed_root_after_anchor", "root_before_anchor", "chain_stall", "chain_read_loop", "off_chain_read_spree", "error_spiral_on_chain")
SUMS = ("n_blocks", "n_scored_read_blocks", "n_achieving_blocks", "n_wasted_blocks", "n_loop_blocks", "n_block_steps", "n_scored_read_block_steps", "n_achieving_block_steps", "n_wasted_block_steps", "n_loop_block_steps")
#: rate -> (counter, counter that divides it)
RATES = {
    "instance_id_rate": ("n_with_instance_id", "n_records"),
    "bonus_map_coverage": ("n_with_bonus_map", "n_records"),
    "call_graph_coverage": ("n_with_call_graph", "n_records"),
    "read_rate": ("n_with_reads", "n_records"),
    "chain_graph_coverage": ("n_chain_graph_covered", "n_records"),
    "anchor_hit_rate": ("n_anchor_hit", "n_chain_evaluable"),
    "root_hit_rate": ("n_root_hit", "n_chain_evaluable"),
    "chain_hit_rate": ("n_chain_hit", "n_chain_evaluable"),
    "anchor_before_root_rate": ("n_anchor_before_root", "n_chain_order_defined"),
    "missed_anchor_rate": ("n_missed_anchor", "n_chain_evaluable"),
    "missed_root_after_anchor_rate": ("n_missed_root_after_anchor", "n_chain_evaluable"),
    "root_before_anchor_rate": ("n_root_before_anchor", "n_chain_order_defined"),
    "chain_stall_rate": ("n_chain_stall", "n_chain_evaluable"),
    "chain_read_loop_rate": ("n_chain_read_loop", "n_chain_evaluable"),
    "off_chain_read_spree_rate": ("n_off_chain_read_spree", "n_chain_evaluable"),
    "error_spiral_on_chain_rate": ("n_error_spiral_on_chain", "n_chain_evaluable"),
    "graph_hit_rate_over_bonus_maps": ("n_hit_call_graph", "n_with_bonus_map"),
    "graph_hit_rate_over_call_graphs": ("n_hit_call_graph", "n_with_call_graph"),
    "ground_truth_hit_rate_over_call_graphs": ("n_hit_ground_truth", "n_with_call_graph"),
    "near_hit_rate_over_call_graphs": ("n_hit_near", "n_with_call_graph"),
    "order_defined_rate": ("n_order_defined", "n_with_call_graph"),
    "reverse_order_rate": ("n_reverse_order", "n_order_defined"),
    "miracle_rate_over_gt_hits": ("n_miracle", "n_miracle_denominator"),
    "block_order_defined_rate": ("n_block_order_defined", "n_with_call_graph"),
    "block_reverse_order_rate": ("n_block_reverse_order", "n_block_order_defined"),
    "block_miracle_rate_over_gt_hits": ("n_block_miracle", "n_block_miracle_denominator"),
    "avg_blocks_per_trace": ("n_blocks", "n_records"),
    "block_achieve_rate": ("n_achieving_blocks", "n_scored_read_blocks"),
    "block_waste_rate": ("n_wasted_blocks", "n_scored_read_blocks"),
    "block_loop_rate": ("n_loop_blocks", "n_blocks"),
    "achieving_block_step_share": ("n_achieving_block_steps", "n_scored_read_block_steps"),
    "wasted_block_step_share": ("n_wasted_block_steps", "n_scored_read_block_steps"),
    "loop_block_step_share": ("n_loop_block_steps", "n_block_steps"),
    "bad_pattern_trace_rate": ("n_traces_with_loop", "n_records"),
    "error_spiral_rate": ("n_traces_with_error_spiral", "n_records"),
}
#: rates that are means, and averages: name -> (column, condition)
MEANS = {
    "chain_node_recall": ("chain_node_recall", "chain_evaluable"),
    "chain_read_precision": ("chain_read_precision", "chain_evaluable"),
    "avg_node_recall": ("hit_recall", "true"),
    "avg_read_precision": ("hit_precision", "true"),
    "avg_hit_f1": ("hit_f1", "true"),
}
AVERAGES = {
    "time_to_anchor": ("first_anchor_step", "chain_evaluable"),
    "time_to_root": ("first_root_step", "chain_evaluable"),
    "steps_anchor_to_root": ("steps_anchor_to_root", "chain_evaluable and coalesce(bonus_case_type, '') <> 'direct' and anchor_before_root is not null"),
    "avg_min_distance_on_hits": ("min_distance", "hit_call_graph"),
    "avg_best_positive_multiplier_on_hits": ("best_positive_multiplier", "hit_call_graph"),
    "avg_order_score": ("order_score", "true"),
    "avg_block_order_score": ("block_order_score", "true"),
    "avg_block_efficiency_steps": ("block_efficiency", "true"),
}
#: What a trend and the validation metrics show of them.
TREND = ("chain_graph_coverage", "anchor_hit_rate", "root_hit_rate", "chain_hit_rate", "chain_node_recall", "chain_read_precision", "anchor_before_root_rate", "graph_hit_rate_over_call_graphs", "ground_truth_hit_rate_over_call_graphs", "avg_node_recall", "avg_read_precision", "miracle_rate_over_gt_hits", "block_achieve_rate", "block_loop_rate", "time_to_anchor", "time_to_root", "steps_anchor_to_root", "avg_order_score", "avg_block_order_score", "avg_block_efficiency_steps")
NOT_VALIDATED = ("instance_id_rate", "graph_hit_rate_over_bonus_maps")
VALIDATION = tuple(n for n in (*RATES, *MEANS, *AVERAGES) if n not in NOT_VALIDATED)
VALIDATION_COUNTS = ("n_records", "n_with_bonus_map", "n_with_call_graph")


def _counters() -> dict[str, Column]:
    yes = lambda c: F.coalesce(F.expr(c), F.lit(False))
    chain = {"n_chain_hit": "chain_hit", "n_anchor_hit": "anchor_hit", "n_root_hit": "root_hit", **{f"n_{p}": p for p in PATTERNS}}
    conditions = {
        "n_with_instance_id": "instance_id <> ''", "n_with_bonus_map": "has_bonus_map", "n_with_call_graph": "has_call_graph", "n_traceable_bonus": "bonus_traceable", "n_with_reads": "n_reads > 0",
        "n_traces_with_loop": "n_loop_blocks > 0", "n_traces_with_error_spiral": "max_error_run >= 3", "n_chain_graph_covered": "chain_graph_covered", "n_chain_evaluable": "chain_evaluable", "n_not_chain_evaluable": "not coalesce(chain_evaluable, false)",
        **{k: f"chain_evaluable and {c}" for k, c in chain.items()},
        "n_chain_order_candidates": "chain_evaluable and coalesce(bonus_case_type, '') <> 'direct'", "n_chain_order_defined": "chain_evaluable and coalesce(bonus_case_type, '') <> 'direct' and anchor_before_root is not null", "n_anchor_before_root": "chain_evaluable and coalesce(bonus_case_type, '') <> 'direct' and anchor_before_root",
        "n_hit_call_graph": "hit_call_graph", "n_order_defined": "order_score is not null", "n_reverse_order": "order_score < 0", "n_block_order_defined": "block_order_score is not null", "n_block_reverse_order": "block_order_score < 0",
        "n_hit_ground_truth": "hit_ground_truth", "n_miracle_denominator": "hit_ground_truth and miracle_step is not null", "n_block_miracle_denominator": "hit_ground_truth and block_miracle_step is not null", "n_hit_near": "hit_near", "n_miracle": "miracle_step", "n_block_miracle": "block_miracle_step",
    }
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in SUMS}
    return {"n_records": F.count("*"), **{k: F.count_if(yes(c)) for k, c in conditions.items()}, **sums}


def summarize(details: DataFrame, *keys: str) -> DataFrame:
    """One row for all details, or for each value of ``keys``: 44 counters, 40 rates, 8 averages. No details give a row of zeros and nulls, or no row by keys."""
    if "bonus_traceable" not in details.columns:
        details = details.withColumn("bonus_traceable", F.col("bonus_case_type").isin("standard", "direct"))
    mean = lambda c, when: F.avg(F.when(F.expr(when), F.col(c).cast("double")))
    wide = details.groupBy(*keys).agg(*[c.alias(k) for k, c in _counters().items()], *[mean(*v).alias(k) for k, v in (MEANS | AVERAGES).items()])
    return wide.select("*", *[rate(F.col(a), F.col(b)).alias(k) for k, (a, b) in RATES.items()])


def by_case_type(details: DataFrame) -> DataFrame:
    """Counters and rates of each case type; graph rates divide by the records with a graph, or where there are none by all."""
    wide = summarize(details.withColumn("case_type", F.coalesce(F.nullif("bonus_case_type", F.lit("")), F.lit("missing_bonus_map"))), "case_type")
    graphs = F.coalesce(F.nullif("n_with_call_graph", F.lit(0)), "n_records")
    counts = ("n_with_call_graph", "n_with_reads", "n_hit_call_graph", "n_hit_ground_truth", "n_hit_near", "n_chain_evaluable", "n_not_chain_evaluable", "n_chain_hit", "n_anchor_hit", "n_root_hit")
    over = {"read_rate": ("n_with_reads", F.col("n_records")), "graph_hit_rate": ("n_hit_call_graph", graphs), "ground_truth_hit_rate": ("n_hit_ground_truth", graphs), "near_hit_rate": ("n_hit_near", graphs), **{f"{k}_hit_rate": (f"n_{k}_hit", F.col("n_chain_evaluable")) for k in ("chain", "anchor", "root")}}
    return wide.select("case_type", F.col("n_records").alias("n"), *counts, *[rate(F.col(a), b).alias(k) for k, (a, b) in over.items()]).orderBy("case_type")


def trends(details: DataFrame) -> DataFrame:
    """Rates and averages of each source and run step, in that order; details without a step are left out."""
    d = details.where("run_step is not null").withColumn("data_source", F.coalesce(F.nullif("data_source", F.lit("")), F.lit("unknown")))
    return summarize(d, "data_source", "run_step").select("data_source", "run_step", "n_records", *TREND).orderBy("data_source", "run_step")


def validation_metrics(details: DataFrame, prefix: str = "val") -> DataFrame:
    """(metric, value) named ``<prefix>/<source>/<name>``: 46 rates and averages without nulls, and three counts."""
    d = details.withColumn("data_source", F.coalesce(F.nullif("data_source", F.lit("")), F.lit("unknown")))
    names = [*VALIDATION, *VALIDATION_COUNTS]
    long = summarize(d, "data_source").select("data_source", *[F.col(c).cast("double") for c in names]).unpivot("data_source", names, "name", "value")
    return long.where("value is not null").select(F.concat_ws("/", F.lit(prefix), "data_source", "name").alias("metric"), "value")


def distributions(details: DataFrame, hit_distances: DataFrame) -> DataFrame:
    """(distribution, bucket, n): recall in tenths, distances of hit nodes, reasons against a chain, bad patterns.

    ``hit_distances``: normalized_distance of each node that each record hits.
    """
    recall = details.where("hit_recall is not null").select(F.lit("recall_histogram").alias("distribution"), F.format_string("%.1f", F.floor(F.col("hit_recall").cast("double") * 10) / 10).alias("bucket"))
    hops = hit_distances.where("normalized_distance is not null").select(F.lit("hop_coverage"), F.format_string("%.3f", F.col("normalized_distance").cast("double")))
    reasons = details.where("not coalesce(chain_evaluable, false)").select(F.lit("not_chain_evaluable_reasons"), F.coalesce(F.nullif("not_chain_evaluable_reason", F.lit("")), F.lit("unknown")))
    patterns = details.where("chain_evaluable").select(F.lit("chain_bad_patterns"), F.explode(F.filter(F.array(*[F.when(F.col(p), F.lit(p)) for p in PATTERNS]), lambda x: x.isNotNull())))
    return recall.union(hops).union(reasons).union(patterns).groupBy("distribution", "bucket").agg(F.count("*").alias("n"))


def case_tally(maps: DataFrame) -> DataFrame:
    """(case_type, n, share) of maps, the most frequent first: one row for each kind of case."""
    counted = maps.groupBy(F.coalesce("case_type", F.lit("unknown")).alias("case_type")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))  # as many rows as kinds of cases
    return counted.select("case_type", "n", rate(F.col("n"), total).alias("share")).orderBy(F.desc("n"), "case_type")
