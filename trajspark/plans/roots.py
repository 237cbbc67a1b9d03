"""How the roots of a call graph were selected: dependencies of patched callables, their components, and what each start matched.

``frames`` as in ``callgraph``; one row of a table always belongs to one instance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import anchors
from ..operators.graphs import KEY, components
from ..operators.staging import stage
from . import callgraph


@dataclass(frozen=True)
class RootSelection:
    """``frames``: patched callables of each trace; ``components``: sink components; ``edges``: dependencies; ``counts``: one row an instance."""

    frames: DataFrame
    components: DataFrame
    edges: DataFrame
    counts: DataFrame


def trace_frames(frames: DataFrame) -> DataFrame:
    """(instance_id, trace_idx, node_key, frame_index, frame_indices, downstream): patched callables of each trace, and the others behind one's first place.

    A trace is gathered once; its frames are capped where it is captured, so the list is short.
    """
    seen = frames.where("is_patched").groupBy(KEY, "trace_idx", "node_key").agg(F.array_sort(F.collect_list("frame_idx")).alias("at"))
    per = seen.groupBy(KEY, "trace_idx").agg(F.collect_list(F.struct("node_key", "at")).alias("all"))
    one = per.select(KEY, "trace_idx", "all", F.explode("all").alias("x"))
    behind = F.filter("all", lambda y: (y["node_key"] != F.col("x.node_key")) & (F.element_at(y["at"], -1) > F.col("x.at")[0]))
    return one.select(KEY, "trace_idx", "x.node_key", F.col("x.at")[0].alias("frame_index"), F.col("x.at").alias("frame_indices"), F.array_sort(F.transform(behind, lambda y: y["node_key"])).alias("downstream"))


def select_roots(frames: DataFrame, issues: DataFrame | None = None) -> RootSelection:
    """Terminal components of the dependencies between patched callables, condensed, and what choosing them has changed.

    ``counts`` compares two walks: from every patched frame (``legacy_``), and from the roots alone. A count is of rewarded nodes at
    distance zero; an instance without patched frames has no row. A callable that isn't a root is an upstream adapter.
    """
    f = stage(callgraph.prepared(frames), "frames")
    seen = stage(trace_frames(f), "patched")
    edges = seen.select(KEY, F.col("node_key").alias("caller"), F.explode("downstream").alias("callee")).distinct()
    nodes = seen.select(KEY, "node_key").distinct()
    parts = stage(components(nodes, edges), "components")
    end = lambda c: parts.select(KEY, F.col("node_key").alias(c), F.col("component").alias(f"of_{c}"))
    left = edges.join(end("caller"), [KEY, "caller"]).join(end("callee"), [KEY, "callee"]).where("of_caller <> of_callee").select(KEY, F.col("of_caller").alias("component")).distinct()
    sinks = parts.join(left, [KEY, "component"], "left_anti")
    listed = sinks.groupBy(KEY, "component").agg(F.array_sort(F.collect_list("node_key")).alias("members"))
    listed = listed.select(KEY, (F.row_number().over(W.partitionBy(KEY).orderBy("component")) - 1).alias("place"), "members")
    roots = stage(sinks.select(KEY, "node_key"), "roots")
    marked = seen.join(roots.withColumn("root", F.lit(True)), [KEY, "node_key"], "left").withColumn("selected_root_seed", F.coalesce("root", F.lit(False)))
    marked = marked.withColumn("trace_terminal", F.size("downstream") == 0).withColumn("upstream_adapter", ~F.col("selected_root_seed")).drop("root")

    scored = None if issues is None else stage(callgraph.anchor_frames(f, issues), "anchors")

    def walked(seeds: DataFrame, prefix: str) -> DataFrame:
        n = callgraph.node_table(f, callgraph.reward_starts(f, seeds, issues, scored), seeds)
        zero, top = F.count_if(F.col("rewardable") & (F.col("raw_hop_distance") == 0)), F.max("hop_max")
        return n.groupBy(KEY).agg(zero.alias(f"{prefix}distance_zero_node_count"), top.alias(f"{prefix}hop_max"))

    adapters = marked.groupBy(KEY).agg(F.countDistinct("node_key").alias("patched"), F.countDistinct(F.when(F.col("upstream_adapter"), F.col("node_key"))).alias("upstream_adapters"))
    return RootSelection(marked, listed, edges, adapters.join(walked(nodes, "legacy_"), KEY).join(walked(roots, ""), KEY))


def start_records(frames: DataFrame, starts: DataFrame, issues: DataFrame) -> DataFrame:
    """``starts`` (``callgraph.reward_starts``) with their source, the anchor's node, and the candidates of the issue that match its frame, in their order.

    Distinct frames are compared with the candidates of their own issue alone.
    """
    f = callgraph.prepared(frames).select(KEY, "trace_idx", F.col("frame_idx").alias("start_idx"), F.col("node_key").alias("anchor_key"), F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce(F.nullif("qualified_name", F.lit("")), "func_name", F.lit("")).alias("own"))
    chosen = stage(starts.join(f, [KEY, "trace_idx", "start_idx"], "left"), "starts")
    met = anchors.scored_pairs(chosen.where("start_idx is not null").select(KEY, "path", "own"), anchors.candidates(issues))
    item = F.struct("place", "kind", "raw", "value", "file_path", "qualified_name", "name", "score")
    matched = met.groupBy(KEY, "path", "own").agg(F.array_sort(F.collect_list(item)).alias("matched"))
    none = F.array().cast(matched.schema["matched"].dataType)
    out = chosen.join(matched, [KEY, "path", "own"], "left").withColumn("matched", F.coalesce("matched", none))
    source = F.when(F.col("start_idx").isNull(), "test_filtered_fallback").otherwise("issue_anchor").alias("reward_start_source")
    return out.select(KEY, "trace_idx", "root_key", "root_idx", source, "start_idx", "anchor_key", "matched")
