"""How an instance is classed from what its test runs showed, and the build of task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Failures worth another try; their stored maps count as missing.
RETRYABLE = ("precompute_failed", "exception", "error")


def case_type(evidence: DataFrame) -> DataFrame:
    """``evidence`` with case_type and reason_code; the first rule that holds decides.

    Columns: n_callables, n_new_callables, state_matches, n_instrumented, exit_code, f2p_failed, zero_tests,
    signature_error, n_traces, n_patched_traces, n_f2p_traces, cap_reached, max_rewardable_distance, exception. Nulls count as false or zero.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    code = F.when(b("zero_tests"), 5).when(b("f2p_failed"), 1).otherwise(n("exit_code"))
    rules: list[tuple[Column, str, str]] = [
        (F.col("exception").isNotNull(), "precompute_failed", "exception"),
        ((n("n_callables") == 0) & (n("n_new_callables") > 0), "newly_created", "newly_created"),
        (n("n_callables") == 0, "no_callable", "no_callable"),
        (~F.coalesce("state_matches", F.lit(True)), "no_trace", "sandbox_code_state_mismatch"),
        (n("n_instrumented") == 0, "instrumentation_failed", "instrumentation_empty"),
        ((code == 0) & (n("n_patched_traces") == 0) & (n("n_traces") > 0), "all_pass", "all_pass"),
        ((n("n_traces") == 0) & b("signature_error"), "signature_mismatch", "signature_mismatch"),
        ((n("n_traces") == 0) & (code == 0), "no_trace", "f2p_collection_missing"),
        (n("n_traces") == 0, "no_trace", "no_trace_exit_one"),
        (n("n_patched_traces") == 0, "no_gt", "no_gt"),
        ((n("n_f2p_traces") == 0) & b("cap_reached"), "trace_cap_inconclusive", "trace_event_cap_no_f2p_inconclusive"),
        (n("n_f2p_traces") == 0, "no_f2p", "no_f2p"),
        (F.coalesce("max_rewardable_distance", F.lit(0.0)) > 0, "standard", "standard"),
    ]
    kind, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for rule, k, r in rules[1:]:
        kind, reason = kind.when(rule, k), reason.when(rule, r)
    return evidence.withColumn("case_type", kind.otherwise("direct")).withColumn("reason_code", reason.otherwise("direct")).withColumn("exit_code", code)


def is_complete(case: Column, reason: Column) -> Column:
    """Whether a stored map needs no other run."""
    return case.isNotNull() & ~case.isin(*RETRYABLE) & ~F.coalesce(reason.isin(*RETRYABLE), F.lit(False))


def to_build(tasks: DataFrame, skips: DataFrame, maps: DataFrame, key: str = "instance_id") -> DataFrame:
    """Tasks that are neither skipped nor have a complete map."""
    done = maps.where(is_complete(F.col("case_type"), F.col("reason_code"))).select(key).distinct()
    return tasks.join(skips.select(key).distinct(), key, "left_anti").join(done, key, "left_anti")


def static_map(callables: DataFrame) -> DataFrame:
    """Nodes of a map without a run: every patched callable is a root at distance 0."""
    return callables.select("instance_id", F.concat_ws("::", "file_path", "qualified_name").alias("node_key"), "file_path", "start_line", "end_line", F.lit(0).alias("hop_distance"), F.lit(0.0).alias("normalized_distance"), F.lit(True).alias("rewardable"), F.lit("root_cause").alias("node_role"))


def failed_then_passed(buggy: DataFrame, fixed: DataFrame) -> DataFrame:
    """Tests (instance_id, test) that failed before the patch and passed behind it."""
    return buggy.where("status in ('FAILED', 'ERROR')").select("instance_id", "test").intersect(fixed.where("status = 'PASSED'").select("instance_id", "test"))


def selector_found(line: Column, selector: Column) -> Column:
    """Whether a line names a test selector at its first occurrence, not as part of a longer name."""
    at = F.locate(selector, line) if isinstance(selector, str) else F.instr(line, selector)
    after = F.substring(line, at + F.length(selector), F.lit(1))
    return (at > 0) & ~after.rlike(r"^[\w]")


def token_usage(calls: DataFrame, key: str = "run_id") -> DataFrame:
    """Sums of a run's tokens, under either name of input and output counts, and of its cost."""
    total = lambda *names: F.sum(F.coalesce(*[F.col(n) for n in names], F.lit(0)))
    return calls.groupBy(key).agg(total("input_tokens", "prompt_tokens").alias("input_tokens"), total("output_tokens", "completion_tokens").alias("output_tokens"), total("cache_hit_tokens").alias("cache_hit_tokens"), total("cost").alias("cost"))


def own_sources(callables: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """``callables`` (keys, qualified_name, start_line, end_line, source ...) with ``own``: their lines without those of callables inside them.

    A callable is inside another of its file if it starts after it and does not end after it. The ranges of a file are gathered
    once, in order, and those inside are taken out of the text line by line. Of equal names in a file the one that starts last counts.
    Tables without ranges have whole sources as their own.
    """
    if not {"start_line", "end_line"} <= set(callables.columns):
        return callables.withColumn("own", F.col("source"))
    last = F.max(F.struct("start_line", "end_line", *[c for c in callables.columns if c not in (*keys, "qualified_name", "start_line", "end_line")])).alias("c")
    one = callables.groupBy(*keys, "qualified_name").agg(last).select(*keys, "qualified_name", "c.*")
    ranges = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("_all"))
    inside = F.filter("_all", lambda r: (r["start_line"] > F.col("start_line")) & (r["end_line"] <= F.col("end_line")))
    out = one.join(ranges, list(keys)).withColumn("_inner", inside)
    at = lambda i: F.col("start_line") + i
    lines = F.filter(F.split("source", "\n"), lambda x, i: ~F.exists("_inner", lambda r: at(i).between(r["start_line"], r["end_line"])))
    return out.withColumn("own", F.array_join(lines, "\n")).select(*callables.columns, "own")


def modified_callables(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Callables of the old version that the new one has, too, with other lines of their own: a change inside an inner callable is that one's alone."""
    other = own_sources(new, keys).select(*keys, "qualified_name", F.col("own").alias("_new"))
    return own_sources(old, keys).join(other, [*keys, "qualified_name"]).where(~F.equal_null("own", "_new")).select(*old.columns)


def new_callables(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("file_path", "qualified_name").distinct(), ["file_path", "qualified_name"], "left_anti")
