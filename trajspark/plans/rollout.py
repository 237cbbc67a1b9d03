"""Rollout dumps: steps from interactions and token masks, records from rows and batches, usage, and the analysis of a dump.

Interactions and rows are JSON texts; what a column function returns is JSON or a typed array.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tasks
from ..functions.steps import nested
from ..functions.text import is_system_error

STEPS_KEY = "p2a_step_traces"  # fixed value: a name of the record format
STEP = "array<struct<step_idx:bigint,response:string,thought:string,tool_results:string,exit_reason:string>>"
#: Names under which providers report usage, and headers that win over them.
USAGE = {"input_tokens": ("prompt_tokens", "input_tokens"), "output_tokens": ("completion_tokens", "output_tokens"), "reasoning_tokens": ("reasoning_tokens",), "cache_hit_tokens": ("cache_hit_tokens", "cached_tokens"), "cache_write_tokens": ("cache_write_tokens",), "cost": ("cost",)}
HEADERS = {"prompt_tokens": "x-usage-prompt-tokens", "completion_tokens": "x-usage-completion-tokens", "cache_hit_tokens": "x-usage-cache-hit-tokens", "cache_write_tokens": "x-usage-cache-write-tokens", "cost": "x-usage-cost"}


def _list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def step_traces(interaction: Column) -> Column:
    """array<struct<step_idx, response_text, thought, tool_calls, tool_results, exit_reason>>: the i-th step with the i-th message of the assistant.

    The step's own response counts first, then the message's content; a step without a number takes its place, from 1 on.
    """
    said = F.filter(_list(F.get_json_object(interaction, "$.messages")), lambda m: F.get_json_object(m, "$.role") == "assistant")
    text = lambda c, f: F.nullif(F.get_json_object(c, f"$.{f}"), F.lit(""))

    def one(step: Column, i: Column) -> Column:
        message = F.get(said, i)
        return F.struct(
            F.coalesce(F.get_json_object(step, "$.step_idx").try_cast("bigint"), (i + 1).cast("bigint")).alias("step_idx"),
            F.coalesce(text(step, "response"), text(message, "content"), F.lit("")).alias("response_text"),
            F.coalesce(text(step, "thought"), F.lit("")).alias("thought"),
            F.coalesce(F.get_json_object(message, "$.tool_calls"), F.lit("[]")).alias("tool_calls"),
            F.coalesce(F.get_json_object(step, "$.tool_results"), F.lit("[]")).alias("tool_results"),
            F.get_json_object(step, "$.exit_reason").alias("exit_reason"),
        )

    return F.transform(_list(F.get_json_object(interaction, "$.trajectory")), one)


def spanned_traces(steps: Column, mask: Column) -> Column:
    """Steps (array<struct<step_idx, response, exit_reason, tool_calls>>) with a response, each with the next run of ones in a token mask.

    Steps beyond the last run are left out. ``parse_error`` says that a step which ended in a format error has no call.
    """
    starts = F.filter(F.transform(mask, lambda m, i: F.when((m != 0) & (F.coalesce(F.get(mask, i - 1), F.lit(0)) == 0), i)), lambda x: x.isNotNull())
    ends = F.filter(F.transform(mask, lambda m, i: F.when((m != 0) & (F.coalesce(F.get(mask, i + 1), F.lit(0)) == 0), i + 1)), lambda x: x.isNotNull())
    spoken = F.filter(steps, lambda s: F.coalesce(s["response"], F.lit("")) != "")

    def one(s: Column, i: Column) -> Column:
        error = F.when((F.coalesce(F.json_array_length(s["tool_calls"]), F.lit(0)) == 0) & (s["exit_reason"] == "format_error"), "No function call found in the response.")
        return F.struct(F.coalesce(s["step_idx"], i + 1).alias("step_idx"), F.get(starts, i).alias("response_start"), F.get(ends, i).alias("response_end"), F.coalesce(s["tool_calls"], F.lit("[]")).alias("tool_calls"), error.alias("parse_error"))

    return F.transform(F.slice(spoken, F.lit(1), F.size(starts)), one)


def dump_records(rows: DataFrame, schema_version: str = "rollout_v1") -> DataFrame:
    """Rollout records: ``rows`` have row (a task in JSON), interaction, run_id, model, base_url, reward, reward_details, error, error_kind, error_stage.

    Reward, details and extra info stay JSON text. A run without steps ended by its error, or for an unknown reason.
    """
    r, i = F.col("row"), F.col("interaction")
    traces = step_traces(i)
    last = F.get_json_object(F.element_at(F.col("_trajectory"), -1), "$.exit_reason")
    resolved = F.when(F.ltrim("reward_details").startswith("{"), F.coalesce(F.get_json_object("reward_details", "$.resolved").try_cast("boolean"), F.lit(False)))
    known = F.from_json(F.coalesce(tasks.extra_info(r), F.lit("{}")), "map<string,string>")
    extra = F.map_concat(F.map_filter(F.create_map(F.lit("instance_id"), tasks.row_instance_id(r), F.lit("data_source"), tasks.row_data_source(r)), lambda k, v: v.isNotNull() & ~F.map_contains_key(known, k)), known)
    out = rows.withColumn("_trajectory", _list(F.get_json_object(i, "$.trajectory"))).withColumn(STEPS_KEY, traces)
    return out.select(
        F.lit(schema_version).alias("schema_version"), "run_id", tasks.row_instance_id(r).alias("instance_id"), tasks.row_data_source(r).alias("data_source"), "model", "base_url",
        F.coalesce(F.get_json_object(i, "$.messages"), F.lit("[]")).alias("messages"), F.coalesce(F.get_json_object(i, "$.trajectory"), F.lit("[]")).alias("trajectory"), STEPS_KEY,
        F.array_join(F.filter(F.transform(STEPS_KEY, lambda s: s["response_text"]), lambda t: t != ""), "\n").alias("response_text"), "reward", "reward_details", resolved.alias("resolved"),
        F.when(F.size("_trajectory") > 0, last).when(F.coalesce("error", F.lit("")) != "", "error").otherwise("unknown").alias("termination_reason"), F.get_json_object(i, "$.execution_time").try_cast("double").alias("execution_time"),
        F.coalesce(F.get_json_object(i, "$.rollout_cache.metrics"), F.lit("{}")).alias("metrics"), F.coalesce(F.get_json_object(i, "$.rollout_cache.token_usage"), F.lit("{}")).alias("token_usage"), F.to_json(extra).alias("extra_info"),
        "error", "error_kind", "error_stage", F.coalesce(is_system_error(F.col("error_kind")), F.lit(False)).alias("system_error"),
    )


def batch_records(batch: DataFrame) -> DataFrame:
    """Records of a validation batch: ``batch`` has record_index, uid, instance_id, data_source, response_text, output_text, step_traces, extra_fields, extra_info (JSON), score.

    Ids of ``uid`` count with a double underscore only; sources and steps are those of the row, of its extra fields, or of its
    extra info. Both objects take the id and the source where they lack them.
    """
    fields, info = F.coalesce("extra_fields", F.lit("{}")), F.coalesce("extra_info", F.lit("{}"))
    text = lambda c, *p: F.nullif(nested(c, *p), F.lit(""))
    own = F.nullif("instance_id", F.lit(""))
    iid = F.coalesce(own, F.when(F.col("uid").contains("__"), F.col("uid")), text(fields, "instance_id"), text(info, "instance_id"), text(info, "tools_kwargs", "reward", "metadata", "instance_id"))
    source = F.coalesce(F.nullif("data_source", F.lit("")), text(fields, "data_source"), text(info, "data_source"), F.lit("unknown"))
    steps = F.coalesce("step_traces", nested(fields, STEPS_KEY), nested(info, STEPS_KEY))

    def completed(c: Column) -> Column:
        held = F.from_json(c, "map<string,string>")
        return F.to_json(F.map_concat(held, F.map_filter(F.create_map(F.lit("instance_id"), iid, F.lit("data_source"), source), lambda k, v: v.isNotNull() & ~F.map_contains_key(held, k))))

    return batch.select("record_index", "uid", iid.alias("instance_id"), source.alias("data_source"), F.coalesce(F.nullif("response_text", F.lit("")), "output_text").alias("response_text"), steps.alias(STEPS_KEY), completed(fields).alias("extra_fields"), completed(info).alias("extra_info"), "score")


def response_usage(payload: Column, headers: Column) -> Column:
    """struct of token counts and cost of a provider's answer: cost info wins over usage, headers (map) over both; the first alias with a number counts, else 0."""

    def found(name: str) -> Column:
        options = [F.get_json_object(payload, f"$.{box}.{name}") for box in ("cost_info", "usage")]
        if name in HEADERS:
            options = [F.try_element_at(headers, F.lit(HEADERS[name])), *options]
        return F.coalesce(*[o.try_cast("double") for o in options])

    return F.struct(*[F.coalesce(*[found(n) for n in names], F.lit(0.0)).alias(k) for k, names in USAGE.items()])


def merged_tool_messages(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``messages`` (key, order, role, text) in which tool messages that follow each other become one: texts joined by newlines, at the first one's place."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(order)
    new = ~((F.col("role") == "tool") & (F.lag("role").over(w) == "tool"))
    runs = messages.withColumn("_run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = runs.groupBy(key, "_run").agg(F.min(order).alias(order), F.min_by("role", order).alias("role"), F.array_sort(F.collect_list(F.struct(order, "text"))).alias("t"))
    return joined.select(key, order, "role", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def system_error_summary(records: DataFrame) -> DataFrame:
    """(n_records, error_kinds, error_stages, example_error), one row if every record is a system error, none otherwise.

    ``records``: error, error_kind, error_stage, system_error, record_index. Kinds and stages are maps of counts.
    """
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    bad = (F.coalesce("error", F.lit("")) != "") & (F.coalesce("system_error", F.lit(False)) | F.coalesce(is_system_error(F.col("error_kind")), F.lit(False)))
    per = records.groupBy(known("error_kind").alias("kind"), known("error_stage").alias("stage")).agg(F.count("*").alias("n"), F.count_if(~bad).alias("fine"), F.min_by("error", "record_index").alias("e"), F.min("record_index").alias("at"))
    # As many rows as kinds and stages.
    rows = per.agg(F.sum("n").alias("n_records"), F.sum("fine").alias("fine"), F.collect_list(F.struct("kind", "n")).alias("k"), F.collect_list(F.struct("stage", "n")).alias("s"), F.substring(F.min_by("e", "at"), 1, 500).alias("example_error"))

    def counts(c: str, name: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(c, lambda x: x[name])))
        return F.map_from_arrays(names, F.transform(names, lambda v: F.aggregate(F.filter(c, lambda x: x[name] == v), F.lit(0).cast("long"), lambda a, x: a + x["n"])))

    return rows.where("n_records > 0 and fine = 0").select("n_records", counts("k", "kind").alias("error_kinds"), counts("s", "stage").alias("error_stages"), "example_error")


def write_analysis(details: DataFrame, folder: str, *, config: dict | None = None, show: bool = False) -> dict:
    """Details as JSON lines, and a summary and a report beside them; the summary is one row, is returned, and printed as JSON with ``show``."""
    from .report import markdown
    from .summary import by_case_type, summarize

    details.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/details")
    summary = summarize(details)
    out = {"config": config or {}, "summary": summary.first().asDict(), "by_case_type": [r.asDict() for r in by_case_type(details).collect()]}
    spark = details.sparkSession
    if show:
        print(json.dumps(out, default=str, indent=2))
    spark.createDataFrame([(json.dumps(out, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    spark.createDataFrame([(markdown(summary, details),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")
    return out


def write_maps(results: DataFrame, folder: str) -> None:
    """One JSON file folder for each instance; results that are worth another try leave none, and an older one goes."""
    from .casetype import is_complete

    done = results.where(is_complete(F.col("case_type"), F.col("reason_code")))
    done.repartition("instance_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instance_id").json(folder)
    retry = results.where(~is_complete(F.col("case_type"), F.col("reason_code"))).select("instance_id").distinct()
    for row in retry.toLocalIterator():
        path = results.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/instance_id={row.instance_id}")
        path.getFileSystem(results.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def load_config(path: str | Path | None, defaults: dict) -> dict:
    """A YAML mapping laid over the defaults, mappings within mappings merged."""
    import yaml

    held = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {} if path else {}
    if not isinstance(held, dict):
        raise ValueError(f"{path} must contain a YAML mapping")
    return deep_merge(defaults, held)


def deep_merge(base: dict, over: dict) -> dict:
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def parse_limit(value: str | int | None, default: int | None = None) -> int | None:
    """A number of rows; ``all`` asks for no limit; None for the default."""
    if value is None:
        return default
    if isinstance(value, str) and value.lower() == "all":
        return None
    try:
        limit = int(value)
    except ValueError as e:
        raise ValueError("a limit is a non-negative integer or 'all'") from e
    if limit < 0:
        raise ValueError("a limit is a non-negative integer or 'all'")
    return limit


def env_int(raw: str | None, default: int | None, minimum: int | None = None) -> int | None:
    """A whole number from the environment; the default where it is unset, malformed or too small."""
    try:
        value = int(raw) if raw is not None else None
    except ValueError:
        return default
    return default if value is None or minimum is not None and value < minimum else value
