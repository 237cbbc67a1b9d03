"""The evaluation cache: tables of experiments, cells, raw rollouts and metrics, as versions of Parquet tables.

A cell is keyed by experiment, provider, model, dataset and instance; its number is a hash of the key. Every change is a join
of the table with the new rows; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rate
from ..operators.upsert import upsert

#: Tables and their columns; the version of the layout.
SCHEMA_VERSION = 1
TABLES = {
    "schema_migrations": "version int, applied_at string",
    "experiments": "experiment_id string, provider_source string, dataset string, config_snapshot string, created_at string, updated_at string",
    "run_cells": "id long, experiment_id string, provider_source string, model_api_name string, model_label string, dataset string, instance_id string, status string, attempts long, run_id string, artifact_rollouts string, artifact_details string, started_at string, ended_at string, error string, created_at string, updated_at string",
    "raw_rollouts": "run_id string, cell_id long, messages_json string, trajectory_json string, step_traces_json string, final_response string, reward_json string, resolved int, token_usage_json string, cache_metrics_json string, rollout_json string, created_at string",
    "quantitative_metrics": "cell_id long, reward double, resolved int, p2a_read int, call_graph_hit int, ground_truth_hit int, near_hit int, min_distance double, turns int, tool_calls int, wall_time double, input_tokens double, output_tokens double, reasoning_tokens double, cache_hit_tokens double, cache_write_tokens double, cost double, metrics_json string, updated_at string",
}
KEY = ["experiment_id", "provider_source", "model_api_name", "dataset", "instance_id"]
PRIMARY = {"schema_migrations": ["version"], "experiments": ["experiment_id", "provider_source", "dataset"], "run_cells": KEY, "raw_rollouts": ["run_id"], "quantitative_metrics": ["cell_id"]}
USAGE = ("input_tokens", "output_tokens", "reasoning_tokens", "cache_hit_tokens", "cache_write_tokens", "cost")


def create(spark: SparkSession, now: str) -> dict[str, DataFrame]:
    """Empty tables, with a stamp of the layout's version."""
    out = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    out["schema_migrations"] = spark.createDataFrame([(SCHEMA_VERSION, now)], TABLES["schema_migrations"])
    return out


def violations(name: str, table: DataFrame) -> DataFrame:
    """Keys of a table that are null or occur more than once, with their number of rows."""
    keys = PRIMARY[name]
    null = " or ".join(f"{k} is null" for k in keys)
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where(f"n > 1 or {null}")


def cell_number(*keys: Column | str) -> Column:
    return F.xxhash64(*(keys or KEY))


def upsert_experiments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshot and updated_at of the new rows; created_at of the old ones where there are."""
    return upsert(old, new, PRIMARY["experiments"], keep_old=["created_at"])


def plan_cells(cells: DataFrame, planned: DataFrame, now: str) -> DataFrame:
    """``cells`` with the ``planned`` ones (key and model_label): new ones are pending, known ones take the label and the time alone.

    This also gets or creates a cell: the number is a hash of the key.
    """
    new = planned.select(*KEY, "model_label").dropDuplicates(KEY).withColumn("_new", F.lit(True))
    j = cells.withColumn("_old", F.lit(True)).withColumnRenamed("model_label", "_label").join(new, KEY, "full")
    fresh = F.col("_old").isNull()
    touched = F.coalesce("_new", F.lit(False))
    values = {
        "id": F.coalesce("id", cell_number()), "model_label": F.coalesce("model_label", "_label"), "status": F.when(fresh, "pending").otherwise(F.col("status")), "attempts": F.when(fresh, 0).otherwise(F.col("attempts")),
        "created_at": F.when(fresh, now).otherwise(F.col("created_at")), "updated_at": F.when(touched, now).otherwise(F.col("updated_at")),
    }
    return j.withColumns(values).select(*cells.columns)


def completed_instances(cells: DataFrame, **where: str) -> DataFrame:
    """Distinct instance_id of the finished cells that have the given values."""
    return _filtered(cells, where).where("status = 'done'").select("instance_id").distinct()


def _filtered(cells: DataFrame, where: dict[str, str | None]) -> DataFrame:
    """Rows with the given values; a value of None or an empty one asks for nothing."""
    for name, value in where.items():
        if value:
            cells = cells.where(F.col(name) == value)
    return cells


def mark_missing(cells: DataFrame, ids: DataFrame, error: str, now: str) -> DataFrame:
    """Cells of ``ids`` (key) that are not done become errors with the last 4,000 characters of the text."""
    hit = cells.join(ids.select(*KEY).distinct().withColumn("_hit", F.lit(True)), KEY, "left")
    go = F.coalesce("_hit", F.lit(False)) & (F.col("status") != "done")
    values = {"status": F.lit("error"), "error": F.lit(error[-4000:]), "ended_at": F.lit(now), "updated_at": F.lit(now)}
    return hit.withColumns({k: F.when(go, v).otherwise(F.col(k)) for k, v in values.items()}).select(*cells.columns)


def number(raw: Column, path: str) -> Column:
    """The number at a path of a JSON text; null for booleans, strings and other types."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(raw), path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.get_json_object(raw, path).try_cast("double"))


def flag(c: Column) -> Column:
    """1 or 0 of a boolean or a count; null stays null."""
    return F.when(c.isNotNull(), (c.cast("double") != 0).cast("int"))


def reward_number(raw: Column) -> Column:
    """A record's reward: a number, or 1 and 0 for a boolean; null for all else."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(raw), "$.reward", "variant"))
    return F.when(kind == "BOOLEAN", F.get_json_object(raw, "$.reward").try_cast("boolean").cast("double")).otherwise(number(raw, "$.reward"))


def tool_call_count(steps: Column) -> Column:
    """Tool calls over an array of steps in JSON; a step without a list of them has none."""
    calls = lambda s: F.coalesce(F.json_array_length(F.get_json_object(s, "$.tool_calls")), F.lit(0))
    return F.aggregate(F.coalesce(steps, F.array().cast("array<string>")), F.lit(0), lambda a, s: a + calls(s))


def last_details(details: DataFrame) -> DataFrame:
    """Of each instance's details (with ``ingest_order``) the last one; those without an id are left out."""
    cols = [c for c in details.columns if c not in ("instance_id", "ingest_order")]
    rows = details.where("coalesce(instance_id, '') <> ''")
    return rows.groupBy("instance_id").agg(F.max_by(F.struct(*cols), "ingest_order").alias("d")).select("instance_id", "d.*")


def ingest(cells: DataFrame, rollouts: DataFrame, metrics: DataFrame, runs: DataFrame, details: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New versions of the three tables after a batch of runs; cells that are not known are created.

    ``runs``: the key, model_label, raw (a rollout record in JSON), ingest_order, artifact_rollouts, artifact_details.
    ``details``: instance_id, ingest_order, n_reads, hit_call_graph, hit_ground_truth, hit_near, min_distance. A cell's
    attempts grow by its runs; the last run sets the rest. A raw rollout goes if its cell or its run_id comes again.
    """
    cells = plan_cells(cells, runs, now)
    text = lambda p: F.nullif(F.get_json_object("raw", p), F.lit(""))
    named = runs.withColumn("cell_id", cell_number()).withColumn("run_id", F.coalesce(text("$.run_id"), F.concat_ws(":", *KEY))).withColumn("error", text("$.error"))
    last = named.groupBy("cell_id").agg(F.count("*").alias("_n"), F.max_by(F.struct("run_id", "error", "artifact_rollouts", "artifact_details", "raw", "instance_id"), "ingest_order").alias("r"))
    j = cells.join(last.select(F.col("cell_id").alias("id"), "_n", "r"), "id", "left")
    hit = F.col("_n").isNotNull()
    values = {"status": F.when(F.col("r.error").isNull(), "done").otherwise("error"), "attempts": F.col("attempts") + F.col("_n"), "run_id": F.col("r.run_id"), "artifact_rollouts": F.col("r.artifact_rollouts"), "artifact_details": F.col("r.artifact_details"), "ended_at": F.lit(now), "error": F.col("r.error"), "updated_at": F.lit(now)}
    new_cells = j.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()}).select(*cells.columns)

    j = lambda p, empty: F.coalesce(F.get_json_object("raw", p), F.lit(empty))
    rows = last.select("cell_id", "r.*")
    resolved = flag(F.get_json_object("raw", "$.resolved").try_cast("boolean").cast("int"))
    new_raw = rows.select("run_id", "cell_id", j("$.messages", "[]").alias("messages_json"), j("$.trajectory", "[]").alias("trajectory_json"), j("$.p2a_step_traces", "[]").alias("step_traces_json"), j("$.response_text", "").alias("final_response"), F.get_json_object("raw", "$.reward").alias("reward_json"), resolved.alias("resolved"), j("$.token_usage", "{}").alias("token_usage_json"), j("$.metrics", "{}").alias("cache_metrics_json"), F.col("raw").alias("rollout_json"), F.lit(now).alias("created_at"))
    kept = rollouts.join(new_raw.select("cell_id"), "cell_id", "left_anti").join(named.select("run_id").distinct(), "run_id", "left_anti").select(*rollouts.columns)
    new_rollouts = kept.unionByName(new_raw)

    lists = [F.from_json(F.get_json_object("raw", p), "array<string>") for p in ("$.p2a_step_traces", "$.trajectory")]
    steps = F.when(F.size(lists[0]) > 0, lists[0]).otherwise(F.coalesce(lists[1], lists[0]))
    wall = F.coalesce(F.nullif(number(F.col("raw"), "$.wall_time"), F.lit(0.0)), number(F.col("raw"), "$.execution_time"))
    usage = [number(F.col("raw"), f"$.token_usage.{c}").alias(c) for c in USAGE]
    m = rows.join(last_details(details), "instance_id", "left").withColumn("_detail", F.to_json(F.struct("n_reads", "hit_call_graph", "hit_ground_truth", "hit_near", "min_distance")))
    blob = F.concat(F.lit('{"cache_metrics":'), j("$.metrics", "{}"), F.lit(',"detail":'), F.col("_detail"), F.lit(',"token_usage":'), j("$.token_usage", "{}"), F.lit("}"))
    new_metrics = m.select("cell_id", reward_number(F.col("raw")).alias("reward"), resolved.alias("resolved"), flag(F.col("n_reads")).alias("p2a_read"), flag(F.col("hit_call_graph").cast("int")).alias("call_graph_hit"), flag(F.col("hit_ground_truth").cast("int")).alias("ground_truth_hit"), flag(F.col("hit_near").cast("int")).alias("near_hit"), F.col("min_distance").cast("double").alias("min_distance"), F.coalesce(F.size(steps), F.lit(0)).alias("turns"), tool_call_count(lists[0]).alias("tool_calls"), wall.alias("wall_time"), *usage, blob.alias("metrics_json"), F.lit(now).alias("updated_at"))
    return new_cells, new_rollouts, upsert(metrics, new_metrics, ["cell_id"])


#: The five keys of a model's row, and the columns that are averaged over its finished cells.
GROUP = ["experiment_id", "provider_source", "dataset", "model_api_name", "model_label"]
MEANS = {"resolved_rate": "resolved", "reward_rate": "reward", "p2a_read_rate": "p2a_read", "call_graph_hit_rate": "call_graph_hit", "ground_truth_hit_rate": "ground_truth_hit", "near_hit_rate": "near_hit", "avg_min_distance": "min_distance", "avg_turns": "turns", "avg_tool_calls": "tool_calls", "avg_wall_time": "wall_time", "avg_input_tokens": "input_tokens", "avg_output_tokens": "output_tokens", "avg_reasoning_tokens": "reasoning_tokens"}


def model_metrics(cells: DataFrame, metrics: DataFrame, *, experiment_id: str | None = None, provider_source: str | None = None, dataset: str | None = None) -> DataFrame:
    """One row for each model of an experiment, by label: cells by status, means over finished cells with turns, ratios of summed tokens, cost.

    Null values are left out of means; a ratio is null where its own tokens sum to zero; the cost is null without finished cells.
    """
    rows = _filtered(cells, {"experiment_id": experiment_id, "provider_source": provider_source, "dataset": dataset}).join(metrics.withColumnRenamed("cell_id", "id"), "id", "left")
    used = (F.col("status") == "done") & F.col("turns").isNotNull()
    total = lambda c: F.sum(F.when(used, F.coalesce(c, F.lit(0.0))))
    share = lambda c: rate(F.nullif(total(c), F.lit(0.0)), total("input_tokens") + total(c))
    status = lambda *s: F.count_if(F.col("status").isin(*s))
    means = [F.avg(F.when(used, F.col(c))).alias(k) for k, c in MEANS.items()]
    return rows.groupBy(*GROUP).agg(F.count("*").alias("target"), status("done").alias("done"), status("error").alias("errors"), status("pending", "running").alias("pending"), *means, share("cache_hit_tokens").alias("cache_hit_rate"), share("cache_write_tokens").alias("cache_write_rate"), total("cost").alias("total_cost")).orderBy("model_label")


def ranked(metrics: DataFrame) -> DataFrame:
    """Models by resolved rate, then by ground-truth hits, nulls last, then by label."""
    return metrics.orderBy(F.desc_nulls_last("resolved_rate"), F.desc_nulls_last("ground_truth_hit_rate"), "model_label")


def placed(instances: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` instances by ``order``, with ``place``. Partitions keep their own first ones, and only those are put in order together."""
    return instances.orderBy(order).limit(limit).withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)) - 1)


def planned_runs(models: DataFrame, instances: DataFrame, cells: DataFrame, limit: int | None) -> DataFrame:
    """The cells that a batch still has to run, by phase: one instance of each model first (smoke), then up to ``limit`` of them (full).

    ``models``: experiment_id, provider_source, model_api_name, model_label, dataset. ``instances``: dataset, instance_id,
    place (their order). Finished cells are left out; a limit of None means all.
    """
    done = cells.where("status = 'done'").select(*KEY)
    plan = models.join(instances, "dataset")
    if limit is not None:
        plan = plan.where(F.col("place") < limit)
        # At most ``limit`` rows for each model: the cells are met by them, not the other way round.
        done = done.join(F.broadcast(plan.select(*KEY)), KEY, "left_semi")
    open_ = plan.join(done, KEY, "left_anti")
    return open_.withColumn("phase", F.when(F.col("place") == 0, "smoke").otherwise("full")).select("phase", *KEY, "model_label", "place")
