"""Scans of rollout dumps and the sinks that write them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import objects
from ..functions.objects import ID_KEYS, STEP_LISTS, STEP_NAMES, let
from ..functions.steps import is_object, items_of, kind_of, nested

#: Keys under which a record list may stand, and objects that may carry a record's fields.
ENVELOPES = ("records", "rollouts", "data", "items", "samples")
CONTAINERS = ("", "extra_fields", "extra_info", "metadata")


def unwrap(raw: Column) -> Column:
    """Records of one JSON value, as an array of JSON texts: a list's items, those of the first envelope that holds a list, or itself."""
    items = lambda v: F.from_json(v, "array<string>", {"mode": "PERMISSIVE"})
    inner = F.coalesce(*[F.when(F.trim(F.get_json_object(raw, f"$.{k}")).startswith("["), items(F.get_json_object(raw, f"$.{k}"))) for k in ENVELOPES])
    out = F.when(F.trim(raw).startswith("["), items(raw)).otherwise(F.coalesce(inner, F.array(raw)))
    return F.filter(out, lambda x: F.trim(x).startswith("{"))


def numbered_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, line, value) of the text files under a path whose names match, blank lines too; lines are numbered from 1 in each file.

    A split of a file has its lines in a row. They are counted first, split by split, which reads the files but parses nothing;
    a line's number is its place in its split and the lines of the splits before, of which there is one small row each.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = rows.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.select("file", "_split", "_first", before.alias("_before")), ["file", "_split"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), "value")


def scan_records(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """(file, line, place, raw) of the .jsonl and .json files under a path; a bad JSONL line stops the scan if ``strict``, named by path and number.

    Records stay JSON text; callers project what they need. ``line`` counts from 1 in a JSONL file and is 0 in a JSON file;
    ``in_order`` sorts by file, line and place.
    """
    lines = numbered_lines(spark, path, "*.[jJ][sS][oO][nN][lL]").where(F.trim("value") != "")
    ok = F.expr("try_parse_json(value) is not null")
    if strict:
        name = F.regexp_replace("file", "^file:/+", "/")
        lines = lines.withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(name, F.lit(":"), F.col("line").cast("string"), F.lit(": malformed JSONL: "), F.substring("value", 1, 80)))))
    else:
        lines = lines.where(ok)
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("line"), "value")
    return lines.unionByName(whole).select("file", "line", F.posexplode(unwrap(F.col("value"))).alias("place", "raw"))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, place, raw) of the Parquet files under a path, a row to a record, as ``scan_records`` gives them for JSON; none without such a file.

    ``line`` numbers a file's rows from 1, by the place that the reader gives them.
    """
    try:
        df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], "file string, line long, place int, raw string")
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.row_index") + 1).alias("line"), F.lit(0).alias("place"), raw.alias("raw"))


def scan(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Records of all files under a path, read as their suffix says: .parquet, .jsonl or .json, in any case; others are passed over."""
    return scan_records(spark, path, strict=strict).unionByName(scan_parquet(spark, path))


def in_order(records: DataFrame) -> DataFrame:
    """Records sorted by path, line and place: the order in which one reader would meet them."""
    return records.orderBy("file", "line", "place")


def text_at(raw: Column, path: str) -> Column:
    """The trimmed string at a dotted path; null for other types and for empty strings."""
    *outer, key = path.split(".")
    held = nested(raw, *outer)
    return F.when(kind_of(held, key) == "STRING", F.nullif(F.trim(nested(held, key)), F.lit("")))


def containers(raw: Column) -> list[Column]:
    """The record and the objects in it that may carry its fields."""
    return [raw if not c else nested(raw, c) for c in CONTAINERS]


def instance_id(raw: Column) -> Column:
    """The first id: under a key of the record (one with a double underscore, but for ``instance_id``), then in the objects below."""
    return let(objects.boxes(raw), id_in)


def id_in(boxes: Column) -> Column:
    """``instance_id`` of a record that is opened already."""
    own, fields, info, meta = (boxes[i] for i in range(4))
    others = F.filter(F.array(*[objects.text(own[k]) for k in ID_KEYS[1:]]), lambda v: v.contains("__"))
    below = [objects.text(b["instance_id"]) for b in (meta, fields, info)]
    rewards = [text_at(info["tools_kwargs"], "reward.metadata.instance_id"), text_at(own["tools_kwargs"], "reward.metadata.instance_id"), text_at(own["reward"], "metadata.instance_id")]
    found = F.concat(F.array(objects.text(own[ID_KEYS[0]])), others, F.array(*below, *rewards))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def data_source(raw: Column) -> Column:
    return let(objects.boxes(raw), source_in)


def source_in(boxes: Column) -> Column:
    return F.coalesce(*[objects.text(boxes[i]["data_source"]) for i in range(len(CONTAINERS))], F.lit("unknown"))


def run_step(raw: Column) -> Column:
    """The first finite number under a step name, container by container, cut to a whole one."""
    return let(objects.boxes(raw), step_in)


def step_in(boxes: Column) -> Column:
    found = F.array(*[objects.written(boxes[i][n]).try_cast("double") for i in range(len(CONTAINERS)) for n in STEP_NAMES])
    return F.get(F.filter(found, lambda x: ~F.isnan(x) & (F.abs(x) < 1e15)), F.lit(0)).cast("long")


def step_list(raw: Column) -> Column:
    """The record's steps as array<string>: of the first container that has a list of them, itself or one level down; else empty."""
    return let(objects.boxes(raw), steps_in)


def steps_in(boxes: Column) -> Column:
    listed = lambda c: F.when(F.ltrim(c).startswith("["), c)
    held = [boxes[i][STEP_LISTS[0]] for i in range(len(CONTAINERS))]
    return items_of(F.coalesce(*[x for h in held for x in (listed(h), *[F.when(is_object(h), listed(nested(h, k))) for k in STEP_LISTS])]))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_sidecar(sets: DataFrame, path: str, limit: int) -> None:
    """Trace sets (instance_id, and an array of traces for each set) cut to ``limit`` each, as gzip JSON.

    ``counts`` tells of each set how many traces there were, how many are kept and whether any was cut; a null set has none.
    """
    names = [c for c, kind in sets.dtypes if kind.startswith("array")]
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    counts = F.struct(*[F.struct(n(c).alias("total"), F.least(n(c), F.lit(limit)).alias("saved"), (n(c) > limit).alias("truncated")).alias(c) for c in names])
    out = sets.withColumn("counts", counts).withColumns({c: F.coalesce(F.slice(c, 1, limit), F.array().cast(sets.schema[c].dataType)) for c in names})
    out.write.mode("overwrite").option("compression", "gzip").json(path)


def write_with_skips(rows: DataFrame, skips: DataFrame, path: str, key: str = "instance_id") -> None:
    """The full table, and beside it the table without the skipped ids."""
    rows.write.mode("overwrite").parquet(f"{path}/full")
    rows.join(skips.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(f"{path}/filtered")
