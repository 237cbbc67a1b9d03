"""The registry of skipped instances, results of gates, and tables that come from files of several kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import scan_parquet  # noqa: F401  also found here

ENTRY = "id string, repo string, reason string, source string, evidence string"
GATE = "instance_id string, gate_pass boolean, error string, buggy_shim struct<n_parsed:bigint,resolved:boolean>, fixed struct<n_parsed:bigint,resolved:boolean>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def skip_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries (id, repo, reason, source, evidence) of a registry in JSON; a missing file is an empty registry."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(f"skip array<struct<{ENTRY.replace(' string', ':string')}>>").json(path, multiLine=True).select(F.explode("skip").alias("s")).select("s.*")


def skip_ids(registry: DataFrame) -> DataFrame:
    return registry.where("id <> ''").select("id").distinct()


def gate_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Results of gates from JSON lines, in order; lines without an id are left out. Files are told apart by ``file``."""
    rows = spark.read.schema(GATE).json(list(paths)).withColumn("file", F.col("_metadata.file_path")).withColumn("line", F.monotonically_increasing_id())
    return rows.where("instance_id <> ''")


def fail_reason(error: Column, buggy: Column, fixed: Column) -> Column:
    """Why a gate failed, by ordered rules; the names are fixed values."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "gate_error")
        .when((buggy["n_parsed"] == 0) | (fixed["n_parsed"] == 0), "collection_failed_zero_tests")
        .when(buggy["resolved"], "buggy_did_not_fail_f2p")
        .when(~fixed["resolved"], "fixed_did_not_pass_p2p")
        .otherwise("f2p_p2p_mismatch")
    )


def merge_gates(registry: DataFrame, gates: DataFrame, source: str, *, evidence: str | None = None, drop_passed_seeds: bool = False, expected: int = 0) -> DataFrame:
    """The registry after gates: failures replace entries by id; report seeds that pass go, if asked for and the gates cover enough instances. Sorted by repo and id.

    The last failure of an id counts; an id may both pass and fail, and is then a failure.
    """
    failed = gates.where("not coalesce(gate_pass, false)").groupBy("instance_id").agg(F.max_by(fail_reason(F.col("error"), F.col("buggy_shim"), F.col("fixed")), F.struct("file", "line")).alias("reason"))
    failed = failed.select(F.col("instance_id").alias("id"), F.substring_index("instance_id", "__", 1).alias("repo"), "reason", F.lit(source).alias("source"), F.lit(evidence).cast("string").alias("evidence"))
    passed = gates.where("gate_pass").select(F.col("instance_id").alias("id")).distinct()
    kept = registry.join(failed.select("id"), "id", "left_anti")
    if drop_passed_seeds and passed.count() + failed.count() >= expected:
        seeds = passed.withColumn("_passed", F.lit(True))
        kept = kept.join(seeds, "id", "left").where("_passed is null or not coalesce(startswith(source, 'report'), false)").drop("_passed")
    return kept.select(*registry.columns).unionByName(failed).orderBy("repo", "id")


def write_registry(registry: DataFrame, path: str) -> None:
    """The registry as one JSON object with a sorted list; it is small by nature."""
    one = registry.agg(F.array_sort(F.collect_list(F.struct("repo", "id", "reason", "source", "evidence"))).alias("skip"))
    one.select(F.transform("skip", lambda e: F.struct(e["id"].alias("id"), e["repo"].alias("repo"), e["reason"].alias("reason"), e["source"].alias("source"), e["evidence"].alias("evidence"))).alias("skip")).coalesce(1).write.mode("overwrite").json(path)


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """(raw) of a dataset's rows as JSON texts: a Parquet table, JSON lines, or a JSON list or object with ``records``.

    Texts in a Parquet table that hold objects or lists stay texts; readers decode them where they stand.
    """
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "parquet":
        df = spark.read.parquet(path)
        return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("raw"))
    if kind == "jsonl":
        return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw"))
    whole = spark.read.text(path, wholetext=True)
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.records"))
    return whole.select(F.explode(F.from_json(listed, "array<string>")).alias("raw"))


def cached_dataset(spark: SparkSession, folder: str, repo_id: str, split: str) -> DataFrame:
    """A dataset's split from a local copy ``<folder>/<owner>--<name>/<split>.parquet``; there is no download, a missing one is an error."""
    path = f"{folder}/{repo_id.replace('/', '--')}/{split}.parquet"
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of a SQLite file on the driver, in batches of rows; such files are small caches."""
    import sqlite3

    columns = [c.name for c in spark.createDataFrame([], schema).schema]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        rows = con.execute(f'SELECT {", ".join(columns)} FROM "{table}"').fetchall()
    return spark.createDataFrame(rows, schema)


def capped_lines(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """(place, value) of a file's lines, the first ``cap`` of them if one is given; the cap is the operator's feature."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    return lines.select("place", "value") if cap is None else lines.orderBy("place").limit(cap).select("place", "value")
