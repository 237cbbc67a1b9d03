"""Scans of captured call traces: JSON lines of a tracer, or blocks between markers in a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overlap import in_some_range

ENTRY = "frames array<struct<file:string,line:int,name:string,code:string>>"
#: Fixed value: how a block of frames stands in a log.
BLOCK = r"(?s)<<<FAULT_TRACE_BEGIN:[^:]+:[^:]+:\d+>>>\n(.*?)<<<FAULT_TRACE_END>>>"
FRAME = r"^([^:]*):(\d+):([^:]*):(.*)$"


def _relative(path: Column, repo: str, other: str = "") -> Column:
    out = F.when(path.startswith(f"{repo}/"), F.substring(path, len(repo) + 2, 1 << 30))
    if other:
        out = out.when(path.startswith(f"{other}/r2e_tests/"), F.substring(path, len(other) + 2, 1 << 30))
    return out.otherwise(path)


def _patched(frames: DataFrame, callables: DataFrame, require: bool) -> DataFrame:
    """``frames`` with is_patched: the line lies in a changed callable, by its instrumented range where it has one."""
    of = lambda c: F.coalesce(*[F.col(n) for n in (f"instr_{c}", c) if n in callables.columns])
    ranges = callables.select("file_path", of("start_line").alias("start_line"), of("end_line").alias("end_line"))
    # Each distinct line is looked up once, however many traces pass it.
    hit = in_some_range(frames.select("file_path", "line_no").distinct(), ranges).withColumn("is_patched", F.lit(True))
    out = frames.join(hit, ["file_path", "line_no"], "left").withColumn("is_patched", F.coalesce("is_patched", F.lit(False)))
    if require:
        out = out.join(out.where("is_patched").select("trace_idx").distinct(), "trace_idx", "left_semi")
    return out.select("trace_idx", "frame_idx", "file_path", "line_no", "func_name", "line_content", "is_patched")


def scan_trace_lines(spark: SparkSession, path: str, callables: DataFrame, repo: str, *, other: str = "", require_patched: bool = True) -> DataFrame:
    """One row for each frame of a tracer's JSON lines; lines that are no JSON and traces without frames are left out.

    ``callables``: (file_path, start_line, end_line[, instr_start_line, instr_end_line]). ``trace_idx`` is unique, in file order.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("trace_idx"), F.from_json("value", ENTRY).alias("e"))
    f = lines.select("trace_idx", F.posexplode("e.frames").alias("frame_idx", "f"))
    frames = f.select("trace_idx", "frame_idx", _relative(F.coalesce("f.file", F.lit("")), repo, other).alias("file_path"), F.coalesce("f.line", F.lit(0)).alias("line_no"), F.coalesce("f.name", F.lit("")).alias("func_name"), F.coalesce("f.code", F.lit("")).alias("line_content"))
    return _patched(frames, callables, require_patched)


def traces_in_logs(logs: DataFrame, callables: DataFrame, repo: str) -> DataFrame:
    """Frames of the marked blocks of ``logs`` (log_id, output); installed packages are left out, and traces without a patched frame."""
    blocks = logs.select("log_id", F.posexplode(F.regexp_extract_all("output", F.lit(BLOCK), F.lit(1))).alias("place", "body")).withColumn("trace_idx", F.struct("log_id", "place"))
    lines = blocks.select("trace_idx", F.posexplode(F.split(F.trim("body"), "\n")).alias("frame_idx", "line")).withColumn("line", F.trim("line")).where(F.col("line").rlike(FRAME))
    part = lambda g: F.regexp_extract("line", FRAME, g)
    frames = lines.select("trace_idx", "frame_idx", _relative(part(1), repo).alias("file_path"), part(2).try_cast("int").alias("line_no"), part(3).alias("func_name"), part(4).alias("line_content"))
    frames = frames.where(~F.col("file_path").contains(".venv/") & ~F.col("file_path").contains("site-packages/"))
    return _patched(frames, callables, True)
