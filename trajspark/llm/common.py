"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words in every contract here: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast only if a count of it shows at most this many rows.
BROADCAST_ROWS = 200_000
#: Bytes of one Arrow batch given to Python: documents can be long, so a bound on rows alone bounds nothing.
ARROW_BYTES = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="trajspark-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's scratch space
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends."""
    path = f"{scratch_root(spark)}/trajspark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows no longer depends on any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files that a materialised table was read from."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, f)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast only after a count has proved the bound; a larger table keeps its shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Keys with more rows than this are joined on the map side, where they are few enough.
CROWD = 10_000


def join_keyed(rows: DataFrame, table: DataFrame, keys: str | list[str], size: str) -> DataFrame:
    """Inner join of rows with a table of one row for each key, where ``size`` says how many rows a key has.

    Crowded keys travel to the rows; only the rows of the others are shuffled, so no task has more than some crowds' worth.
    """
    keys = [keys] if isinstance(keys, str) else keys
    few = table.where(F.col(size) <= CROWD)
    crowds = table.where(F.col(size) > CROWD)
    if crowds.isEmpty():
        return rows.join(few, keys)
    crowds = broadcast_if_small(crowds)
    return rows.join(crowds, keys).unionByName(rows.join(crowds.select(*keys), keys, "left_anti").join(few, keys))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold; a smaller setting of the session is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).lower().removesuffix("b")
    if not held.isdigit() or int(held) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text without nulls, as an array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem = f"_{stem}"
    return stem


def row_ids(df: DataFrame, id_col: str, *order: str) -> tuple[DataFrame, str]:
    """``df`` with one more column, a unique long that sorts like ``id_col``; and that column's name, which no other column has.

    Where ids are unique, whole numbers and never null, the number is the id. Otherwise rows are numbered in the order of
    (id, nulls last, then ``order``); equal rows may take their numbers in any order, which changes no result.
    """
    rid = free_name(df, "_rid")
    if isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        seen = df.groupBy(F.col(id_col).alias("i")).count().agg(F.max("count").alias("c"), F.sum(F.col("i").isNull().cast("int")).alias("n")).first()
        if (seen.c or 0) <= 1 and not seen.n:
            return df.withColumn(rid, F.col(id_col).cast("long")), rid
    part, at = free_name(df, "_part"), free_name(df, "_at")
    ranged = materialise(df.repartitionByRange(F.col(id_col).asc_nulls_last(), *order).sortWithinPartitions(F.col(id_col).asc_nulls_last(), *order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "rows")
    # The numbers of one written partition are consecutive; its offset is the count of those before it. One row a partition.
    counts = sorted(tuple(r) for r in ranged.groupBy(part).agg(F.count("*"), F.min(at)).collect())
    shift, before = [], 0
    for number, n, low in counts:
        shift.append((number, before - low))
        before += n
    shifts = df.sparkSession.createDataFrame(shift, f"`{part}` int, `{rid}` long")
    return ranged.join(broadcast_if_small(shifts), part).withColumn(rid, F.col(at) + F.col(rid)).select(*df.columns, rid), rid
