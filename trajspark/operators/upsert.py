"""Upserts without a transactional format: old and new rows are merged by key into a new version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; one aggregation, which combines before the shuffle."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in cols])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, keep_old: list[str] = (), keep_first: list[str] = ()) -> DataFrame:
    """Rows of ``old`` and ``new`` by key: new values win, but for ``keep_old`` (the old row's, if it has one, null or not) and ``keep_first`` (the old value unless null)."""
    o, n = (df.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias(name)) for df, name in ((old, "o"), (new, "n")))

    def value(c: str):
        if c in keep_old:
            return F.when(F.col("o").isNotNull(), F.col("o")[c]).otherwise(F.col("n")[c])
        if c in keep_first:
            return F.coalesce(F.col("o")[c], F.col("n")[c])
        return F.when(F.col("n").isNotNull(), F.col("n")[c]).otherwise(F.col("o")[c])

    return o.join(n, keys, "full").select(*[c if c in keys else value(c).alias(c) for c in old.columns])


def mark_running(cells: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Cells of ``ids`` that are not done become running and keep a start that they have."""
    hit = cells.join(ids.select("cell_id").distinct().withColumn("_hit", F.lit(True)), "cell_id", "left")
    go = F.coalesce("_hit", F.lit(False)) & (F.col("status") != "done")
    return hit.withColumn("started_at", F.when(go, F.coalesce("started_at", F.lit(now))).otherwise(F.col("started_at"))).withColumn("status", F.when(go, "running").otherwise(F.col("status"))).select(*cells.columns)


def add_attempts(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """Cells after a batch of runs (cell_id, ingest_order, error): attempts grow by its runs, the last run sets status and error (its last 4000 characters)."""
    last = runs.groupBy("cell_id").agg(F.count("*").alias("_n"), F.max_by(F.struct(F.right("error", F.lit(4000)).alias("e")), "ingest_order").alias("_r"))
    j = cells.join(last, "cell_id", "left")
    hit = F.col("_n").isNotNull()
    return j.withColumn("attempts", F.col("attempts") + F.coalesce("_n", F.lit(0))).withColumn("status", F.when(hit, F.when(F.col("_r.e").isNull(), "done").otherwise("error")).otherwise(F.col("status"))).withColumn("error", F.when(hit, F.col("_r.e")).otherwise(F.col("error"))).select(*cells.columns)
