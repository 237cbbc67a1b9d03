"""Set operations on keyed rows, and selection of rows by their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without(rows: DataFrame, skip: DataFrame, key: str) -> DataFrame:
    return rows.join(skip.select(key).distinct(), key, "left_anti")


def added(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return without(new, old, key)


def modified(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on both sides with another value; null is a value like any other."""
    o = old.select(key, F.col(value).alias("_old"))
    return new.join(o, key).where(~F.col(value).eqNullSafe(F.col("_old"))).select(key)


def merge_skips(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Skip records by id: a new one replaces the old one."""
    cols = [c for c in old.columns if c != key]
    o, n = (df.select(key, F.struct(*cols).alias(name)) for df, name in ((old, "o"), (new, "n")))
    return o.join(n, key, "full").select(key, *[F.coalesce("n", "o")[c].alias(c) for c in cols])


def select_rows(rows: DataFrame, order: str, *, offset: int = 0, limit: int | None = None, ids: list[str] | None = None, id_col: str = "instance_id") -> DataFrame:
    """Rows with the given ids, in order, without the first ``offset``; ``limit`` None means all, 0 none."""
    df = rows.where(F.col(id_col).isin(ids)) if ids is not None else rows
    df = df.orderBy(order).offset(offset)
    return df if limit is None else df.limit(limit)
