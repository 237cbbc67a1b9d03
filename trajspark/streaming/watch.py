"""Refreshing of metrics while rollouts arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def watch_records(spark: SparkSession, path: str, schema: str, on_batch: Callable[[DataFrame, int], None], *, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Hand each batch of new JSONL files to ``on_batch(rows, number)``; without ``seconds``, take what is there and stop."""
    rows = spark.readStream.schema(schema).json(path)
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{max(seconds, 1)} seconds"}
    return rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def distinct_events(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event once; how long a key is held is bounded by the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


class FirstDistinct(StatefulProcessor):
    """State of one run: the first ``cap`` distinct keys, and how many rows came with another one after that."""

    def __init__(self, key: str, cap: int):
        self.key, self.cap = key, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "place long")
        self.counts = handle.getValueState("counts", "kept long, overflow long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        kept, overflow = self.counts.get() if self.counts.exists() else (0, 0)
        before, new = (kept, overflow), []
        for frame in rows:
            for k in frame[self.key]:
                if self.seen.containsKey((k,)):
                    continue
                if kept < self.cap:
                    self.seen.updateValue((k,), (kept,))
                    new.append((*key, k, kept, None))
                    kept += 1
                else:
                    overflow += 1
        if (kept, overflow) != before:
            self.counts.update((kept, overflow))
        if overflow != before[1]:
            new.append((*key, None, None, overflow))
        yield pd.DataFrame(new, columns=["run", "key", "place", "overflow"]).astype({"place": "Int64", "overflow": "Int64"})

    def close(self) -> None:
        pass


def capped_events(events: DataFrame, *, run: str = "run_id", key: str = "event_id", cap: int = 10_000) -> DataFrame:
    """(run, key, place, overflow): the first ``cap`` distinct keys of each run of a stream, each once, in the order in which they came.

    A run's state is bounded by the cap, which is what the operator is for: rows with a further key are only counted, and the
    count so far is put out, with a null key, whenever it has grown. What comes again, in a batch or later, changes nothing while its
    key is held; beyond the cap, repeats can't be told apart and count. Rows without a run or a key are left out. Needs the RocksDB
    state store: spark.sql.streaming.stateStore.providerClass.
    """
    rows = events.select(F.col(run).cast("string").alias("run"), F.col(key).cast("string").alias("key")).where("run is not null and key is not null")
    return rows.groupBy("run").transformWithStateInPandas(FirstDistinct("key", cap), "run string, key string, place long, overflow long", "Append", "None")


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def poll(refresh, *, interval: float = 5.0, rounds: int | None = None, sleep=None) -> int:
    """Call ``refresh()`` every ``interval`` seconds (one at least) until it returns True or ``rounds`` are over; returns the rounds."""
    import time

    wait, done = sleep or time.sleep, 0
    while rounds is None or done < rounds:
        done += 1
        if refresh() is True:
            break
        if rounds is None or done < rounds:
            wait(max(interval, 1.0))
    return done


def score_steps(batches: DataFrame, score, folder: str, *, step: str = "step", checkpoint: str, prefix: str = "val"):
    """Start a stream that scores each micro-batch: ``score(rows)`` gives details, written as JSON lines under ``<folder>/details/batch=<number>/<step>=<n>``.

    A batch that Spark can't score leaves one row ``<prefix>/error`` = 1 under ``<folder>/errors/batch=<number>`` instead, and the
    stream goes on; faults of other kinds stop it. A batch that is run again replaces what it has left before, whichever it was.
    """

    def one(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        none = spark.createDataFrame([], "metric string, value double, message string")
        try:
            score(rows).write.mode("overwrite").partitionBy(step).json(f"{folder}/details/batch={number}")
            failed = none
        except (PySparkException, Py4JJavaError) as e:  # a batch's failure is its result
            none.write.mode("overwrite").json(f"{folder}/details/batch={number}")
            failed = spark.createDataFrame([(f"{prefix}/error", 1.0, str(e)[:500])], none.schema)
        failed.write.mode("overwrite").json(f"{folder}/errors/batch={number}")

    return batches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
