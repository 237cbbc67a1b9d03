"""Streams whose batches and rows come again."""

import json

import pytest

from trajspark.streaming import watch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def events(*pairs):
    return [{"run_id": r, "event_id": k} for r, k in pairs]


def test_capped_events(rocks, tmp_path):
    """Three files, the later ones with rows of the earlier; the stream is stopped and started again between them."""
    for name, rows in (("a", events(("x", "1"), ("x", "2"), ("x", "1"), ("y", "1"), (None, "1"), ("x", None))), ("b", events(("x", "2"), ("x", "3"), ("x", "4"), ("y", "1"))), ("c", events(("x", "3"), ("x", "1"), ("y", "1")))):
        put(tmp_path / "in", f"{name}.json", rows)
        stream = rocks.readStream.schema("run_id string, event_id string").json(str(tmp_path / "in"))
        out = watch.capped_events(stream, cap=3)
        q = out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = rocks.read.schema("run string, key string, place long, overflow long").json(str(tmp_path / "out")).collect()
    assert sorted((r.run, r.key, r.place) for r in got if r.key) == [("x", "1", 0), ("x", "2", 1), ("x", "3", 2), ("y", "1", 0)]
    assert [(r.run, r.overflow) for r in got if r.key is None] == [("x", 1)]


def test_batch_that_is_run_again(spark, tmp_path):
    """A batch whose results were written, but not its commit, is run again by the next start: its results are there once."""
    put(tmp_path / "in", "a.json", [{"step": 1, "v": 2}, {"step": 2, "v": 3}])

    def run(score=lambda rows: rows):
        stream = spark.readStream.schema("step int, v int").json(str(tmp_path / "in"))
        q = watch.score_steps(stream, score, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()

    def again():
        for f in (tmp_path / "cp/commits").iterdir():
            f.unlink()

    def read(kind):
        return spark.read.schema("batch int, step int, v int, metric string").json(str(tmp_path / "out" / kind)).collect()

    run()
    again()
    run()
    assert sorted((r.batch, r.step, r.v) for r in read("details")) == [(0, 1, 2), (0, 2, 3)] and read("errors") == []
    again()
    run(lambda rows: rows.select("missing"))
    assert read("details") == [] and [r.metric for r in read("errors")] == ["val/error"]
    again()
    run()
    assert len(read("details")) == 2 and read("errors") == []


def test_other_faults_stop_the_stream(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"step": 1, "v": 2}])
    stream = spark.readStream.schema("step int, v int").json(str(tmp_path / "in"))

    def broken(rows):
        raise KeyError("a fault of the code")

    q = watch.score_steps(stream, broken, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    with pytest.raises(Exception, match="a fault of the code"):
        q.processAllAvailable()
