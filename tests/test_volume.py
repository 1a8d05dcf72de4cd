"""Daily volumes of a stream: equal to the batch, late rows, replays, checks per batch."""

import pytest
from pyspark.sql import functions as F

from daymart.operators import quality
from daymart.streaming import volume

SCHEMA = "ts timestamp, shop string"


@pytest.fixture()
def feed(spark, tmp_path):
    files = str(tmp_path / "files")

    def send(*times):
        spark.createDataFrame([(t, "a" if i % 2 else "b") for i, t in enumerate(times)], "ts string, shop string").select(F.col("ts").cast("timestamp"), "shop").coalesce(1).write.mode("append").parquet(files)

    spark.createDataFrame([], SCHEMA).write.parquet(files)
    send.run = lambda **k: volume.run_volume_stream(volume.volume_stream(spark.readStream.schema(SCHEMA).parquet(files), "ts"), str(tmp_path / "out"), str(tmp_path / "mark"), **k)
    send.counts = lambda: {r.inc_day: r.cnt for r in volume.volumes(spark, str(tmp_path / "out")).collect()}
    send.results = lambda: volume.check_results(spark, str(tmp_path / "out"))
    send.stream = lambda **o: spark.readStream.schema(SCHEMA).options(**o).parquet(files)
    return send


def test_late_rows(feed):
    feed("2024-01-01 10:00:00", "2024-01-01 23:50:00", "2024-01-02 00:20:00")
    feed.run()
    assert feed.counts() == {"20240101": 2, "20240102": 1}
    feed("2024-01-01 23:40:00", "2024-01-02 00:30:00")  # inside the watermark of an hour
    feed.run()
    assert feed.counts() == {"20240101": 3, "20240102": 2}
    feed("2024-01-03 08:00:00")
    feed.run()
    feed("2024-01-01 23:59:00", "2024-01-03 09:00:00")  # the first day is closed
    query = feed.run()
    assert feed.counts() == {"20240101": 3, "20240102": 2, "20240103": 2}
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 1


def test_replay_counts_once(feed, monkeypatch):
    feed("2024-01-01 10:00:00", "2024-01-02 10:00:00")
    feed.run()
    feed("2024-01-02 11:00:00", "2024-01-02 12:00:00")

    def broken(day):
        raise RuntimeError("suite lost")

    with pytest.raises(Exception, match="suite lost"):
        feed.run(checks=broken)  # after the batch's counts were written
    feed("2024-01-02 13:00:00")
    feed.run()
    feed.run()
    assert feed.counts() == {"20240101": 1, "20240102": 4}


def test_suite_runs_on_every_batch(feed):
    feed(*["2024-01-01 10:00:00"] * 4, "2024-01-02 10:00:00")
    feed.run()
    feed(*["2024-01-02 11:00:00"] * 3)
    feed.run()
    got = {(r.batch, r.name): (r.measured, r.status) for r in feed.results().collect()}
    first, second = min(got)[0], max(got)[0]
    assert got[first, "volume of 20240102"] == (0.75, "FAILED")
    assert got[second, "volume of 20240102"] == (0.0, "PASSED")
    assert got[first, "days out of band up to 20240102"] == (1.0, "FAILED")
    assert got[second, "days out of band up to 20240102"] == (0.0, "PASSED")
    assert quality.score(feed.results().where(F.col("batch") == second)).first().score == 100


def test_nothing_sent(feed):
    feed.run()
    assert feed.run() is not None


def test_keys(feed, spark, tmp_path):
    feed("2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-02 10:00:00")
    stream = volume.volume_stream(feed.stream(), "ts", keys=["shop"])
    rows = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: rows.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "keys")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(rows) == [("a", "20240101", 1), ("b", "20240101", 1), ("b", "20240102", 1)]
