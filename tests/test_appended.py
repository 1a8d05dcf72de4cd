"""Bytes appended to logs: offsets, encodings, splits, replays."""

import json

import pytest
from pyspark.sql import functions as F

from daymart.streaming import appended, logs

BAD = "2026 LLM CLI 调用超时 一次\n重试 in x.llm now\n302 Found\n降级\n"
CLEAN = "all well\nnothing\n"


@pytest.fixture()
def folder(tmp_path):
    where = tmp_path / "logs"
    where.mkdir()
    return where


def append(path, text, encoding="utf-8"):
    with open(path, "ab") as f:
        f.write(text.encode(encoding))


def counts(df):
    from daymart.operators.logs import log_health

    return tuple(log_health(df).first())


def lines(df):
    return [(r.file, r.value) for r in df.orderBy("file", "start").collect()]


def test_only_what_follows_a_snapshot_counts(spark, folder):
    append(folder / "task.1.log", BAD)
    before = appended.snapshot_offsets(str(folder))
    append(folder / "task.1.log", CLEAN)
    assert counts(appended.read_appended(spark, str(folder), before)) == (0, 0, 0, 0)
    append(folder / "task.1.log", BAD)
    assert counts(appended.read_appended(spark, str(folder), before)) == (1, 1, 1, 1)
    assert counts(appended.read_appended(spark, str(folder))) == (2, 2, 2, 2)


def test_new_files_are_read_whole(spark, folder):
    append(folder / "task.1.log", BAD)
    before = appended.snapshot_offsets(str(folder))
    assert list(before) == ["task.1.log"] and before["task.1.log"] == len(BAD.encode())
    (folder / "deep").mkdir()
    append(folder / "deep" / "task.2.log", CLEAN)
    append(folder / "other.txt", BAD)
    got = lines(appended.read_appended(spark, str(folder), before, "task.*.log"))
    assert got == [("deep/task.2.log", "all well"), ("deep/task.2.log", "nothing")]


def test_gbk_and_utf8(spark, folder):
    append(folder / "a.log", BAD, "gbk")
    append(folder / "a.log", BAD)
    assert counts(appended.read_appended(spark, str(folder))) == (2, 2, 2, 2)
    (folder / "b.log").write_bytes(b"\xff\xff bad\n")
    assert lines(appended.read_appended(spark, str(folder), pattern="b.log"))[0][1].endswith(" bad")


@pytest.mark.parametrize("split", [5, 29, 64, 5000])
def test_splits_cut_no_line(spark, folder, split):
    text = "".join(f"{'x' * (i * 7 % 23)}{i} 降级\n" + "\n" * (i % 3) for i in range(14)) + "open end"
    append(folder / "a.log", text.replace("\n", "\r\n") if split == 29 else text)
    whole = [("a.log", x) for x in text.split("\n")]
    assert lines(appended.read_appended(spark, str(folder), split_bytes=split)) == whole
    low = len("".join(f"{x}\n" for _, x in whole[:5]).encode())
    if split != 29:
        assert lines(appended.read_appended(spark, str(folder), {"a.log": low}, split_bytes=split)) == whole[5:]


def test_empty_and_rewritten(spark, folder):
    assert lines(appended.read_appended(spark, str(folder))) == []
    assert lines(appended.read_appended(spark, str(folder / "none"))) == []
    (folder / "a.log").write_bytes(b"")
    assert lines(appended.read_appended(spark, str(folder))) == []
    append(folder / "a.log", "short\n")
    assert lines(appended.read_appended(spark, str(folder), {"a.log": 500})) == [("a.log", "short")]


def run(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    appended.appended_health_stream(spark, str(folder), out, mark)
    return tuple(logs.log_health_total(spark, out).first())


def test_stream_goes_on_at_its_offset(spark, folder, tmp_path):
    append(folder / "a.log", BAD + "降级 but not finish")
    assert run(spark, folder, tmp_path) == (1, 1, 1, 1)
    append(folder / "a.log", "ed\n" + CLEAN)
    append(folder / "b.log", BAD, "gbk")
    assert run(spark, folder, tmp_path) == (2, 2, 2, 3)
    assert run(spark, folder, tmp_path) == (2, 2, 2, 3)
    by_file = {r.file: r.degradations for r in appended.health_by_file(spark, str(tmp_path / "out")).collect()}
    assert by_file == {"a.log": 2, "b.log": 1}


def test_failed_batch_is_replayed_once(spark, folder, tmp_path):
    """A batch that fails after its bytes grew reads the same range again, and later bytes in the next batch."""
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    append(folder / "a.log", BAD)

    def fail(batch, batch_id):
        raise RuntimeError("lost")

    query = appended.read_appended_stream(spark, str(folder)).writeStream.foreachBatch(fail).option("checkpointLocation", mark).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    append(folder / "a.log", BAD)
    assert run(spark, folder, tmp_path) == (2, 2, 2, 2)
    sizes = {r.batch: r.n for r in spark.read.parquet(out).groupBy("batch").agg(F.sum("timeouts").alias("n")).collect()}
    assert sizes == {"0": 1, "1": 1}


def test_offsets_are_one_number_per_file(folder):
    append(folder / "a.log", "one\ntwo")
    reader = appended.AppendedLog({"path": str(folder)}).streamReader(None)
    assert json.loads(json.dumps(reader.latestOffset())) == {"a.log": 4}
    with pytest.raises(ValueError):
        appended.AppendedLog({}).streamReader(None)


def test_long_unfinished_line(folder):
    append(folder / "a.log", "end\n" + "x" * (3 * appended.TAIL_BYTES))
    assert appended.AppendedLog({"path": f"file:{folder}"}).streamReader(None).latestOffset() == {"a.log": 4}
