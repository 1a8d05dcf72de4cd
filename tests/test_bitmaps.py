"""Distinct entities from day bitmaps against sets."""

import random
from datetime import date, timedelta

import pytest

from daymart.operators import bitmaps as B


def rows(seed=4, n=600):
    r = random.Random(seed)
    day = lambda i: (date(2024, 1, 1) + timedelta(days=i)).strftime("%Y%m%d")
    out = [(f"u{int(r.paretovariate(0.6)) % 300}", day(r.choice([*range(12), *range(40, 44), 75])), r.choice("ab")) for _ in range(n)]
    return out + [("u1", day(3), "a")] * 200 + [(None, day(5), "a")]


SCHEMA = "user string, inc_day string, shop string"


def window(data, day, n, pick=lambda r: True):
    end = date(int(day[:4]), int(day[4:6]), int(day[6:]))
    low = (end - timedelta(days=n - 1)).strftime("%Y%m%d")
    return len({u for u, d, s in data if u is not None and low <= d <= day and pick((u, d, s))})


@pytest.mark.parametrize("n, buckets", [(1, 3), (7, 1), (30, 5)])
def test_rolling(spark, n, buckets):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    numbers = B.number_entities(df, "user", buckets)
    found = numbers.collect()
    assert len(found) == len({(r.bucket, r.no) for r in found}) == len({u for u, _, _ in data if u})
    for b in {r.bucket for r in found}:  # dense in each bucket
        assert sorted(r.no for r in found if r.bucket == b) == list(range(1, 1 + sum(r.bucket == b for r in found)))
    days = B.day_bitmaps(df, "inc_day", "user", numbers)
    got = {r.inc_day: r.entities for r in B.distinct_rolling(days, "inc_day", n).collect()}
    assert got == {d: window(data, d, n) for _, d, _ in data}
    assert B.distinct_between(days, "inc_day", "20240103", "20240111").first().entities == window(data, "20240111", 9)


def test_rolling_per_key(spark):
    data = rows(n=150)
    df = spark.createDataFrame(data, SCHEMA)
    days = B.day_bitmaps(df, "inc_day", "user", B.number_entities(df, "user", 2), ["shop"])
    got = {(r.shop, r.inc_day): r.entities for r in B.distinct_rolling(days, "inc_day", 5, ["shop"]).collect()}
    assert got == {(s, d): window(data, d, 5, lambda r, s=s: r[2] == s) for u, d, s in data if u}


def test_many_entities_fill_several_chunks(spark):
    df = spark.range(70_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN '20240101' ELSE '20240103' END AS inc_day")
    days = B.day_bitmaps(df, "inc_day", "id", B.number_entities(df, "id", 1))
    assert days.select("chunk").distinct().count() == 3
    assert {r.inc_day: r.entities for r in B.distinct_rolling(days, "inc_day", 3).collect()} == {"20240101": 35_000, "20240103": 70_000}


def test_history_grows_by_days(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    history = B.History(spark, str(tmp_path / "users"), "string", buckets=3)
    history.add(df.where("inc_day < '20240110'"), "user")
    before = {r.entity: (r.bucket, r.no) for r in history.numbers.collect()}
    history.add(df.where("inc_day >= '20240110'"), "user")
    history.add(df.where("inc_day = '20240111'"), "user")  # a replay
    after = {r.entity: (r.bucket, r.no) for r in history.numbers.collect()}
    assert before.items() <= after.items() and len(set(after.values())) == len(after) == history.numbers.count()
    assert {r.inc_day: r.entities for r in history.rolling(30).collect()} == {d: window(data, d, 30) for _, d, _ in data}
    late = {r.inc_day: r.entities for r in history.rolling(7, since="20240210").collect()}
    assert late == {d: window(data, d, 7) for _, d, _ in data if d >= "20240210"}
    assert history.distinct("20240101", "20240131").first().entities == window(data, "20240131", 31)
    # a window reads its own days only
    from daymart.sources.partitions import scans

    read = scans(history.distinct("20240101", "20240103"))
    assert [s.selected[0] for s in read if "inc_day" in s.partition_columns] == [3]


def test_nothing(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    days = B.day_bitmaps(df, "inc_day", "user", B.number_entities(df, "user"))
    assert B.distinct_rolling(days, "inc_day").collect() == []
    assert B.distinct_between(days, "inc_day", "20240101", "20240102").first().entities == 0
