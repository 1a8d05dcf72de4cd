"""Registered functions in check files, and regression of outputs by digests."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daymart.operators import sets
from daymart.plans.registry import Registry

FILE = """
-- [metric-total] the total of a shop reaches its floor
-- weight: High
select shop from (select distinct shop from facts) where shop_total(shop) < floor_of(shop);

-- [metric-rows] rows of the day
select day_rows('${bizdate}') as n;
-- expect: n = 2

-- [rule-negative] no amount below the bound
select * from below(0);
"""


def registry():
    r = Registry()
    r.function("floor_of", "shop STRING", "DOUBLE", "CASE shop WHEN 'a' THEN 10 ELSE 1 END")
    r.metric("shop_total", "facts", "sum(amount)", "shop = shop_total.name", "name STRING")
    r.metric("day_rows", "facts", "count(*)", "inc_day = day_rows.day", "day STRING", "BIGINT")
    r.check("below", "bound INT", "SELECT shop, amount FROM facts WHERE amount < below.bound")
    return r


GOOD = [("a", "20240101", 8), ("a", "20240102", 4), ("b", "20240102", 2)]


@pytest.mark.parametrize(
    "fault, failed",
    [(None, set()), (("a", "20240103", -5), {"total", "negative"}), (("b", "20240102", 1), {"rows"}), (("c", "20240101", 0), {"total"})],
)
def test_check_file_calls_what_is_registered(spark, fault, failed):
    facts = spark.createDataFrame([*GOOD, *([fault] if fault else [])], "shop string, inc_day string, amount int")
    rows = registry().run_checks(spark, {"facts": facts}, FILE, "20240102").collect()
    assert {r.name: r.message for r in rows if r.message} == {}
    assert {r.name for r in rows if r.status == "FAILED"} == failed and len(rows) == 3


def test_names(spark):
    r = registry()
    with pytest.raises(ValueError):
        r.function("floor_of", "", "INT", "1")
    with pytest.raises(ValueError):
        r.metric("bad name", "facts", "1")

    @F.pandas_udf("long")
    def doubled(x):
        return x * 2

    r.udf("doubled", doubled)
    r.install(spark, {"facts": spark.createDataFrame(GOOD, "shop string, inc_day string, amount int")})
    assert spark.sql("select sum(doubled(amount)) from facts").first()[0] == 28
    plan = spark.sql("select shop_total('a')")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "SQLFunction" not in plan  # inlined
    unknown = r.run_checks(spark, {"facts": spark.table("facts")}, "-- [x-y]\nselect no_such_metric(1)").collect()
    assert [x.status for x in unknown] == ["FAILED"] and unknown[0].message


def outputs(seed=3, n=400):
    r = random.Random(seed)
    old = [(i % 90, r.choice("xyz"), r.choice([None, 1.5, 2.0])) for i in range(n)]
    new = list(old)
    new[5] = (5, "changed", None)
    del new[100:104]
    new += [(1000, "new", 1.0), (1000, "new", 1.0), (None, "null key", 0.0), old[7]]
    return old, new


SCHEMA = "k int, s string, v double"


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_rows_of_differing_ranges_only(spark, ranges):
    old, new = outputs()
    a, b = Counter(old), Counter(new)
    want = {(*row, a[row], b[row]) for row in a | b if a[row] != b[row]}
    left, right = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (old, new))
    assert {tuple(r) for r in sets.diff_by_digest(left, right, ["k"], ranges).collect()} == want
    kept = sets.digests(left, ["k"], ranges=ranges)
    assert {tuple(r) for r in sets.diff_by_digest(left, right, ["k"], ranges, kept).collect()} == want
    differ = {r[0] for r in sets.differing_ranges(kept, sets.digests(right, ["k"], ranges=ranges)).collect()}
    touched = spark.createDataFrame([(row[0],) for row in want], "k int").select(sets._range_of(["k"], ranges)).distinct()
    assert differ == {r[0] for r in touched.collect()}


def test_equal_outputs_shuffle_no_rows(spark):
    old, _ = outputs()
    left, right = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(old[::-1], SCHEMA).repartition(5)
    assert sets.differing_ranges(sets.digests(left, ["k"]), sets.digests(right, ["k"])).collect() == []
    assert sets.diff_by_digest(left, right, ["k"]).collect() == []
    empty = left.limit(0)
    assert sets.diff_by_digest(empty, empty, ["k"]).collect() == []
    assert sets.diff_by_digest(empty, left, ["k"]).agg(F.sum("new_rows")).first()[0] == len(old)


def test_hot_row_is_repeated_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sets, "REPEAT_PART", 7)
    old = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3, "x string")
    new = spark.createDataFrame([("a",)] * 8 + [("b",)] * 17 + [("c",)], "x string")
    got = Counter(map(tuple, sets.multiset_diff(old, new).collect()))
    assert got == {("a", "old"): 42, ("b", "new"): 14, ("c", "new"): 1}
