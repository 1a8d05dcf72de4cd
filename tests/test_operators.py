import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from daymart.operators import aggs, contracts, joins, profiling, quality, sets, windows
from daymart.plans import marts


def bag(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def day(i):
    return (date(2024, 1, 1) + timedelta(days=i)).strftime("%Y%m%d")


# --- joins


def test_orphans_and_scope(spark):
    child = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, pid int")
    parent = spark.createDataFrame([(1,), (1,), (4,)], "key int")
    assert bag(joins.orphans(child, parent, ["pid"], ["key"]), "id") == [(2,), (3,)]
    assert bag(joins.in_scope(child, parent, ["pid"], ["key"]), "id") == [(1,)]


def test_latest_available_skips_empty_days(spark):
    df = spark.createDataFrame([("20240101", 1), ("20240102", 0), ("20240109", 5)], "inc_day string, n int")
    assert bag(joins.latest_available(df, "20240105")) == [("20240102", 0)]
    assert bag(joins.latest_available(df, "20240105", cond="n > 0")) == [("20240101", 1)]
    assert bag(joins.latest_available(df, "20230105")) == []
    assert bag(joins.latest_available(df, "20240108", since="20240103")) == []


def test_fanout_counts_without_multiplying(spark):
    left = spark.createDataFrame([(1,)] * 3 + [(2,)], "k int")
    right = spark.createDataFrame([(1,)] * 4 + [(2,)], "k int")
    assert bag(joins.fanout(left, right, ["k"])) == [(1, 3, 4, 12)]


def test_cross_join_is_refused(spark):
    a, b = spark.range(3).toDF("a"), spark.range(3).toDF("b")
    with pytest.raises(ValueError):
        joins.refuse_cross_join(a.join(b, F.col("a") > F.col("b")))
    joins.refuse_cross_join(a.join(b, F.col("a") == F.col("b")))


def test_join_spec_is_checked():
    with pytest.raises(ValueError):
        joins.JoinSpec(("a",), ("a", "b"))
    with pytest.raises(ValueError):
        joins.JoinSpec(("a",), ("b",), cardinality="2:3")


def test_left_join_becomes_inner_with_pushed_filter(spark, folder):
    o, c = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("orders", "customer"))
    spec = joins.JoinSpec(("o_custkey",), ("c_custkey",))
    plan = joins.join_rel(o, c, spec).where("c_mktsegment = 'BUILDING'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan


# --- aggregates


def test_single_or_null_and_lists(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (4, "z"), (4, None)], "k int, v string")
    assert bag(df.groupBy("k").agg(aggs.single_or_null("v").alias("v"))) == [(1, "a"), (2, None), (3, None), (4, "z")]
    assert bag(aggs.list_agg_distinct(df, ["k"], "v", "vs")) == [(1, "a"), (2, "a,b"), (4, "z")]


def test_totals_levels(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "x", 4)], "p string, q string, n int")
    out = aggs.with_totals(df, ["p", "q"], {"n": F.sum("n")})
    assert out.where("level = 2").first()["n"] == 7
    assert out.where("level = 0").agg(F.sum("n")).first()[0] == 7


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k int, v decimal(18,2)")
    assert df.agg(aggs.sum0("v").alias("v"), aggs.ratio(F.sum("v"), F.count("v")).alias("r")).first() == (0, None)


# --- windows


def test_rolling_distinct_brute_force(spark):
    rng = random.Random(3)
    rows = [(day(rng.randrange(60)), rng.randrange(12)) for _ in range(150)] + [(day(5), 1)] * 200
    got = bag(windows.rolling_distinct(spark.createDataFrame(rows, "inc_day string, u int"), "inc_day", "u", 7))
    want = []
    for d in sorted({r[0] for r in rows}):
        lo = (date(int(d[:4]), int(d[4:6]), int(d[6:])) - timedelta(days=6)).strftime("%Y%m%d")
        want.append((d, len({u for x, u in rows if lo <= x <= d})))
    assert got == want


def test_rolling_mean_counts_missing_days(spark):
    df = spark.createDataFrame([("a", day(0), 7), ("a", day(6), 7), ("a", day(7), 0), ("a", day(30), 0)], "k string, d string, v int")
    assert [r[3] for r in bag(windows.rolling_mean(df, ["k"], "d", "v"))] == [1.0, 2.0, 1.0, None]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_budget_window_blocks(spark, block):
    rng = random.Random(5)
    rows = [(k, i, rng.randrange(9)) for k, n in (("hot", 200), ("b", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, o int, c int")
    got = bag(windows.suffix_sum(df, ["k"], "o", "c", "s", block), "k", "o", "s")
    want = sorted((k, o, sum(c for k2, o2, c in rows if k2 == k and o2 >= o)) for k, o, _ in rows)
    assert got == want
    assert bag(windows.budget_window(df, ["k"], "o", "c", 20, block), "k", "o", "running") == [w for w in want if w[2] <= 20]


def test_dedup_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "z", 1), (2, "c", 0)], "k int, v string, ts int")
    out = windows.dedup_latest(df, ["k"], [F.desc("ts"), F.asc("v")])
    assert bag(out) == [(1, "a", 2), (2, "c", 0)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_retained_needs_the_step_before(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 2)], "u int, w int")
    assert bag(windows.retained(df, "u", "w")) == [(1, 1, False), (1, 2, True), (1, 4, False), (2, 2, False)]


# --- sets


def test_line_diff(spark):
    old = spark.createDataFrame([(1, "a\nb\nb\n"), (2, "x")], "id int, text string")
    new = spark.createDataFrame([(1, "b\r\nc\nd"), (3, "y\n\nz")], "id int, text string")
    assert bag(sets.line_diff(old, new, "id")) == [(1, 2, 1, 3), (2, 0, 1, 1), (3, 3, 0, 3)]


def test_diff_states(spark):
    old = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "a"), (3, 3.0, "b"), (5, 0.0, "q"), (5, 0.0, "q")], "k int, v double, s string")
    new = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None), (4, 4.0, "c"), (5, 0.0, "q")], "k int, v double, s string")
    got = dict(bag(sets.diff_datasets(old, new, ["k"], ["v", "s"]), "k", "state"))
    assert got == {1: "same", 2: "changed", 3: "removed", 4: "added", 5: "duplicate"}
    assert bag(sets.multiset_diff(old.where("k = 5"), new.where("k = 5")), "k", "side") == [(5, "old")]


def test_merge_never_overwrites(spark):
    cur = spark.createDataFrame([(1, "keep")], "k int, v string")
    upd = spark.createDataFrame([(1, "no"), (2, "b"), (2, "a")], "k int, v string")
    assert bag(sets.merge_insert_only(cur, upd, ["k"], ["v"])) == [(1, "keep"), (2, "a")]


def test_changed_ignores_blank_lines(spark):
    now = spark.createDataFrame([(1, " a\n\n\n\nb "), (2, "c"), (3, "n")], "k int, text string")
    before = spark.createDataFrame([(1, "a\n\nb"), (2, "d")], "k int, text string")
    assert bag(sets.changed(now, before, "k"), "k", "changed") == [(1, False), (2, True), (3, True)]


# --- profiling


def test_choose_columns(spark):
    schema = spark.createDataFrame([], "guid string, sign_tm string, scene_type string, order_no string, qty int, note string, a_id int").schema
    c = profiling.choose_columns(schema, "use sign_tm, note, scene_type and qty")
    assert c.enums == ("scene_type", "note", "sign_tm")
    assert c.profile == ("sign_tm", "scene_type", "qty", "note", "order_no", "a_id")


def test_profile_nulls_and_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "row_id int, v string")
    assert bag(profiling.profile_columns(df, ["row_id", "v"])) == [("row_id", 3, 0, 3, "unique"), ("v", 3, 2, 1, "has duplicates")]
    assert bag(profiling.key_candidates(df), "column", "verified") == [("row_id", True)]
    assert profiling.profile_enums(df, ["v"], 1).first()["value"] is None


def test_bounded_latest_partition(spark):
    df = spark.createDataFrame([("20220505",), ("20230107",)], "inc_day string")
    assert profiling.latest_partition(df, bounded=True, today=date(2024, 2, 1)) == "20230107"
    assert profiling.latest_partition(df, bounded=True, today=date(2026, 2, 1)) == "20230107"
    assert profiling.latest_partition(df.limit(0)) is None


# --- quality


def test_statuses(spark):
    rows = [("a", 5.0, ">0", None), ("b", 0.0, ">0", None), ("c", None, ">0", None), ("d", 0.2, ">10%", None), ("e", None, ">0", "X"), ("f", 1.0, "n/a", None)]
    df = spark.createDataFrame(rows, "name string, measured double, threshold string, message string")
    assert dict(bag(quality.evaluate(df), "name", "status")) == {
        "a": "FAILED", "b": "PASSED", "c": "SKIPPED", "d": "FAILED", "e": "FAILED", "f": "SKIPPED",
    }


def test_score_bands(spark):
    def scored(*rows):
        return tuple(quality.score(spark.createDataFrame(list(rows), "status string, weight int")).first())

    assert scored(("PASSED", 30), ("SKIPPED", 30)) == (100, "green")
    assert scored(("FAILED", 5)) == (95, "green")
    assert scored(("FAILED", 30)) == (70, "yellow")
    assert scored(("FAILED", 30), ("FAILED", 15)) == (55, "red")
    assert scored(*[("FAILED", 30)] * 5) == (0, "red")
    empty = spark.createDataFrame([], "status string, weight int")
    assert tuple(quality.summary(empty).first()) == (0, 0, 0, 0, 0)
    assert tuple(quality.score(empty).first()) == (100, "green")


def test_runtime_failure_does_not_stop_the_suite(spark):
    t = {"t": spark.createDataFrame([("x", 1), ("2", None)], "s string, n int")}
    checks = [
        quality.Check("boundary", "cast", "t", "count_if(cast(s as int) > 0)", weight="Low"),
        quality.Check("uniqueness", "null", "t", quality.nulls(["n"]), weight="High"),
        quality.Check("consistency", "gone", "nowhere", quality.nulls(["n"])),
    ]
    got = {r["name"]: (r["status"], r["measured"]) for r in quality.run_suite(t, checks).collect()}
    assert got == {"cast": ("FAILED", None), "null": ("FAILED", 1.0), "gone": ("FAILED", None)}


def test_same_source_checks_share_one_scan(spark, folder):
    t = {"o": spark.read.parquet(f"{folder}/orders.parquet")}
    checks = [quality.Check("boundary", str(i), "o", quality.breaks(f"o_totalprice < {i}")) for i in range(5)]
    plan = quality.suite(t, checks)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1


def test_check_filter_prunes_days(spark, tmp_path):
    rows = spark.createDataFrame([(1, "20240101"), (None, "20240102")], "n int, inc_day string")
    rows.write.partitionBy("inc_day").parquet(str(tmp_path / "t"))
    t = {"t": spark.read.parquet(str(tmp_path / "t"))}
    checks = [
        quality.Check("uniqueness", "all", "t", quality.nulls(["n"])),
        quality.Check("uniqueness", "day", "t", quality.nulls(["n"]), where="inc_day = '20240101'"),
    ]
    out = quality.suite(t, checks)
    assert dict(bag(out, "name", "measured")) == {"all": 1.0, "day": 0.0}
    assert contracts.unpruned_scans(out) == 1


def test_case_file():
    text = "-- [唯一性-key] a\n-- 权重: High\nselect 1;\n-- 预期: 0\n\n-- [x-y] b\n-- threshold: >5\nselect 2\nfrom t;\n"
    a, b = quality.read_cases(text)
    assert (a.category, a.name, a.weight, a.threshold, a.sql) == ("唯一性", "key", "High", ">0", "select 1")
    assert (b.weight, b.threshold, b.sql) == ("Medium", ">5", "select 2\nfrom t")


def test_fresh_and_volume(spark):
    df = spark.createDataFrame([("20240101",)] * 4 + [("20240102",)] * 1, "inc_day string")
    got = df.agg(quality.stale_days("inc_day", "20240103"), quality.day_volume_change("inc_day", "20240102")).first()
    assert tuple(got) == (1, 0.75)
    assert bag(quality.volume_band(df, "inc_day", "20240102"), "inc_day", "pct_change") == [("20240102", -75.0)]


def test_table_roles(spark):
    df = spark.createDataFrame([("x.ads_a",), ("dwd_b",), ("Results_c",)], "table_name string")
    assert bag(quality.table_roles(df)) == [("Results_c", "target"), ("dwd_b", "upstream"), ("x.ads_a", "target")]


# --- contracts


def test_check_contract(spark):
    target = spark.createDataFrame([], "a int, b string, inc_day string").schema
    good = spark.createDataFrame([], "a int, b string")
    assert contracts.check_contract(good, target, ["inc_day"]).count() == 0
    assert contracts.check_contract(good, target, ["inc_day"], dynamic=True).first()["issue"] == "count"
    bad = spark.createDataFrame([], "b string, a int")
    assert [r["issue"] for r in contracts.check_contract(bad, target, ["inc_day"]).collect()] == ["name", "name"]
    typed = spark.createDataFrame([], "a bigint, b string, inc_day string")
    assert bag(contracts.check_contract(typed, target, ["inc_day"], dynamic=True)) == [(1, "type", "int", "bigint")]


def test_missing_outputs(spark):
    want = spark.createDataFrame([("a.ads_x",), ("a.dws_y",), ("tmp_a.tmp_z",), ("a.foo",), ("a.ok",)], "table_name string")
    have = spark.createDataFrame([("a.ok",)], "table_name string")
    assert bag(contracts.missing_outputs(want, have)) == [("a.ads_x", "critical"), ("a.dws_y", "warning"), ("a.foo", "critical")]


# --- mended operators


CASES = """
-- [唯一性-orders] one row per order and day
select order_id, count(*) as cnt from {o} where inc_day = '$[time(yyyyMMdd,-1d)]' group by order_id having cnt > 1;
-- 预期: 0 条
-- [时效性-newest] loaded up to the run date
select max(inc_day) as max_day from {o};
-- 预期: max_day = '$[time(yyyyMMdd,-1d)]'
-- [一致性-amount] paid is total less discount
select order_id from {o} where inc_day = '$[time(yyyyMMdd,-1d)]' and abs(pay - (total - off)) > 0.01;
-- 预期: 0 条
-- [业务反证-closed] a cancelled order has no payment time
select order_id from {o} where inc_day = '$[time(yyyyMMdd,-1d)]' and status = '50' and paid_at is not null;
-- 预期: 0 条
-- [波动-count] change from day to day
select inc_day, round((count(*) - lag(count(*)) over(order by inc_day)) * 100.0 / lag(count(*)) over(order by inc_day), 2) as pct_change
from {o} where inc_day >= '$[time(yyyyMMdd,-7d)]' group by inc_day;
-- 预期: pct_change 在 ±30% 以内
"""


def test_check_file_on_clean_and_faulty_data(spark):
    good = [(i, d, 10.0, 2.0, 8.0, "20", None) for d in ("20240101", "20240102") for i in range(4)]
    schema = "order_id int, inc_day string, total double, off double, pay double, status string, paid_at string"
    run = lambda rows, day="20240102": {
        r.name: r.status for r in quality.run_sql_checks(spark, {"o": spark.createDataFrame(rows, schema)}, CASES, day).collect()
    }
    assert set(run(good).values()) == {"PASSED"} and len(run(good)) == 5
    bad = [*good, (0, "20240102", 10.0, 2.0, 9.0, "50", "x"), (9, "20240102", 1.0, 0.0, 1.0, "20", None)]
    assert run(bad) == {"orders": "FAILED", "newest": "PASSED", "amount": "FAILED", "closed": "FAILED", "count": "FAILED"}
    assert run(good, "20240103")["newest"] == "FAILED"
    assert set(run(good, None).values()) == {"FAILED"}  # nothing may pass on an unresolved day


def test_failing_select_list_is_seen(spark):
    df = {"o": spark.createDataFrame([("x",)], "v string")}
    text = "-- [a-b] c\nselect cast(v as int) as n from {o};\n"
    assert quality.run_suite(df, [quality.sql_check(spark, c) for c in quality.read_cases(text)]).first()["status"] == "FAILED"


def test_wide_and_many_profiles(spark):
    wide = spark.createDataFrame([tuple(range(12))], ", ".join(f"c{i}_id int" for i in range(12)))
    assert len(profiling.choose_columns(wide.schema).profile) == 12
    assert len(profiling.choose_columns(wide.schema, limit=3).profile) == 3
    tables = {f"t{i}": wide for i in range(10)} | {"broken": spark.createDataFrame([("x",)], "v string").selectExpr("cast(v as int) as a_id")}
    rows = profiling.profile_tables(tables).collect()
    assert len(rows) == 121 and [r.table_name for r in rows if r.error] == ["broken"]


def test_turnover_counts_days_without_movement(spark):
    snaps = spark.createDataFrame([(1, "a", f"2024010{d}", 70.0, 0.0) for d in (1, 3)] + [(1, "a", "20240120", 70.0, 0.0)], "warehouse_id int, sku_id string, inc_day string, stock_quantity double, locked_quantity double")
    moves = spark.createDataFrame([(1, "a", "20240101", "OUTBOUND", -7.0)], "warehouse_id int, sku_id string, inc_day string, movement_type string, quantity double")
    skus = spark.createDataFrame([("a", 1, 1)], "sku_id string, safety_stock int, reorder_point int")
    got = {r.inc_day: (r.daily_outbound, r.turnover_days) for r in marts.inventory_turnover(snaps, moves, skus).collect()}
    assert got == {"20240101": (7.0, 70.0), "20240103": (0.0, 70.0), "20240120": (0.0, None)}


def test_new_users_are_new_for_ever(spark):
    rows = [("old", "2023-01-02 10:00:00", 5.0), ("old", "2024-01-29 10:00:00", 5.0), ("new", "2024-01-30 10:00:00", 5.0)]
    s = spark.createDataFrame(rows, "user_id string, t string, duration_seconds double").selectExpr(
        "user_id", "cast(t as timestamp_ntz) as login_time", "duration_seconds", "replace(substr(t, 1, 10), '-', '') as inc_day"
    )
    assert [(r.week_id, r.wau, r.new_users) for r in marts.weekly_retention(s, "20240130").collect()] == [("2024-W05", 2, 1)]


def test_unstable_job_is_found(spark):
    runs = iter([1, 2])
    job = lambda: spark.createDataFrame([(1, next(runs)), (2, 5)], "k int, v int")
    assert bag(contracts.idempotent(job, ["k"])) == [("changed", 1), ("same", 1)]
    random_job = lambda: spark.range(5).withColumn("v", F.rand())
    assert bag(contracts.idempotent(random_job, ["id"]), "state") == [("changed",)]


def test_percent_threshold_reads_the_share(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "n int")
    run = lambda bound: quality.suite({"t": df}, [quality.Check("boundary", "n", "t", quality.out_of_range("n", 1, 9), threshold=bound)]).first()
    assert (run(">50%").measured, run(">50%").status, run(">5%").status, run(">0").measured) == (0.1, "PASSED", "FAILED", 1.0)
