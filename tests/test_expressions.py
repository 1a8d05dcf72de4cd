import hashlib
import math

import pytest
from pyspark.sql import functions as F

from daymart.functions import days, exprs, text, vectors


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, col, **lits):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in lits.items()]).select(col).first()[0]


def test_safe_div(spark):
    df = spark.createDataFrame([(6.0, 3.0), (6.0, 0.0), (6.0, None), (6.0, -2.0)], "n double, d double")
    assert values(df.select(exprs.safe_div("n", "d"), exprs.safe_div("n", "d", 1, positive=True))) == [
        (2.0, 2.0), (None, None), (None, None), (-3.0, None),
    ]


def test_project_refuses_star(spark):
    with pytest.raises(ValueError):
        exprs.project(spark.range(1), ["a.*"])


def test_fill_and_conform(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "a", "2")], "n int, s string, raw string")
    assert values(exprs.fill_defaults(df, ["n", "s"])) == [(0, "", "x"), (1, "a", "2")]
    target = spark.createDataFrame([], "raw bigint, n string").schema
    assert values(exprs.conform(df, target, dirty=True)) == [(None, None), (2, "1")]


def test_enum_and_classes(spark):
    df = spark.createDataFrame([("1",), ("9",), (None,)], "c string")
    assert values(df.select(exprs.decode_enum("c", {"1": "one"}), exprs.decode_enum("c", {"1": "one"}, "?"))) == [
        ("one", "one"), (None, "?"), (None, "?"),
    ]
    rule = exprs.classify({"low": "c < '5'", "one": "c = '1'"}, "rest")
    assert values(df.select(rule)) == [("low",), ("rest",), ("rest",)]


def test_clamp_and_flags(spark):
    df = spark.createDataFrame([(90000,), (10,), (None,)], "s int")
    assert values(exprs.clamp(df, "s", 0, 86400)) == [(86400, 1), (10, 0), (None, 0)]
    flagged = exprs.scenario_flags(df, {"long": "s > 100"})
    assert values(flagged.where(exprs.any_scenario(["long"]))) == [(90000, 1)]


def test_types():
    assert [exprs.fold_type(t) for t in ("VARCHAR", "int", "DECIMAL(18,2)", "Datetime", "blob")] == [
        "string", "bigint", "decimal", "timestamp", "blob",
    ]


def test_days(spark):
    assert days.resolve_macro("d = '$[time(yyyyMMdd,-1d)]' or d >= '$[monday(yyyyMMdd,-1d)]' or '${bizdate}'", "20240103") == (
        "d = '20240103' or d >= '20240101' or '20240103'"
    )
    assert days.resolve_macro("$[time(yyyyMMdd,-30d)]", "20240131") == "20240102"
    with pytest.raises(ValueError):
        days.bounded_until("inc_day", "20240101")
    weeks = spark.createDataFrame([("2024-12-30",), ("2021-01-03",)], "d string").select(days.iso_week(F.to_date("d")))
    assert values(weeks) == [("2025-W01",), ("2020-W53",)]
    assert one(spark, days.previous_day(F.col("d")), d="20240301") == "20240229"


def test_day_range_is_pushed(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet").where(days.ts_between_days("o_orderdate", "19980601", "19980602"))
    assert "GreaterThanOrEqual(o_orderdate" in df._jdf.queryExecution().executedPlan().toString()


def test_tokens(spark):
    df = spark.createDataFrame([("数据abcd",), ("",), (None,), ("x" * 7,)], "t string")
    assert [r[0] for r in values(df.select(text.est_tokens("t")))] == [4, 0, 0, 1]


def test_clean_text(spark):
    body = "a ![i](u) <b>c</b>\n" + "---\n" * 4 + "\n\n\n\nend" + "z" * 500
    got = one(spark, text.clean_text(F.col("t")), t=body)
    assert got == "a  c\n---\n\nend" + "z" * 500
    assert one(spark, text.clean_text(F.col("t")), t="<b>short</b>") == "<b>short</b>"
    assert one(spark, text.clean_text(F.col("t"), min_chars=0), t="<b>short</b>") == "short"


def test_names(spark):
    assert one(spark, text.unescape_md(F.col("t")), t=r"a\_b \= \x") == r"a_b = \x"
    noisy = spark.createDataFrame([("dwd.t_order",), ("www.site.x",), ("a.png",), ("mydocs.oss",)], "n string")
    assert [r[0] for r in values(noisy.select(text.is_noise("n")))] == [False, True, True, True]


def test_terms(spark):
    df = spark.createDataFrame([("border line", "order"), ("the ORDER", "order"), ("上岗率统计", "上岗率"), ("a.b+c", "b+c"), ("abxc", "b.c")], "t string, k string")
    assert [r[0] for r in values(df.select(text.term_hit("k", "t")))] == [False, True, True, True, False]


def test_keywords(spark):
    assert sorted(one(spark, text.keywords(F.col("t")), t="GMV of 订单统计 x")) == ["gmv", "of", "单统", "统计", "订单"]
    got = one(spark, text.match_units(F.col("t")), t="order_id 订单量")
    assert "order_id" in got and "单量" in got and "order" not in got
    assert set(one(spark, text.substrings(F.col("t"), F.array(F.lit(2), F.lit(3))), t="ABC")) == {"ab", "bc", "abc"}


def test_identifiers(spark):
    got = one(spark, text.identifiers(F.col("t")), t="Select order_no, éabcd abc FROM t_order_1")
    assert got == ["order_no", "t_order_1"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([1.0], [-1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in values(df.select(vectors.cosine("a", "b")))] == [1.0, 0.0, -1.0, 0.0]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], df.schema).select(vectors.cosine("a", "b")).collect()


@pytest.mark.parametrize("dim", [5, 32, 70])
def test_hash_vector(spark, dim):
    raw = []
    for i in range(0, dim, 32):
        raw += [(b - 128) / 128 for b in hashlib.sha256(f"héllo:{i}".encode()).digest()][: dim - i]
    norm = math.sqrt(sum(v * v for v in raw))
    got = one(spark, vectors.hash_vector(F.col("t"), dim), t="héllo")
    assert got == pytest.approx([v / norm for v in raw])
