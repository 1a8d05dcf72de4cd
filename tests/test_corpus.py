import random

import numpy as np
from pyspark.sql import functions as F

from daymart.operators import conversations, logs, retrieval, scripts
from daymart.plans import domains, model, semantic
from daymart.sources import tables


def bag(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def corpus(spark, *texts):
    rows = [(i, f"s{i}.sql", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "script_id int, path string, sql_text string")


def test_lineage_ignores_columns_comments_and_strings(spark):
    text = (
        "-- from a.old\n/* join\nb.old */ INSERT OVERWRITE TABLE ads.T1 select x.id as id, 'from c.str' as s\n"
        "from dwd.t2 x left join Dim.t3 y on x.id = y.id join dwd.T2 z on 1=1"
    )
    got = bag(scripts.table_lineage(corpus(spark, text, "select 1")))
    assert got == [(0, "dim.t3", "ads.t1"), (0, "dwd.t2", "ads.t1")]
    cols = bag(scripts.column_lineage(corpus(spark, text)), "target_field", "source_table", "source_field")
    assert cols == [("id", "dwd.t2", "id")]


def test_long_literal_is_no_problem(spark):
    text = "insert overwrite table a.b select '" + "x''y\\'" * 5000 + "' as c from d.e"
    assert bag(scripts.table_lineage(corpus(spark, text))) == [(0, "d.e", "a.b")]


def test_audit_rules(spark):
    text = "\n".join(
        ["SELECT a.* from t", "select x", "union all", "select * from u", "-- select *", "sum(x), sum(nvl(y,0))", "sum( z )", "with c as (", " with ", "where riqi = 'riqi'", "'riqi' -- riqi", "cross  join q", "create table dw.t", "create table if not exists dw.t", "drop table if exists tmp_a.b", "nullif (a, 0)", "insert OVERWRITE table q"]
    )
    got = bag(scripts.audit(corpus(spark, text)), "line", "rule")
    assert got == [
        (1, "keyword-case"), (7, "raw-sum"), (8, "cte"), (9, "cte"), (10, "partition-name"), (12, "cross-join"),
        (13, "stage-db"), (16, "unsupported-function"), (17, "keyword-case"),
    ]


def test_select_star_near_union(spark):
    far = "select * from a\n\n\n\nunion all"
    assert bag(scripts.audit(corpus(spark, far)), "line", "rule") == [(1, "select-star")]


def test_risks(spark):
    bad = "select 1 from a.b join a.c join a.d on 1=1 " + " ".join(f"join x.t{i} on 1=1" for i in range(4))
    assert bag(scripts.risk_flags(corpus(spark, bad, "select 1 from a.b where inc_day='x'"))) == [(0, 7, 1, 0, 1, 1), (1, 1, 0, 0, 0, 0)]


def test_metrics_last_comment_and_first_call_win(spark):
    noted = "-- 指标: gmv: old | sum(a)\n-- 指标：gmv：new | sum(b) | x > 1 | yuan\nselect sum(q)"
    plain = "select SUM(t.`pay`), sum( pay ), count(distinct id), avg(a + b)"
    got = bag(scripts.mine_metrics(corpus(spark, noted, plain)))
    assert got == [
        (0, "gmv", "new", "sum(b)", "x > 1", "yuan"), (1, "count_id", "id", "count(distinct id)", "", ""), (1, "sum_pay", "pay", "SUM(t.`pay`)", "", ""),
    ]


def test_inserts_and_partition_window(spark):
    text = "insert overwrite table a.T\nx\ny\npartition (d = '$[time(yyyyMMdd,-1d)]')\ninsert into table b.u\n\n\n\npartition (d)"
    got = bag(scripts.find_inserts(corpus(spark, text)))
    assert got == [(0, 1, "a.T", "d = '$[time(yyyyMMdd,-1d)]'"), (0, 5, "b.u", "")]
    assert scripts.find_inserts(corpus(spark, text), "t").count() == 1


def test_mined_table_names(spark):
    text = "ods_x.dwd_order and ods_x, dim_city.name http://ads_a.example.com dwd_order tmp_ DWS_Pay"
    got = bag(scripts.mine_tables(corpus(spark, text), "script_id", "sql_text"))
    assert [r[2] for r in got] == ["dwd_order", "dim_city", "ads_a", "dws_pay"]


def test_impact_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    start = spark.createDataFrame([("a",)], "table_name string")
    assert bag(scripts.impact(spark, edges, start)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert bag(scripts.impact(spark, edges, spark.createDataFrame([("d",)], "table_name string"), downstream=False)) == [
        ("a", 3), ("b", 2), ("c", 1), ("d", 0),
    ]


def test_productivity(spark):
    rows = [("a/x.sql", "sql", "create table t\nselect 1\n"), ("a/templates/y.sql", "sql", "select\n1"), ("d/a.md", "md", "graph TD\ngraph TD"), ("README.md", "md", "graph TD")]
    got = scripts.productivity(spark.createDataFrame(rows, "path string, kind string, text string"), fixes=3).first()
    assert tuple(got) == (2, 1, 1, 2, round((1 + 20 + 30 + 60) / 60, 1), 0)


def test_unknown_tables(spark):
    text = "create table tmp_a.t1 as select 1 from dw.known; insert overwrite table ads.z select 1 from tmp_a.t1 join DW.lost on 1=1"
    cat = spark.createDataFrame([("DW.Known",)], "table_name string")
    assert bag(scripts.unknown_tables(corpus(spark, text), cat)) == [(0, "dw.lost")]


# --- retrieval


def test_top_k_tiles_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(60, 8)).round(2)
    vecs[10] = vecs[3]
    vecs[11] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id int, v array<double>")
    norm = np.linalg.norm(vecs, axis=1)
    want = []
    for i in range(60):
        sims = [0.0 if norm[i] * norm[j] == 0 else round(float(vecs[i] @ vecs[j] / norm[i] / norm[j]), 6) for j in range(60)]
        best = sorted(((-s, j) for j, s in enumerate(sims) if s >= 0.1))[:4]
        want += [(i, j, r + 1) for r, (_, j) in enumerate(best)]
    for rows, tile, cells, fan in ((256, 64 << 20, 4_000_000, 64), (3, 100, 50, 2), (1, 1, 1, 3)):
        for name, value in (("BLOCK_ROWS", rows), ("CELLS", cells), ("FAN_IN", fan)):
            monkeypatch.setattr(retrieval, name, value)
        got = bag(retrieval.top_k(df, df, "id", "v", 4, 0.1, tile_bytes=tile), "query_id", "match_id", "rank")
        assert got == sorted(want)
    few = df.where("id < 5")
    got = bag(retrieval.top_k(few, df, "id", "v", 4, 0.1), "query_id", "match_id", "rank")
    assert got == sorted(w for w in want if w[0] < 5)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, []), (4, [2.0, 0.1])], "id int, v array<float>")
    got = bag(retrieval.top_k(df, df, "id", "v", 9), "query_id", "match_id", "rank")
    assert got == [(1, 1, 1), (1, 4, 2), (4, 1, 2), (4, 4, 1)]
    assert retrieval.top_k(df.limit(0), df, "id", "v").collect() == []
    assert retrieval.top_k(df, df.limit(0), "id", "v").collect() == []


def test_components_brute_force(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = dict(bag(retrieval.components(spark, spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {n: find(n) for n in linked}


def test_rare_tokens(spark):
    rows = [(1, "alpha_one common"), (2, "alpha_one beta_two common"), (3, "beta_two common"), (4, "common"), (5, "gamma_x abc"), (6, "beta_two")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert bag(retrieval.group_by_rare_tokens(df, "id")) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 1)]


def test_score_catalog(spark):
    q = spark.createDataFrame([(1, "order 订单量"), (2, "zzz"), (3, "!!")], "id int, text string")
    cat = spark.createDataFrame(
        [("b", "domain", "Orders"), ("a", "domain", "orders"), ("a", "attribute", "订单 量"), ("c", "entity", "reorder")],
        "domain_id string, kind string, text string",
    )
    got = {(r["id"], r["domain_id"]): round(r["score"], 6) for r in retrieval.score_catalog(q, cat, "id").collect()}
    assert got == {(1, "b"): round(3 / 9, 6), (1, "a"): round(4 / 9, 6), (1, "c"): round(2 / 9, 6)}
    assert bag(retrieval.match_domain(retrieval.score_catalog(q, cat, "id"), "id"), "id", "domain_id") == [(1, "a")]


def test_rank_entities(spark):
    q = spark.createDataFrame([(1, "order id of 客户")], "id int, text string")
    e = spark.createDataFrame([("order",), ("reorder",), ("客户表",)], "entity string")
    a = spark.createDataFrame([("order", "order_id", "the id of it"), ("reorder", "x", "id")], "entity string, attribute string, description string")
    got = bag(retrieval.rank_entities(q, e, a, "id"), "entity", "score", "rank")
    assert got == [("order", 3 + 2 + 1, 1), ("reorder", 2, 3), ("客户表", 3, 2)]


def test_search_static_wins(spark):
    s = spark.createDataFrame([(1, "Pay rate", "")], "id int, name string, description string")
    d = spark.createDataFrame([(1, "pay new", ""), (2, "x", "daily PAY")], "id int, name string, description string")
    assert bag(retrieval.search(s, d, "pay"), "id", "name") == [(1, "Pay rate"), (2, "x")]


def test_search_corpus(spark):
    docs = spark.createDataFrame([(1, "ads_order x\n ads_order_detail\nADS_ORDER\n" + "ads_order\n" * 6), (2, "上岗率及效能")], "id int, text string")
    got = bag(retrieval.search_corpus(docs, ["ads_order", "上岗率", "ADS_ORDER "], "id"))
    assert got == [(1, "ads_order", 8, ["ads_order x", "ADS_ORDER", "ads_order", "ads_order", "ads_order"]), (2, "上岗率", 1, ["上岗率及效能"])]


def test_search_terms_are_literal_and_caseless(spark):
    docs = spark.createDataFrame([(1, "合计金额(元)\nCAFÉ au lait"), (2, "金额元 cafe")], "id int, text string")
    got = bag(retrieval.search_corpus(docs, ["金额(元)", "café", "(额", "额"], "id"), "id", "term", "hit_lines")
    assert got == [(1, "café", 1), (1, "金额(元)", 1), (1, "额", 1), (2, "额", 1)]


def test_search_by_kind_of_file(spark):
    files = [
        ("a/x.sql", "insert overwrite table dw.ads_pay partition (inc_day='1')\nselect 1 from t\ninsert overwrite table dw.other\n"),
        ("b/note.md", "about ads_pay\n\n ads_pay again \nnothing"),
        ("c/model.json", '{"t": "ads_pay"}'),
        ("d/readme.txt", "ads_pay"),
    ]
    rows = retrieval.search_files(spark.createDataFrame(files, "path string, text string"), ["ADS_PAY"]).orderBy("path").collect()
    assert [(r.path, r.kind, r.hit_count, r.hits) for r in rows] == [
        ("a/x.sql", "sql", None, None),
        ("b/note.md", "md", 2, ["about ads_pay", "ads_pay again"]),
        ("c/model.json", "json", None, None),
    ]
    assert [(i.line, i.table_name, i.partition) for i in rows[0].inserts] == [(1, "dw.ads_pay", "inc_day='1'")] and rows[2].inserts is None


# --- conversations and logs


def test_truncate_matches_the_loop(spark):
    rng = random.Random(2)
    rows = []
    for c in range(30):
        rows += [(c, t, rng.choice(["user", "assistant", "system"] if t < 2 else ["user", "assistant"]), "w" * rng.randrange(0, 60)) for t in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    budget = 30
    want = []
    for c in range(30):
        conv = [(t, role, len(x) // 4) for cc, t, role, x in rows if cc == c]
        system = sum(n for _, r, n in conv if r == "system")
        others = [(t, n) for t, r, n in conv if r != "system"]
        while others and system + sum(n for _, n in others) > budget:
            others.pop(0)
        kept = {t for t, _ in others} | {t for t, r, _ in conv if r == "system"}
        want += [(c, t, t in kept, system > budget) for t, _, _ in conv]
    for block in (2, 10_000):
        assert bag(conversations.truncate_conv(df, budget, block), "conv_id", "turn", "kept", "over_budget") == sorted(want)


def test_compress(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "user", "d"), (2, 0, "user", "x"), (2, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r["conv_id"], r["section"], r["turn"], r["text"]) for r in conversations.compress_conv(df).orderBy("conv_id", "section", "turn").collect()]
    assert got == [
        (1, "recent", 3, "c"), (1, "recent", 4, "d"), (1, "summary", None, "[历史对话已压缩] 共 2 条消息 （用户 1 条，助手 1 条）。"),
        (1, "system", 0, "s"), (2, "recent", 0, "x"), (2, "recent", 1, "y"),
    ]


def test_log_lines(spark):
    lines = ["x.llm LLM CLI 调用超时，重试", "x.llm 重试 302 Found", "other 重试", "连接失败 降级"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    assert tuple(logs.log_health(df).first()) == (1, 1, 2, 1)
    assert tuple(logs.log_health(df.limit(0)).first()) == (0, 0, 0, 0)


def test_missing_keywords(spark):
    docs = spark.createDataFrame([(1, "k", "has A"), (2, "k", " "), (3, "other", "")], "id int, kind string, text string")
    assert bag(logs.missing_keywords(docs, {"k": ["A", "B"]}, "kind", "id")) == [(1, "k", ["B"])]


# --- models


def test_model_spellings():
    a = model.load_model(
        {"domain_id": "d", "domain_name": "n", "entities": [{"name": "E", "table": "t", "primary_key": ["a", "b"]}],
         "metrics": [{"name": "m", "formula": "sum(x)"}], "relationships": [{"from": "E", "to": "F", "type": "N:1", "condition": "F.y = E.x"}],
         "business_rules": ["one", {"k": 1}]}
    )
    assert (a.name, a.entities["E"].source, a.entities["E"].primary_key, a.metrics["m"].expression) == ("n", "t", "a, b", "sum(x)")
    rel = a.relationships[0]
    assert (rel.cardinality, rel.left_keys, rel.right_keys) == ("N:1", ("x",), ("y",))
    assert a.business_rules == {"rule_1": "one", "rule_2": '{"k": 1}'}
    assert {m.domain_id for m in (domains.orders_model(), domains.activity_model(), domains.stock_model())} == {
        "ecommerce_order", "saas_user_activity", "supply_chain_inventory",
    }


def test_cancelled_orders_are_not_paid(spark):
    df = spark.createDataFrame([("a", "20", 10.0), ("b", "50", 99.0), ("c", "10", 5.0)], "order_id string, order_status string, pay_amount double")
    got = semantic.metric_table(df, domains.orders_model(), ["gmv", "pay_rate", "avg_order_value"], scale=4).first()
    assert tuple(got) == (10.0, 33.3333, 10.0)
    empty = semantic.metric_table(df.limit(0), domains.orders_model(), ["gmv", "pay_rate", "avg_order_value"]).first()
    assert tuple(empty) == (None, None, None)


def test_turnover_ignores_case_and_fanout(spark):
    stock = spark.createDataFrame([("w", 10), ("w", 30)], "k string, stock int")
    moves = spark.createDataFrame([("w", "OUTBOUND", -4), ("w", "outbound", -6), ("w", "inbound", 100)], "k string, movement_type string, q int")
    assert semantic.turnover_days(stock, moves, ["k"], "q", "stock").first()["turnover_days"] == 4.0


# --- tables


def test_catalog_tables(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField("id", T.LongType(), metadata={"comment": "it's the key"}), T.StructField("inc_day", T.StringType())]
    )
    tables.create_table(spark, "dwd_demo_t", schema, location=str(tmp_path / "t"), comment="demo facts")
    got = bag(tables.describe_table(spark, "dwd_demo_t"))
    assert got == [("id", "bigint", "it's the key", False), ("inc_day", "string", "", True)]
    assert ("dwd_demo_t",) in bag(tables.list_tables(spark, keyword="DEMO"), "table_name")
    days = spark.createDataFrame([(1, "20240101"), (2, "20240102")], "id long, inc_day string")
    tables.write_partitions(days, "dwd_demo_t")
    tables.write_partition(spark.createDataFrame([(9,)], "id long"), "dwd_demo_t", "20240102")
    tables.append(spark.createDataFrame([(8, "20240103")], "id long, inc_day string"), "dwd_demo_t")
    assert bag(spark.table("dwd_demo_t")) == [(1, "20240101"), (8, "20240103"), (9, "20240102")]
    from daymart.operators import contracts

    one = tables.scan(spark, "dwd_demo_t", F.col("inc_day") == "20240101")
    assert contracts.unpruned_scans(one) == 0 and contracts.unpruned_scans(spark.table("dwd_demo_t")) == 1
    assert tuple(contracts.scanned_partitions(spark.table("dwd_demo_t"), "inc_day", 2).first()) == (3, True)
    stage = tables.stage(one, "tmp_demo_stage")
    assert bag(stage) == [(1, "20240101")]
    spark.sql("drop table tmp_demo_stage")


def test_scan_corpus(spark, tmp_path):
    for name, body in {"a/x.sql": "select\n1", "a/logs/y.sql": "no", "b c/z.md": "doc", "b c/q.txt": "no", "m.json": "{}"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = bag(tables.scan_corpus(spark, str(tmp_path)), "kind", "text")
    assert got == [("json", "{}"), ("md", "doc"), ("sql", "select\n1")]
