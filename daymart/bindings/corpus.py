"""Script corpus, logs and scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..operators import scripts as S
from . import bind
from .frames import LOGS, SCRIPTS, log_lines, scripts, table

# literals and comments emptied, as the edges must not come from them
CLEAN = rf"(SELECT script_id, path, sql_text, regexp_replace(regexp_replace(sql_text, '''[^'']*''', '''''', 'g'), '--[^\n]*', ' ', 'g') AS c FROM {SCRIPTS})"
SOURCES = rf"(SELECT DISTINCT script_id, lower(unnest(regexp_extract_all(c, '(?i)\b(?:from|join)\s+([a-z_]\w*\.\w+)', 1))) AS source FROM {CLEAN})"
TARGETS = rf"(SELECT DISTINCT script_id, lower(unnest(list_concat(regexp_extract_all(c, '(?i)insert overwrite table (\w+\.\w+)', 1), regexp_extract_all(c, '(?i)create table (\w+\.\w+)', 1)))) AS target FROM {CLEAN})"
EDGES = f"(SELECT script_id, source, target FROM {SOURCES} JOIN {TARGETS} USING (script_id) WHERE source <> target)"


@bind("s1_table_lineage", "script_id:i source:s target:s", f"SELECT * FROM {EDGES}")
def s1(spark, sf):
    return S.table_lineage(scripts(spark, sf))


@bind(
    "s2_column_lineage",
    "script_id:i target:s target_field:s source_table:s source_field:s",
    rf"""WITH b AS (SELECT script_id, c, lower(regexp_extract(c, 'insert overwrite table (\w+\.\w+)', 1)) AS target,
        regexp_extract(c, '(?is)insert overwrite table .*?\bselect\s+(.*?)\s+from\b', 1) AS body FROM {CLEAN}),
      i AS (SELECT script_id, c, target, unnest(regexp_extract_all(body, '\w+\.\w+\s+as\s+\w+')) AS item FROM b)
      SELECT script_id, target, regexp_extract(item, 'as\s+(\w+)', 1) AS target_field,
        coalesce(nullif(lower(regexp_extract(c, '(?i)\b(?:from|join)\s+(\w+\.\w+)\s+' || regexp_extract(item, '^(\w+)', 1) || '\b', 1)), ''), 'unknown') AS source_table,
        regexp_extract(item, '\.(\w+)', 1) AS source_field FROM i""",
)
def s2(spark, sf):
    return S.column_lineage(scripts(spark, sf))


@bind(
    "s2_column_items",
    "script_id:i target:s target_field:s source_table:s source_field:s",
    rf"""WITH b AS (SELECT script_id, c, lower(regexp_extract(c, 'insert overwrite table (\w+\.\w+)', 1)) AS target,
        regexp_extract(c, '(?is)insert overwrite table .*?\bselect\s+(.*?)\s+from\b', 1) AS body FROM {CLEAN}),
      i AS (SELECT script_id, c, target, unnest(regexp_extract_all(body, '(?i)[\w\(\)\.\s+\-*/]+\s+as\s+\w+')) AS item FROM b),
      r AS (SELECT *, regexp_replace(regexp_extract(item, '(?is)^(.*)\s+as\s+\w+$', 1), '^\s+|\s+$', '', 'g') AS raw FROM i),
      t AS (SELECT *, CASE WHEN regexp_matches(raw, '^\w+\.\w+$') THEN lower(regexp_extract(c, '(?i)\b(?:from|join)\s+(\w+\.\w+)\s+' || regexp_extract(raw, '^(\w+)', 1) || '\b', 1)) ELSE '' END AS tbl FROM r)
      SELECT script_id, target, regexp_extract(item, '(\w+)$', 1) AS target_field, CASE WHEN tbl = '' THEN 'unknown' ELSE tbl END AS source_table,
        CASE WHEN tbl = '' THEN raw ELSE regexp_extract(raw, '\.(\w+)', 1) END AS source_field FROM t""",
)
def s2_items(spark, sf):
    return S.column_items(scripts(spark, sf))


START = "dim_demo.dim_small_ring_df"


@bind(
    "s3_impact_downstream",
    "table_name:s depth:i",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM {EDGES}),
      r AS (SELECT '{START}' AS t, 0 AS d UNION SELECT e.target, r.d + 1 FROM r JOIN e ON e.source = r.t WHERE r.d < 30)
      SELECT t AS table_name, min(d) AS depth FROM r GROUP BY 1""",
)
def s3(spark, sf):
    edges = S.table_lineage(scripts(spark, sf))
    start = edges.where(F.col("source") == START).select(F.col("source").alias("table_name"))
    return S.impact(spark, edges, start)


@bind(
    "s3_impact_upstream",
    "table_name:s depth:i",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM {EDGES}),
      r AS (SELECT 'ads_demo.ads_brand_12_di' AS t, 0 AS d UNION SELECT e.source, r.d + 1 FROM r JOIN e ON e.target = r.t WHERE r.d < 30)
      SELECT t AS table_name, min(d) AS depth FROM r GROUP BY 1""",
)
def s3u(spark, sf):
    edges = S.table_lineage(scripts(spark, sf))
    start = edges.where("target = 'ads_demo.ads_brand_12_di'").select(F.col("target").alias("table_name"))
    return S.impact(spark, edges, start, downstream=False)


def _line_rule(rule: str, severity: str, cond: str) -> str:
    return f"SELECT script_id, '{rule}' AS rule, '{severity}' AS severity, line FROM l WHERE NOT starts_with(trim(t), '--') AND ({cond})"


AUDIT = f"""WITH s AS (SELECT script_id, string_split(regexp_replace(sql_text, '\\n$', ''), chr(10)) AS ls FROM {SCRIPTS}),
  u AS (SELECT script_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM s),
  l AS (SELECT *, coalesce(lag(t, 2) OVER w, '') || ' ' || coalesce(lag(t) OVER w, '') || ' ' || t || ' ' || coalesce(lead(t) OVER w, '') || ' ' || coalesce(lead(t, 2) OVER w, '') AS near,
    regexp_replace(regexp_replace(t, '''[^'']*''', '''''', 'g'), '--.*$', '') AS code FROM u WINDOW w AS (PARTITION BY script_id ORDER BY line))
  """ + " UNION ALL ".join(
    [
        _line_rule("select-star", "ERROR", r"regexp_matches(t, '(?i)\bselect\s+(\w+\.)?\*') AND NOT regexp_matches(near, '(?i)\bunion\b')"),
        _line_rule(
            "keyword-case", "ERROR",
            r"regexp_matches(regexp_extract(t, '(?i)^\s*(select|from|where|group by|having|order by|left join|right join|inner join|full join|join|union all|union|insert overwrite|insert|create table|drop table|with)'), '[A-Z]')",
        ),
        _line_rule("raw-sum", "INFO", r"regexp_matches(t, '(?i)\bsum\s*\(\s*[a-z_]') AND NOT regexp_matches(t, '(?i)\bsum\s*\(\s*(nvl|coalesce|case)')"),
        _line_rule("cte", "ERROR", r"regexp_matches(t, '(?i)^\s*with\s+\w+\s+as\b|^\s*with\s*$')"),
        _line_rule("partition-name", "ERROR", r"regexp_matches(code, '(?i)\b(cur_date|data_date|riqi)\b')"),
        _line_rule("cross-join", "ERROR", r"regexp_matches(t, '(?i)\bcross\s+join\b')"),
        _line_rule("unsupported-function", "ERROR", r"regexp_matches(code, '(?i)\bnullif\s*\(')"),
        _line_rule(
            "stage-db", "ERROR",
            r"(regexp_extract(t, '(?i)\bdrop\s+table\s+if\s+exists\s+(\w+)\.', 1) <> '' AND NOT regexp_matches(t, '(?i)exists\s+tmp_'))"
            r" OR (regexp_extract(t, '(?i)\bcreate\s+table\s+(\w+)\.', 1) <> '' AND NOT regexp_matches(t, '(?i)table\s+tmp_'))",
        ),
    ]
)


@bind("s4_audit", "script_id:i rule:s severity:s line:i", AUDIT)
def s4(spark, sf):
    return S.audit(scripts(spark, sf))


@bind(
    "s5_risk_flags",
    "script_id:i tables:i no_where:i no_partition_word:i joins_over_ons:i many_tables:i",
    rf"""SELECT script_id, len(list_distinct(regexp_extract_all(lower(c), '\b(?:from|join)\s+([a-z_]\w*\.\w+)', 1))) AS tables,
      CASE WHEN contains(lower(sql_text), 'where') THEN 0 ELSE 1 END AS no_where,
      CASE WHEN contains(lower(sql_text), 'where') AND NOT contains(lower(sql_text), 'day') THEN 1 ELSE 0 END AS no_partition_word,
      CASE WHEN len(regexp_extract_all(c, '(?i)\bjoin\b')) > len(regexp_extract_all(c, '(?i)\b(on|using)\b')) THEN 1 ELSE 0 END AS joins_over_ons,
      CASE WHEN len(list_distinct(regexp_extract_all(lower(c), '\b(?:from|join)\s+([a-z_]\w*\.\w+)', 1))) > 5 THEN 1 ELSE 0 END AS many_tables FROM {CLEAN}""",
)
def s5(spark, sf):
    return S.risk_flags(scripts(spark, sf))


DOCS = "(SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, 'md' AS kind, text FROM documents)"


@bind(
    "s6_productivity",
    "sql_lines:i ddl_count:i doc_count:i graphs:i hours_saved:r1 score:i",
    f"""WITH a AS (SELECT sum(CASE WHEN kind = 'sql' AND NOT contains(path, 'templates') THEN len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END) AS sql_lines,
        count(*) FILTER (WHERE kind = 'sql' AND NOT contains(path, 'templates') AND contains(upper(text), 'CREATE TABLE')) AS ddl_count,
        count(*) FILTER (WHERE kind = 'md') AS doc_count, sum(CASE WHEN kind = 'md' THEN (length(text) - length(replace(text, 'graph TD', ''))) // 8 END) AS graphs
        FROM (SELECT path, 'sql' AS kind, sql_text AS text FROM {SCRIPTS} UNION ALL SELECT * FROM {DOCS}))
      SELECT *, round((sql_lines * 0.5 + doc_count * 20 + graphs * 15) / 60, 1) AS hours_saved,
        least(100, floor(round((sql_lines * 0.5 + doc_count * 20 + graphs * 15) / 60, 1) / 2)) AS score FROM a""",
)
def s6(spark, sf):
    sql = scripts(spark, sf).select("path", F.lit("sql").alias("kind"), F.col("sql_text").alias("text"))
    docs = table(spark, sf, "documents")
    md = docs.select(
        F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.lit("md").alias("kind"), "text"
    )
    return S.productivity(sql.unionByName(md))


@bind(
    "s7_mine_metrics",
    "script_id:i metric_id:s name:s expression:s filter:s unit:s",
    rf"""WITH n AS (SELECT script_id, unnest(regexp_extract_all(sql_text, '--\s*指标[：:][^\n]*')) AS t, generate_subscripts(regexp_extract_all(sql_text, '--\s*指标[：:][^\n]*'), 1) AS i FROM {SCRIPTS}),
      p AS (SELECT script_id, i, trim(regexp_extract(t, '指标: (\w+)', 1)) AS metric_id, string_split(regexp_replace(t, '^--\s*指标: \w+: ', ''), '|') AS f FROM n),
      c AS (SELECT script_id, metric_id, trim(f[1]) AS name, trim(f[2]) AS expression, coalesce(trim(f[3]), '') AS filter, coalesce(trim(f[4]), '') AS unit
        FROM p QUALIFY row_number() OVER (PARTITION BY script_id, metric_id ORDER BY i DESC) = 1),
      x AS (SELECT script_id, unnest(regexp_extract_all(sql_text, '(?i)\b(?:sum|count|avg)\s*\(\s*(?:\w+\.)?\w+\s*\)')) AS e,
        generate_subscripts(regexp_extract_all(sql_text, '(?i)\b(?:sum|count|avg)\s*\(\s*(?:\w+\.)?\w+\s*\)'), 1) AS i FROM {SCRIPTS} WHERE script_id NOT IN (SELECT script_id FROM c)),
      y AS (SELECT script_id, i, lower(regexp_extract(e, '^(\w+)', 1)) || '_' || regexp_extract(e, '(\w+)\s*\)$', 1) AS metric_id, regexp_extract(e, '(\w+)\s*\)$', 1) AS name, e FROM x)
      SELECT * FROM c UNION ALL SELECT script_id, metric_id, name, e, '', '' FROM y QUALIFY row_number() OVER (PARTITION BY script_id, metric_id ORDER BY i) = 1""",
)
def s7(spark, sf):
    return S.mine_metrics(scripts(spark, sf))


@bind(
    "s8_unknown_tables",
    "script_id:i table_name:s",
    f"""SELECT script_id, source AS table_name FROM {SOURCES} s WHERE source NOT IN (SELECT 'dwd_demo.dwd_' || lower(p_type) || '_order_di' FROM part)
      AND NOT EXISTS (SELECT 1 FROM {TARGETS} t WHERE t.script_id = s.script_id AND t.target = s.source)""",
)
def s8(spark, sf):
    known = table(spark, sf, "part").select(F.concat(F.lit("DWD_demo.dwd_"), F.lower("p_type"), F.lit("_order_di")).alias("table_name"))
    return S.unknown_tables(scripts(spark, sf), known)


@bind(
    "k11_find_inserts",
    "script_id:i line:i table_name:s partition:s",
    f"""WITH s AS (SELECT script_id, string_split(sql_text, chr(10)) AS ls FROM {SCRIPTS}),
      l AS (SELECT script_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM s),
      h AS (SELECT script_id, i, regexp_extract(t, '(?i)insert\\s+overwrite\\s+table\\s+([A-Za-z0-9_.]+)', 1) AS tbl FROM l WHERE regexp_matches(t, '(?i)insert\\s+overwrite\\s+table')),
      p AS (SELECT script_id, i, regexp_extract(t, '(?i)partition\\s*\\((.*)$', 1) AS p FROM l WHERE regexp_matches(t, '(?i)partition\\s*\\('))
      SELECT h.script_id, h.i AS line, tbl AS table_name, coalesce(regexp_replace(arg_min(p.p, p.i), '\\)$', ''), '') AS "partition"
      FROM h LEFT JOIN p ON p.script_id = h.script_id AND p.i BETWEEN h.i AND h.i + 3 GROUP BY ALL""",
)
def k11(spark, sf):
    return S.find_inserts(scripts(spark, sf))


PREFIX = "'^(ods_|dwd_|dws_|dm_|dim_|ads_|tmp_|sds_|sd_|tt_|ti_|tb_|glt_|pkg_)'"


@bind(
    "k12_mine_tables",
    "script_id:i position:i table_name:s",
    rf"""WITH k AS (SELECT script_id, regexp_extract_all(lower(sql_text), '[a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)*') AS ks FROM {SCRIPTS}),
      t AS (SELECT script_id, string_split(unnest(ks), '.') AS ps, generate_subscripts(ks, 1) AS ti FROM k),
      p AS (SELECT script_id, ti, generate_subscripts(ps, 1) AS pi, unnest(ps) AS n, ps FROM t),
      f AS (SELECT *, regexp_matches(n, {PREFIX}) AND length(n) >= 5 AS likes,
        coalesce(regexp_matches(ps[pi + 1], {PREFIX}) AND length(ps[pi + 1]) >= 5, FALSE) AS is_left FROM p),
      d AS (SELECT DISTINCT script_id, n FROM f WHERE is_left),
      o AS (SELECT script_id, n, min((ti, CASE WHEN pi > 1 THEN 0 ELSE 1 END, pi)) AS k FROM f
        WHERE likes AND (pi > 1 OR (script_id, n) NOT IN (SELECT script_id, n FROM d)) GROUP BY ALL)
      SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY k) AS position, n AS table_name FROM o""",
)
def k12(spark, sf):
    return S.mine_tables(scripts(spark, sf), "script_id", "sql_text")


# --- logs ----------------------------------------------------------------------------

COUNTS = """count(*) FILTER (WHERE contains(value, 'LLM CLI 调用超时')) AS timeouts,
  count(*) FILTER (WHERE NOT contains(value, 'LLM CLI 调用超时') AND contains(value, '重试') AND contains(value, '.llm')) AS retries,
  count(*) FILTER (WHERE contains(value, '302 Found') OR contains(value, '连接失败')) AS platform_errors,
  count(*) FILTER (WHERE contains(value, '降级')) AS degradations"""
HEALTH = "timeouts:i retries:i platform_errors:i degradations:i"


@bind("l1_log_health", f"inc_day:s {HEALTH}", f"SELECT inc_day, {COUNTS} FROM {LOGS} GROUP BY 1")
def l1(spark, sf):
    return L.log_health(log_lines(spark, sf), ["inc_day"])


@bind("l2_log_health_stream", HEALTH, f"SELECT {COUNTS} FROM {LOGS}")
def l2(spark, sf):
    from ..session import StageArea
    from ..streaming.logs import log_health_stream, log_health_total

    area = StageArea(spark, "logs")
    lines = log_lines(spark, sf)
    files, out, mark = area.path("files"), area.path("out"), area.path("checkpoint")
    # two runs: the second one reads only the files written after the first
    lines.where("inc_day < '20240115'").select("value").write.text(files + "/run=1")
    log_health_stream(spark, files, out, mark)
    lines.where("inc_day >= '20240115'").select("value").write.text(files + "/run=2")
    log_health_stream(spark, files, out, mark)
    return log_health_total(spark, out)


def append_logs(df, root, encoding):
    """Each period's lines go to the end of its own log file, as its writer would append them."""
    import pyarrow.fs as fs

    def write(batches):
        store, where = fs.FileSystem.from_uri(root)
        store.create_dir(where)
        for batch in batches:
            rows = batch.to_pydict()
            for name, value in zip(rows["name"], rows["value"]):
                with store.open_append_stream(f"{where}/{name}") as f:
                    f.write(value.encode(encoding))
            yield batch.select(["name"])

    per_file = df.withColumn("name", F.concat(F.lit("task."), F.substring("inc_day", 1, 7), F.lit(".log")))
    # blocks of lines, so that no row holds a whole log
    blocks = per_file.groupBy("name", F.crc32("value") % 64).agg(F.concat(F.array_join(F.collect_list("value"), "\n"), F.lit("\n")).alias("value"))
    blocks.select("name", "value").repartition("name").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


@bind(
    "l2_appended_log_stream",
    f"file:s {HEALTH}",
    f"SELECT 'task.' || substr(inc_day, 1, 7) || '.log' AS file, {COUNTS} FROM {LOGS} GROUP BY 1",
)
def l2_appended(spark, sf):
    """Three runs over growing logs: new files, bytes appended in another encoding, nothing new."""
    from ..session import StageArea
    from ..streaming import appended

    area = StageArea(spark, "appended")
    lines = log_lines(spark, sf)
    files, out, mark = area.path("files"), area.path("out"), area.path("checkpoint")
    append_logs(lines.where("inc_day < '20240115'"), files, "utf-8")
    appended.appended_health_stream(spark, files, out, mark, "task.*.log")
    append_logs(lines.where("inc_day >= '20240115'"), files, "gbk")
    appended.appended_health_stream(spark, files, out, mark, "task.*.log")
    appended.appended_health_stream(spark, files, out, mark, "task.*.log")
    return appended.health_by_file(spark, out)


@bind(
    "l2_after_snapshot",
    f"file:s lines:i {HEALTH}",
    f"SELECT 'task.' || substr(inc_day, 1, 7) || '.log' AS file, count(*) AS lines, {COUNTS} FROM {LOGS} WHERE inc_day >= '20240115' GROUP BY 1",
)
def l2_snapshot(spark, sf):
    """What one run added: bytes after a snapshot of the file sizes, and files that are new since."""
    from ..session import StageArea
    from ..streaming import appended

    files = StageArea(spark, "snapshot").path("files")
    lines = log_lines(spark, sf)
    append_logs(lines.where("inc_day < '20240115'"), files, "gbk")
    before = appended.snapshot_offsets(files)
    append_logs(lines.where("inc_day >= '20240115'"), files, "utf-8")
    added = appended.read_appended(spark, files, before, split_bytes=1 << 16)
    return L.log_health(added, ["file"]).join(added.groupBy("file").agg(F.count(F.lit(1)).alias("lines")), "file")


CHECKS = "(SELECT user_id AS case_id, event_type AS name, CASE WHEN event_type = 'error' AND value > 200 THEN 'fail' WHEN event_type = 'view' THEN 'skip' ELSE 'pass' END AS status FROM events)"
FINDINGS = """(SELECT user_id AS case_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS dimension,
  CASE WHEN value > 250 THEN 'Critical' WHEN value > 150 THEN 'Warning' ELSE 'Info' END AS severity FROM events)"""


def checks(spark, sf):
    status = F.when(F.expr("event_type = 'error' AND value > 200"), "fail").when(F.col("event_type") == "view", "skip")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("name"), status.otherwise("pass").alias("status")
    )


def findings(spark, sf):
    severity = F.when(F.col("value") > 250, "Critical").when(F.col("value") > 150, "Warning").otherwise("Info")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("dimension"),
        severity.alias("severity"),
    )


@bind(
    "l3_scorecard",
    "case_id:i checks:i failed:i skipped:i critical:i warning:i passed:b",
    f"""SELECT case_id, checks, failed, skipped, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, failed = 0 AS passed FROM
      (SELECT case_id, count(*) AS checks, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'skip') AS skipped FROM {CHECKS} GROUP BY 1)
      LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE severity = 'Warning') AS warning FROM {FINDINGS} GROUP BY 1) USING (case_id)""",
)
def l3(spark, sf):
    return L.scorecard(checks(spark, sf), findings(spark, sf))


@bind(
    "l3_findings_by_dimension",
    "dimension:s critical:i warning:i",
    f"""SELECT coalesce(dimension, 'general') AS dimension, count(*) FILTER (WHERE severity = 'Critical') AS critical,
      count(*) FILTER (WHERE severity = 'Warning') AS warning FROM {FINDINGS} WHERE severity <> 'Info' GROUP BY 1""",
)
def l3d(spark, sf):
    return L.findings_by_dimension(findings(spark, sf))


@bind(
    "l4_missing_keywords",
    "doc_id:i lang:s missing:s",
    """WITH m AS (SELECT doc_id, lang, list_filter(CASE lang WHEN 'en' THEN ['the', 'and', 'with'] WHEN 'fr' THEN ['que', 'dans'] ELSE [] END,
        lambda r: NOT contains(text, r)) AS missing FROM documents WHERE trim(text) <> '')
      SELECT doc_id, lang, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0""",
)
def l4(spark, sf):
    out = L.missing_keywords(
        table(spark, sf, "documents"), {"en": ["the", "and", "with"], "fr": ["que", "dans"]}, "lang", "doc_id"
    )
    return out.withColumn("missing", F.array_join("missing", ","))
