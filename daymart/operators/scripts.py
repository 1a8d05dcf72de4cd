"""Jobs over a corpus of SQL scripts: DataFrame (script_id, path, sql_text).

A script is one row and is read in place with array functions; only edges, names and
violations leave the row, so nothing is windowed or collected per script.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import as_col
from ..functions.text import count_matches, lines_of
from ..session import StageArea, spread

# Table-name prefixes by warehouse layer, and the shortest such name.
LAYER_PREFIXES = (
    "ods_", "dwd_", "dws_", "dm_", "dim_", "ads_", "tmp_", "sds_", "sd_", "tt_", "ti_", "tb_", "glt_", "pkg_",
)
MIN_TABLE_NAME = 5

# Statement shapes looked for in script text.
TARGET = r"(?i)insert\s+overwrite\s+table\s+(\w+\.\w+)"
SOURCE = r"(?i)\b(?:from|join)\s+([a-zA-Z_]\w*\.\w[\w.]*)"
ALIASED = r"(?i)\b(?:from|join)\s+([a-zA-Z_]\w*\.[a-zA-Z_]\w*)\s+(?:as\s+)?([a-zA-Z_]\w*)\b"
CREATED = r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?(\w+\.\w+)"
INSERTED = r"(?i)\binsert\s+(?:overwrite|into)\s+(?:table\s+)?(\w+\.\w+)"
INSERT_LINE = r"(?i)insert\s+(?:overwrite\s+)?(?:into\s+)?table\s+([A-Za-z0-9_.]+)"
PARTITION_LINE = r"(?i)partition\s*\((.*)$"
PARTITION_WINDOW = 4
ITEM = r"(?i)([\w\(\)\.\s+\-*/]+)\s+as\s+(\w+)"
JOINS = r"(?i)\bjoin\b"
ON_OR_USING = r"(?i)\b(?:on|using)\b"
NOT_ALIASES = (
    "where", "on", "left", "right", "inner", "full", "cross", "join", "group", "order", "union", "having",
    "limit", "lateral", "using", "select", "set", "partition",
)


def bare(sql: Column | str) -> Column:
    """Script text without comments, string literals emptied."""
    c = F.regexp_replace(as_col(sql), r"(?s)/\*.*?\*/", " ")
    # unrolled and possessive: no recursion on long literals
    c = F.regexp_replace(c, r"'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"", "''")
    return F.regexp_replace(c, r"--[^\n]*", " ")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _parts(text: Column, pattern: str, **groups: int) -> Column:
    """Array of structs with the named groups of every match. The text is searched once;
    groups are read from the short matches."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(n) for n, g in groups.items()]),
    )


def _each(df: DataFrame, arr: Column | str, name: str, *keep: str) -> DataFrame:
    """One row per array element. The outer form with a filter behind it keeps the planner
    from pushing a non-empty test, and with it the whole extraction, below the projection."""
    return df.select(*keep, F.explode_outer(arr).alias(name)).where(F.col(name).isNotNull())


def _lowered(names: Column) -> Column:
    return F.array_distinct(F.transform(names, lambda t: F.lower(F.rtrim(t, F.lit(".")))))


def _cleaned(scripts: DataFrame) -> DataFrame:
    """Cleaned once per script, before the extractions read it several times."""
    return spread(scripts.select("script_id", "sql_text"), "script_id").withColumn("_clean", bare("sql_text"))


def targets_and_sources(scripts: DataFrame) -> DataFrame:
    clean = F.col("_clean")
    return _cleaned(scripts).select(
        "script_id",
        _lowered(F.concat(_found(clean, INSERTED), _found(clean, CREATED))).alias("targets"),
        _lowered(_found(clean, SOURCE)).alias("sources"),
    )


def table_lineage(scripts: DataFrame) -> DataFrame:
    """Distinct (script_id, source, target) edges, anchored on FROM and JOIN."""
    pairs = F.flatten(
        F.transform(
            "targets",
            lambda t: F.transform(
                F.filter("sources", lambda s: s != t), lambda s: F.struct(s.alias("source"), t.alias("target"))
            ),
        )
    )
    return _each(targets_and_sources(scripts), pairs, "e", "script_id").select("script_id", "e.source", "e.target")


def column_lineage(scripts: DataFrame) -> DataFrame:
    """(script_id, target, target_field, source_table, source_field) of simple
    ``alias.column as name`` items in the select after the insert."""
    text = F.col("_clean")
    pairs = F.filter(_parts(text, ALIASED, t=1, a=2), lambda p: ~F.lower(p["a"]).isin(*NOT_ALIASES))
    body = F.regexp_extract(text, r"(?is)insert\s+overwrite\s+table\s+\w+\.\w+.*?\bselect\s+(.*?)\s+from\b", 1)
    fields = _parts(body, r"(?i)\b([a-zA-Z_]\w*)\.([a-zA-Z_]\w*)\s+as\s+(\w+)", a=1, f=2, o=3)
    rows = _cleaned(scripts).select(
        "script_id",
        F.lower(F.regexp_extract(text, TARGET, 1)).alias("target"),
        pairs.alias("_p"),
        F.explode(fields).alias("_f"),
    )
    # an alias used twice resolves to its last table
    match = F.filter("_p", lambda p: F.lower(p["a"]) == F.lower("_f.a"))
    return rows.select(
        "script_id",
        "target",
        F.col("_f.o").alias("target_field"),
        F.coalesce(F.lower(F.try_element_at(match, F.lit(-1))["t"]), F.lit("unknown")).alias("source_table"),
        F.col("_f.f").alias("source_field"),
    )


def column_items(scripts: DataFrame) -> DataFrame:
    """(script_id, target, target_field, source_table, source_field) of every ``item as name`` in the select after the
    insert (the first select without one).

    An item with a table's alias in front gives that table and its column; any other item gives itself and
    ``unknown``, and so does an alias that is the name of a CTE.
    """
    text = F.col("_clean")
    inserted = F.regexp_like(text, F.lit(TARGET))
    after = F.when(inserted, F.regexp_extract(text, TARGET + r"(?s)(.*)$", 2)).otherwise(text)
    items = _parts(F.regexp_extract(after, r"(?is)\bselect\s+(.*?)\s+from\b", 1), ITEM, r=1, o=2)
    named = F.filter(_parts(text, ALIASED, t=1, a=2), lambda p: ~F.lower(p["a"]).isin(*NOT_ALIASES))
    tables = F.filter(named, lambda p: ~F.regexp_like(text, F.concat(F.lit(r"(?i)(?:with|,)\s*"), p["a"], F.lit(r"\s+as\s*\("))))
    rows = _cleaned(scripts).select(
        "script_id",
        F.when(inserted, F.lower(F.regexp_extract(text, TARGET, 1))).otherwise("unknown_target").alias("target"),
        tables.alias("_p"),
        F.explode(items).alias("_i"),
    )
    raw = F.regexp_replace("_i.r", r"^\s+|\s+$", "")
    parts = F.split(raw, r"\.")
    match = F.filter("_p", lambda p: (F.size(parts) > 1) & (F.lower(p["a"]) == F.lower(parts[0])))
    table = F.lower(F.try_element_at(match, F.lit(-1))["t"])
    return rows.select(
        "script_id",
        "target",
        F.col("_i.o").alias("target_field"),
        F.coalesce(table, F.lit("unknown")).alias("source_table"),
        F.when(table.isNotNull(), parts[1]).otherwise(raw).alias("source_field"),
    )


def impact(
    spark: SparkSession, edges: DataFrame, start: DataFrame, downstream: bool = True, depth: int | None = None
) -> DataFrame:
    """(table_name, depth): everything reachable from the start tables, nearest depth.

    Breadth first until nothing new is found or ``depth`` is reached. Each level is one
    equi-join from the frontier, written to the shared scratch folder; cycles end because
    known tables never enter a frontier again.
    """
    near, far = ("source", "target") if downstream else ("target", "source")
    stage = StageArea(spark, "impact")
    hops = stage.save(edges.select(F.col(near).alias("near"), F.col(far).alias("far")).distinct(), "hops")
    seen = frontier = stage.save(start.select("table_name").distinct().withColumn("depth", F.lit(0)))
    for level in count(1):
        if depth is not None and level > depth:
            break
        step = (
            hops.join(frontier.select(F.col("table_name").alias("near")), "near", "left_semi")
            .select(F.col("far").alias("table_name"))
            .distinct()
            .join(seen, "table_name", "left_anti")
            .withColumn("depth", F.lit(level))
        )
        frontier, found = stage.save_observed(step, n=F.count(F.lit(1)))
        if not found["n"]:
            break
        seen = seen.unionByName(frontier)
        if level % 16 == 0:  # keep the plan short on deep graphs
            seen = stage.save(seen, f"seen-{level}")
    return seen


@dataclass(frozen=True)
class Rule:
    """Line-local rule: hit pattern, exception pattern, severity, which text it reads."""

    name: str
    severity: str
    pattern: str
    unless: str | None = None
    on_code: bool = False
    keep_comments: bool = False


# The audit rules and the words they look for.
RULES = (
    Rule("select-star", "ERROR", r"(?i)\bselect\s+(?:\w+\.)?\*"),
    Rule(
        "keyword-case", "ERROR",
        r"(?i)^\s*(?:select|from|where|group by|having|order by|left join|right join|inner join|full join|join"
        r"|union all|union|insert overwrite|insert|create table|drop table|with)",
    ),
    Rule("raw-sum", "INFO", r"(?i)\bsum\s*\(\s*[a-z_]", unless=r"(?i)\bsum\s*\(\s*(?:nvl|coalesce|case)"),
    Rule("cte", "ERROR", r"(?i)^\s*with\s+\w+\s+as\b|^\s*with\s*$", keep_comments=True),
    Rule("partition-name", "ERROR", r"(?i)\b(?:cur_date|data_date|riqi)\b", on_code=True),
    Rule("cross-join", "ERROR", r"(?i)\bcross\s+join\b"),
    Rule("unsupported-function", "ERROR", r"(?i)\bnullif\s*\(", on_code=True),
)
UNION_LINES_BEFORE, UNION_LINES_AFTER = 3, 2
STAGE_DB = (
    r"(?i)\bcreate\s+table\s+(?!if\s+not\s+exists\b)(?!external\b)(\w+)\.",
    r"(?i)\bdrop\s+table\s+if\s+exists\s+(\w+)\.",
)


def audit(scripts: DataFrame) -> DataFrame:
    """(script_id, rule, severity, line) of every violation, line numbers from 1."""
    lines = lines_of("sql_text")

    def code(ln: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(ln, r"'[^']*'", "''"), r"--.*$", "")

    def matches(rule: Rule, ln: Column, i: Column) -> Column:
        c = F.regexp_like(code(ln) if rule.on_code else ln, F.lit(rule.pattern))
        if rule.unless:
            c = c & ~F.regexp_like(ln, F.lit(rule.unless))
        if rule.name == "keyword-case":
            c = c & F.regexp_like(F.regexp_extract(ln, rule.pattern, 0), F.lit("[A-Z]"))
        if rule.name == "select-star":
            first = F.greatest(F.lit(0), i + 1 - UNION_LINES_BEFORE)
            near = F.slice("_lines", first + 1, i + 1 + UNION_LINES_AFTER - first)
            c = c & ~F.regexp_like(F.array_join(near, " "), F.lit(r"(?i)\bunion\b"))
        if not rule.keep_comments:
            c = c & ~F.regexp_like(ln, F.lit(r"^\s*--"))
        return c

    def in_wrong_db(ln: Column) -> Column:
        out = F.lit(False)
        for p in STAGE_DB:
            db = F.lower(F.regexp_extract(ln, p, 1))
            out = out | ((db != "") & ~db.startswith("tmp_"))
        return out & ~F.regexp_like(ln, F.lit(r"^\s*--"))

    def violations(ln: Column, i: Column) -> Column:
        found = [
            F.when(matches(r, ln, i), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), (i + 1).alias("line")))
            for r in RULES
        ]
        found.append(
            F.when(in_wrong_db(ln), F.struct(F.lit("stage-db").alias("rule"), F.lit("ERROR").alias("severity"), (i + 1).alias("line")))
        )
        return F.array_compact(F.array(*found))

    return (
        spread(scripts.select("script_id", "sql_text"), "script_id")
        .select("script_id", lines.alias("_lines"))
        .select("script_id", F.explode(F.flatten(F.transform("_lines", violations))).alias("v"))
        .select("script_id", "v.rule", "v.severity", F.col("v.line").cast("bigint").alias("line"))
    )


PARTITION_WORDS = ("inc_day", "day", "data_day")
MANY_TABLES = 5


def risk_flags(scripts: DataFrame) -> DataFrame:
    """Cost risks per script: no WHERE, no partition word, more joins than conditions,
    more than five source tables."""
    clean, low = F.col("_clean"), F.lower("sql_text")
    word = F.lit(False)
    for p in PARTITION_WORDS:
        word = word | F.contains(low, F.lit(p))
    has_where = F.contains(low, F.lit("where"))
    return _cleaned(scripts).select(
        "script_id",
        F.size(_lowered(_found(clean, SOURCE))).cast("bigint").alias("tables"),
        F.when(~has_where, 1).otherwise(0).alias("no_where"),
        F.when(has_where & ~word, 1).otherwise(0).alias("no_partition_word"),
        F.when(count_matches(clean, JOINS) > count_matches(clean, ON_OR_USING), 1).otherwise(0).alias("joins_over_ons"),
    ).withColumn("many_tables", F.when(F.col("tables") > MANY_TABLES, 1).otherwise(0))


# Minutes credited per unit and documents that do not count.
MINUTES = {"line": 0.5, "doc": 20, "graph": 15, "fix": 20}
PLAIN_DOCS = ("README.md", "CHANGELOG.md", "CONTRIBUTING.md")


def productivity(corpus: DataFrame, fixes: int = 0) -> DataFrame:
    """Lines, DDL scripts, documents, graphs, hours saved and a score capped at 100.

    ``corpus`` is (path, kind, text).
    """
    is_sql = (F.col("kind") == "sql") & ~F.contains("path", F.lit("templates"))
    name = F.element_at(F.split("path", "/"), -1)
    is_doc = (F.col("kind") == "md") & ~name.isin(*PLAIN_DOCS) & ~F.regexp_like("path", F.lit(r"\.git|\.venv"))
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.size(lines_of("text")))
    totals = corpus.agg(
        F.coalesce(F.sum(F.when(is_sql, n_lines)), F.lit(0)).alias("sql_lines"),
        F.count_if(is_sql & F.contains(F.upper("text"), F.lit("CREATE TABLE"))).alias("ddl_count"),
        F.count_if(is_doc).alias("doc_count"),
        F.coalesce(F.sum(F.when(is_doc, count_matches("text", "graph TD"))), F.lit(0)).alias("graphs"),
    )
    minutes = (
        F.col("sql_lines") * MINUTES["line"]
        + F.col("doc_count") * MINUTES["doc"]
        + F.col("graphs") * MINUTES["graph"]
        + fixes * MINUTES["fix"]
    )
    return totals.withColumn("hours_saved", F.round(minutes / 60, 1)).withColumn(
        "score", F.least(F.lit(100), F.floor(F.col("hours_saved") / 2)).cast("bigint")
    )


# The structured metric comment and the aggregate calls taken otherwise.
METRIC_COMMENT = r"(?m)--\s*指标[：:]\s*(\w+)\s*[：:]\s*([^|\n]+?)\s*\|\s*([^|\n]+?)(?:\s*\|\s*([^|\n]*?))?(?:\s*\|\s*([^\n]+?))?[ \t]*$"
AGG_CALL = r"(?i)\b(sum|count|avg)\s*\(\s*(?:distinct\s+)?(?:`?\w+`?\.)?`?(\w+)`?\s*\)"


def mine_metrics(scripts: DataFrame) -> DataFrame:
    """(script_id, metric_id, name, expression, filter, unit).

    Structured comments win, the last one per id; scripts without any give their plain
    aggregate calls, the first per id.
    """
    text = F.col("sql_text")

    def metric(id_: Column, name: Column, expression: Column, cond: Column, unit: Column) -> Column:
        return F.struct(
            id_.alias("metric_id"), F.trim(name).alias("name"), F.trim(expression).alias("expression"),
            F.trim(cond).alias("filter"), F.trim(unit).alias("unit"),
        )

    none = F.lit("")
    found = spread(scripts.select("script_id", "sql_text"), "script_id").select(
        "script_id",
        _parts(text, METRIC_COMMENT, i=1, n=2, e=3, f=4, u=5).alias("_noted"),
        _parts(text, AGG_CALL, f=1, c=2, x=0).alias("_called"),
    )
    noted = F.transform("_noted", lambda m: metric(m["i"], m["n"], m["e"], m["f"], m["u"]))
    called = F.transform(
        "_called", lambda m: metric(F.concat(F.lower(m["f"]), F.lit("_"), m["c"]), m["c"], m["x"], none, none)
    )
    chosen = found.select("script_id", F.when(F.size("_noted") > 0, F.reverse(noted)).otherwise(called).alias("_m"))
    first = F.filter(
        "_m", lambda m, i: F.array_position(F.transform("_m", lambda x: x["metric_id"]), m["metric_id"]) == i + 1
    )
    return _each(chosen, first, "m", "script_id").select("script_id", "m.*")


def unknown_tables(scripts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(script_id, table_name) read by a script, not in the catalog and not made by it."""
    used = _each(targets_and_sources(scripts), F.array_except("sources", "targets"), "table_name", "script_id")
    known = catalog.select(F.lower("table_name").alias("table_name")).distinct()
    return used.join(known, "table_name", "left_anti").select("script_id", "table_name")


def find_inserts(scripts: DataFrame, table: str | None = None) -> DataFrame:
    """(script_id, line, table_name, partition) of insert statements; the partition text is
    looked for in the four lines from the insert on."""
    lines = lines_of("sql_text")
    hits = F.filter(
        F.transform("_lines", lambda ln, i: F.struct(i.alias("i"), F.regexp_extract(ln, INSERT_LINE, 1).alias("t"))),
        lambda h: h["t"] != "",
    )
    near = F.filter(
        F.slice("_lines", F.col("h.i") + 1, PARTITION_WINDOW), lambda ln: F.regexp_like(ln, F.lit(PARTITION_LINE))
    )
    found = F.rtrim(F.regexp_extract(F.coalesce(F.try_element_at(near, F.lit(1)), F.lit("")), PARTITION_LINE, 1))
    out = (
        scripts.select("script_id", lines.alias("_lines"))
        .select("script_id", "_lines", F.explode(hits).alias("h"))
        .select(
            "script_id",
            (F.col("h.i") + 1).cast("bigint").alias("line"),
            F.col("h.t").alias("table_name"),
            F.rtrim(F.regexp_replace(found, r"\)$", "")).alias("partition"),
        )
    )
    if table is not None:
        out = out.where(F.lower(F.element_at(F.split("table_name", r"\."), -1)) == table.lower())
    return out


def mine_tables(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, position, table_name) in order of first use.

    A name right of a dot counts when it has a layer prefix, and makes its left part a
    database name, which then never counts as a table; other parts count when they look
    like tables themselves.
    """
    prefix = "^(?:" + "|".join(LAYER_PREFIXES) + ")"

    def table_like(n: Column) -> Column:
        return F.regexp_like(n, F.lit(prefix)) & (F.length(n) >= MIN_TABLE_NAME)

    tokens = _found(F.lower(as_col(text)), r"([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)")
    split = spread(docs.select(key, text), key).select(key, F.transform(tokens, lambda t: F.split(t, r"\.")).alias("_tokens"))

    def marked(parts: Column) -> Column:
        """Parts with flags: right side of a table-like pair, left side of one."""
        return F.transform(
            parts,
            lambda p, i: F.struct(
                p.alias("n"),
                table_like(p).alias("like"),
                ((i > 0) & table_like(p)).alias("right"),
                F.coalesce(table_like(F.get(parts, i + 1)), F.lit(False)).alias("left"),
            ),
        )

    flagged = split.select(key, F.transform("_tokens", marked).alias("_p"))
    dbs = F.transform(F.filter(F.flatten("_p"), lambda p: p["left"]), lambda p: p["n"])
    ordered = F.flatten(
        F.transform(
            "_p",
            lambda parts: F.concat(
                F.filter(parts, lambda p: p["right"]),
                F.filter(parts, lambda p: ~p["right"] & p["like"] & ~F.array_contains(F.col("_dbs"), p["n"])),
            ),
        )
    )
    names = F.array_distinct(F.transform(ordered, lambda p: p["n"]))
    return (
        flagged.withColumn("_dbs", dbs)
        .select(key, F.posexplode(names).alias("position", "table_name"))
        .withColumn("position", (F.col("position") + 1).cast("bigint"))
    )
