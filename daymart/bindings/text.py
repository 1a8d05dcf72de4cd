"""Retrieval, similarity, text and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine, hash_vector
from ..operators import conversations as C
from ..operators import retrieval as R
from ..session import spread
from . import bind
from .frames import LOGS, log_lines, table

CJK = r"[\x{4e00}-\x{9fff}]"


def kw_sql(source: str, key: str, text: str) -> str:
    """(key, keyword): ASCII words of two letters or more and CJK bigrams."""
    return rf"""(SELECT DISTINCT {key}, keyword FROM (
      SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z]+')) AS keyword FROM {source}
      UNION ALL SELECT {key}, substr(run, i, 2) FROM (SELECT {key}, run, unnest(range(1, length(run))) AS i FROM
        (SELECT {key}, unnest(regexp_extract_all({text}, '{CJK}{{2,}}')) AS run FROM {source}))) WHERE length(keyword) >= 2)"""


@bind(
    "k1_keywords",
    "keyword:s docs:i",
    f"SELECT keyword, count(*) AS docs FROM {kw_sql('documents', 'doc_id', 'text')} GROUP BY 1",
)
def k1(spark, sf):
    kws = R.query_keywords(table(spark, sf, "documents"), "doc_id")
    return kws.groupBy("keyword").agg(F.count(F.lit(1)).alias("docs"))


@bind(
    "k1_keywords_cjk",
    "keyword:s lines:i",
    f"SELECT keyword, count(*) AS lines FROM {kw_sql(f'(SELECT row_number() OVER () AS id, value FROM {LOGS})', 'id', 'value')} GROUP BY 1",
)
def k1c(spark, sf):
    lines = log_lines(spark, sf).select(F.explode(T.keywords("value")).alias("keyword"))
    return lines.groupBy("keyword").agg(F.count(F.lit(1)).alias("lines"))


QUERIES = "(SELECT p_partkey AS query_id, p_type || ' ' || p_name AS text FROM part)"
CATALOG = """(SELECT DISTINCT p_brand AS domain_id, 'domain' AS kind, 3 AS w, p_brand AS text FROM part
  UNION ALL SELECT DISTINCT p_brand, 'entity', 2, p_type FROM part
  UNION ALL SELECT DISTINCT p_brand, 'attribute', 1, p_name FROM part)"""
SCORES = f"""(SELECT query_id, domain_id, least(1.0, CAST(sum(w) AS DOUBLE) / (any_value(n) * 3)) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM {kw_sql(QUERIES, "query_id", "text")}) k
  JOIN {CATALOG} c ON contains(lower(c.text), k.keyword) GROUP BY ALL)"""


def part_queries(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_type", "p_name").alias("text")
    )


def catalog(spark, sf):
    p = table(spark, sf, "part")

    def texts(rows, kind, col):
        return rows.select(F.col("p_brand").alias("domain_id"), F.lit(kind).alias("kind"), F.col(col).alias("text")).distinct()

    return (
        texts(p, "domain", "p_brand")
        .unionByName(texts(p, "entity", "p_type"))
        .unionByName(texts(p, "attribute", "p_name"))
    )


@bind("k2_score_catalog", "query_id:i domain_id:s score:r6", f"SELECT * FROM {SCORES}")
def k2(spark, sf):
    return R.score_catalog(part_queries(spark, sf), catalog(spark, sf), "query_id")


@bind(
    "k2_match_domain",
    "query_id:i domain_id:s score:r6",
    f"SELECT * FROM {SCORES} WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, domain_id) = 1",
)
def k2m(spark, sf):
    return R.best_domains(part_queries(spark, sf), catalog(spark, sf), "query_id")


@bind(
    "k3_rank_entities",
    "query_id:i entity:s score:i rank:i",
    rf"""WITH k AS (SELECT * FROM {kw_sql(QUERIES, "query_id", "text")}),
      e AS (SELECT DISTINCT p_type, unnest(string_split_regex(lower(p_type), '\W+')) AS keyword FROM part),
      t AS (SELECT DISTINCT p_type, p_name, p_brand, unnest(string_split_regex(lower(p_name || ' ' || p_brand), '\W+')) AS keyword FROM part),
      n AS (SELECT query_id, p_type AS entity, 3 * count(*) AS p FROM k JOIN e USING (keyword) GROUP BY ALL),
      a AS (SELECT query_id, p_type AS entity, count(*) + 1 AS p FROM k JOIN t USING (keyword) GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank
      FROM (SELECT query_id, entity, sum(p) AS score FROM (SELECT * FROM n UNION ALL SELECT * FROM a) GROUP BY ALL) QUALIFY rank <= 10""",
)
def k3(spark, sf):
    p = table(spark, sf, "part")
    attributes = p.select(
        F.col("p_type").alias("entity"), F.col("p_name").alias("attribute"), F.col("p_brand").alias("description")
    ).distinct()
    entities = p.select(F.col("p_type").alias("entity")).distinct()
    return R.rank_entities(part_queries(spark, sf), entities, attributes, "query_id")


@bind(
    "k4_rank_metrics",
    "query_id:i metric:s score:i rank:i",
    rf"""WITH k AS (SELECT * FROM {kw_sql(QUERIES, "query_id", "text")}),
      m AS (SELECT p_name AS metric, max(p_type) AS d, 'sum(' || replace(p_name, ' ', '_') || ') / brand' AS e FROM part GROUP BY p_name),
      s AS (SELECT query_id, metric, sum(CASE WHEN regexp_matches(lower(metric), '\b' || keyword || '\b') THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(lower(d), '\b' || keyword || '\b') THEN 1 ELSE 0 END
        + CASE WHEN regexp_matches(lower(e), '\b' || keyword || '\b') THEN 1 ELSE 0 END) AS score FROM k, m GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, metric) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""",
)
def k4(spark, sf):
    metrics = (
        table(spark, sf, "part")
        .groupBy(F.col("p_name").alias("metric"))
        .agg(F.max("p_type").alias("description"))
        .withColumn("expression", F.concat(F.lit("sum("), F.translate("metric", " ", "_"), F.lit(") / brand")))
    )
    return R.rank_metrics(part_queries(spark, sf), metrics, "query_id")


WORD = r"[\p{L}\p{N}_]"


def hit_sql(term: str, text: str) -> str:
    """Case-insensitive hit on Unicode word boundaries."""
    return rf"regexp_matches({text}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])' || {term} || '(?:$|[^\p{{L}}\p{{N}}_])')"


@bind("k5_term_hit", "doc_id:i hit:b", f"SELECT doc_id, {hit_sql('lang', 'text')} AS hit FROM documents")
def k5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.term_hit("lang", "text").alias("hit"))


@bind(
    "k6_search",
    "id:i name:s description:s",
    """SELECT * FROM (SELECT p_partkey AS id, p_name AS name, p_type AS description FROM part WHERE p_size <= 25
      UNION ALL SELECT p_partkey, p_name, p_brand FROM part WHERE p_size > 25)
      WHERE contains(lower(name || chr(10) || description), 'ring') OR contains(lower(name || chr(10) || description), 'ring')""",
)
def k6(spark, sf):
    p = table(spark, sf, "part").withColumnsRenamed({"p_partkey": "id", "p_name": "name"})
    static = p.where("p_size <= 25").select("id", "name", F.col("p_type").alias("description"))
    return R.search(static, p.select("id", "name", F.col("p_brand").alias("description")), "RING")


@bind(
    "k7_cosine",
    "vec_id:i score:r6",
    """SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def k7(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", cosine("embedding", "next").alias("score"))


@bind(
    "k8_top_k",
    "query_id:i match_id:i score:r6 rank:i",
    """SELECT query_id, match_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM
      (SELECT q.vec_id AS query_id, c.vec_id AS match_id,
        round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings c)
      WHERE score >= 0.2 QUALIFY rank <= 5""",
)
def k8(spark, sf):
    e = table(spark, sf, "embeddings")
    return R.top_k(e, e, "vec_id", "embedding", 5, 0.2)


@bind(
    "k9_hash_embedding",
    "conv_id:i turn:i dims:i vector:s norm:r6",
    """WITH h AS (SELECT conv_id, turn, array_to_string(list_transform(range(12), lambda k: sha256(text || ':' || CAST(k * 32 AS VARCHAR))), '') AS hex FROM conversations),
      v AS (SELECT conv_id, turn, list_transform(range(384), lambda j: (CAST('0x' || substr(hex, CAST(j * 2 + 1 AS BIGINT), 2) AS INTEGER) - 128) / 128.0) AS v FROM h),
      n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM v)
      SELECT conv_id, turn, 384 AS dims, array_to_string(list_transform(v, lambda x: CAST(round(x / norm * 1000000) AS BIGINT)), ',') AS vector, 1.0 AS norm FROM n""",
)
def k9(spark, sf):
    from ..functions.vectors import l2_norm

    texts = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    rows = texts.select("conv_id", "turn", hash_vector("text", 384).alias("v"))
    shown = F.array_join(F.transform("v", lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",")
    return rows.select("conv_id", "turn", F.size("v").alias("dims"), shown.alias("vector"), l2_norm("v").alias("norm"))


TERMS = ["the", "Der", "maison", "que", "Été", "über", "金额(元)"]
LINES = r"string_split_regex(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')"
HITS = " UNION ALL ".join(
    rf"""SELECT doc_id, '{t.lower()}' AS term, list_filter({LINES}, lambda x: regexp_matches(x, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){t}(?:$|[^\p{{L}}\p{{N}}_])')) AS hits FROM documents"""
    if t.isascii()
    else f"""SELECT doc_id, '{t.lower()}' AS term, list_filter({LINES}, lambda x: contains(lower(x), '{t.lower()}')) AS hits FROM documents"""
    for t in TERMS
)


@bind(
    "k10_search_corpus",
    "doc_id:i term:s hit_lines:i first_lines:s",
    rf"""SELECT doc_id, term, len(hits) AS hit_lines,
      array_to_string(list_transform(hits[1:5], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ' | ') AS first_lines
      FROM ({HITS}) WHERE len(hits) > 0""",
)
def k10(spark, sf):
    hits = R.search_corpus(table(spark, sf, "documents"), TERMS, "doc_id")
    return hits.withColumn("first_lines", F.array_join("first_lines", " | "))


@bind(
    "k13_rare_token_groups",
    "doc_id:i group_id:i",
    r"""WITH RECURSIVE t AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9_]{3,}'))) AS token FROM documents),
      r AS (SELECT token FROM t WHERE token NOT IN ('select','from','where','group','order','left','cast','round') GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3),
      p AS (SELECT a.doc_id AS s, b.doc_id AS d, count(*) AS n FROM t a JOIN t b USING (token) JOIN r USING (token) WHERE a.doc_id < b.doc_id GROUP BY ALL),
      e AS (SELECT s, d FROM p QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC, s) = 1),
      c AS (SELECT doc_id, doc_id AS root FROM documents WHERE doc_id NOT IN (SELECT d FROM e) UNION ALL SELECT e.d, c.root FROM c JOIN e ON e.s = c.doc_id)
      SELECT doc_id, root AS group_id FROM c""",
)
def k13(spark, sf):
    return R.group_by_rare_tokens(table(spark, sf, "documents"), "doc_id")


# --- text ---------------------------------------------------------------------------


@bind(
    "z1_est_tokens",
    "source:s doc_id:i tokens:i",
    rf"""SELECT 'documents' AS source, doc_id, (length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) * 5 + length(text)) // 4 AS tokens FROM documents
      UNION ALL SELECT 'logs', user_id, sum((length(regexp_replace(value, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) * 5 + length(value)) // 4) FROM {LOGS} GROUP BY 2""",
)
def z1(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("source"), "doc_id", T.est_tokens("text").alias("tokens"))
    logs = log_lines(spark, sf).groupBy(F.col("user_id").alias("doc_id")).agg(F.sum(T.est_tokens("value")).alias("tokens"))
    return docs.unionByName(logs.withColumn("source", F.lit("logs")))


CONV = """(SELECT *, CASE WHEN role = 'system' THEN 0 ELSE length(text) // 4 END AS cost, CASE WHEN role = 'system' THEN length(text) // 4 ELSE 0 END AS sys FROM conversations)"""


@bind(
    "z2_truncate_conversation",
    "conv_id:i turn:i role:s kept:b over_budget:b",
    f"""SELECT conv_id, turn, role, role = 'system' OR sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) + sum(sys) OVER (PARTITION BY conv_id) <= 400 AS kept,
      sum(sys) OVER (PARTITION BY conv_id) > 400 AS over_budget FROM {CONV}""",
)
def z2(spark, sf):
    return C.truncate_conv(table(spark, sf, "conversations"), C.budget_of(18_400), block=4)


@bind(
    "z3_compress_conversation",
    "conv_id:i section:s turn:i role:s text:s",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role <> 'system')
      SELECT conv_id, 'system' AS section, turn, role, text FROM conversations WHERE role = 'system'
      UNION ALL SELECT conv_id, 'recent', turn, role, text FROM o WHERE rn <= 2
      UNION ALL SELECT conv_id, 'summary', NULL, 'system', '[历史对话已压缩] 共 ' || count(*) || ' 条消息 （用户 ' || count(*) FILTER (WHERE role = 'user')
        || ' 条，助手 ' || count(*) FILTER (WHERE role = 'assistant') || ' 条）。' FROM o WHERE rn > 2 GROUP BY conv_id""",
)
def z3(spark, sf):
    return C.compress_conv(table(spark, sf, "conversations"))


def clean_sql(text: str) -> str:
    return rf"""CASE WHEN length({text}) < 500 THEN {text} ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '!\[.*?\]\(.*?\)', '', 'g'),
      '<[^>]+>', '', 'g'), '(?m)(^---\s*\n){{3,}}', E'---\n\n', 'g'), '\n{{3,}}', E'\n\n', 'g') END"""


@bind(
    "z4_clean_text",
    "page_id:i clean:s",
    f"SELECT page_id, {clean_sql('html')} AS clean FROM pages",
)
def z4(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_text("html").alias("clean"))


@bind("z4_clean_documents", "doc_id:i clean:s", f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents")
def z4d(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("clean"))


@bind(
    "z5_names",
    "page_id:i host:s noise:b plain:s",
    r"""SELECT page_id, host, regexp_matches(host, '(aliyuncs|mydocs\.oss|oss-cn-|oss\.)$|\.(aliyuncs|mydocs\.oss|oss-cn-|oss\.)')
        OR len(list_intersect(string_split(host, '.'), ['aliyuncs','mydocs','aliyun','oss','oss-cn','www','http','https','com','cn','net','org','png','jpg','jpeg','gif','pdf','xlsx','csv','html','json'])) > 0 AS noise,
      regexp_replace(replace(path, '-', '\-'), '\\([_\-=`*~])', '\1', 'g') AS plain FROM
      (SELECT page_id, lower(regexp_extract(url, '://([^/]+)', 1)) AS host, regexp_extract(url, '://[^/]+(.*)$', 1) AS path FROM pages)""",
)
def z5(spark, sf):
    host = F.lower(F.regexp_extract("url", "://([^/]+)", 1))
    path = F.regexp_replace(F.regexp_extract("url", "://[^/]+(.*)$", 1), "-", r"\\-")
    return table(spark, sf, "pages").select(
        "page_id", host.alias("host"), T.is_noise(host).alias("noise"), T.unescape_md(path).alias("plain")
    )
