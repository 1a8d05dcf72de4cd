"""One query per operator over the shared tables, with the statement that DuckDB can run where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import StageArea
from . import bpe, decontamination, exact, lexical, licenses, mixing, ngram_join, quotations, sharding, suffixes, tokens, toxicity, whitening


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_dedup(_read(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return quotations.format_chats(_read(spark, folder, "conversations"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(_read(spark, folder, "documents"), 200).drop("kept")


def op5_token_output(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    to = StageArea(spark, "token-files").path("out")
    tokens.write(_read(spark, folder, "documents"), to, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokens.read(spark, to, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.report(_read(spark, folder, "documents"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, folder, "documents"), 4, 85)


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_read(spark, folder, "documents"), 8)


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_read(spark, folder, "embeddings"), 16).drop("residual")


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op3_chat_formatting": r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text,
    coalesce(conv_id::VARCHAR, chr(0)) AS c, coalesce(turn, -1)::BIGINT AS t FROM conversations),
l AS (
  SELECT rid, c, t, line, pos, regexp_extract(line, '^(?:[ \t]*>)+') AS marks, len(regexp_replace(marks, '[^>]', '', 'g')) AS level
  FROM (SELECT rid, c, t, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM m)),
n AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY rid ORDER BY pos), 0) AS after FROM l),
kept AS (
  SELECT rid, regexp_replace(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT
    (after > 0 AND regexp_matches(line, '(?i)\b(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*$'))), '^\s*\n|\s+$', '', 'g') AS own
  FROM n GROUP BY rid HAVING max(level) > 0),
o AS (SELECT m.*, CASE WHEN kept.rid IS NULL THEN text ELSE coalesce(own, '') END AS own FROM m LEFT JOIN kept USING (rid)),
passages AS (
  SELECT DISTINCT c, t, trim(regexp_replace(lower(p), '\s+', ' ', 'g'), ' ') AS norm FROM (
    SELECT c, t, unnest(list_concat([own], string_split_regex(own, '\n[ \t]*\n'), string_split(own, chr(10)),
      string_split_regex(cut, '\n[ \t]*\n|\x01'), string_split_regex(cut, '\n|\x01'))) AS p
    FROM (SELECT *, regexp_replace(regexp_replace(own, '([.!?…])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g') AS cut FROM o))),
runs AS (
  SELECT rid, c, t, level, min(pos) AS line, string_agg(trim(substr(line, len(marks) + 1), ' '), chr(10) ORDER BY pos) AS text
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid, level ORDER BY pos) AS run FROM l WHERE level > 0) GROUP BY rid, c, t, level, run),
keys AS (
  SELECT rid, c, t, level, line, rank, rank > n AS part, trim(regexp_replace(lower(p), '\s+', ' ', 'g'), ' ') AS norm FROM (
    SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS rank FROM (
      SELECT *, 1 + len(string_split_regex(text, '\n\n+')) AS n, list_concat([text], string_split_regex(text, '\n\n+'), string_split(text, chr(10)),
        string_split_regex(cut, '\n[ \t]*\n|\x01'), string_split_regex(cut, '\n|\x01')) AS ps
      FROM (SELECT *, regexp_replace(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g') AS cut FROM runs)))),
found AS (
  SELECT k.*, (SELECT max(p.t) FROM passages p WHERE p.c = k.c AND p.norm = k.norm AND p.t < k.t) AS near, f.far
  FROM keys k LEFT JOIN (SELECT norm, min({'c': c, 't': t}) AS far FROM passages GROUP BY norm) f ON f.norm = k.norm AND f.far.c <> k.c WHERE k.norm <> ''),
links AS (
  SELECT rid, c, t, level, line, near, CASE WHEN near IS NULL THEN far END AS far FROM found
  QUALIFY row_number() OVER (PARTITION BY rid, level, line ORDER BY far IS NULL AND near IS NULL, part, near IS NULL, rank) = 1),
answers AS (
  SELECT rid, count(*) AS n_quotes, max(level) AS levels, -(min({'level': level, 'up': -near}) FILTER (near IS NOT NULL)).up AS reply,
    (min({'level': level, 'line': line, 'far': far}) FILTER (far IS NOT NULL)).far AS far FROM links GROUP BY rid),
ups AS (SELECT c, t, max(reply) AS up FROM m JOIN answers USING (rid) WHERE reply IS NOT NULL GROUP BY c, t),
roots AS (
  SELECT DISTINCT c, t, t AS root FROM m WHERE (c, t) NOT IN (SELECT c, t FROM ups)
  UNION ALL SELECT u.c, u.t, r.root FROM roots r JOIN ups u ON u.c = r.c AND u.up = r.t)
SELECT conv_id, turn, role, own AS text, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(levels, 0)::INTEGER AS levels, reply AS reply_turn,
  nullif(far.c, chr(0)) AS quoted_conv, far.t AS quoted_turn, root AS root_turn,
  (row_number() OVER (PARTITION BY c ORDER BY root, t) - 1)::BIGINT AS position, '<|' || coalesce(role, '') || '|>' || chr(10) || own AS chat
FROM o LEFT JOIN answers USING (rid) JOIN roots USING (c, t)""",
    "op7_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
grams AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT rid, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
links AS (
  SELECT x.rid AS a, y.rid AS b FROM grams x JOIN grams y ON x.g = y.g AND x.rid <> y.rid
  JOIN sizes s ON s.rid = x.rid JOIN sizes t ON t.rid = y.rid
  GROUP BY x.rid, y.rid, s.n, t.n HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))),
reach AS (SELECT rid, rid AS other FROM words UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT p.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(q.doc_id) AS component_id
FROM words p LEFT JOIN sizes s USING (rid) JOIN reach r ON r.rid = p.rid JOIN words q ON q.rid = r.other
GROUP BY p.rid, p.doc_id, s.n""",
    "op9_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, source_size * 2.0::DOUBLE AS cap FROM src),
levels AS (
  SELECT *, cap / weight AS ratio,
    (budget - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lev
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    CASE WHEN ratio <= lev THEN cap ELSE max(CASE WHEN ratio > lev THEN lev END) OVER () * weight END AS target FROM levels),
run AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / nullif(t.source_size, 0)) AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (coalesce(whole, 0) * size + greatest(0, least(size, floor(target - coalesce(whole, 0) * source_size) - ahead)))::BIGINT AS taken
FROM run""",
    "op10_decontamination": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM documents),
bench AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bench WHERE len(w) > 0)),
places AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
found AS (SELECT DISTINCT rid, item, p.k, i FROM places p JOIN wins USING (win) WHERE p.k = wins.k),
hit AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS pos FROM found) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)""",
    "op12_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT rid, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM s),
q AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
lengths AS (SELECT rid, doc_id, 25 + (75 * n * docs) // terms AS m FROM s, g),
scores AS (
  SELECT item, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM tf JOIN weights USING (term) JOIN lengths USING (rid) JOIN q USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_toxicity,
        op3_chat_formatting,
        op4_suffix_dedup,
        op5_token_output,
        op6_license_scan,
        op7_ngram_join,
        op8_sharding,
        op9_mixing,
        op10_decontamination,
        op11_whitening,
        op12_lexical_search,
        op13_bpe,
    )
}
