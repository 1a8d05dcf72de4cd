"""Keyword scoring, term search, vector top-k and grouping by rare tokens.

Term matching is done as equi-joins on words, bigrams or substrings, so it shuffles by
term instead of comparing every query with every text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers, keywords, lines_of, match_units, substrings, term_pattern
from ..session import StageArea, spread
from .scripts import find_inserts
from .windows import rank_top

# Weight of one keyword hit per kind of catalog text, and the match bar.
DOMAIN_WEIGHTS = {"domain": 3, "entity": 2, "attribute": 1, "metric": 2}
MATCH_FROM = 0.3


def query_keywords(queries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, keyword), distinct per query."""
    return spread(queries.select(key, text), key).select(key, F.explode(keywords(text)).alias("keyword"))


def _keyword_sets(kws: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Queries that ask for the same keywords share their answer: (key, _class), and (_class, keyword)."""
    sets = kws.groupBy(key).agg(F.sort_array(F.collect_set("keyword")).alias("_set"))
    classes = sets.groupBy("_set").agg(F.min(key).alias("_class"))
    members = sets.join(classes, "_set").select(key, "_class")
    return members, classes.select("_class", F.explode("_set").alias("keyword"))


def _catalog_scores(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(_class, domain_id, score) of the keyword sets."""
    sizes = asked.agg(F.sort_array(F.collect_set(F.length("keyword")))).scalar()
    per_query = asked.groupBy("_class").agg(F.count(F.lit(1)).alias("n_keywords"))
    weight = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in DOMAIN_WEIGHTS.items() for x in kv]), F.col("kind")
    )
    texts = catalog.select("domain_id", weight.alias("w"), "text").withColumn("_sizes", sizes)
    units = texts.select("domain_id", "w", F.explode(substrings("text", "_sizes")).alias("keyword"))
    unit_weight = units.groupBy("keyword", "domain_id").agg(F.sum("w").alias("w"))
    hits = asked.join(unit_weight, "keyword").groupBy("_class", "domain_id").agg(F.sum("w").alias("hits"))
    return hits.join(per_query, "_class").select(
        "_class",
        "domain_id",
        F.least(F.lit(1.0), F.try_divide(F.col("hits").cast("double"), F.col("n_keywords") * 3.0)).alias("score"),
    )


def score_catalog(
    queries: DataFrame, catalog: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """Score of every (query, domain) with a hit.

    ``catalog`` is (domain_id, kind, text). A keyword hits a text that contains it, so
    texts are expanded to their substrings of the keyword lengths that occur (one scalar
    set, bounded by the longest keyword) and joined on equality. Hits are summed per
    (keyword, domain) before queries are joined in; queries with equal keywords are scored once.
    """
    members, asked = _keyword_sets(query_keywords(queries, key, text), key)
    return members.join(_catalog_scores(asked, catalog), "_class").drop("_class")


def match_domain(scores: DataFrame, key: str, bar: float = MATCH_FROM) -> DataFrame:
    """Best domain per query from the bar on; ties keep the first domain id."""
    best = rank_top(scores, [key], [F.desc("score"), F.asc("domain_id")], 1).drop("rank")
    return best.where(F.col("score") >= bar)


def best_domains(queries: DataFrame, catalog: DataFrame, key: str, text: str = "text", bar: float = MATCH_FROM) -> DataFrame:
    """The same from the texts: each keyword set picks its domain before queries are joined in, so the pairs of all
    queries and domains are never made."""
    members, asked = _keyword_sets(query_keywords(queries, key, text), key)
    return members.join(match_domain(_catalog_scores(asked, catalog), "_class", bar), "_class").drop("_class")


def _candidates(asked: DataFrame, points: DataFrame, item: str, n: int) -> DataFrame:
    """(_class, item) pairs that hold the n best items of each keyword set.

    The n best postings of each keyword (its champions) give a score that n items reach: the bar. An item that is no
    champion and shares one keyword with the set can't beat that keyword's champions. So it is enough to look through
    either the keywords without which an item stays below the bar, or all but the most frequent one (an item that
    shares two has another); the set takes what has fewer postings.
    """
    worth = F.col("points") + F.col("bonus")
    facts = points.groupBy("keyword").agg(F.count(F.lit(1)).alias("_df"), F.max(worth).alias("_most"))
    champions = rank_top(points, ["keyword"], [worth.desc(), F.asc(item)], n).drop("rank")
    near = asked.join(champions, "keyword").groupBy("_class", item).agg(_score().alias("_low"))
    reached = rank_top(near, ["_class"], [F.desc("_low")], n).groupBy("_class")
    bar = reached.agg(F.when(F.count(F.lit(1)) == n, F.min("_low")).otherwise(0).alias("_bar"))
    rising = Window.partitionBy("_class").orderBy("_most", F.desc("_df"), "keyword").rowsBetween(Window.unboundedPreceding, 0)
    marked = asked.join(facts, "keyword").join(bar, "_class").select(
        "_class",
        "keyword",
        "_df",
        (F.sum("_most").over(rising) >= F.col("_bar")).alias("_needed"),
        (F.row_number().over(Window.partitionBy("_class").orderBy(F.desc("_df"), "keyword")) > 1).alias("_rarer"),
    )
    cost = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("_df"))).over(Window.partitionBy("_class")), F.lit(0))
    cheaper = F.when(cost("_needed") < cost("_rarer"), F.col("_needed")).otherwise(F.col("_rarer"))
    chosen = marked.withColumn("_look", cheaper).where("_look")
    looked = chosen.select("_class", "keyword").join(points.select("keyword", item), "keyword").select("_class", item)
    return looked.unionByName(near.select("_class", item)).distinct()


def _score() -> Column:
    return (F.sum("points") + F.max("bonus")).cast("bigint")


def _best_items(kws: DataFrame, points: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """Top n items per query by the sum of the points of its keywords, and the largest bonus once.

    ``points`` is (keyword, item, points, bonus), one row per keyword and item. Scores are made for candidates only.
    Keyword sets and points are written first, as several steps read them.
    """
    area = StageArea(kws.sparkSession, "ranking")
    members, asked = (area.save(df) for df in _keyword_sets(kws, key))
    points = area.save(points)
    found = _candidates(asked, points, item, n).join(asked, "_class").join(points, ["keyword", item])
    scores = found.groupBy("_class", item).agg(_score().alias("score"))
    best = rank_top(scores, ["_class"], [F.desc("score"), F.asc(item)], n)
    return members.join(best, "_class").drop("_class")


def entity_points(entities: DataFrame, attributes: DataFrame) -> DataFrame:
    names = entities.select("entity", F.explode(match_units("entity")).alias("keyword"), F.lit(3).alias("p"), F.lit(0).alias("a"))
    # one text per attribute: a keyword found in name and description counts once
    both = F.concat_ws("\n", "attribute", "description")
    attrs = attributes.select("entity", F.explode(match_units(both)).alias("keyword"), F.lit(1).alias("p"), F.lit(1).alias("a"))
    return names.unionByName(attrs).groupBy("keyword", "entity").agg(F.sum("p").alias("points"), F.max("a").alias("bonus"))


def rank_entities(
    queries: DataFrame, entities: DataFrame, attributes: DataFrame, key: str, text: str = "text", n: int = 10
) -> DataFrame:
    """Top entities per query: 3 per keyword in the name, 1 per keyword in an attribute's
    name or description, and 1 more when any attribute matched.

    ``entities`` is (entity), ``attributes`` is (entity, attribute, description).
    """
    return _best_items(query_keywords(queries, key, text), entity_points(entities, attributes), key, "entity", n)


def metric_points(metrics: DataFrame) -> DataFrame:
    def units(col: str, weight: int) -> DataFrame:
        return metrics.select("metric", F.explode(match_units(col)).alias("keyword"), F.lit(weight).alias("p"))

    both = units("metric", 3).unionByName(units("description", 1)).unionByName(units("expression", 1))
    return both.groupBy("keyword", "metric").agg(F.sum("p").alias("points")).withColumn("bonus", F.lit(0))


def rank_metrics(queries: DataFrame, metrics: DataFrame, key: str, text: str = "text", n: int = 10) -> DataFrame:
    """Top metrics per query: 3 per keyword in the name, 1 in the description, 1 in the
    expression. ``metrics`` is (metric, description, expression)."""
    return _best_items(query_keywords(queries, key, text), metric_points(metrics), key, "metric", n)


def search(static: DataFrame, dynamic: DataFrame, word: str, key: str = "id") -> DataFrame:
    """Catalog rows whose name or description holds the word; a static row hides the
    dynamic row of the same id."""
    both = static.unionByName(dynamic.join(static.select(key).distinct(), key, "left_anti"))
    low = F.lower(F.concat_ws("\n", "name", "description"))
    return both.where(low.contains(word.lower()))


def search_corpus(docs: DataFrame, terms: Sequence[str], key: str, text: str = "text", shown: int = 5) -> DataFrame:
    """Term x document hits: number of hit lines and the first few of them.

    The terms are parameters, so each text is read once and matched in place.
    """
    wanted = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))

    def hit(term: str):
        pattern = term_pattern(term) if term.isascii() else "(?iu)" + re.escape(term)
        return F.struct(
            F.lit(term).alias("term"),
            F.filter("_lines", lambda ln: F.regexp_like(ln, F.lit(pattern))).alias("hits"),
        )

    return (
        spread(docs.select(key, text), key)
        .withColumn("_lines", lines_of(text))
        .withColumn("_hit", F.explode(F.array(*[hit(t) for t in wanted])))
        .where(F.size("_hit.hits") > 0)
        .select(
            key,
            "_hit.term",
            F.size("_hit.hits").cast("bigint").alias("hit_lines"),
            F.transform(
                F.slice("_hit.hits", 1, shown), lambda ln: F.regexp_replace(ln, r"^\s+|\s+$", "")
            ).alias("first_lines"),
        )
    )


def search_files(files: DataFrame, terms: Sequence[str], path: str = "path", text: str = "text", shown: int = 5) -> DataFrame:
    """(term, path, kind, hit_count, hits, inserts) of the files that hold a term, by kind of file.

    SQL scripts answer with their inserts into the table of the term's name, notes (``.md``) with their hit lines,
    model files (``.json``) with their path alone; other files are not searched.
    """
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    known = files.select(F.col(path).alias("path"), F.col(text).alias("text"), kind.alias("kind")).where(F.col("kind").isin("sql", "md", "json"))
    found = search_corpus(known, terms, "path", "text", shown).join(known.select("path", "kind"), "path")
    made = find_inserts(known.where("kind = 'sql'").select(F.col("path").alias("script_id"), F.col("text").alias("sql_text")))
    made = made.withColumn("term", F.lower(F.element_at(F.split("table_name", r"\."), -1)))
    inserts = made.groupBy(F.col("script_id").alias("path"), "term").agg(F.array_sort(F.collect_list(F.struct("line", "table_name", "partition"))).alias("inserts"))
    note = F.col("kind") == "md"
    return found.join(inserts, ["path", "term"], "left").select(
        "term", "path", "kind", F.when(note, F.col("hit_lines")).alias("hit_count"), F.when(note, F.col("first_lines")).alias("hits"), "inserts"
    )


# --- vector top-k -------------------------------------------------------------------


#: bytes of vectors on each side of a tile; scores held at once by a task; rows of a block
TILE_BYTES, CELLS, BLOCK_ROWS = 64 << 20, 4_000_000, 256
#: tiles of one query group whose answers are merged first
FAN_IN = 64
BLOCKS = "block bigint, ids binary, vectors binary"
PARTIAL = "query_id bigint, match_id bigint, score double, part int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) to blocks of unit vectors as one matrix each."""
    base, at = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            rows = batch.slice(lo, BLOCK_ROWS)
            m = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            row = [pa.array([base + at]), pa.array([rows.column(0).to_numpy().tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["block", "ids", "vectors"])
            at += 1


def _side(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not table.num_rows:  # a side without rows comes without columns too
        return
    for ids, vectors in zip(table.column(-2).to_pylist(), table.column(-1).to_pylist()):
        ids = np.frombuffer(ids, np.int64)
        yield ids, np.frombuffer(vectors, np.float64).reshape(len(ids), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best scores and their ids, ties by id; fewer columns than k are filled with -inf."""
    n, width = scores.shape
    if width > k:  # only what reaches the k-th score of its row is sorted
        bar = np.partition(scores, width - k, axis=1)[:, width - k]
        row, col = np.nonzero(scores >= bar[:, None])
    else:
        row, col = np.divmod(np.arange(scores.size), max(width, 1))
    s, i = scores[row, col], ids[row, col]
    turn = np.lexsort((i, -s, row))
    row, s, i = row[turn], s[turn], i[turn]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    out, names = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
    out[row[kept], place[kept]], names[row[kept], place[kept]] = s[kept], i[kept]
    return out, names


def _tile(k: int, threshold: float, digits: int):
    """All query blocks against all corpus blocks of a tile."""

    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, corpus: pa.Table) -> pa.Table:
        part = key[1].as_py()
        out = []
        for query_ids, q in _side(queries):
            top = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
            step = max(1, CELLS // len(q))
            for ids, c in _side(corpus):
                for lo in range(0, len(c), step):
                    scores = np.round(q @ c[lo : lo + step].T, digits) + 0.0
                    names = np.broadcast_to(ids[lo : lo + step], scores.shape)
                    top = _best(np.hstack([top[0], scores]), np.hstack([top[1], names]), k)
            good = (top[0] >= threshold) & (top[0] > -np.inf)
            columns = [np.repeat(query_ids, good.sum(axis=1)), top[1][good], top[0][good], np.full(int(good.sum()), part, np.int32)]
            out.append(pa.table(columns, names=["query_id", "match_id", "score", "part"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int32())], names=["query_id", "match_id", "score", "part"])

    return run


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    key: str,
    vec: str,
    k: int = 5,
    threshold: float = 0.0,
    digits: int = 6,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """Exact top-k by cosine for many queries: (query_id, match_id, score, rank).

    Both sides are written once as blocks of unit vectors. Query and corpus blocks are dealt into groups, and every
    pair of groups is a tile that one task multiplies: it holds ``tile_bytes`` of vectors a side and forwards at most
    k rows per query. Tiles of a query are merged ``FAN_IN`` at a time, then together. Scores are compared at
    ``digits`` decimals so that equal vectors tie and fall back to the id. Rows without an id or a vector are left out.
    """
    spark = corpus.sparkSession
    area = StageArea(spark, "top-k")

    def blocks(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
        rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
        saved, seen = area.save_observed(spread(rows).mapInArrow(_pack, BLOCKS), name, n=F.count(F.lit(1)), size=F.sum(F.length("vectors")))
        return saved, int(seen["n"]), int(seen["size"] or 0)

    q, q_blocks, q_bytes = blocks(queries, "queries")
    c, c_blocks, c_bytes = (q, q_blocks, q_bytes) if queries is corpus else blocks(corpus, "corpus")
    slots = spark.sparkContext.defaultParallelism
    q_groups, c_groups = max(1, -(-q_bytes // tile_bytes)), max(1, -(-c_bytes // tile_bytes))
    # a side is sent once per group of the other, so small inputs are cut on both sides to fill the slots
    finer = max(1.0, math.sqrt(2 * slots / (q_groups * c_groups)))
    q_groups, c_groups = min(max(q_blocks, 1), math.ceil(q_groups * finer)), min(max(c_blocks, 1), math.ceil(c_groups * finer))
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = lambda n: F.expr(f"cast(pmod(shiftright(block, 33) + (block & {(1 << 33) - 1}), {n}) as int)")
    left = q.select(group(q_groups).alias("g"), other(c_groups).alias("h"), "ids", "vectors")
    right = c.select(other(q_groups).alias("g"), group(c_groups).alias("h"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    tasks = min(q_groups * c_groups, 16 * slots)
    pairs = left.repartition(tasks, "g", "h").groupBy("g", "h").cogroup(right.repartition(tasks, "g", "h").groupBy("g", "h"))
    best = pairs.applyInArrow(_tile(k, threshold, digits), PARTIAL)
    order = [F.desc("score"), F.asc("match_id")]
    if c_groups > FAN_IN:
        best = rank_top(best.withColumn("part", F.floor(F.col("part") / FAN_IN)), ["query_id", "part"], order, k).drop("rank")
    return rank_top(best.drop("part"), ["query_id"], order, k)


# --- grouping by rare tokens ----------------------------------------------------------

# A token in at most this many items links them.
RARE_AT_MOST = 3


def rare_token_edges(items: DataFrame, key: str, text: str) -> DataFrame:
    """(src, dst) from every item to the earlier one (smaller id) that it shares most rare tokens with; the smallest
    of several.

    A token in more than three items is no anchor. Count, smallest, largest and sum of the
    integer ids name all items of a rare token, so one aggregation with partial sums is
    enough and frequent tokens are reduced before they are shuffled.
    """
    rows = spread(items.select(key, text), key)
    tokens = rows.select(F.col(key).cast("bigint").alias("id"), F.explode(identifiers(text)).alias("token"))
    stats = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("src"), F.max("id").alias("hi"),
        F.sum(F.col("id").cast("decimal(38,0)")).alias("total"),
    )
    middle = (F.col("total") - F.col("src") - F.col("hi")).cast("bigint")
    pair = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    lo, hi = F.col("src"), F.col("hi")
    pairs = F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, middle), pair(lo, hi), pair(middle, hi)))
    rare = stats.where((F.col("n") >= 2) & (F.col("n") <= RARE_AT_MOST))
    shared = rare.select(F.inline(pairs)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("dst").agg(F.min(F.struct((-F.col("n")).alias("n"), "src")).alias("best"))
    return best.select("best.src", "dst")


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of an edge list; the component is its smallest id.

    Alternates large-star and small-star rounds. Each round is an aggregation and an
    equi-join, written to the shared scratch folder so a lost executor costs one round.
    """
    stage = StageArea(spark, "components")
    current = stage.save(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "edges-0")
    last = None
    for i in range(1, max_rounds + 1):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        nxt, mark = stage.save_observed(
            small, f"edges-{i}", n=F.count(F.lit(1)), digest=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        )
        stage.drop(f"edges-{i - 1}")
        current = nxt
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def group_by_rare_tokens(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, group_id): an item joins the group of the earlier item that it shares most rare tokens with, so one shared
    token doesn't chain groups; an item that shares none starts a group. The group is named by its smallest id."""
    found = components(items.sparkSession, rare_token_edges(items, key, text)).withColumnRenamed("id", key)
    return items.select(key).join(found, key, "left").select(key, F.coalesce("component", key).alias("group_id"))
