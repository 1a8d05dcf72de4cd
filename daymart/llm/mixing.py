"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import StageArea
from .common import column

WORD = r"[^\x20\x09-\x0D]+"


def fill(sources: DataFrame, budget: Column, max_epochs: float) -> DataFrame:
    """Targets of ``sources`` (source, weight, source_size) that share ``budget`` by weight.

    A source stops at ``max_epochs`` times its size and what it can't take goes to the others by weight. Sorted by
    size over weight, the full sources are a prefix: a source is full if its cap is not above the level that the
    budget left by those before it reaches.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    return (
        sources.withColumns({"cap": cap, "budget": budget})
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("flat", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("flat") * F.col("weight")))
        .select("source", "weight", "source_size", "target")
    )


#: rows of a plan that are broadcast; a larger plan is joined
PLAN_ROWS = 500_000


def _sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """Source, size, draw (order within the source) and piece (a 4096th of the source) of a row."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return {
        "source": column(source_col).cast("string"),
        "size": F.coalesce(F.regexp_count(column(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long"),
        "draw": draw,
        "piece": F.substring(draw, 1, 3),
    }


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Per source and piece: words before it, its words, whole repetitions and the words that the rest of them takes."""
    pieces = rows.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    sources = pieces.groupBy("source").agg(F.sum("words").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    targets = fill(sources, total, max_epochs)
    before = F.sum("words").over(Window.partitionBy("source").orderBy("piece")) - F.col("words")
    return (
        pieces.withColumn("base", before)
        .alias("p")
        .join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .select(F.col("p.source").alias("of"), F.col("p.piece").alias("at"), "base", "words", "source_size", "target")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
    )


def _with_part(rows: DataFrame) -> DataFrame:
    """Words that each row takes of the rest, in the order of the draws."""
    inside = Window.partitionBy("source", "piece").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead)).cast("long"))


def _of_piece() -> Column:
    return F.col("source").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("at"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes every document: ``whole`` full repetitions and ``part`` words of one more.

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` times all words. A source
    with target t and size s repeats each document floor(t / s) times; the fraction goes to the documents in the
    order of a seeded hash of the id, as full repetitions until the rest ends inside one document, which is taken in
    part. So the words taken of a source are its target rounded down, and a rerun takes the same.
    Null text and text without words have size 0 and take nothing. Repeated rows count as documents of their own;
    an empty table gives an empty result; columns other than id, text and source are ignored.
    """
    sized = _sized(docs, seed, id_col, text_col, source_col)
    rows = docs.select(column(id_col).alias("doc_id"), *[c.alias(n) for n, c in sized.items()])
    rows = StageArea(docs.sparkSession, "mixing").save(rows, "sized")
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken")
    joined = _with_part(rows.join(_plan(rows, weights, share, max_epochs), _of_piece()))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken, F.col("whole").cast("long").alias("whole"), "part")


def repeat(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as ``mix`` takes it. The one document per source that ``mix``
    takes in part stands once more if at least half of it is taken. Pieces that lie wholly before or after a source's
    rest need no order; only the piece in which the rest ends is sorted, so texts are not shuffled for the others."""
    own = docs.columns
    sized = _sized(docs, seed, id_col, text_col, source_col)
    area = StageArea(docs.sparkSession, "mixing")
    slim = area.save(docs.select(*[c.alias(n) for n, c in sized.items()]), "sized")
    plan, seen = area.save_observed(_plan(slim, weights, share, max_epochs), "plan", n=F.count(F.lit(1)))
    plan = F.broadcast(plan) if seen["n"] <= PLAN_ROWS else plan
    kept = [column(c).alias(f"c{i}") for i, c in enumerate(own)]
    rows = docs.select(*kept, column(id_col).alias("doc_id"), *[c.alias(n) for n, c in sized.items()]).join(plan, _of_piece())
    ends_here = (F.col("base") < F.col("rest")) & (F.col("rest") < F.col("base") + F.col("words"))
    clear = rows.filter(~ends_here).withColumn("more", (F.col("base") < F.col("rest")) & (F.col("size") > 0))
    split = _with_part(rows.filter(ends_here)).withColumn("more", (F.col("part") > 0) & (2 * F.col("part") >= F.col("size")))
    both = clear.unionByName(split.drop("part"))
    times = F.when(F.col("size") > 0, F.col("whole") + F.col("more").cast("int")).otherwise(F.lit(0)).cast("int")
    return both.withColumn("times", times).filter("times > 0").select(*[f"c{i}" for i in range(len(own))], F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one")).drop("one").toDF(*own)
