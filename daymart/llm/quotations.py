"""Chat formatting by quotation linking: quoted passages are traced to the messages they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import StageArea
from .common import column

MARKS = r"^(?:[ \t]*>)+"
#: a level-0 line like this right before a quotation belongs to it
ATTRIBUTION = r"(?i)\b(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*$"
NO_CONVERSATION = "\x00"
#: ends of sentences
SENTENCE = r"(?<=[.!?\u2026])\s+|(?<=[\u3002\uFF01\uFF1F])"
#: messages are numbered in pieces of this many turns
PIECE = 1024


def normal(text: Column) -> Column:
    """Lower case, one space for any white space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Quote level, text without marks and the whole of every line."""

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        level = F.length(F.regexp_replace(marks, r"[^>]", ""))
        return F.struct(level.alias("level"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("body"), line.alias("line"))

    return F.transform(F.split(text, r"\r?\n"), parse)


def _own(lines: Column) -> Column:
    """The lines outside quotations, without attributions, joined again."""
    after = F.slice(F.concat(lines, F.array(F.lit(None).cast("struct<level:int,body:string,line:string>"))), 2, F.size(lines))
    pairs = F.arrays_zip(lines.alias("here"), after.alias("next"))
    leads = lambda x: (F.coalesce(x["next"]["level"], F.lit(0)) > 0) & x["here"]["line"].rlike(ATTRIBUTION)
    kept = F.filter(pairs, lambda x: (x["here"]["level"] == 0) & ~leads(x))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["here"]["line"]), "\n"), r"^\s*\n|\s+$", "")


def _sentences(text: Column) -> Column:
    """Sentences, over line ends within a paragraph and of every line by itself."""
    return F.concat(F.split(text, r"\n[ \t]*\n|" + SENTENCE), F.split(text, r"\n|" + SENTENCE))


def _norms(pieces: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(pieces, normal)), lambda p: p != "")


def _passages(text: Column) -> Column:
    """The text as a whole, its paragraphs, its lines and its sentences, normalised."""
    return _norms(F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, r"\n"), _sentences(text)))


def quoted(messages: DataFrame) -> DataFrame:
    """Quoted passages: maximal runs of lines of one level, with their keys: the whole, then paragraphs, then as parts
    lines and sentences."""
    lines = messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>")).select("c", "t", "h", F.posexplode(_lines(F.col("text"))).alias("at", "x"))
    lines = lines.select("c", "t", "h", "at", "x.level", "x.body").filter("level > 0").distinct()
    run = F.col("at") - F.row_number().over(Window.partitionBy("c", "t", "h", "level").orderBy("at"))
    runs = lines.withColumn("run", run).groupBy("c", "t", "h", "level", "run").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("x"))
    text = F.array_join(F.transform("x", lambda p: F.trim(p["body"])), "\n")
    runs = runs.withColumn("text", text)
    whole = _norms(F.concat(F.array(F.col("text")), F.split("text", r"\n\n+")))
    parts = F.array_except(_norms(F.concat(F.split("text", r"\n"), _sentences(F.col("text")))), whole)
    keys = F.concat(*[F.transform(k, lambda p, part=part: F.struct(F.lit(part).alias("part"), p.alias("norm"))) for k, part in ((whole, False), (parts, True))])
    return runs.select("c", "t", "h", "level", F.element_at("x", 1)["at"].alias("line"), keys.alias("keys")).filter(F.size("keys") > 0)


def _key(norm: Column) -> tuple[Column, Column]:
    """128 bits that stand for a normalised passage."""
    return F.xxhash64(norm).alias("k1"), F.xxhash64(F.lit(1), norm).alias("k2")


def passages_asked_for(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """(c, t, k1, k2) of the messages' passages that some quotation asks for.

    Only hashes leave the text, and those that nobody asks for are dropped by a semi join before anything is shuffled;
    without quotations the messages are not even cut into passages.
    """
    wanted = asked.select("k1", "k2").distinct()
    hashes = F.transform(_passages(F.col("own")), lambda p: F.struct(*_key(p)))
    return messages.select("c", "t", F.explode(hashes).alias("k")).select("c", "t", "k.*").join(wanted, ["k1", "k2"], "left_semi").distinct()


def link(messages: DataFrame, area: StageArea) -> DataFrame:
    """Every quoted passage with the message it comes from: in its conversation the latest earlier one that has the
    passage, else the first in another conversation. The whole passage is tried before its paragraphs, and single lines
    and sentences only where neither is found anywhere. Passages are told apart by 128 bits of their hashes."""
    asked = quoted(messages).select("c", "t", "h", "level", "line", F.posexplode("keys").alias("rank", "x"))
    asked = area.save(asked.select("c", "t", "h", "level", "line", "rank", "x.part", *_key(F.col("x.norm"))), "asked")
    originals = area.save(passages_asked_for(messages, asked), "originals")
    # one window per passage and conversation; equal texts of equal turns were merged before
    steps = asked.select("c", "k1", "k2", "t", F.lit(None).cast("long").alias("source")).unionByName(
        originals.select("c", "k1", "k2", "t", F.col("t").alias("source"))
    )
    earlier = Window.partitionBy("c", "k1", "k2").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    near = steps.distinct().withColumn("near", F.max("source").over(earlier)).filter("source IS NULL AND near IS NOT NULL").select("c", "k1", "k2", "t", "near")
    first = originals.groupBy("k1", "k2").agg(F.min(F.struct("c", "t")).alias("far"))
    found = asked.join(near, ["c", "k1", "k2", "t"], "left").join(first, ["k1", "k2"], "left")
    far = F.when(F.col("near").isNull() & (F.col("far.c") != F.col("c")), F.col("far"))
    found = found.withColumn("far", far).withColumn("rank", F.when(F.coalesce(F.col("near"), F.col("far.t")).isNotNull(), F.col("rank")))
    best = F.min_by(F.struct("near", "far"), F.struct(F.col("rank").isNull(), "part", F.col("near").isNull(), "rank"))
    return found.groupBy("c", "t", "h", "level", "line").agg(best.alias("best")).select("c", "t", "h", "level", "line", "best.near", "best.far")


def _roots(area: StageArea, replies: DataFrame) -> DataFrame:
    """The first message of each reply's thread by pointer jumping: rounds grow with the logarithm of the depth."""
    ups, seen = area.save_observed(replies, None, n=F.count(F.lit(1)))
    moved = seen["n"]
    while moved:
        over = ups.select("c", F.col("t").alias("up"), F.col("up").alias("further"))
        step = ups.join(over, ["c", "up"], "left").select("c", "t", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved"))
        ups, seen = area.save_observed(step, None, n=F.count(F.when(F.col("moved"), True)))
        ups, moved = ups.drop("moved"), seen["n"]
    return ups.select("c", "t", F.col("up").alias("root"))


def _positions(rows: DataFrame) -> DataFrame:
    """Place of each message in its conversation by thread and turn, counted from 0 without holding a conversation."""
    rows = rows.withColumns({"part": F.floor(F.col("root") / PIECE), "piece": F.floor(F.col("t") / PIECE)})
    small = rows.groupBy("c", "part", "root", "piece").agg(F.count("*").alias("n"))
    large = small.groupBy("c", "part").agg(F.sum("n").alias("n"))
    a = large.select("c", "part", (F.sum("n").over(Window.partitionBy("c").orderBy("part")) - F.col("n")).alias("a"))
    b = small.select("c", "part", "root", "piece", (F.sum("n").over(Window.partitionBy("c", "part").orderBy("root", "piece")) - F.col("n")).alias("b"))
    inside = F.row_number().over(Window.partitionBy("c", "part", "root", "piece").orderBy("t", "h")) - 1
    return rows.join(b, ["c", "part", "root", "piece"]).join(a, ["c", "part"]).withColumn("position", F.col("a") + F.col("b") + inside)


def format_chats(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Every message without its quotations, with what it answers and its place in the reply order.

    Lines that begin with ``>`` are quotations, as many levels deep as there are marks. A message answers the source
    of its shallowest linked quotation (the latest source among several). Messages stand by the first message of
    their thread, then by turn, so an answer follows what it answers; a message without a linked quotation starts a
    thread. ``chat`` is the message in chat form. ``quoted_conv`` and ``quoted_turn`` name a source in another
    conversation, which does not order messages.
    Null and empty texts stay as empty messages; null turns stand before all others as turn -1; messages of a null
    conversation form one. Rows that repeat conversation and turn share a place in threads and keep rows of their
    own. Other columns are ignored; an empty table gives an empty result.
    """
    area = StageArea(conversations.sparkSession, "quotations")
    rows = conversations.select(
        column(conv_col).alias("conv_id"),
        column(turn_col).alias("turn"),
        column(role_col).cast("string").alias("role"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"),
    ).select(
        "*",
        F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_CONVERSATION)).alias("c"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("t"),
        F.xxhash64("role", "text").alias("h"),
    )
    has_quote = F.col("text").rlike(r"(?m)^[ \t]*>")
    rows = area.save(rows.withColumn("own", F.when(has_quote, _own(_lines(F.col("text")))).otherwise(F.col("text"))), "messages")
    links = area.save(link(rows, area), "links")

    of = links.groupBy("c", "t", "h").agg(
        F.count("*").alias("n_quotes"),
        F.max("level").alias("levels"),
        F.min(F.when(F.col("near").isNotNull(), F.struct("level", (-F.col("near")).alias("up")))).alias("up"),
        F.min(F.when(F.col("far").isNotNull(), F.struct("level", "line", "far"))).alias("foreign"),
    )
    of = of.select("c", "t", "h", "n_quotes", "levels", (-F.col("up.up")).alias("reply"), F.col("foreign.far").alias("far"))
    replies = of.filter("reply IS NOT NULL").groupBy("c", "t").agg(F.max("reply").alias("up"))
    placed = rows.join(of, ["c", "t", "h"], "left").join(_roots(area, replies), ["c", "t"], "left").withColumn("root", F.coalesce("root", "t"))
    done = _positions(placed)
    no_null = lambda c: F.when(F.col(c) != NO_CONVERSATION, F.col(c))
    return done.select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("levels", F.lit(0)).cast("int").alias("levels"),
        F.col("reply").alias("reply_turn"),
        no_null("far.c").alias("quoted_conv"),
        F.col("far.t").alias("quoted_turn"),
        F.col("root").alias("root_turn"),
        F.col("position").cast("long").alias("position"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own")).alias("chat"),
    )
