"""Exact deduplication by an extendible-hash index on shared files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import StageArea
from .common import body, column

#: keys that a bucket holds before it splits, at least
BUCKET_KEYS = 2048
#: bits of the directory of a small index; it deepens with the distinct keys, so a bucket never grows with the data
DEPTH = 12
#: bits up to which the directory (a row per cell, under 1 MB) is broadcast; a deeper one is joined
BROADCAST_DEPTH = 16
#: a key with more than 1 / HOT_SHARE of all rows is hot; there can't be HOT_SHARE of them
HOT_SHARE = 1000
SALTS = 32


def directory(keys: DataFrame, capacity: int, depth: int = DEPTH) -> DataFrame:
    """Bucket of every directory cell (the leading ``depth`` bits of a key).

    The directory starts as one bucket and doubles: wherever a bucket holds more than ``capacity`` keys, one more
    leading bit tells its two halves apart. All doublings are evaluated at once from the cell counts; a cell's bucket
    is its shortest prefix that is not overfull, or the whole cell. ``bucket`` is 1 followed by the prefix's bits.
    Prefixes are counted by sums, so no task sees all cells, and each cell meets only the few prefixes of its bucket.
    """
    cells = keys.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("cell")).agg(F.count("*").alias("n"))
    prefixes = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {depth} - bits)")
    )
    held = prefixes.groupBy("bits", "prefix").agg(F.sum("n").alias("n"))
    fits = held.filter((F.col("n") <= capacity) | (F.col("bits") == depth)).select("bits", "prefix")
    # of nested prefixes that fit the shortest one is the bucket
    above = fits.select((F.col("bits") + 1).alias("bits"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    buckets = fits.join(above, ["bits", "prefix"], "left_anti")
    return prefixes.join(buckets, ["bits", "prefix"]).select(
        "cell", F.col("bits").alias("local_depth"), (F.expr("shiftleft(1L, bits)") + F.col("prefix")).alias("bucket")
    )


def depth_for(distinct: int, bucket_keys: int) -> int:
    """Bits that tell a bucket's worth of keys apart four times over, DEPTH at least."""
    return min(48, max(DEPTH, (max(1, distinct) // max(1, bucket_keys)).bit_length() + 2))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    key: Callable[[Column], Column] = F.xxhash64,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """For every row the id that stays among equal texts (the largest), the group's size and the text's SHA-256.

    Keys (64-bit hashes of the text) are counted first; their counts give the directory and the few hot keys. Then
    each bucket, a range of keys, is one task's: it compares the bytes of texts with equal keys and chains those
    that differ. Texts of hot keys are reduced to distinct ones before they are sent. The written index holds one
    entry per distinct text; a text is kept in it only where a chain has several entries.
    Null text counts as empty. Null ids lose against others; a group of null ids has a null keep_id. Rows that
    repeat id and text can't be told apart and share one answer. An empty table gives an empty result.
    ``key`` may be any 64-bit function of the text; collisions cost time and never merge texts.
    """
    area = StageArea(docs.sparkSession, "exact-dedup")
    text = body(text_col)
    rows = docs.select(column(id_col).alias("doc_id"), text.alias("body")).withColumn("h", key(F.col("body")))
    keys, seen = area.save_observed(rows.groupBy("h").agg(F.count("*").alias("n")), "keys", distinct=F.count(F.lit(1)), total=F.coalesce(F.sum("n"), F.lit(0)))
    hot = [r.h for r in keys.filter(F.col("n") > max(1, seen["total"] // HOT_SHARE)).collect()]  # fewer than HOT_SHARE
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)

    depth = depth_for(seen["distinct"], bucket_keys)
    cells = area.save(directory(keys, bucket_keys, depth), "directory").select("cell", "bucket")
    cell = F.shiftrightunsigned("h", 64 - depth).alias("cell")
    placed = rows.select("*", cell).join(F.broadcast(cells) if depth <= BROADCAST_DEPTH else cells, "cell")

    def entries(part: DataFrame) -> DataFrame:
        return part.groupBy("bucket", "h", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))

    chain = Window.partitionBy("bucket", "h")
    index = entries(placed.filter(~is_hot).repartition("bucket"))  # an owner's task compares the bytes of its keys
    if hot:
        index = index.unionByName(entries(placed.filter(is_hot)))  # distinct texts first, then the owner
    index = index.withColumn("chained", F.count("*").over(chain)).withColumn("body", F.when(F.col("chained") > 1, F.col("body")))
    index, links = area.save_observed(index, "index", collided=F.count(F.when(F.col("chained") > 1, True)))

    salt = F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    asked = rows.select("doc_id", "h", salt.alias("salt"), F.sha2("body", 256).alias("text_sha256"))
    single = index.filter(F.col("chained") == 1).drop("body")
    found = asked.join(single.withColumn("salt", F.explode(salts)), ["h", "salt"])
    wanted = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket"]
    found = found.select(*wanted)
    if links["collided"]:  # chains with several entries: the text decides
        several = index.filter(F.col("chained") > 1)
        text_rows = rows.select("doc_id", "h", "body", F.sha2("body", 256).alias("text_sha256"))
        found = found.unionByName(text_rows.join(several, ["h", "body"]).select(*wanted))
    return found
