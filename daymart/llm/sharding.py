"""Sharding by a weighted hash tree: a document descends region, rack and shard by weighted draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import StageArea
from .common import body, column

#: documents of one shard are numbered in this many independent pieces
PIECES = 1024


@dataclass(frozen=True)
class HashTree:
    """``nodes`` maps an inner node to its (child, weight) pairs; leaves are ``shard-<k>``.

    An inner node's weight is the sum below it, so shares follow the shard weights. If one weight changes, draws
    change only on the path from the root to it: documents enter or leave the nodes on that path and stay put
    elsewhere.
    """

    nodes: tuple[tuple[str, tuple[tuple[str, float], ...]], ...]
    depth: int = 3

    @staticmethod
    def regular(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2, weights: dict[int, float] | None = None) -> HashTree:
        """Fill racks with shards and regions with racks, in order. Trees of different counts are different trees: to add
        shards to one that is in use, let it grow."""
        if shards < 1:
            raise ValueError("at least one shard is needed")
        children: dict[str, dict[str, float]] = {}
        for k in range(shards):
            w = (weights or {}).get(k, 1.0)
            rack = k // shards_per_rack
            path = ["root", f"region-{rack // racks_per_region}", f"rack-{rack}", f"shard-{k}"]
            for up, down in zip(path, path[1:]):
                kids = children.setdefault(up, {})
                kids[down] = kids.get(down, 0.0) + w
        return HashTree(tuple((up, tuple(kids.items())) for up, kids in children.items()))

    def grown(self, weight: float = 1.0) -> HashTree:
        """This tree with one more shard. It gets a rack and a region of its own, so the weight of no other node changes
        and documents move into the new shard only, whatever the count was."""
        names = {kid for _, kids in self.nodes for kid, _ in kids}
        new = {kind: f"{kind}-{max(int(n.rsplit('-', 1)[1]) for n in names if n.startswith(kind)) + 1}" for kind in ("region", "rack", "shard")}
        nodes = tuple((up, (*kids, (new["region"], weight)) if up == "root" else kids) for up, kids in self.nodes)
        return HashTree((*nodes, (new["region"], ((new["rack"], weight),)), (new["rack"], ((new["shard"], weight),))), self.depth)

    def place(self, key: Column) -> Column:
        """The shard number of a key: at each node the child with the least exponential draw divided by weight wins."""
        tree = F.create_map(
            *[x for up, kids in self.nodes for x in (F.lit(up), F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in kids]))]
        )

        def draw(kid: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, kid["child"]), 11).cast("double") + 0.5) / float(1 << 53)
            return F.struct((-F.ln(u) / kid["weight"]).alias("score"), kid["child"].alias("child"))

        at: Column = F.lit("root")
        for _ in range(self.depth):
            at = F.array_min(F.transform(F.element_at(tree, at), draw))["child"]
        return F.substring_index(at, "-", -1).cast("int")


def _placed(docs: DataFrame, tree: HashTree, grown: HashTree, id_col: str, text_col: str, keep: dict[str, Column]) -> DataFrame:
    text = body(text_col)
    rows = docs.select(
        *[c.alias(n) for n, c in keep.items()],
        column(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return rows.select(
        "*",
        tree.place(F.col("doc_id")).alias("shard"),
        grown.place(F.col("doc_id")).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PIECES)).cast("int").alias("piece"),
    )


def _slots(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """Rows counted within their shard from 0: the rows of the pieces before, then the place in the piece."""
    before = (
        slim.groupBy("shard", "piece")
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n"))
        .select("shard", "piece", "base")
    )
    inside = Window.partitionBy("shard", "piece").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    joined = rows.join(F.broadcast(before), ["shard", "piece"])  # at most shards x PIECES rows
    return joined.withColumn("slot", (F.col("base") + F.row_number().over(inside) - 1).cast("long"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tree: HashTree | None = None, grown: HashTree | None = None) -> DataFrame:
    """Shard, slot and size of every document.

    ``doc_id`` and the tree decide the shard (law ``key``), so equal ids, null ids among them, share a shard.
    ``grown_shard`` is the shard in the tree grown by one shard, which takes rows only into the new one. Slots count the rows of a shard from 0 without gaps,
    in the order of hash piece (of id and text, so rows of one id are spread) and id; repeated rows take slots of their own. Null text has size 1, as empty text.
    An empty table gives an empty result. Other columns are ignored.
    """
    tree = tree or HashTree.regular(shards)
    placed = _placed(docs, tree, grown or tree.grown(), id_col, text_col, {})
    rows = StageArea(docs.sparkSession, "sharding").save(placed, "placed")
    return _slots(rows, rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tree: HashTree | None = None) -> DataFrame:
    """``docs`` with all columns and their ``shard`` and ``slot``, numbered as by ``shard``."""
    tree = tree or HashTree.regular(shards)
    own = docs.columns
    slim = _placed(docs, tree, tree, id_col, text_col, {})
    rows = _placed(docs, tree, tree, id_col, text_col, {f"c{i}": column(c) for i, c in enumerate(own)})
    return _slots(rows, slim).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "shard", "slot")
