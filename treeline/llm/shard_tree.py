"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A document descends the tree by weighted draws: each child of a node gets ln(u) / weight for a u in (0, 1] that depends on the
document's key and the child's name only, and the largest draw wins. A child's share is its part of the weights, and a change
of weight moves documents only into or out of the subtree whose weight changed. `grown` puts the new shard into a region of its
own, so that no other weight changes and documents move only into the new shard.

Law: `key` (the id and the tree decide). Draws are column expressions; nothing is learned from the data and no row has to meet
another to get its shard. For gapless slots, rows that agree in id, size and checksum are counted by the part of the input they
came from; these counts are dealt by shard and by leading bits of their hash into pieces of about PIECE rows, and running sums
over pieces and within them give each part of a group its first slot. Only rows of one group from one part of the input meet in
a task, so that neither a shard nor a group of equal rows is gathered there, however large it is. The rows are written as a
durable table before they are counted, so that a row keeps its part when a lost task is done again.

Defined results: a null id is the key "null"; a null text has size EXTRA and the checksum of an empty text; rows that agree in
id, size and checksum are interchangeable and get neighbouring slots; an empty table gives an empty result; an input column with
the name of an output column gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import durable, pieces_for

EXTRA = 8
PIECE = 50_000
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def leaf(shard: int, weight: float = 1.0) -> Node:
    return Node(f"s{shard}", weight, (), shard)


def group(name: str, children: list[Node]) -> Node:
    return Node(name, math.fsum(c.weight for c in children), tuple(children))


def tree(regions: int = 3, racks: int = 2, shards: int = 4) -> Node:
    """A balanced tree of regions x racks x shards, each shard of weight 1, shards numbered from 0 in order."""
    number = iter(range(regions * racks * shards))
    return group("root", [group(f"r{r}", [group(f"r{r}k{k}", [leaf(next(number)) for _ in range(shards)]) for k in range(racks)]) for r in range(regions)])


def leaves(node: Node) -> list[Node]:
    return [node] if not node.children else [x for c in node.children for x in leaves(c)]


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and a rack of its own."""
    n = len(leaves(root))
    return group(root.name, [*root.children, group(f"r+{n}", [group(f"r+{n}k0", [leaf(n, weight)])])])


def with_shard(df: DataFrame, key: str, root: Node, name: str) -> DataFrame:
    """Adds the shard of the key column as name, descending one level at a time.

    The nodes of a level stand in one constant array; a row looks up its node's children there and draws among them.
    """
    level = [root]
    df = df.withColumn(name, F.lit(0))
    while any(n.children for n in level):
        below = [c for n in level for c in (n.children or (n,))]
        at, rows = 0, []
        for n in level:
            own = n.children or (n,)
            rows.append("array(" + ", ".join(f"named_struct('n', '{c.name}', 'w', {c.weight!r}D, 'at', {at + i})" for i, c in enumerate(own)) + ")")
            at += len(own)
        u = f"(cast(conv(substr(md5(concat(`{key}`, '/', c.n)), 1, {DRAW_DIGITS}), 16, 10) AS bigint) + 1) / {float(16**DRAW_DIGITS)!r}D"
        best = f"array_max(transform(array({', '.join(rows)})[`{name}`], c -> named_struct('d', ln({u}) / c.w, 'at', -c.at))).at"
        df = df.withColumn(name, -F.expr(best))
        level = below
    return df.withColumn(name, F.expr(f"array({', '.join(str(n.shard) for n in level)})[`{name}`]"))


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", root: Node | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """All rows, with size, text_crc32, law, shard, slot and grown_shard; of the input columns those in keep, all where it is None."""
    root = root or tree()
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    out = docs.drop(*[c for c in docs.columns if c.lower() in added])
    kept = [c for c in out.columns if keep is None or c in keep]
    out = out.withColumns({"__id": F.col(id_col), "__key": F.coalesce(F.col(id_col).cast("string"), F.lit("null"))})
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = out.withColumns({"size": F.octet_length(text).cast("bigint") + EXTRA, "text_crc32": F.crc32(text), "law": F.lit("key")})
    out = with_shard(with_shard(out, "__key", root, "shard"), "__key", grown(root), "grown_shard")
    order = F.md5(F.concat_ws("|", "__key", F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    out = out.withColumns({"__h": F.conv(F.substring(order, 1, 15), 16, 10).cast("bigint"), "__part": F.spark_partition_id()})
    out = durable(out.select(*[F.col(f"`{c}`") for c in kept], "__id", "__key", "size", "text_crc32", "law", "shard", "grown_shard", "__h", "__part"))
    bits = pieces_for(out.count() // max(1, len(leaves(root))), PIECE)
    same = ["shard", "__h", "__key", "size", "text_crc32", "__part"]
    groups = out.groupBy(*same).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__id"))
    groups = groups.withColumn("__piece", F.shiftright("__h", 60 - bits))
    before = Window.unboundedPreceding, -1
    over_pieces = Window.partitionBy("shard").orderBy("__piece").rowsBetween(*before)
    pieces = groups.groupBy("shard", "__piece").agg(F.sum("__n").alias("__n"))
    pieces = pieces.select("shard", "__piece", F.coalesce(F.sum("__n").over(over_pieces), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("shard", "__piece").orderBy("__h", "__id", "size", "text_crc32", "__key", "__part").rowsBetween(*before)
    earlier = groups.withColumn("__earlier", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    first = earlier.join(pieces, ["shard", "__piece"]).select(*same, (F.col("__first") + F.col("__earlier")).alias("__from"))
    number = F.row_number().over(Window.partitionBy(*same).orderBy("__part"))
    out = out.join(first, same).withColumn("slot", F.col("__from") + number - 1)
    return out.select(*[F.col(f"`{c}`") for c in kept], *added)
