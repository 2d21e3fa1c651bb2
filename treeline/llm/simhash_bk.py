"""SimHash near-duplicates by BK-trees.

Fingerprints: of a text, with A-Z lower-cased, every 4-word shingle (repeats included; a shorter text is one shingle) is hashed by
XXH64 with seed 42; a bit of the fingerprint is 1 if it is set in over half of the hashes. Two fingerprints that differ in at most
RADIUS bits are linked, and a component is what links connect.

Links: fingerprints are made distinct first, so copies cost nothing further. The 64 bits are cut into RADIUS + 2 blocks; two linked
fingerprints agree in two blocks at least, so each pair of blocks deals the fingerprints into shards in which every link is found in
one shard or more. The blocks only say which shards a fingerprint goes to; within a shard links are found by its BK-tree alone: each child
hangs on its parent by their integer distance, and a search follows only edges within the radius of its own distance to the node. Every search
takes what it finds out of the tree and goes on from there, so that a shard gives the edges of a spanning forest rather than all pairs, and a
dense group of near copies costs little more than its size. Trees are not broadcast: that would gather all fingerprints on the driver; a
shard's tree and its searches meet in one task instead.

A shard with more than MOST fingerprints is dealt again: its other bits are cut into RADIUS + 1 blocks, of which two linked fingerprints share
one. What is still larger than MOST after that, a dense group, is cut into parts, and each two of its parts make a tree of their own: memory
stays bounded and no link is lost.

Components: the forest edges are contracted by alternating large-star and small-star steps on tables of edges, each step written to
the shared folder, until nothing changes. In a large-star step each edge meets what its smaller end has found to be smaller still; least
neighbours are grouped with partial sums and written down, so that both sides of a join are read from files and adaptive execution can split
the partition of a node with very many edges. Links and components stay distributed; the driver sees counts.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; ids may repeat or be null (a null id
never names a component unless all ids in it are null); a very long text is hashed in stretches; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import durable, scratch, with_small_batches, written

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Bits of the blocks; with RADIUS + 2 blocks, RADIUS differing bits leave two blocks equal.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one shard that make one tree.
MOST = 20_000
HASHES = 65_536


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        cut = map(joined.__getitem__, map(slice, starts[at : at + HASHES], stops[at : at + HASHES]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, min(HASHES, n - at))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([signed(fingerprint(t.as_py())) for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp], names=["id", "key", "fp"])


class Tree:
    """A BK-tree that can take values out again."""

    def __init__(self, values: list[int]):
        self.values = values
        self.parent = [-1] * len(values)
        self.below: list[dict[int, int] | None] = [None] * len(values)
        self.left = [1] * len(values)  # values still in the tree, at and below each node
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while True:
                self.left[at] += 1
                d = (values[at] ^ v).bit_count()
                edges = self.below[at]
                if edges is None:
                    edges = self.below[at] = {}
                if d not in edges:
                    edges[d] = i
                    self.parent[i] = at
                    break
                at = edges[d]
        self.here = [True] * len(values)

    def take(self, i: int) -> None:
        self.here[i] = False
        while i >= 0:
            self.left[i] -= 1
            i = self.parent[i]

    def near(self, v: int, radius: int) -> list[int]:
        """The places of values still in the tree within the radius of v."""
        found, todo = [], [0]
        values, below, left, here = self.values, self.below, self.left, self.here
        while todo:
            i = todo.pop()
            if not left[i]:
                continue
            d = (values[i] ^ v).bit_count()
            if d <= radius and here[i]:
                found.append(i)
            edges = below[i]
            if edges:
                for e, child in edges.items():
                    if d - radius <= e <= d + radius:
                        todo.append(child)
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that connect the distinct values exactly as all links within the radius do."""
    tree, edges = Tree(values), []
    for root in range(len(values)):
        if not tree.here[root]:
            continue
        tree.take(root)
        todo = [root]
        while todo:
            at = todo.pop()
            for i in tree.near(values[at], radius):
                tree.take(i)
                edges.append((values[root], values[i]))
                todo.append(i)
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, block, part, fp) sorted by the first three: the forest of each tree's values."""
    mask = (1 << 64) - 1
    shard, values, out = None, [], []

    def drained() -> Iterator[pa.RecordBatch]:
        pairs = [sorted((signed(a), signed(b)), reverse=True) for a, b in out]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for b in batches:
        keys = np.stack([b.column(i).to_numpy() for i in (0, 1, 2)], axis=1)
        fps = b.column(3).to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(keys[s].tolist())
            if now != shard:
                if len(values) > 1:
                    out += forest(values, RADIUS)
                shard, values = now, []
            values += [x & mask for x in fps[s:e].tolist()]
        if len(out) > 10_000:
            yield from drained()
            out = []
    if len(values) > 1:
        out += forest(values, RADIUS)
    yield from drained()


def _cuts() -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    at = np.cumsum((0, *BLOCKS))
    return [(int(a), w) for a, w in zip(at, BLOCKS, strict=False)]


def _bits(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)


def shards(fps: DataFrame) -> DataFrame:
    """(shard, fp): each distinct fingerprint once for each two blocks; the shard names the blocks and their bits."""
    fp, keys = F.col("fp"), []
    for n, ((a, wa), (b, wb)) in enumerate(combinations(_cuts(), 2)):
        keys.append(F.shiftleft(_bits(fp, a, wa), wb).bitwiseOR(_bits(fp, b, wb)).bitwiseOR(F.lit(n << 24)))
    return fps.select(F.explode(F.array(*keys)).alias("shard"), "fp")


def dealt_again(large: DataFrame) -> DataFrame:
    """(shard, block, fp): each row of large shards once for each of RADIUS + 1 blocks of the bits that its shard leaves open."""
    fp, rests = F.col("fp"), []
    for two in combinations(_cuts(), 2):
        rest = F.lit(0).cast("long")
        for at, width in _cuts():
            if (at, width) not in two:
                rest = F.shiftleft(rest, width).bitwiseOR(_bits(fp, at, width))
        rests.append(rest)
    width = -(-(64 - 2 * min(BLOCKS)) // (RADIUS + 1))
    rest = F.element_at(F.array(*rests), F.shiftright("shard", 24).cast("int") + 1)
    blocks = F.array(*[F.shiftleft(F.lit(j + 1).cast("long"), width).bitwiseOR(_bits(F.col("rest"), j * width, width)) for j in range(RADIUS + 1)])
    return large.withColumn("rest", rest).select("shard", F.explode(blocks).alias("block"), "fp")


def links(fps: DataFrame, n: int, most: int = MOST) -> DataFrame:
    """Edges (u > v) that connect the n distinct fingerprints as all links do."""
    dealt = shards(fps).select("shard", F.lit(0).cast("long").alias("block"), "fp")
    if n <= most:  # no shard can hold more
        parts = dealt.withColumn("part", F.lit(0).cast("long"))
    else:
        large = durable(dealt.groupBy("shard").count().filter(F.col("count") > most).select(F.col("shard").alias("ls")))
        marked = dealt.join(large, F.col("shard") == F.col("ls"), "left")
        small = marked.filter(F.col("ls").isNull()).select("shard", "block", "fp", F.lit(0).cast("long").alias("part"))
        again = durable(dealt_again(marked.filter(F.col("ls").isNotNull()).select("shard", "fp")))
        dense = again.groupBy("shard", "block").count().filter(F.col("count") > most)
        dense = durable(dense.select(F.col("shard").alias("ds"), F.col("block").alias("db"), F.ceil(2 * F.col("count") / most).cast("int").alias("cuts")))
        own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        paired = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: (F.least(own, j) * F.col("cuts") + F.greatest(own, j)).cast("long"))
        joined = again.join(dense, (F.col("shard") == F.col("ds")) & (F.col("block") == F.col("db")), "left")
        parts = small.union(joined.select("shard", "block", "fp", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(paired)).alias("part")))
    parts = parts.select("shard", "block", "part", "fp").repartition("shard", "block", "part").sortWithinPartitions("shard", "block", "part")
    return parts.mapInArrow(_forests, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u > v): root is the smallest node that it is connected with."""
    spark = edges.sparkSession
    edges, path = written(edges)
    before = None
    while True:
        with scratch(spark) as gone:
            gone.append(path)
            # The least smaller neighbour of each node that has one; the others are smaller than all their neighbours.
            least = durable(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"))
            large = durable(edges.join(least, F.col("v") == F.col("n"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
            least = durable(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"))
            small = large.join(least, F.col("u") == F.col("n"))
            small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
            edges, path = written(small.filter("u > v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, key, fp) of every row, and (fp, least, root) of every fingerprint: the least id with it and its component's root."""
    ids = docs.schema[id_col].dataType.simpleString()
    read = with_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    prints = durable(read.mapInArrow(_fingerprints, f"id {ids}, key long, fp long"))
    classes = durable(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes.select("fp"), classes.count()))
    # A fingerprint without links is its own root.
    return prints, classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id of its component)."""
    prints, rooted = _rooted(docs, id_col, text_col)
    rooted = durable(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    of = rooted.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    # Both sides are read from files, so that each is shuffled for this join and a fingerprint with very many rows can be split.
    out = prints.join(durable(of), F.col("fp") == F.col("f"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that agree in id and text (by the id itself and a hash of both) with a row (__kept_id, __kept_key) of kept, each once.

    Of rows that agree so but differ in other columns the one with the least hash of all columns stays.
    """
    own = F.col(f"`{id_col}`")
    rows = docs.withColumn("__own_key", F.xxhash64(own, F.col(f"`{text_col}`")))
    # Ids are compared in an array, so that rows are dealt by the key alone and need not be dealt again for the grouping.
    same = F.size(F.array_distinct(F.array(own, F.col("__kept_id")))) == 1
    rows = rows.join(kept, (F.col("__own_key") == F.col("__kept_key")) & same, "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    least = rows.groupBy("__own_key", own.alias("__kept_id")).agg(F.min_by(whole, F.xxhash64(*plain)).alias("__row"))
    return least.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row of each component: the one with the smallest id (null ids last), of equal ids the least hash."""
    prints, rooted = _rooted(docs, id_col, text_col)
    of = durable(rooted.select(F.col("fp").alias("f"), "root"))
    first = prints.join(of, F.col("fp") == F.col("f")).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x"))
    return one_of_each(docs, durable(first.select(F.col("x.id").alias("__kept_id"), F.col("x.key").alias("__kept_key"))), id_col, text_col)
