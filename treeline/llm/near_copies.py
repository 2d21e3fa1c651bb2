"""SimHash near-dedup with an exact check: the near-dedup stage of the pipeline.

Two texts are linked if the sets of their SHINGLE-word shingles (A-Z lower-cased; a shorter text is one shingle; hashed by XXH64 with
seed 42) have a Jaccard similarity of PERCENT or more, and a component is what links connect.

Candidates: texts with equal sets are made one first. Each set has a SimHash fingerprint (a bit is 1 if it is set in over half of the
hashes), and the operator of simhash_bk links fingerprints within its RADIUS by BK-trees; sets with one fingerprint are joined with the least of
them. At a similarity of 0.8 two fingerprints differ in about ten bits, and blocks of so few bits find no shards, so that these
candidates are not all: BANDS bands of ROWS least hashes each deal the sets into buckets; two sets of similarity s share one with a
probability of 1 - (1 - s^ROWS)^BANDS, which is over 0.9999 at 0.8. A bucket joins its members with the least of them, so that it costs its
size. What is connected by either is a group; a pair that only one of them finds is compared like any other.

Links: the texts of a group meet in one task, which compares their sets exactly. Two sets that are similar enough share one of their
least hashes (the first n - ceil(PERCENT n) + 1 of n), so only such pairs are compared, and a set that is found is taken out, so that
a spanning forest leaves the task. A group above MOST_SETS sets or MOST_SHINGLES shingles is cut into parts, and each two of its parts meet in
a task of their own: memory stays bounded and no link is lost, but each member is read as often as there are parts.

Defined results: null, empty and blank texts are copies of each other and similar to nothing else; ids may repeat or be null; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import durable, scratch, with_small_batches, written
from treeline.llm import simhash_bk
from treeline.llm.simhash_bk import SEED, components, one_of_each, signed

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 6
#: Keys, of eight bytes each, that are broadcast at most.
FEW_KEYS = 2_000_000
MOST_SETS = 4_000
MOST_SHINGLES = 2_000_000
#: Shingles whose products with all multipliers are held at once.
HELD = 4_096
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[len(words) - n :].tolist()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, stops)), repeat(SEED)), np.uint64, n))


def bands(found: np.ndarray) -> list[int]:
    """The buckets of a set; none for an empty one."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), HELD):
        np.minimum(least, (found[at : at + HELD, None] * MULTIPLIERS).min(axis=0), out=least)
    return [signed(xxhash.xxh3_64_intdigest(row.tobytes(), i)) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def simhash(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), HELD):
        counts += np.unpackbits(found[at : at + HELD].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found), bitorder="little").tobytes(), "little")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints, sizes, sims, buckets = [], [], [], []
        for t in b.column(1):
            found = shingles(t.as_py())
            prints.append(signed(xxhash.xxh3_64_intdigest(found.tobytes())))
            sizes.append(len(found))
            sims.append(signed(simhash(found)))
            buckets.append(bands(found))
        cols = [b.column(0), b.column(2), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sims, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "fp", "n", "sim", "bands"])


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that connect the places of distinct sets exactly as all links do."""
    heads = [s[: len(s) + (-percent * len(s)) // 100 + 1].tolist() for s in sets]
    having: dict[int, list[int]] = {}
    for i, head in enumerate(heads):
        for h in head:
            having.setdefault(h, []).append(i)
    here, tried, edges = [True] * len(sets), [-1] * len(sets), []
    for root in range(len(sets)):
        if not here[root]:
            continue
        here[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            mine = sets[at]
            for h in heads[at]:
                left = having[h] = [j for j in having[h] if here[j]]
                for j in left:
                    if tried[j] == at:
                        continue
                    tried[j] = at
                    m, n = sorted((len(mine), len(sets[j])))
                    if 100 * m < percent * n:
                        continue
                    both = len(np.intersect1d(mine, sets[j], assume_unique=True))
                    if 100 * both >= percent * (m + n - both):
                        here[j] = False
                        edges.append((root, j))
                        todo.append(j)
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (root, part, fp, text) sorted by (root, part): the forest of each group or pair of parts."""
    now, held = None, {}

    def drained() -> Iterator[pa.RecordBatch]:
        prints = list(held)
        pairs = [sorted((prints[i], prints[j]), reverse=True) for i, j in forest(list(held.values()))]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for b in batches:
        for root, part, fp, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
            if (root, part) != now:
                yield from drained()
                now, held = (root, part), {}
            if fp not in held:
                held[fp] = shingles(text.as_py())
    yield from drained()


def simhash_candidates(classes: DataFrame) -> DataFrame:
    """(u, v), u > v: sets (fp, sim) of one SimHash fingerprint with the least of them, and these leasts along the links of simhash_bk."""
    leasts = durable(classes.groupBy("sim").agg(F.min("fp").alias("least")))
    same = classes.join(leasts.withColumnRenamed("sim", "s"), F.col("sim") == F.col("s")).filter("fp > least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    near = simhash_bk.links(leasts.select(F.col("sim").alias("fp")), leasts.count())
    a, b = (leasts.select(F.col("sim").alias(f"s{i}"), F.col("least").alias(f"l{i}")) for i in (0, 1))
    met = near.join(a, F.col("u") == F.col("s0")).join(b, F.col("v") == F.col("s1"))
    return same.union(met.select(F.greatest("l0", "l1").alias("u"), F.least("l0", "l1").alias("v")))


def links(texts: DataFrame, classes: DataFrame, most_sets: int = MOST_SETS, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """Edges (u > v) that connect the sets (fp, key, n, sim, bands) as all links between members of a group do; texts has (key, text). Groups are what SimHash and the bands connect."""
    dealt = durable(classes.select(F.explode("bands").alias("band"), "fp"))
    shared = dealt.groupBy("band").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most").select(F.col("band").alias("b"), "least")
    stars = dealt.join(shared, F.col("band") == F.col("b")).filter("fp > least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()
    of = components(simhash_candidates(classes).union(stars).distinct())
    of = durable(of.union(of.select(F.col("root").alias("node"), "root")).distinct().join(classes.select("fp", "key", "n"), F.col("node") == F.col("fp")).select("fp", "key", "n", "root"))
    cuts = F.greatest(F.ceil(2 * F.count(F.lit(1)) / most_sets), F.ceil(2 * F.sum("n") / most_shingles)).cast("int")
    large = of.groupBy("root").agg(cuts.alias("cuts"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).filter((F.col("c") > most_sets) | (F.col("s") > most_shingles))
    of = of.join(large.select(F.col("root").alias("r"), "cuts"), F.col("root") == F.col("r"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    paired = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: (F.least(own, j) * F.col("cuts") + F.greatest(own, j)).cast("long"))
    whole = of.select(F.col("key").alias("k"), "fp", "root", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(paired)).alias("part"))
    whole = durable(whole)
    if whole.count() <= FEW_KEYS:  # texts of no group are left out where they lie; beyond the bound they are shuffled with the others
        texts = texts.join(F.broadcast(whole.select(F.col("k").alias("bk")).distinct()), F.col("key") == F.col("bk"), "left_semi")
    met = texts.join(whole, F.col("key") == F.col("k")).select("root", "part", "fp", "text")
    return met.repartition("root", "part").sortWithinPartitions("root", "part").mapInArrow(_forests, "u long, v long").distinct()


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row of each component: the one with the smallest id (null ids last), of equal ids the least hash."""
    with scratch(docs.sparkSession):  # only the keys of the rows that stay are needed further
        kept, _ = written(_kept(docs, id_col, text_col))
    return one_of_each(docs, kept, id_col, text_col)


def _kept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__kept_id, __kept_key): the row of each component that stays."""
    ids = docs.schema[id_col].dataType.simpleString()
    read = with_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    prints = durable(read.mapInArrow(_sets, f"id {ids}, key long, fp long, n long, sim long, bands array<long>"))
    # A set's first row stands for all that have it.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x")
    classes = durable(prints.groupBy("fp").agg(least, F.min("key").alias("key"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands")))
    roots = components(links(read.select("key", "text"), classes))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("x", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("x").alias("x"))
    return first.select(F.col("x.id").alias("__kept_id"), F.col("x.key").alias("__kept_key"))
