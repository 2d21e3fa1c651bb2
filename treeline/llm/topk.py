"""Exact top-k by inner product with the no-random-access algorithm over sorted lists.

Queries are dealt by a hash into blocks of at most QUERY_NUMBERS numbers; a block is sent to the candidates, which stay where they lie. A
task sorts the candidates that it reads, BLOCK at a time, into one list for each component. A query reads those lists in order, from the
top where its own component is positive and from the bottom where it is negative: in every round a stretch, twice as long as before, of the
lists that can still change scores most (the product of weight and of what is left of the list's range). It only touches candidates that
a list has shown. Such a candidate's score lies between what has been read plus the least that its unread lists can add, and the same
plus the values at which those lists have been left. The k-th best lower bound, or the k-th best score of earlier blocks where that is higher,
is what an outsider has to reach. When no unseen candidate can, reading stops as soon as the candidates that still can are few, or looking them
up costs no more than the next stretch; their final scores are then resolved. `depth` is the part of the lists that has been read.

On spread-out vectors of many components bounds are loose: once no unseen candidate can qualify, which takes a fifth of the lists, most of
those that have been seen still can, and looking them up costs less than reading on. Skewed vectors, with few large
components, stop early with few candidates left.

Scale: the work is queries x candidates at worst, as an exact search over a stated query set is. Neither side is copied for each block
of the other: candidates are read once for each block of queries and never shuffled; each task hands on k rows for each query.

Numbers are whole: scores that doubles might not hold exactly are made of Python's integers, and a score beyond a long counts as the
nearest long. Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id; a
missing component counts as 0; identical rows count once; candidates never include rows with the query's own id; with fewer than k
candidates all are returned; ties go to the smaller id; an empty table, or one without queries, gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import durable, with_small_batches

#: Numbers of the queries that are sent to all tasks at once: 32 MB.
QUERY_NUMBERS = 4 << 20
#: Candidates whose lists are sorted together.
BLOCK = 8_192
#: The first stretch of a list; candidates that are looked up whatever the next stretch costs.
FIRST, FEW = 128, 32
#: Numbers of a candidate that can be looked up in the time in which one entry of a list is read.
LOOKUPS = 24
#: A round reads the lists that hold this part of what can still change scores.
PART = 0.75
#: Whole numbers below this are exact as doubles.
LARGE, HIGH = float(1 << 53), (1 << 63) - 1


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h) of every row that takes part; h tells rows of one id apart."""
    v = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    v = v.filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return v.select("id", "v", F.xxhash64("id", "v").alias("h"))


def matrix(lists: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale x) of every component, as whole doubles; missing ones are 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def dot(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix times the vector in this thread alone: a task has one core."""
    return np.einsum("ij,j->i", a, x.astype(np.float64))


class Lists:
    """Candidates (ids, hashes, whole numbers in rows) with one sorted list for each component.

    Sums are made of doubles and are exact, as callers see to it that none passes LARGE.
    """

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, rows: np.ndarray):
        self.ids, self.hashes, self.rows = ids, hashes, rows.astype(np.float64)
        low = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
        values = np.ascontiguousarray(np.take_along_axis(self.rows.T, low, axis=1))
        #: Places and values of each list from its bottom (0) and from its top (1).
        self.places = (low, np.ascontiguousarray(low[:, ::-1]))
        self.values = (values, np.ascontiguousarray(values[:, ::-1]))
        #: A candidate's place in each list from its bottom.
        self.rank = np.empty(self.rows.shape, np.int32)
        np.put_along_axis(self.rank, low.T, np.arange(len(rows), dtype=np.int32)[:, None], axis=0)

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -LARGE) -> tuple[np.ndarray, np.ndarray, float]:
        """(places, scores, depth): all candidates that may be among the k best at or above the floor; a few more may come with them."""
        n = len(self.rows)
        dims = np.flatnonzero(query)
        weights = query[dims].astype(np.float64)
        fits = self.ids != own
        if not len(dims) or n <= max(k, FEW):
            places = np.flatnonzero(fits)
            return places, dot(self.rows[places], query), 0.0
        up = weights > 0
        first, last = self.values[0][dims, 0], self.values[0][dims, -1]
        worst, edge = weights * np.where(up, first, last), weights * np.where(up, last, first)  # edge: where each list has been left
        at, stretch = np.zeros(len(dims), np.int64), np.full(len(dims), FIRST)
        read, seen = np.zeros(n), np.zeros(n, bool)
        to_reach, may = floor, np.zeros(0, np.int64)

        def bounds(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The least and the most that the scores of some candidates can be: what the lists that have not shown them can add at worst and at best."""
            places = self.rank[which][:, dims]
            hidden = (np.where(up, n - 1 - places, places) >= at).astype(np.float64)
            return read[which] + dot(hidden, worst), read[which] + dot(hidden, edge)

        while (slack := edge - worst).any():
            chosen = np.argsort(-slack, kind="stable")
            chosen = chosen[: 1 + int(np.searchsorted(np.cumsum(slack[chosen]), PART * slack.sum()))]
            for a, way in {(int(at[i]), bool(up[i])) for i in chosen}:
                # Lists that are read from the same place on in the same direction are read together.
                some = chosen[(at[chosen] == a) & (up[chosen] == way)]
                b = min(n, a + int(stretch[some[0]]))
                found, values = self.places[way][dims[some], a:b], weights[some, None] * self.values[way][dims[some], a:b]
                flat = found.ravel()
                read += np.bincount(flat, weights=values.ravel(), minlength=n)
                seen[flat] = True
                edge[some], at[some], stretch[some] = values[:, -1], b, 2 * stretch[some]
            # The best few of what has been read give a bound that the k-th best is not below.
            likely = np.argpartition(np.where(fits, read, -np.inf), n - 2 * k)[n - 2 * k :] if n > 2 * k else np.arange(n)
            likely = likely[(seen & fits)[likely]]
            if len(likely) >= k:
                least, _ = bounds(likely)
                to_reach = max(to_reach, float(np.partition(least, len(least) - k)[len(least) - k]))
            if not seen.all() and edge.sum() >= to_reach:
                continue
            # No unseen candidate can be among the best: reading on only serves to leave fewer to be looked up.
            may, cheap = np.flatnonzero(seen & fits), LOOKUPS * np.minimum(stretch, n - at)[chosen].sum()
            if len(may) * len(dims) > cheap:
                least, most = bounds(may)
                if len(may) >= k:
                    to_reach = max(to_reach, float(np.partition(least, len(least) - k)[len(least) - k]))
                may = may[most >= to_reach]
            if len(may) <= FEW + k or len(may) * len(dims) <= cheap:
                break
        else:  # what is left of every list is one value, and an unseen candidate has it in all of them
            may = np.flatnonzero(fits) if edge.sum() >= to_reach else np.flatnonzero(seen & fits)
        scores = dot(self.rows, query)[may] if 2 * len(may) > n else dot(self.rows[may], query)
        return may, scores, float(at.sum()) / (n * len(dims))


def best_of(ids: np.ndarray, hashes: np.ndarray, scores: list[int] | np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best (score, id, hash), each once."""
    found = sorted({(-int(s), int(i), int(h)) for s, i, h in zip(scores, ids, hashes, strict=True)})[:k]
    return [(-s, i, h) for s, i, h in found]


class Search:
    """What a task knows of each query: its k best so far, and how far lists have been read."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.hashes, self.queries, self.k = ids, hashes, queries, k
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in ids]
        self.depth = np.zeros(len(ids))
        self.blocks = 0
        self.most = np.abs(queries).max(axis=1, initial=0)

    def add(self, ids: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> None:
        _, single = np.unique(np.stack([ids, hashes], axis=1), axis=0, return_index=True)
        ids, hashes, rows = ids[single], hashes[single], rows[single]
        width = max(rows.shape[1], self.queries.shape[1])
        rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
        if self.queries.shape[1] < width:
            self.queries = np.pad(self.queries, ((0, 0), (0, width - self.queries.shape[1])))
        most = np.abs(rows).max(axis=1, initial=0)
        # Of rows whose sums might not be exact with some query, or of such queries, every score is made of Python's integers.
        usual = self.most < 2.0**24
        plain = most * max(1.0, float(self.most[usual].max(initial=0))) * width < LARGE
        lists = Lists(ids[plain], hashes[plain], rows[plain]) if plain.any() else None
        self.blocks += 1
        for q in range(len(self.ids)):
            got, own = self.best[q], int(self.ids[q])
            if usual[q] and lists:
                floor = max(-LARGE, min(LARGE, float(got[-1][0]))) if len(got) == self.k else -LARGE
                may, scores, depth = lists.search(self.queries[q], own, self.k, floor)
                if len(may) > 4 * self.k:  # ties at the last place stay
                    least = np.partition(scores, len(may) - self.k)[len(may) - self.k]
                    may, scores = may[scores >= least], scores[scores >= least]
                got = got + best_of(lists.ids[may], lists.hashes[may], scores, self.k)
                self.depth[q] += depth
            others = np.flatnonzero((~plain if usual[q] else np.ones(len(ids), bool)) & (ids != own))
            if len(others):
                query = [int(x) for x in self.queries[q]]
                scores = [min(HIGH, max(-HIGH - 1, sum(a * int(b) for a, b in zip(query, rows[c], strict=True) if a))) for c in others]
                got = got + best_of(ids[others], hashes[others], scores, self.k)
            self.best[q] = [(-s, i, h) for s, i, h in sorted({(-s, i, h) for s, i, h in got})[: self.k]]

    def result(self) -> pa.RecordBatch:
        rows = [(int(self.ids[q]), int(self.hashes[q]), i, h, s, float(self.depth[q] / max(1, self.blocks))) for q in range(len(self.ids)) for s, i, h in self.best[q]]
        kinds = [pa.int64()] * 5 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["query_id", "qh", "id", "h", "score", "depth"])


def blocks_of(queries: DataFrame, numbers: int) -> list[DataFrame]:
    """The queries in blocks of at most so many numbers (a single longer vector is a block of its own)."""
    total = queries.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    cuts = -(-2 * total // numbers) if total > numbers else 1
    while True:
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(cuts)))
        sizes = dealt.groupBy("block").agg(F.sum(F.size("v").cast("long")).alias("n"), F.count(F.lit(1)).alias("c"))
        if not sizes.filter((F.col("n") > numbers) & (F.col("c") > 1)).take(1):
            return [dealt.filter(F.col("block") == b).select("id", "v", "h") for b in range(cuts)]
        cuts *= 2


def exact_top_k(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score, depth) for the rows of df where is_query holds, against all others."""
    context = df.sparkSession.sparkContext
    candidates = valid_vectors(with_small_batches(df), id_col, vector_col)
    queries = durable(valid_vectors(df.filter(is_query), id_col, vector_col).distinct())
    parts = None
    for block in blocks_of(queries, QUERY_NUMBERS):
        asked = block.toArrow()
        numbers = matrix(asked["v"].combine_chunks(), 1, scale)
        sent = context.broadcast((asked["id"].to_numpy(), asked["h"].to_numpy(), numbers))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            search = Search(*sent.value, k)
            held: list[pa.RecordBatch] = []

            def done() -> None:
                t = pa.Table.from_batches(held)
                search.add(t["id"].to_numpy(), t["h"].to_numpy(), matrix(t["v"].combine_chunks(), 1, scale))

            for b in batches:
                for first in range(0, b.num_rows, BLOCK):
                    held.append(b.slice(first, BLOCK))
                    if sum(x.num_rows for x in held) >= BLOCK:
                        done()
                        held = []
            if held:
                done()
            yield search.result()

        part = candidates.mapInArrow(run, "query_id long, qh long, id long, h long, score long, depth double")
        parts = part if parts is None else parts.union(part)
    deep = Window.partitionBy("query_id", "qh")
    found = parts.withColumn("depth", F.max("depth").over(deep)).dropDuplicates(["query_id", "qh", "id", "h"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "h")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score", "depth")
