"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated output.

Word vectors: each token (a run of word characters or of other marks, hashed to one of BUCKETS) has a fixed sparse random index
vector with entries of +1 and -1. Over the whole corpus a token gathers the index vectors of the tokens up to WINDOW places away. Tokens
that no label has seen still get vectors from the company they keep. A document is pooled to the mean and the spread of its tokens' unit
vectors, weighted down for frequent tokens, plus its length.

The network (one hidden layer, trained with Adam on the driver) learns from at most SAMPLE labelled rows outside the held-out fold; a
fifth of them is kept aside to fit the temperature that calibrates the probabilities. Everything else covers all data.

Scale: one pass over the corpus leaves a table of BUCKETS x DIMENSIONS sums in each task, cut into slices. They are added up in two rounds,
first each slice over FAN neighbouring tasks, dealt over all shuffle partitions, then what is left of it, so that no task reads a share
of all tables. The driver receives the summed table, whose size is fixed (8 MB), and the pooled sample of SAMPLE rows at most. Scoring is a
map over rows with the fixed-size model; a very long text is pooled in one go, at 128 bytes a token.

Defined results: null, empty and blank texts are scored from a zero vector; with no usable labels, or with one kind only, the
score is the share of label 1 (0.5 without any); null ids are not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import with_small_batches
from treeline.llm.labelled import held_out, training_rows

BUCKETS = 1 << 15
DIMENSIONS = 32
ENTRIES = 4
WINDOW = 2
SLICE = 512
#: Tasks whose tables are added up in the first round.
FAN = 256
#: The most labelled rows that the network is fitted on.
SAMPLE = 20_000
HIDDEN = 32
CHUNK = 250_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
REMEMBERED = 100_000


class Codes(dict):
    """Token to bucket, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        code = self[token] = xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        return code


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each bucket's non-zero entries; the same on every worker."""
    rng = np.random.default_rng(20_240_229)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :ENTRIES]
    return places.astype(np.int64), rng.choice(np.array([-1, 1], np.int64), (BUCKETS, ENTRIES))


def encode(text: str | None, codes: Codes) -> np.ndarray:
    tokens = TOKEN.findall(text) if text else []
    return np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))


def gather(codes: np.ndarray, table: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to table what the tokens of a stretch of corpus gather; -1 parts documents. The last column counts tokens."""
    for k in range(1, WINDOW + 1):
        a, b = codes[:-k], codes[k:]
        ok = (a >= 0) & (b >= 0)
        for i in range(1, k):
            ok &= codes[i : len(codes) - k + i] >= 0
        a, b = a[ok], b[ok]
        for x, y in ((a, b), (b, a)):
            for j in range(ENTRIES):
                table += np.bincount(x * (DIMENSIONS + 1) + places[y, j], weights=signs[y, j], minlength=table.size)
    seen = codes[codes >= 0]
    table += np.bincount(seen * (DIMENSIONS + 1) + DIMENSIONS, minlength=table.size)


def _corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    table, codes = np.zeros(BUCKETS * (DIMENSIONS + 1)), Codes()
    held: list[np.ndarray] = []
    n = 0
    for b in batches:
        for t in b.column(0):
            if c := t.as_py():
                held += [encode(c, codes), np.array([-1])]
                n += len(held[-2]) + 1
                if n > CHUNK:
                    gather(np.concatenate(held), table, places, signs)
                    held, n = [], 0
    if held:
        gather(np.concatenate(held), table, places, signs)
    yield from _sliced(table)


def _sliced(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = table.astype(np.int64).reshape(BUCKETS // SLICE, -1)
    used = np.flatnonzero(parts.any(axis=1))
    fan = pa.array(np.full(len(used), TaskContext.get().partitionId() // FAN), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), fan, pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "fan", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for part, fan, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            x = np.frombuffer(sums.as_py(), np.int64)
            total[part, fan] = total[part, fan] + x if (part, fan) in total else x
    # The second round adds up what is left of a slice.
    cols = [pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "fan", "sums"])


def word_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """BUCKETS x DIMENSIONS unit vectors, each times the weight of its bucket, learned over all texts."""
    kind = "part int, fan int, sums binary"
    sums = docs.select(F.col(text_col)).mapInArrow(_corpus, kind).repartition("part", "fan").mapInArrow(_added, kind)
    sums = sums.select("part", F.lit(0).alias("fan"), "sums").repartition("part").mapInArrow(_added, kind)
    table = np.zeros((BUCKETS // SLICE, SLICE * (DIMENSIONS + 1)))
    for r in sums.collect():  # of fixed size: one row for each slice of the table
        table[r.part] = np.frombuffer(r.sums, np.int64)
    table = table.reshape(BUCKETS, DIMENSIONS + 1)
    vectors, counts = table[:, :DIMENSIONS], table[:, DIMENSIONS]
    vectors = vectors - counts[:, None] * vectors.sum(axis=0) / max(counts.sum(), 1)  # without what all tokens share
    norm = np.linalg.norm(vectors, axis=1)
    weight = 1e-2 / (1e-2 + counts / max(counts.sum(), 1))
    return (vectors / np.maximum(norm, 1e-9)[:, None] * np.where(norm > 0, weight, 0)[:, None]).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, codes: Codes) -> np.ndarray:
    """The mean and the spread of the tokens' vectors, how much tokens repeat, and the length."""
    c = encode(text, codes)
    if not len(c):
        return np.zeros(2 * DIMENSIONS + 2, np.float32)
    v = vectors[c]
    return np.concatenate([v.mean(axis=0), v.std(axis=0), [len(np.unique(c)) / len(c), np.log1p(len(c)) / 10]]).astype(np.float32)


@dataclass
class Network:
    """tanh(x W1 + b1) W2 + b2, divided by a temperature, through a logistic."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(x: int, share: float) -> Network:
    p = min(max(share, 1e-3), 1 - 1e-3)
    return Network(np.zeros(x), np.ones(x), np.zeros((x, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def train(x: np.ndarray, y: np.ndarray, *, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Fits the network with Adam and then its temperature on every fifth row, which the weights have not seen."""
    if len(y) < 10 or len(np.unique(y)) < 2:
        return constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    tx, ty = x[~aside].astype(np.float64), y[~aside].astype(np.float64)
    mean, scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
    d = x.shape[1]
    p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    tx = (tx - mean) / scale
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(ty)), max(1, len(ty) // batch)):
            a, t = tx[rows], ty[rows]
            h = np.tanh(a @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(rows)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [a.T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], np.array([e.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    z, t = net.logits(x[aside].astype(np.float64)), y[aside]
    if len(np.unique(t)) == 2:
        loss = lambda c: float(np.logaddexp(0, np.where(t == 1, -z, z) / c).mean())
        net.temperature = min(np.geomspace(0.5, 8, 60), key=loss)
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, held_out, score, predicted, and the columns named in keep."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(with_small_batches(docs), text_col))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            x = [pooled(t.as_py(), vectors.value, codes).tolist() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float32())), b.column(3)], names=["id", "key", "x", "label"])

    known = training_rows(docs, labels, label_col=label_col, id_col=id_col, text_col=text_col, most=sample)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = known.mapInArrow(features, f"id {kind}, key long, x array<float>, label int").toArrow()  # at most `sample` pooled rows
    rows = rows.sort_by([("id", "ascending"), ("key", "ascending")])
    x = np.array(rows["x"].to_pylist(), np.float32).reshape(-1, 2 * DIMENSIONS + 2)
    net = context.broadcast(train(x, rows["label"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                got = net.value.scores(np.array([pooled(t.as_py(), vectors.value, codes) for t in b.column(1)]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.float64()), *b.columns[3:]], names=["__id", "held_out", "score", *b.schema.names[3:]])

    others = [c for c in keep if c not in (id_col, "held_out", "score", "predicted")]
    read = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), held_out(id_col).alias("held_out"), *[F.col(f"`{c}`") for c in others])
    schema = ", ".join([f"__id {kind}, held_out boolean, score double", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)])
    out = read.mapInArrow(score, schema)
    return out.select(F.col("__id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"`{c}`") for c in others])
