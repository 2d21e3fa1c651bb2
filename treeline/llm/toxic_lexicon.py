"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps look-alike letters of other scripts and digits that stand for letters to Latin ones, and leaves words parted by
single blanks. The lexicon's entries are whole words or beginnings of words; they and their weights are learned from labelled rows: the
log-odds of a document that holds the entry. An entry must be in at least LEAST toxic documents and have a weight of MIN_WEIGHT. A beginning
stands for its longer forms unless one word makes up nearly all of its finds. Exception phrases are a find together with
the word before or after it, where labelled clean documents hold the pair and toxic ones hardly ever; a find inside one doesn't count.

A document's strength is the sum of its finds' weights per hundred words, and a logistic curve of its logarithm, fitted on the same rows, gives
the score.

Scale: the labelled sample is bounded by SAMPLE rows, whatever the tables hold; its counts are made on the executors. All entries and
exceptions that pass the thresholds make the lexicon and reach the driver: as each stands in LEAST sampled texts at least, their number is
bounded by the sample's words, not by the corpus. Scoring is a map over rows with an automaton built once for each task; a very long text
costs its length times the logarithm of its finds.

Defined results: null, empty and blank texts have no finds and get the base score; without usable labels the lexicon is empty and every
row gets one score below the threshold; null ids are not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import durable, with_small_batches
from treeline.llm.labelled import held_out, training_rows

#: The most labelled rows that the lexicon is learned from.
SAMPLE = 20_000
LEAST = 5
MIN_WEIGHT = 4.0
BEGINNINGS = range(4, 13)
#: A whole word stands for its beginnings if it makes up this part of their finds.
ONE_WORD = 0.9

# Letters of other scripts that look like Latin letters, and digits that stand for letters.
LOOK_ALIKE = dict(zip("аеорсухіѕјԁһкмтвнαβεηικνορτυχ", "aeopcyxisjdhkmtbhabenikvoptux", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
FOLD = str.maketrans(LOOK_ALIKE | DIGITS)
IN_WORD = re.compile(r"(?<=\w)[@$](?=\w)")
BREAKS = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Words parted by one blank, with a blank at both ends; a single blank if there are none."""
    if not text:
        return " "
    text = text.lower()
    if "@" in text or "$" in text:
        text = IN_WORD.sub(lambda m: "a" if m[0] == "@" else "s", text)
    text = BREAKS.sub(" ", text.translate(FOLD)).strip()
    return f" {text} " if text else " "


def entries_of(words: set[str]) -> set[str]:
    """The whole words, and their beginnings, as the automaton sees them."""
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if k < len(w)}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float] = (-3.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            a.add_word(w, (len(w), x))
        for e in self.exceptions:
            a.add_word(e, (len(e), 0.0))
        if not len(a):
            return None
        a.make_automaton()
        return a


def finds(text: str, a: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the finds in folded text outside exception phrases, by start; of finds at one place the weightiest, of equal ones the shortest."""
    if a is None:
        return []
    best: dict[int, tuple[int, float]] = {}
    reach: dict[int, int] = {}  # the farthest end of the exception phrases from each start
    for end, (n, w) in a.iter(text):
        start = end + 1 - n
        if not w:
            reach[start] = end + 1  # ends come in increasing order
        elif start not in best or best[start][1] < w:
            best[start] = (end + 1, w)
    if not reach:
        return [(s, e, w) for s, (e, w) in sorted(best.items())]
    # One sweep over the places: an exception phrase that began before a find and reaches its end excuses it.
    out, far = [], 0
    for s in sorted(best.keys() | reach.keys()):
        far = max(far, reach.get(s, 0))
        if s in best and far < best[s][0]:
            out.append((s, *best[s]))
    return out


def strength(text: str | None, a: ahocorasick.Automaton | None) -> float:
    f = folded(text)
    total = sum(w for _, _, w in finds(f, a))
    return float(np.log1p(100 * total / max(f.count(" ") - 1, 1))) if total else 0.0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = (Counter(), Counter())

    def drained() -> pa.RecordBatch:
        keys = list(found[0].keys() | found[1].keys())
        cols = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in found)]
        return pa.RecordBatch.from_arrays(cols, names=["entry", "clean", "toxic"])

    for b in batches:
        for t, y in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            found[y].update(entries_of(set(folded(t.as_py()).split())))
        if len(found[0]) + len(found[1]) > 400_000:
            yield drained()
            found = (Counter(), Counter())
    yield drained()


def chosen(counts: list[tuple[str, int, int]], clean: int, toxic: int) -> dict[str, float]:
    """Of entries with their numbers of clean and toxic documents, those of the lexicon with their weights."""
    weight = {e: float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))) for e, c, t in counts}
    known = {e: t for e, _, t in counts}
    strong = {e for e, x in weight.items() if x >= MIN_WEIGHT and known[e] >= LEAST}
    whole: dict[str, int] = {}
    for e in strong:
        if e.endswith(" "):
            for k in BEGINNINGS:
                whole[e[: k + 1]] = max(whole.get(e[: k + 1], 0), known[e])
    begins = {e for e in strong if not e.endswith(" ") and whole.get(e, 0) < ONE_WORD * known[e]}
    covered = lambda e: any(e[: k + 1] in begins for k in BEGINNINGS if k + 1 < len(e.rstrip()) + (e.endswith(" ")))
    kept = {e for e in strong if (e in begins or e.endswith(" ")) and not covered(e)}
    return {e: weight[e] for e in sorted(kept)}


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logistic curve a + b x by Newton's method, with a light pull of b to zero."""
    a = np.stack([np.ones_like(x), x], axis=1)
    c = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + np.diag([1e-6, 1e-1])
        c = c + np.linalg.solve(h, a.T @ (y - p) - np.array([0, 1e-1]) * c)
    return float(c[0]), float(c[1])


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str, id_col: str, text_col: str, sample: int = SAMPLE) -> Lexicon:
    known = durable(training_rows(docs, labels, label_col=label_col, id_col=id_col, text_col=text_col, most=sample).select("id", "text", "label"))
    kind = docs.schema[id_col].dataType.simpleString()
    n = dict(known.groupBy("label").count().collect())
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return Lexicon(curve=(-3.0 if not toxic else 3.0, 0.0))
    counts = known.mapInArrow(_counts, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = counts.filter((F.col("toxic") >= LEAST) & (F.ln((F.col("toxic") + 0.5) / (toxic + 1)) - F.ln((F.col("clean") + 0.5) / (clean + 1)) >= MIN_WEIGHT))
    lexicon = Lexicon(chosen([tuple(r) for r in strong.collect()], clean, toxic))

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        pairs: list[tuple[str, int]] = []
        for b in batches:
            for t, y in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                f = folded(t.as_py())
                for s, e, _ in finds(f, a):
                    end = e if f[e - 1] == " " else f.index(" ", e) + 1
                    if s > 0:
                        pairs.append((f[f.rindex(" ", 0, s) : end], y))
                    if end < len(f):
                        pairs.append((f[s : f.index(" ", end) + 1], y))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32())], names=["pair", "label"])

    pairs = known.mapInArrow(sifted, "pair string, label int").groupBy("pair").agg(F.sum(F.col("label")).alias("toxic"), F.count(F.lit(1)).alias("n"))
    excused = pairs.filter((F.col("n") - F.col("toxic") >= 3) & (10 * F.col("toxic") <= F.col("n"))).collect()
    lexicon.exceptions = tuple(sorted(r.pair for r in excused))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([strength(t.as_py(), a) for t in b.column(1)], pa.float64()), b.column(2)], names=["id", "x", "label"])

    rows = known.mapInArrow(measured, f"id {kind}, x double, label int").toArrow()  # at most `sample` numbers
    rows = rows.sort_by([("id", "ascending"), ("x", "ascending"), ("label", "ascending")])  # the same sums whenever it is done again
    lexicon.curve = curve(rows["x"].to_numpy(), rows["label"].to_numpy().astype(float))
    return lexicon


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    lexicon = learn(with_small_batches(docs), labels, label_col=label_col, id_col=id_col, text_col=text_col, sample=sample)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        a, b = lexicon.curve
        for x in batches:
            z = a + b * np.array([strength(t.as_py(), auto) for t in x.column(1)])
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["id", "held_out", "score"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    out = read.mapInArrow(score, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
