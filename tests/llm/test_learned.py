"""What the learned scores learn from, and the lexicon against naive matching."""

import random
import zlib

import numpy as np
import pytest
from odd_rows import SF
from pyspark.sql import functions as F

from treeline.llm import toxic_lexicon
from treeline.llm.labelled import training_rows
from treeline.llm.quality_net import quality_scores, train
from treeline.llm.toxic_lexicon import Lexicon, curve, finds, folded, learn, toxicity_scores

COLUMNS = {"id_col": "doc_id", "text_col": "text"}


def test_training_rows_hold_the_bound(spark):
    many = spark.range(50_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    same = spark.range(20_000).select(F.lit(4).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    docs = many.union(same).union(spark.createDataFrame([(7, None), (None, "x"), (8, "")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2, j) for i in (3, 4, 7, 8) for j in (0, 1)], "doc_id long, quality int, toxic int")
    rows = lambda d, most: [tuple(r) for r in training_rows(d, labels, label_col="quality", most=most, **COLUMNS).collect()]
    few = rows(docs, 40)
    assert len(few) == 40 and sorted(few) == sorted(rows(docs.repartition(9), 40))
    known = [i for i in (4, 8) if zlib.crc32(str(i).encode()) % 5]
    assert {(i, t) for i, _, t, _ in rows(docs, 10**6) if i != 3} == {(i, {4: "one text", 8: ""}[i]) for i in known}


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_a_repeated_id_and_clashing_names(spark, docs, labels, score):
    one = docs.filter("doc_id = 3").crossJoin(spark.range(300)).drop("id")
    all_ = docs.union(one).withColumns({"held_out": F.lit("x"), "score": F.lit("y"), "predicted": F.lit("z"), "label": F.lit(1), "__id": F.lit(2)})
    a, b = ({(r.doc_id, round(r.score, 9)) for r in score(x, labels).collect()} for x in (all_, docs))
    assert len(a) == len(b) and score(all_, labels).count() == docs.count() + 300


def naive(text, lexicon):
    """Every occurrence of every entry, one after the other."""
    places = lambda e: [i for i in range(len(text)) if text.startswith(e, i)]
    excused = [(i, i + len(e)) for e in lexicon.exceptions for i in places(e)]
    best = {}
    for e, w in lexicon.weights.items():
        for i in places(e):
            if i not in best or (best[i][1], -best[i][0]) < (w, -i - len(e)):
                best[i] = (i + len(e), w)
    return sorted((s, e, w) for s, (e, w) in best.items() if not any(x <= s and e <= y for x, y in excused))


def test_automaton_against_naive_matching():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(200):
        weights = {f" {word()} " if rng.random() < 0.5 else f" {word()}": rng.choice([1.0, 2.5, 4.0]) for _ in range(6)}
        lexicon = Lexicon(weights, tuple({f" {word()} {word()} " for _ in range(4)} - weights.keys()))
        text = folded(" ".join(word() for _ in range(rng.randint(0, 60))))
        assert finds(text, lexicon.automaton()) == naive(text, lexicon)


def test_finds_of_a_very_long_text_take_one_sweep():
    lexicon = Lexicon({" bad ": 4.0}, (" not bad ",))
    assert len(finds(folded("bad not bad " * 100_000), lexicon.automaton())) == 100_000


def test_scores_against_a_plain_computation(spark, docs, labels):
    """The learned lexicon, applied by naive matching, gives the query's scores; the lexicon has every entry that passes."""
    lexicon = learn(docs, labels, label_col="toxic", **COLUMNS)
    got = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    a, b = lexicon.curve
    for r in docs.collect():
        f = folded(r.text)
        total = sum(w for _, _, w in naive(f, lexicon))
        x = np.log1p(100 * total / max(f.count(" ") - 1, 1)) if total else 0.0
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(a + b * x, -30, 30))))
    rows = [r.asDict() for r in training_rows(docs, labels, label_col="toxic", most=toxic_lexicon.SAMPLE, **COLUMNS).collect()]
    n = [sum(r["label"] == y for r in rows) for y in (0, 1)]
    counts = [{}, {}]
    for r in rows:
        for e in toxic_lexicon.entries_of(set(folded(r["text"]).split())):
            counts[r["label"]][e] = counts[r["label"]].get(e, 0) + 1
    strong = [(e, counts[0].get(e, 0), t) for e, t in counts[1].items() if t >= toxic_lexicon.LEAST]
    assert lexicon.weights == pytest.approx(toxic_lexicon.chosen(strong, *n))


def test_curve_is_the_likeliest():
    rng = np.random.default_rng(2)
    x = rng.random(400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(4 * x - 2)))).astype(float)
    loss = lambda a, b: np.logaddexp(0, np.where(y == 1, -1, 1) * (a + b * x)).sum() + 0.05 * b * b
    a, b = curve(x, y)
    assert all(loss(a, b) <= loss(a + s, b + t) + 1e-9 for s in (-0.05, 0, 0.05) for t in (-0.05, 0, 0.05))


def test_temperature_improves_calibration():
    """On noisy labels the network is too sure of itself; the temperature mends that for rows that it hasn't seen."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 20)).astype("float32")
    y = (rng.random(900) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    net = train(x[:450], y[:450], epochs=120)
    z, t = net.logits(x[450:]), y[450:]
    loss = lambda c: float(np.logaddexp(0, np.where(t == 1, -z, z) / c).mean())
    assert net.temperature > 1 and loss(net.temperature) < loss(1.0)


def test_empty_tables(spark, empty, labels):
    assert training_rows(empty, labels, label_col="toxic", most=5, **COLUMNS).count() == 0
    assert SF and learn(empty, labels, label_col="toxic", **COLUMNS).weights == {}
