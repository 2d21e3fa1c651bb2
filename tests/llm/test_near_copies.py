"""The pipeline's near-dedup stage: exact similarity of five-word shingles."""

import random

import pytest
from odd_rows import SF
from pyspark.sql import functions as F

import corpus_pipeline
from treeline.llm import near_copies


def exact(rows):
    """The ids that stay, over all pairs."""
    cut = lambda t: frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset()
    rows = sorted((i, cut(t)) for i, t in rows)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def copies():
    """Texts with some words changed, from hardly similar to almost equal, and chains of them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(30):
        t = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(6):
            out.append(" ".join(t))
            t = list(t)
            for _ in range(rng.randint(1, 6)):
                t[rng.randrange(len(t))] = word()
    return list(enumerate(out))


@pytest.mark.parametrize("most_sets, most_shingles", [(4_000, 2_000_000), (3, 2_000_000), (4_000, 400)])
def test_stage_against_all_pairs(spark, monkeypatch, most_sets, most_shingles):
    """Also with groups cut into parts."""
    monkeypatch.setattr(near_copies.links, "__defaults__", (most_sets, most_shingles))
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()} == exact(rows)


def test_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FEW_KEYS", 0)
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()} == exact(rows)


def test_stage_on_documents_and_odd_rows(spark, docs, odd, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == exact(rows)
    kept = corpus_pipeline.near_dedup(spark, odd, SF)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.filter("text LIKE 'Same%'").collect()] == [5]
    assert kept.filter(F.coalesce(F.trim(F.translate("text", "\t\n", "  ")), F.lit("")) == "").count() == 1
    assert corpus_pipeline.near_dedup(spark, empty, SF).count() == 0


def test_simhash_links_are_candidates(spark, monkeypatch):
    """Without a band the stage still finds the copies that BK-trees link, and none that the exact check refuses."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    near = [words[:600], [*words[:300], "other", *words[301:600]], words[300:]]
    fps = [near_copies.simhash(near_copies.shingles(" ".join(t))) for t in near]
    assert (fps[0] ^ fps[1]).bit_count() <= near_copies.simhash_bk.RADIUS
    monkeypatch.setattr(near_copies, "_sets", lambda batches, f=near_copies._sets: (b.set_column(5, "bands", near_copies.pa.array([[]] * b.num_rows, near_copies.pa.list_(near_copies.pa.int64()))) for b in f(batches)))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(near)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()} == {0, 2}
