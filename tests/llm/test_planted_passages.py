"""Substring dedup of passages set into the middle of sentences, and of rows that share an id."""

import random

from brute_substrings import brute_dedup, pieces
from odd_rows import ODD, rows_of

from treeline.llm.sentence_spans import WINDOW, dedup_substrings, sentences

SCHEMA = "doc_id long, text string, source string"


def test_passages_inside_sentences_are_found(spark):
    """Passages of 51 to 80 words, whose sentences have 35 to 45, begin and end within sentences of such lengths."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    rows, passages = [], []
    for k in range(60):
        passage = some(rng.randint(51, 80))
        for stop in range(rng.randint(5, 40), len(passage) - 1, rng.randint(35, 45)):
            passage[stop] += "."
        passages.append(passage)
        for i in (2 * k, 2 * k + 1):
            before, after = some(rng.randint(1, 40)), some(rng.randint(1, 40))
            rows.append((i, f"{' '.join(some(20))}. {' '.join(before + passage + after)}. {' '.join(some(20))}.", "s"))
    got = {r.doc_id: r.text for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA), min_run=0).collect()}
    for k, passage in enumerate(passages):
        assert got[2 * k] == rows[2 * k][1]
        gone = set(rows[2 * k + 1][1].split()) - set(got[2 * k + 1].split())
        assert gone <= set(passage) and len(gone) >= 15 and set(passage) - gone <= set(passage[: WINDOW + 1] + passage[-2 * WINDOW :])


def test_cuts_do_not_depend_on_what_stands_around():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    passage = [word() for _ in range(60)]
    inner = set()
    for n in (0, 3, 30, 200):
        text = " ".join([word() for _ in range(n)] + passage + [word() for _ in range(n)])
        cuts, at = set(), 0
        for s in sentences(text):
            at += len(s.split())
            cuts.add(at - n)
        inner.add(tuple(sorted(c for c in cuts if WINDOW < c < 60 - WINDOW)))
    assert len(inner) == 1 and len(inner.pop()) >= 1


def test_rows_that_share_the_least_id(spark):
    """Of two texts of the least id the one with the smaller key keeps a span, also where a third row has it."""
    shared = "The quick brown fox jumps over it again. A lazy dog sleeps on and on without a care. "
    texts = [(1, shared + "One thing follows here, and it is short."), (1, shared + "Quite another thing follows there, and it is not."), (2, shared + "Nothing more is said of it by anyone, they say.")]
    df = spark.createDataFrame([(i, t, "s") for i, t in texts], SCHEMA)
    got = [(r.doc_id, shared.strip() in r.text) for r in dedup_substrings(df, min_run=0).collect()]
    assert sorted(got) == [(1, False), (1, True), (2, False)]


def test_capitalised_words_do_not_end_a_sentence():
    assert sentences("He moved to New York with Anna Smith in May. Then he left.") == ["He moved to New York with Anna Smith in May. ", "Then he left."]


def test_pieces_against_a_scan_of_characters(docs):
    for t in [r.text or "" for r in docs.collect()] + [x or "" for x in ODD[:-1]] + ["a.b c? ! d\n\n e.) f", " x", "1. 2. 3."]:
        assert sentences(t) == pieces(t)


def test_substrings_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.text for r in dedup_substrings(docs).collect()} == brute_dedup(rows)


def test_passages_are_caught_and_clean_documents_left_alone(spark):
    """With the default least run: passages of 51 to 90 words in sentences of 4 to 20, set anywhere into prose; half of the rows have none."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))

    def prose(n):
        out = []
        while len(out) < n:
            out += [word() for _ in range(rng.randint(4, 20))]
            out[-1] += "."
        return out[:n]

    phrase = prose(25)
    rows = []
    for k in range(100):
        passage = prose(rng.randint(51, 90))
        rows += [(3 * k + j, " ".join(prose(rng.randint(30, 120)) + passage + prose(rng.randint(30, 120)))) for j in (0, 1)]
        rows.append((3 * k + 2, " ".join(prose(60) + (phrase if k % 2 else []) + prose(60))))  # a phrase that many share is no passage
    got = {r.doc_id: r.n_removed for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[3 * k + 1] > 0 for k in range(100)) >= 95
    assert all(got[3 * k] == 0 for k in range(100)) and sum(got[3 * k + 2] == 0 for k in range(100)) >= 98


def test_ids_of_other_types_and_clashing_names(spark, odd):
    rows = [(f"id{i}", r[1], 3, 4) for i, r in enumerate(rows_of(ODD))]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string, N_Removed int, n_sentences int"))
    assert out.columns == ["doc_id", "text", "n_sentences", "n_removed"] and out.count() == len(rows)
    assert sorted(r.text == "" for r in out.collect() if r.doc_id in ("id5", "id6")) == [False, True]
