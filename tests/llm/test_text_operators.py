"""Licenses, classifier, near and substring dedup, encoding, toxicity and the pipeline."""

import random
import re
import zlib
from array import array

import pytest
import sentencepiece
import xxhash
from brute_substrings import brute_dedup
from odd_rows import LONG, ODD, SF
from pyspark.sql import functions as F

import corpus_pipeline
from test_near_copies import exact
from treeline.llm import near_copies, queries, sentence_spans
from treeline.llm import simhash_bk as bk
from treeline.llm.license_align import align, increasing
from treeline.llm.quality_net import quality_scores, train
from treeline.llm.sentence_spans import dedup_substrings, sentences, spans
from treeline.llm.sentencepiece_wfst import META, MODEL, Normaliser, encode_documents, load
from treeline.llm.toxic_lexicon import Lexicon, finds, folded, toxicity_scores

SCHEMA = "doc_id long, text string, source string"


def shuffled(x):
    return sorted(map(repr, x))


# Licenses


def test_patience_finds_a_longest_increasing_run():
    rng = random.Random(1)
    for _ in range(50):
        p = list(range(9))
        rng.shuffle(p)
        best = max(sum(m >> i & 1 for i in range(9)) for m in range(512) if (s := [p[i] for i in range(9) if m >> i & 1]) == sorted(s))
        got = increasing(list(enumerate(p)))
        assert len(got) == best and [b for _, b in got] == sorted(b for _, b in got)


def test_alignment_is_common_and_increasing():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert align("a x b y c".split(), "a b c".split()) == [(0, 0), (2, 1), (4, 2)]


# Learned scores


def accuracy(spark, scores, column):
    rows = scores.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    return rows.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


@pytest.mark.parametrize("name, column", [("op3_quality_classifier", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, column):
    out = queries.queries()[name](spark, "/root/testdata/sf0.01")
    rows = out.collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert accuracy(spark, out, column) >= 0.9


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_scores_of_odd_tables(spark, odd, empty, labels, score):
    out = score(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert score(odd, labels.limit(0)).count() == odd.count() and score(empty, labels).count() == 0


def test_training_needs_two_kinds():
    import numpy as np

    assert train(np.zeros((20, 4), "float32"), np.ones(20)).scores(np.zeros((1, 4)))[0] > 0.9


def test_folding_and_exceptions():
    assert folded("  1D10T, ЅСUМ!  p@th") == " idiot scum path " and folded(None) == " "
    lex = Lexicon({" scum ": 2.0, " idio": 1.0}, (" pond scum ",))
    a = lex.automaton()
    assert [w for _, _, w in finds(folded("idiotic pond scum and scum"), a)] == [1.0, 2.0]


# Near duplicates


def reference_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, radius=4):
    """The smallest index that each value is connected with, over all pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_of_odd_texts():
    assert [bk.fingerprint(t) for t in ODD] == [reference_print(t) for t in ODD]


def cloud(n, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.choice(out) if out and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("most", [10_000, 60, 8])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, most):
    """Also with shards dealt again, and with dense ones cut into parts."""
    values = cloud(300)
    df = spark.createDataFrame([(bk.signed(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in bk.components(bk.links(df, len(values), most)).collect()}
    got, want = {}, {}
    for v, c in zip(values, classes(values), strict=True):
        got.setdefault(roots.get(bk.signed(v), bk.signed(v)), set()).add(v)
        want.setdefault(c, set()).add(v)
    assert shuffled(map(sorted, got.values())) == shuffled(map(sorted, want.values()))


def test_near_duplicates_against_all_pairs(docs):
    rows = docs.orderBy("doc_id").collect()
    want = classes([reference_print(r.text) for r in rows])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in bk.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (f"{reference_print(r.text):016x}", rows[c].doc_id) for r, c in zip(rows, want, strict=True)}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(12)
    nodes = rng.sample(range(-(10**9), 10**9), 400)
    edges = [(nodes[i], nodes[i + 1]) for i in range(99)] + [(nodes[100], nodes[i]) for i in range(101, 300)] + [(nodes[300 + i % 7], nodes[310 + i]) for i in range(80)]
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "u long, v long")
    got = {r.node: r.root for r in bk.components(df).collect()}
    groups = [nodes[:100], nodes[100:300], *([nodes[300 + k], *(nodes[310 + i] for i in range(80) if i % 7 == k)] for k in range(7))]
    assert got == {x: min(g) for g in groups for x in g if x != min(g)}


def test_rows_that_agree_in_id_and_text(spark):
    """One of them stays, whatever else they hold, and a row of another id is never kept in its place."""
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "q r s t u v", "x"), (None, "q r s t u v", "x"), (2, "a b c d e f", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    for keep in (bk.keep_one, near_copies.keep_one):
        got = sorted(map(repr, (tuple(r) for r in keep(df).collect())))
        assert got == sorted(map(repr, (tuple(r) for r in keep(df.repartition(5)).collect())))
        assert len(got) == 2 and got[0].startswith("(1,") and "q r s" in got[1]


def test_near_duplicates_of_odd_rows(odd, empty):
    out = bk.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {r.component_id for r in out if r.fingerprint == "0" * 16} == {0}
    kept = bk.keep_one(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.filter("text LIKE 'Same%'").collect()] == [5]
    assert bk.near_duplicates(empty).count() == 0 == bk.keep_one(empty).count()


# Substrings


def test_sentences_are_a_partition():
    for t in ODD:
        assert "".join(sentences(t or "")) == (t or "")
    assert len(sentences(LONG)) > 1000


def test_a_planted_passage_goes_from_all_but_the_first(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join((word() + (". " if rng.random() < 0.12 else "")).strip() for _ in range(n))
    passage = prose(80) + "."
    texts = [f"{prose(60)} {passage} {prose(60)}" for _ in range(5)] + [prose(150)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in dedup_substrings(df).collect()}
    core = sentences(passage)[1:-1]
    assert got[0] == texts[0] and got[5] == texts[5]
    assert all(s not in got[i] for i in range(1, 5) for s in core[1:-1] if len(s.split()) > 2)


def test_substrings_of_odd_rows(odd, empty):
    out = dedup_substrings(odd)
    assert set(out.columns) == set(odd.columns) | {"n_sentences", "n_removed"} and out.count() == odd.count()
    same = {(r.doc_id, r.text) for r in out.collect() if r.doc_id in (5, 6)}
    assert same == {(5, ODD[5]), (6, "")}
    assert dedup_substrings(empty).count() == 0


def test_spans_depend_on_their_words_only():
    tail = "The quick brown fox jumps over it. A lazy dog sleeps on and on. Nobody minds at all, they say."
    assert {h for _, _, h in spans("Something else before. " + tail)} >= {h for _, _, h in spans(tail)}
    assert sentence_spans.spans("") == []


# Encoding


def test_encoding_equals_the_library(docs):
    t, lib = load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in docs.collect()] + [x for x in ODD if x is not None] + ["▁a ▁ b", "<s></s><unk><0x0A>", "    four\n\n\ttab", "aaaaaaaaaaaaaaaaaaaa", "日本語テキスト🎉é́"]
    for x in texts:
        ids = t.encode(x).tolist()
        assert ids == lib.encode(x) and t.decode(ids) == lib.decode(ids)
        assert t.decode(ids) == x or "▁" in x


def test_encoding_of_odd_rows(odd, empty):
    out = encode_documents(odd)
    assert set(out.columns) == set(odd.columns) | {"n_tokens", "round_trip"}
    for r in out.collect():
        assert (r.ids is None) == (r.text is None) and (r.text is None or (r.round_trip and r.n_tokens == len(r.ids)))
    assert encode_documents(empty).count() == 0


@pytest.mark.parametrize("prefix", [True, False])
def test_normaliser(prefix):
    start = META if prefix else ""
    for t in ["", " ", "   ", "a", " a", "a ", "  a   b  ", "a\t b\n  c", "x" * 50 + "  "]:
        assert Normaliser(prefix, False).run(t) == (start + t.replace(" ", META) if t else "")
        squeezed = re.sub(" +", " ", t.strip(" "))
        assert Normaliser(prefix, True).run(t) == (start + squeezed.replace(" ", META) if squeezed else "")


def test_paths_against_merging():
    """The shortest path is what merging the whole text gives."""
    t = load(MODEL)
    rng = random.Random(5)
    for _ in range(300):
        x = META + "".join(rng.choice("aeinrst▁ohdl\u00e9\u4e00") for _ in range(rng.randint(1, 14)))
        ids = [i for s in t.merged(list(x)) for i in t.written(t.ids.get(s, len(t.pieces)), s)]
        assert t.chunk(x) == bytes(memoryview(array("i", ids)))


# The pipeline


def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r.doc_id: r.predicted for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = sorted((r.doc_id, r.text) for r in docs.collect() if scored[r.doc_id])
    stay = exact(good)
    single = [x for x in good if x[0] in stay]
    cut = {i: t for i, t in brute_dedup(single).items() if t.strip() or not dict(single)[i].strip()}
    stages = dict(corpus_pipeline.STAGES)
    kept = docs
    for name in list(stages)[:3]:
        kept = stages[name](spark, kept, SF)
        assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == cut
    total = {i: len((t or "").split()) for i, t in cut.items()}
    out = corpus_pipeline.run(spark, SF).collect()
    sent = sum(len(re.findall(r"[^\x20\x09-\x0D]+", cut[r.doc_id])) for r in out)
    assert {r.doc_id for r in out} <= set(cut) and all(r.round_trip for r in out)
    assert 1.5 * sum(total.values()) - max(total.values()) * 2 <= sent <= 1.5 * sum(total.values()) + 1
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(r.ids == lib.encode(cut[r.doc_id]) for r in out)
