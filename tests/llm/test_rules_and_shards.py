"""Quality rules, sharding, mixing and top-k: odd inputs, brute force and laws."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from treeline.llm import queries, shard_tree
from treeline.llm.line_rules import line_rules
from treeline.llm.mixing import mix_sources, source_targets
from treeline.llm.shard_tree import grown, leaves, shard_documents, tree

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    fix = lambda x: round(x, 5) if isinstance(x, float) else x
    got = sorted((tuple(fix(r[c]) for c in names) for r in df.collect()), key=repr)
    ask = con.execute(queries.oracle_sql()[name])
    have = [d[0] for d in ask.description]
    assert sorted(have) == names
    assert got == sorted((tuple(fix(dict(zip(have, r, strict=True))[c]) for c in names) for r in ask.fetchall()), key=repr)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def measures(t):
    w = words(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(win) if c[x] > 1 for k in range(3)})


def test_base_measures_of_odd_texts(odd):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_rules(odd).collect())
    assert got == Counter((r.doc_id, *measures(r.text)) for r in odd.collect())


def test_lines_above_the_limit_go(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"Common   LINE here\n{body(i)}", "h") for i in range(6)] + [(10 + i, f"common line here\n{body(10 + i)}", "other") for i in range(3)]
    rows += [(20, "\n".join(["common line here"] * 30) + "\nrest of it", "h"), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.n_removed_words, r.kept, r.text) for r in line_rules(df, max_docs=5, max_repeat_percent=100, clean_text=True).collect()}
    assert {(i, 3, True, body(i)) for i in range(6)} | {(10 + i, 0, True, rows[6 + i][1]) for i in range(3)} | {(20, 90, False, "rest of it")} == got


def test_one_id_and_text_under_two_hosts(spark):
    """The line is frequent in h1 and rare in h2, and the document is judged under each."""
    body = " ".join(f"w{j}" for j in range(60))
    rows = [(i, f"common line here\n{body} {i}", "h1") for i in range(6)] + [(50, f"common line here\n{body}", h) for h in ("h1", "h2", None)]
    got = {(r.doc_id, r.n_removed_words) for r in line_rules(spark.createDataFrame(rows, SCHEMA), max_docs=5).collect()}
    assert got == {(i, 3) for i in range(6)} | {(50, 3), (50, 0)}


def test_repeated_windows_in_a_long_text(spark):
    rng = random.Random(4)
    t = " ".join(rng.choice("abcdefghijkl") + rng.choice("mnopqrst") for _ in range(20_000))
    got = line_rules(spark.createDataFrame([(1, t, "s")], SCHEMA)).first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == measures(t)


def test_rules_on_an_empty_table(empty):
    assert line_rules(empty).count() == 0 == mix_sources(empty).count() == shard_documents(empty).count()


def test_shards_follow_the_law(spark, odd):
    out = shard_documents(odd)
    assert set(out.columns) == set(odd.columns) | {"text_crc32", "law", "slot", "grown_shard"}
    rows = out.collect()
    for r in rows:
        t = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(t) + 8, zlib.crc32(t), "key")
        assert r.grown_shard in (r.shard, 24)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = shard_documents(spark.range(24_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).groupBy("shard").count().collect()
    assert len(many) == 24 and all(800 < r["count"] < 1200 for r in many)


def test_slots_of_equal_rows_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(shard_tree, "PIECE", 40)
    plain = spark.range(2000).select("id", F.lit("x").alias("text"))
    equal = spark.range(0, 1000, 1, 7).select(F.lit(None).cast("long").alias("id"), F.lit("same").alias("text"))
    named = spark.range(0, 300, 1, 3).select(F.lit(5).cast("long").alias("id"), F.lit("x").alias("text"))
    got = shard_documents(plain.union(equal).union(named).withColumnRenamed("id", "doc_id")).collect()
    slots, places = defaultdict(list), defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        places[r.doc_id].append(r.slot)
    assert len(got) == 3300 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    for i, n in ((None, 1000), (5, 301)):
        assert sorted(places[i]) == list(range(min(places[i]), min(places[i]) + n))


def test_growing_twice_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    root = grown(tree(2, 2, 2))
    assert [n.shard for n in leaves(root)] == list(range(9))
    assert all(r.grown_shard in (r.shard, 9) for r in shard_documents(ids, root=root).collect())


def fill(sizes, weights, budget, passes=2):
    """Targets by handing out what is left, round after round."""
    got, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = budget - sum(got[s] for s in sizes if s not in open_)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > passes * sizes[s]}
        for s in over or open_:
            got[s] = passes * sizes[s] if over else share[s]
        open_ -= over or open_
    return got


def test_targets_and_takes(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", "dd", None])) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix_sources(df).collect()
    again = mix_sources(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    weights = dict(zip(["a", "b", "c", "dd", None], [3, 1, 2, 3, 1], strict=True))
    target = fill(sizes, weights, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 80 for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_any_number_of_ranges_gives_the_same_cut(spark):
    df = spark.createDataFrame([(i, "w " * (i % 13), f"s{i % 70}") for i in range(3000)], SCHEMA)
    whole = {r.doc_id: (r.taken, r.target) for r in mix_sources(df).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert whole == {r.doc_id: (r.taken, r.target) for r in mix_sources(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = sum(i % 13 for i in range(3000))
    assert 1.5 * total - 24 <= sum(t for t, _ in whole.values()) <= 1.5 * total


def test_clashing_names(spark, docs):
    names = {c: F.lit("x") for c in ("taken", "target", "copies", "source_size", "size", "slot", "law", "shard", "grown_shard", "text_crc32", "n_words", "kept", "gone", "count")}
    odd = docs.withColumns(names)
    for f, c in ((lambda d: mix_sources(d, keep=()), "taken"), (shard_documents, "slot"), (line_rules, "n_removed_words")):
        a, b = ({(r.doc_id, r[c]) for r in f(x).collect()} for x in (odd, docs))
        assert a == b


def test_shares_follow_weights(spark):
    """A node's share of the documents is its part of the weights."""
    root = shard_tree.group("root", [shard_tree.group("a", [shard_tree.group("ak", [shard_tree.leaf(0, 3.0), shard_tree.leaf(1, 1.0)])]), shard_tree.group("b", [shard_tree.group("bk", [shard_tree.leaf(2, 4.0)])])])
    ids = spark.range(16_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = {r.shard: r["count"] for r in shard_documents(ids, root=root).groupBy("shard").count().collect()}
    assert all(abs(got[s] - n) < 300 for s, n in ((0, 6000), (1, 2000), (2, 8000)))


def test_a_changed_weight_moves_rows_only_into_its_subtrees(spark):
    """With shard 2 of rack 1 in region 0 heavier, rows move only into a subtree that holds it, at every level; the rest stays."""

    def build(w):
        number = iter(range(12))
        racks = lambda r: [shard_tree.group(f"r{r}k{k}", [shard_tree.leaf(i, w if i == 5 else 1.0) for i in (next(number) for _ in range(3))]) for k in range(2)]
        return shard_tree.group("root", [shard_tree.group(f"r{r}", racks(r)) for r in range(2)])

    ids = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = ({r.doc_id: r.shard for r in shard_documents(ids, root=build(w)).collect()} for w in (1.0, 3.0))
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    region, rack = lambda s: s // 6, lambda s: s // 3
    assert moved and any(y == 5 for _, y in moved)
    for x, y in moved:
        if region(x) != region(y):
            assert region(y) == 0  # the heavier region gains
        elif rack(x) != rack(y):
            assert rack(y) == 1  # within a region, the heavier rack
        else:
            assert y == 5  # within a rack, the heavier shard


def test_mixing_odd_rows(odd):
    out = mix_sources(odd)
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns) | {"source_size", "target", "copies", "taken"}
    assert all(r.taken == 0 for r in out.filter("size = 0").collect())
    assert source_targets(odd.select(F.col("source").alias("__source"), F.lit(0).alias("__size"))).filter("target <> 0").count() == 0
