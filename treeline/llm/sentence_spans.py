"""Substring dedup over sliding spans of sentences.

A text is cut into sentences after . ! ? (and closing marks) and at line ends. A second level cuts long sentences, so that a passage set
into the middle of another sentence is found, too: of every WINDOW words of a sentence, the last of those with the least hash ends a
piece. Such a cut depends on the words of its own window only, so that equal passages are cut alike wherever they stand, and no
WINDOW words are without one: any 3 * WINDOW + 1 words of a passage hold a complete span. From every piece a span runs over the fewest
consecutive pieces, MIN_SENTENCES at least, that hold MIN_WORDS words. Spans are hashed to 128 bits over their lower-cased words and
joined over the whole corpus. The first occurrence of a span is the one in the row with the least id (of rows that share it, the one
with the least hash of its text), and within a row the earliest; what spans cover elsewhere is repeated. Neighbouring repeated pieces are removed
if they hold min_run words together or make up the whole text, so that a clean document keeps a sentence or two that others happen to have.

Scale: spans are computed once and written to the shared folder as (row, hash, place). Counting the rows of a hash is a grouping with
partial sums; the repeated hashes are joined back by a sort-merge join whose both sides are shuffled, so that adaptive execution splits
the partition of a passage that very many rows share. What a row loses is gathered by row, bounded by the row's own length, and written
down, so that its size is known when it meets the texts: below the session's threshold it is broadcast and no text is shuffled. No row meets
all others of its group.

Defined results: null and empty texts pass unchanged; texts with fewer words than MIN_WORDS or fewer pieces than MIN_SENTENCES form
one span over the whole text (so that short copies are found, too) unless they have fewer than SHORT words; rows that repeat an id and a
text are one row and both are kept; ids that aren't whole numbers are ordered by their hash; null ids come after all others, ordered by
a hash of the text; a very long text costs its length; an input column named n_sentences or n_removed gives way; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from treeline.llm.common import durable, scratch, with_small_batches, written

MIN_SENTENCES = 2
MIN_WORDS = 15
SHORT = 8
#: No so many words are without a cut.
WINDOW = 16
#: Words that neighbouring repeated pieces hold at least where they are removed.
MIN_RUN = 35

#: Spans and rows that a worker holds before it hands them on.
BATCH_SPANS, BATCH_ROWS = 20_000, 500

SENTENCE = re.compile(r".*?(?:[.!?]+[\"'”’»)\]]*\s+|\n\s*|\Z)", re.S)

PART = re.compile(r"\s*\S+\s*")


def chosen(h: list[int]) -> list[int]:
    """The places after the last of the least values of every WINDOW values, in order."""
    out, at, n = [], 0, len(h)
    while at + WINDOW <= n:
        window = h[at : at + WINDOW]
        least = min(window)
        best = at + WINDOW - 1 - window[::-1].index(least)
        out.append(best + 1)
        for i in range(at + WINDOW, min(n, best + WINDOW)):
            if h[i] <= least:
                at = i - WINDOW + 1
                break
        else:
            at = best + 1
    return out


def sentences(text: str) -> list[str]:
    """The sentences, long ones in pieces, with the white space that follows them; joined, they are the text."""
    out = []
    for s in SENTENCE.findall(text):
        if not s:
            continue
        if len(s) <= 2 * WINDOW or len(words := s.lower().split()) <= WINDOW:
            out.append(s)
            continue
        parts = PART.findall(s)
        # The last word ends the sentence anyway.
        ends = chosen(list(map(xxhash.xxh32_intdigest, words[:-1])))
        out += ["".join(parts[x:y]) for x, y in pairwise([0, *ends, len(parts)])]
    return out


def spans(text: str, found: list[str] | None = None) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, digest) of every span."""
    cut = sentences(text) if found is None else found
    norm = [s.lower().split() for s in cut]
    size = [len(w) for w in norm]
    joined = [" ".join(w) for w in norm]
    n, total = len(cut), sum(size)
    if total < SHORT:
        return []
    if n < MIN_SENTENCES or total < MIN_WORDS:
        return [(0, n, xxhash.xxh3_128_digest(" ".join(x for x in joined if x)))]
    out, end, words = [], 0, 0
    for i in range(n):
        while end < n and (end - i < MIN_SENTENCES or words < MIN_WORDS):
            words += size[end]
            end += 1
        if end - i < MIN_SENTENCES or words < MIN_WORDS:
            break
        out.append((i, end - i, xxhash.xxh3_128_digest(" ".join(x for x in joined[i:end] if x))))
        words -= size[i]
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, h1, h2, at, n, again): again if the row has the same span before."""
    names = ["row", "key", "h1", "h2", "at", "n", "again"]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for row, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            t = text.as_py()
            if not t:
                continue
            seen = set()
            for at, n, h in spans(t):
                for c, v in zip(cols, (row, key, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), at, n, h in seen), strict=True):
                    c.append(v)
                seen.add(h)
            if len(cols[0]) > BATCH_SPANS:
                yield _batch(cols, names)
                cols = [[] for _ in names]
        yield _batch(cols, names)


def _batch(cols: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def removed(text: str, lost: list[tuple[int, int]], min_run: int = MIN_RUN) -> tuple[str, int, int]:
    """The text without the lost sentences, how many it had and how many went."""
    cut = sentences(text)
    gone = bytearray(len(cut))
    for at, n in lost:
        gone[at : at + n] = b"\x01" * n
    start = gone.find(1)
    while start >= 0:
        end = gone.find(0, start)
        end = len(cut) if end < 0 else end
        if end - start < len(cut) and sum(len(s.split()) for s in cut[start:end]) < min_run:
            gone[start:end] = bytes(end - start)
        start = gone.find(1, end)
    return "".join(s for s, g in zip(cut, gone, strict=True) if not g), len(cut), sum(gone)


def _cleaner(at: int, min_run: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH_ROWS):
                yield cleaned(whole.slice(first, BATCH_ROWS))

    def cleaned(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, had, went = [], [], []
        for t, lost in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
            t, lost = t.as_py(), lost.as_py()
            if lost:
                t, h, w = removed(t, [(x["at"], x["n"]) for x in lost], min_run)
            else:
                h, w = len(sentences(t or "")), 0
            texts.append(t)
            had.append(h)
            went.append(w)
        cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(had, pa.int32()), pa.array(went, pa.int32())], names=[*b.schema.names[:-1], "n_sentences", "n_removed"])

    return clean


def row_order(docs: DataFrame, id_col: str, key: Column) -> Column:
    """A row's place among others, as a long: its id or, where ids aren't whole numbers, their hash; null ids come last by their text."""
    own = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.shiftrightunsigned(F.xxhash64(id_col), 2)
    return F.coalesce(F.when(F.col(id_col).isNotNull(), own), F.lit(2**62) + F.shiftrightunsigned(key, 2))


def lost_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, key, lost): for each row that loses something, the spans (at, n) that aren't first occurrences."""
    key = F.xxhash64(F.col(text_col))
    row = row_order(docs, id_col, key)
    found = durable(docs.select(row.alias("row"), key.alias("key"), F.col(text_col).alias("text")).mapInArrow(_spans, "row long, key long, h1 long, h2 long, at int, n int, again boolean"))
    # at and n in one number, for smaller shuffles.
    place = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("place")
    fresh = found.filter("NOT again").select("h1", "h2", "row", "key", place)
    repeated = fresh.groupBy("h1", "h2").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    joined = fresh.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))
    joined = durable(joined.select("h1", "h2", "row", "key", "place", (F.col("row") > F.col("first")).alias("later")))
    # Rows that share the least id but not their text are told apart by the key, and the smaller key is first.
    least = joined.filter("NOT later")
    shared = least.groupBy("h1", "h2").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "low")
    tied = least.join(shared, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))).filter("key > low")
    here = found.filter("again").select("row", "key", place)
    lost = joined.filter("later").select("row", "key", "place").union(tied.select("row", "key", "place")).union(here)
    where = F.struct(F.shiftright("place", 32).cast("int").alias("at"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n"))
    return lost.groupBy("row", "key").agg(F.collect_set(where).alias("lost"))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """All rows and columns with the repeated sentences cut from the text, and n_sentences and n_removed (pieces of long ones count)."""
    added = ("n_sentences", "n_removed")
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = with_small_batches(docs).select(*[F.col(f"`{c}`") for c in kept])
    key = F.xxhash64(F.col(text_col))
    rows = rows.withColumn("__key", key).withColumn("__row", row_order(docs, id_col, F.col("__key")))
    with scratch(docs.sparkSession):  # spans are not needed once it is known what goes
        lost, _ = written(lost_spans(docs, id_col, text_col))
    lost = lost.select(F.col("row").alias("__lost_row"), F.col("key").alias("__lost_key"), F.col("lost").alias("__lost"))
    whole = rows.join(lost, (F.col("__row") == F.col("__lost_row")) & (F.col("__key") == F.col("__lost_key")), "left").select(*[F.col(f"`{c}`") for c in kept], "__lost")
    schema = whole.drop("__lost").schema.add("n_sentences", "integer").add("n_removed", "integer")
    return whole.mapInArrow(_cleaner(kept.index(text_col), min_run), schema)
