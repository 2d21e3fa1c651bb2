"""Quality rules from cross-document line frequency, in DataFrame operations only.

Every line is normalised (lower case, blanks squeezed) and hashed with its host to 64 bits. A line that more than max_docs
documents of one host carry, each counted once, is boilerplate of that host and is removed; a document that keeps less than min_left of its words
is depleted and rejected. A base rule on words and repetition comes first.

Scale: counting shuffles one hash for each line of a document, pre-aggregated. The frequent lines are written down; Spark broadcasts
that table if it is below the session's threshold, else the join is a shuffle, salted by document, so that a line that a third of all
documents carry is spread over SALTS tasks. Only lines to be removed go on from there. Texts are shuffled only if the cleaned
text is asked for. Two lines are confused only if their 64-bit hashes are equal. What rows lose is one row for each id, host and text, so that
very many equal rows are the larger side of the last join alone, which adaptive execution splits. A document's measures need its words
in memory at once.

Defined results: a null text has no words and fails the base rule; null hosts form one host; each row counts
as a document, rows that repeat an id, a host and a text get the same verdict, and one text under two hosts is judged under each; lines without words are never removed; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import WHITE_SPACE, durable, n_words, words

SYMBOLS = "#*$%&|<>"
SALTS = 16


def normal_line(line: Column) -> Column:
    """Lower case, with runs of white space as one blank and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def base_measures(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the column text.

    For n_repeat_words each 3-word window is one long: its hash in the high bits, its place in as many low bits as the text
    needs, so that sorting longs makes windows of equal hashes neighbours. Only these are then sorted by their words, which decide.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    blank = F.lit(0).cast("long")
    out = docs.withColumn("__w", words(F.col(text)))
    out = out.withColumn("n_words", F.size("__w").cast("long"))
    out = out.withColumn("word_chars", F.length(F.translate(t, WHITE_SPACE, "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    out = out.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE_SPACE, "")) > 0))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    out = out.withColumn("__bits", F.ceil(F.log2(F.size("__w") + 1.0)).cast("int"))
    packed = F.expr(
        "CASE WHEN size(__w) < 3 THEN array() ELSE transform(sequence(0, size(__w) - 3),"
        " i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __bits) | cast(i AS bigint)) END"
    )
    out = out.withColumn("__s", F.sort_array(packed.cast("array<bigint>")))
    alike = F.expr(
        "transform(filter(__s, (x, k) -> (k > 0 AND shiftrightunsigned(x, __bits) = shiftrightunsigned(__s[k - 1], __bits))"
        " OR (k < size(__s) - 1 AND shiftrightunsigned(x, __bits) = shiftrightunsigned(__s[k + 1], __bits))),"
        " x -> x & (shiftleft(1L, __bits) - 1))"
    )
    out = out.withColumn("__p", alike)
    # Words hold no blanks, so that a window's words joined by blanks are the window.
    named = F.expr("transform(__p, p -> named_struct('s', concat_ws(' ', __w[int(p)], __w[int(p) + 1], __w[int(p) + 2]), 'p', p))")
    out = out.withColumn("__p", F.sort_array(named))
    equal = F.expr("transform(filter(__p, (x, k) -> (k > 0 AND x.s = __p[k - 1].s) OR (k < size(__p) - 1 AND x.s = __p[k + 1].s)), x -> x.p)")
    out = out.withColumn("__p", F.sort_array(equal))
    covered = F.expr(
        "aggregate(__p, named_struct('end', 0L, 'n', 0L),"
        " (a, p) -> named_struct('end', p + 3, 'n', a.n + least(3L, p + 3 - a.end)), a -> a.n)"
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, blank))
    return out.drop("__w", "__lines", "__bits", "__s", "__p")


def line_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 50,
    min_left: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    clean_text: bool = False,
) -> DataFrame:
    """Per row: id, the base measures, base_failed, n_removed_words, kept; with clean_text also the text without its boilerplate lines."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text")).withColumn("__key", F.xxhash64("__text"))
    lines = rows.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, WHITE_SPACE, "")) > 0))
    hashed = F.transform("__lines", lambda x: F.xxhash64(F.col("__host"), normal_line(x)))
    counted = lines.select(F.explode(F.array_distinct(hashed)).alias("__line")).groupBy("__line").count()
    # Written down, so that its size is known: Spark broadcasts it below the session's threshold and shuffles it beyond.
    frequent = durable(counted.filter(F.col("count") > max_docs).select(F.col("__line").alias("__fl"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__fs")))
    each = lines.select("__id", "__host", "__key", F.posexplode("__lines").alias("__at", "__one"))
    each = each.select("__id", "__host", "__key", "__at", F.xxhash64("__host", normal_line(F.col("__one"))).alias("__line"), n_words(F.col("__one")).alias("__n"), F.pmod(F.xxhash64("__id", "__key"), F.lit(SALTS)).cast("int").alias("__salt"))
    hits = each.join(frequent, (F.col("__line") == F.col("__fl")) & (F.col("__salt") == F.col("__fs"))).select("__id", "__host", "__key", "__at", "__line", "__n").distinct()
    gone = hits.groupBy(F.col("__id").alias("__gid"), F.col("__host").alias("__gh"), F.col("__key").alias("__gk")).agg(F.sum("__n").alias("__gone"), *([F.collect_set("__line").alias("__drop")] if clean_text else []))
    base = base_measures(rows, "__text")
    same = F.col("__id").eqNullSafe(F.col("__gid")) & F.col("__host").eqNullSafe(F.col("__gh")) & (F.col("__key") == F.col("__gk"))
    out = base.join(gone, same, "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    removed = F.coalesce("__gone", F.lit(0)).cast("long")
    out = out.withColumn("base_failed", failed).withColumn("n_removed_words", removed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")))
    columns = [F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    if clean_text:
        left = F.filter(F.split("__text", "\n"), lambda x: ~F.coalesce(F.array_contains("__drop", F.xxhash64(F.col("__host"), normal_line(x))), F.lit(False)) | (F.length(F.translate(x, WHITE_SPACE, "")) == 0))
        columns.append(F.concat_ws("\n", left).alias(text_col))
    return out.select(*columns)
