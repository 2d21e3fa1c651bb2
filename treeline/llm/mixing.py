"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a flow of its documents in a fixed shuffled order, read through at most PASSES times. A document's virtual finish
time in a pass is (the source's words up to and with it, earlier passes included) / the source's weight. All flows merge in order
of finish time, and the merged stream is cut where it reaches the budget, SHARE of all words. A source that has been read
PASSES times has nothing left to send, so the others take its part by weight: a source's target is the smaller of PASSES times
its size and weight x t, with the t at which the targets sum to the budget.

Scale: only (id, source, words, hash) leave the scan; they are written once. A source's running sum is taken in pieces of about
PIECE rows, dealt by source and leading bits of the hash, on top of a table of piece sums, so a source with a third of all rows is
spread over many tasks. The merged stream is sorted globally by ranges of finish time, each range in a task of its own; the sums of the
ranges say in which of them the budget ends, and only that range is looked through for the place. Sources, of which there may be as many
as hosts, are numbered and levelled in the same way, by ranges and sums of ranges. Only one row for each range of a sort, as many as there
are shuffle partitions, reaches one task or the driver.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in order; null
ids are ordered first; rows that agree in id, source and words are interchangeable; an empty table gives an empty result; an
input column with the name of an output column gives way to it; a very long text is counted whole, like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import durable, n_words, pieces_for

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
PIECE = 1_000
HASH_DIGITS = 15


def ranges(df: DataFrame, *order: Column) -> DataFrame:
    """The rows dealt into ranges of the order, written down, with their range as __range."""
    return durable(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def sums_before(df: DataFrame, order: tuple[Column, ...], columns: dict[str, str]) -> DataFrame:
    """df with, as columns[c], the sum of each column c over all rows earlier in the order, which must tell rows apart."""
    dealt = ranges(df, *order)
    # One row for each range, so that one task and every task can hold them.
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__sum_{c}") for c in columns])
    starts = totals.select(F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__sum_{c}").over(earlier), F.lit(0)).alias(f"__from_{c}") for c in columns])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    for c, name in columns.items():
        joined = joined.withColumn(name, F.col(f"__from_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return joined.select(*df.columns, *columns.values())


def source_targets(sizes: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, words): rank, source_size, weight and target of each source."""
    t = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size")).withColumn("__one", F.lit(1))
    t = sums_before(t, (F.col("__source").asc_nulls_last(),), {"__one": "__before"}).withColumn("__rank", (F.col("__before") + 1).cast("int"))
    t = t.withColumn("__weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1))
    t = t.withColumn("__cap", (passes * F.col("source_size")).cast("double")).withColumn("__runs_out", F.col("__cap") / F.col("__weight"))
    t = durable(sums_before(t, (F.col("__runs_out"), F.col("__rank")), {"__cap": "__caps", "__weight": "__weights"}))
    size, weight, last = t.agg(F.sum("source_size"), F.sum("__weight"), F.max("__runs_out")).first()
    # Of the sources in order of running out, the first that does not run out fixes t for all that follow.
    t = t.withColumn("__t", (F.lit(share * (size or 0)) - F.col("__caps")) / (F.lit(weight or 1.0) - F.col("__weights")))
    first = t.filter(F.col("__t") <= F.col("__runs_out")).agg(F.min(F.struct("__runs_out", "__rank", "__t")).alias("x")).first().x
    level = first["__t"] if first else last or 0.0
    return t.withColumn("target", F.least(F.col("__cap"), F.col("__weight") * F.lit(level))).select("__source", "__rank", "source_size", "__weight", "target")


def finish_times(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds to rows (__id, __source, __size, __hash, __piece) the first pass's finish time and the time that a whole pass takes."""
    sums = rows.groupBy("__source", "__piece").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    pieces = sums.alias("s").join(targets.alias("t"), F.col("s.__source").eqNullSafe(F.col("t.__source"))).select(
        F.col("s.__source").alias("__ps"), F.col("s.__piece").alias("__pp"), "__before", "__rank", "source_size", "__weight", "target"
    )
    joined = rows.join(pieces, F.col("__source").eqNullSafe(F.col("__ps")) & (F.col("__piece") == F.col("__pp")))
    inside = Window.partitionBy("__rank", "__piece").orderBy("__hash", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__before") + F.sum("__size").over(inside)
    return joined.withColumn("__finish", upto / F.col("__weight")).withColumn("__pass", F.col("source_size") / F.col("__weight")).drop("__ps", "__pp", "__before")


def cut(timed: DataFrame, budget: float, passes: int = PASSES) -> tuple[float, int] | None:
    """The last (finish time, source rank) that the merged stream sends before it would pass the budget; None if it sends nothing."""
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: F.col("__finish") + p * F.col("__pass")))
    stream = ranges(timed.filter("__size > 0").select("__size", "__rank", every.alias("__at")), F.col("__at"), F.col("__rank"))
    spent, sent = 0, None
    for r in stream.groupBy("__range").agg(F.sum("__size").alias("words"), F.max(F.struct("__at", "__rank")).alias("last")).orderBy("__range").collect():
        if spent + r.words > budget:
            inside = Window.partitionBy("__range").orderBy("__at", "__rank").rowsBetween(Window.unboundedPreceding, 0)
            found = stream.filter(F.col("__range") == r["__range"]).withColumn("__total", F.sum("__size").over(inside) + spent)
            return found.filter(F.col("__total") <= budget).agg(F.max(F.struct("__at", "__rank")).alias("x")).first().x or sent
        spent, sent = spent + r.words, r.last
    return sent


def copies(sent: tuple[float, int] | None, passes: int = PASSES) -> Column:
    """How many passes of a document lie before the cut."""
    if sent is None:
        return F.lit(0).cast("long")
    at, rank = sent
    times = [F.col("__finish") + p * F.col("__pass") for p in range(passes)]
    return F.when(F.col("__size") == 0, F.lit(0)).otherwise(sum((F.when((t < at) | ((t == at) & (F.col("__rank") <= rank)), 1).otherwise(0) for t in times), F.lit(0))).cast("long")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """All rows and columns (or, besides id and source, those named in keep), with size, source_size, target, copies and taken (= copies x size)."""
    added = ("size", "source_size", "target", "copies", "taken")

    def sized(*columns: str) -> DataFrame:
        d = docs.select(*columns, F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), n_words(F.col(text_col)).alias("__size"))
        shuffled = F.md5(F.concat_ws("|", F.coalesce(F.col("__id").cast("string"), F.lit("null")), F.col("__size").cast("string")))
        return d.withColumn("__hash", F.conv(F.substring(shuffled, 1, HASH_DIGITS), 16, 10).cast("long"))

    others = [f"`{c}`" for c in (docs.columns if keep is None else keep) if c.lower() not in added and c not in (id_col, source_col)]
    narrow = durable(sized())
    rows, total = narrow.agg(F.count(F.lit(1)), F.sum("__size")).first()
    bits = pieces_for(rows, PIECE)
    piece = F.shiftright(F.col("__hash"), 4 * HASH_DIGITS - bits)
    targets = durable(source_targets(narrow, share, passes, weights))
    timed = durable(finish_times(narrow.withColumn("__piece", piece), targets))
    sent = cut(timed, share * (total or 0), passes)
    # A caller that keeps no other column gets the narrow table; with texts the same times are taken over the whole rows.
    wide = timed if not others else finish_times(sized(*others).withColumn("__piece", piece), targets)
    out = wide.withColumn("copies", copies(sent, passes))
    return out.select(
        F.col("__id").alias(id_col), F.col("__source").alias(source_col), *[F.col(c) for c in others], F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken")
    )
