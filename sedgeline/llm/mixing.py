"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Sizes are summed by (source, hash bucket). Under each source's budget lies one boundary bucket: every row below it is
taken, every row above it isn't, and only the boundary bucket's rows are summed again by the next bits of the hash. The
thresholds are nested: a smaller budget takes a subset. Rows are filtered against their source's threshold, never sorted.

Sources in code point order, null last, weigh 5, 2, 1, repeating, and share 100 % of all words. A target stops at CAP
times its source's words; what is cut off is shared again by weight among the others. A source with a target of several
times its words is taken whole that many times, and the rest by threshold. The rows on the threshold itself (one row,
unless rows repeat) give the part of their words that is still missing.

Defined results: null or empty text has size 0 and takes 0; an empty table gives an empty result; rows that repeat fall
on the same side of a threshold; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, attach, documents, stage, unstage

WEIGHTS = (5, 2, 1)
CAP = 3
#: Bits of the hash that each level of histograms reads; 63 in all.
LEVELS = (12, 12, 13, 13, 13)
SEED = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: source, source_size, target. The windows run over sources, not rows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    total, all_w = F.sum("source_size").over(Window.partitionBy()), F.sum("w").over(Window.partitionBy())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))
    done_w = F.coalesce(F.sum("w").over(before), F.lit(0))
    return (
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("w", weigh)
        .withColumn("ratio", cap * F.col("source_size") / F.col("w"))
        # the level of each possible set of capped sources; the right one is the highest
        .withColumn("level", (total - capped) / (all_w - done_w))
        .withColumn("level", F.max("level").over(Window.partitionBy()))
        .select("source", "source_size", F.least(F.col("w") * F.col("level"), (cap * F.col("source_size")).cast("double")).alias("target"))
    )


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: times (whole copies), budget, shift and prefix of the boundary bucket, below (words under it), held (words in it).

    rows: source, size, h (a hash of 63 bits).
    """
    quota = F.round("target").cast("long")
    state = targets.withColumn("times", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0)))
    state = state.withColumn("budget", quota - F.col("times") * F.col("source_size"))
    state = stage(
        state.select("*", F.lit(63).alias("shift"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.col("source_size").alias("held")),
        "mix-state",
    )
    n_sources, bits = state.count(), 0
    for width in LEVELS:
        bits += width
        shift = 63 - bits
        inside = attach(rows, state.select("source", "shift", "prefix"), ["source"], n_sources).where(F.expr("shiftrightunsigned(h, shift) = prefix"))
        hist = inside.groupBy("source", F.expr(f"shiftrightunsigned(h, {shift})").alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = attach(hist.withColumn("cum", F.sum("words").over(upto)), state.select("source", "budget", F.col("below").alias("under")), ["source"], n_sources)
        cross = (
            hist.where(F.col("under") + F.col("cum") > F.col("budget"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "cum", "words", "n")).alias("b"))
        )
        new = attach(state, cross, ["source"], n_sources)
        new = new.select(
            "source", "source_size", "target", "times", "budget",
            F.when(F.col("b").isNotNull(), F.lit(shift)).otherwise(F.col("shift")).alias("shift"),
            F.coalesce("b.bucket", "prefix").alias("prefix"),
            F.coalesce(F.col("below") + F.col("b.cum") - F.col("b.words"), "below").alias("below"),
            F.coalesce("b.words", "held").alias("held"),
            F.coalesce("b.n", F.lit(0)).alias("n"),
        )
        old, state = state, stage(new, "mix-state")
        unstage(old)
        if (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    return state


def taken() -> Column:
    """Words taken from a row that has its source's threshold beside it."""
    mine = F.expr("shiftrightunsigned(h, shift)")
    left = F.col("budget") - F.col("below")
    part = F.when(F.col("held") > 0, F.expr("cast(cast(size as decimal(38,0)) * (budget - below) div held as long)")).otherwise(F.lit(0))
    extra = F.when(F.col("budget") <= 0, F.lit(0)).when(mine < F.col("prefix"), F.col("size")).when((mine == F.col("prefix")) & (left > 0), part).otherwise(F.lit(0))
    return (F.col("times") * F.col("size") + extra).cast("long")


def row_hash(doc_id: Column, size: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, size, F.lit(SEED)), 1)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken. Texts are read once."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = stage(rows.withColumn("h", row_hash(F.col("doc_id"), F.col("size"))), "mix-rows")
    state = thresholds(rows, source_targets(rows, weights, cap))
    return attach(rows, state, ["source"]).select("doc_id", "source", "size", "source_size", "target", taken().alias("taken"))


def op3_mixing(spark, sf_dir) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, the one on the threshold cut behind the last word taken.

    What is kept of a cut text stands as it was, white space and line breaks too.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("source"), n_words(F.col("text")).alias("size"), "doc_id")
    rows = rows.select("doc", "source", "size", row_hash(F.col("doc_id"), F.col("size")).alias("h"))
    narrow = stage(rows.select("source", "size", "h"), "mix-rows")
    state = thresholds(narrow, source_targets(narrow))
    whole = F.col("taken").cast("long") - F.col("times") * F.col("size")
    takes = F.when(F.col("size") == 0, F.array(F.col("size"))).otherwise(
        F.concat(F.array_repeat(F.col("size"), F.col("times").cast("int")), F.when(whole > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>")))
    )
    out = attach(rows, state, ["source"]).withColumn("taken", taken()).select("doc", "size", F.explode(takes).alias("take"))
    with_space = F.regexp_extract_all("doc.text", F.lit(f"[{SPACE_CLASS}]*{WORD_CLASS}"), 0)  # each word and what stands before it
    cut = F.array_join(F.slice(with_space, F.lit(1), F.col("take").cast("int")), "")
    out = out.withColumn("__text", F.when(F.col("take") < F.col("size"), cut).otherwise(F.col("doc.text")))
    put = {"text": F.col("__text"), "n_chars": F.when(F.col("take") < F.col("size"), F.length("__text")).otherwise(F.col("doc.n_chars")) if "n_chars" in names else None}
    return out.select([(put[c] if put.get(c) is not None else F.col("doc").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in names])
