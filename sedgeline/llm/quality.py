"""Quality rules: robust multivariate outliers of text statistics, per language and source. DataFrame functions only.

Each text gives a vector of transformed statistics. For each (lang, source), a minimum-covariance-determinant estimate
is found by concentration steps: start from medians and median deviations, keep the COVERAGE share of rows with the
smallest distances, take their mean and covariance, repeat until the determinants settle. Distances are Mahalanobis distances under the group's
estimate, scaled so that their median is that of a chi-square variable. Groups of a few rows lean on their language's
estimate: it counts as PRIOR_ROWS rows of every group. A row beyond the cutoff is rejected; the cutoff comes from the
table's own distances (see `cutoff`), labels play no part.

Aggregates combine on the map side, so a source with a third of all rows costs one row a task. Statistics of texts are
computed once into a narrow table. Defined results: null text has no words; texts without words fail the base rules and
take no part in estimates; null lang or source is a group of its own; rows at the same distance stay or go together;
repeated rows count each time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, attach, documents, stage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
COVERAGE = 0.75
#: Concentration steps at most; they end when no group's determinant changes by more than SETTLED (its logarithm).
STEPS, SETTLED = 6, 1e-3
PRIOR_ROWS = 50
#: Quantiles 0.5 and 0.999 of chi-square with five degrees of freedom.
CHI2_MEDIAN, CHI2_FAR = 4.3515, 20.515
#: Bins of the far distances' logarithms.
BIN = 0.02
#: Share of variance between two classes from which they count as two: that of a uniform density cut in halves.
TWO_CLASSES = 0.75
#: Interquartile ranges above the upper quartile, for one class.
FENCE = 1.5
#: Standard deviations in a median deviation, for a normal variable.
MAD_TO_SD = 1.4826
#: Variances below this are raised to it: statistics that are constant in a group don't reject by themselves.
FLOOR = (0.25, 0.04, 0.25, 0.25, 0.25)
DIM = len(FLOOR)
_X = [f"x{i}" for i in range(DIM)]
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _zip_hash(a: Column, step: int) -> Column:
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def _covered(h: Column) -> Column:
    """Words under windows that occur twice or more, from the windows' hashes."""
    by_hash = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

    def places(s: Column) -> Column:
        n = F.size(s) - 1
        same = F.zip_with(
            F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.when(a["v"] == b["v"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
        )
        return F.array_sort(F.array_distinct(F.flatten(same)))

    start = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
    add = lambda acc, x: F.struct((acc["words"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("words"), x.alias("last"))
    return let(by_hash, lambda s: F.aggregate(places(s), start, add, lambda acc: acc["words"]))


def repeated_words(words: Column) -> Column:
    """Number of words in WINDOW-word windows found twice or more; windows are compared by 64-bit hashes."""
    return let(
        _zip_hash_levels(F.transform(words, lambda w: F.xxhash64(w))),
        lambda h: F.when(F.size(h) < 2, F.lit(0)).when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)),
    )


def _zip_hash_levels(h: Column) -> Column:
    def zipped(step: int):
        return lambda a: _zip_hash(a, step)  # a parameter more would be taken for the element's index

    step = 1
    while step < WINDOW:
        h = let(h, zipped(step))
        step *= 2
    return h


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Base statistics of every whole text beside the kept columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    words = F.regexp_extract_all(text, F.lit(WORD_CLASS), 0)
    return docs.select(
        *keep,
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.greatest(F.size(F.split(text, "\n")), F.lit(1)).cast("long").alias("n_lines"),
    ).select(*keep, "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_lines")


def vector() -> list[Column]:
    """The transformed statistics."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p(F.col("n_words")),
        F.log(chars / n),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(10 * F.col("n_dup_lines") / F.col("n_lines")),
        F.log1p(10 * F.col("n_repeat_words") / n),
    ]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIM) for j in range(i + 1)]


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean and covariance by (lang, source), shrunk towards the language's; then the Cholesky factor of the covariance."""
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)]
    sums += [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _pairs()]
    own = stage(rows.groupBy("lang", "source").agg(*sums), "mcd-sums")
    n, m = F.col("n"), F.lit(float(PRIOR_ROWS))
    cov = lambda i, j, p="": F.col(f"{p}q{i}{j}") / F.col(f"{p}n") - F.col(f"{p}s{i}") * F.col(f"{p}s{j}") / F.col(f"{p}n") / F.col(f"{p}n")
    lang = own.groupBy("lang").agg(*[F.sum(c).alias(f"l{c}") for c in own.columns if c not in ("lang", "source")])
    both = attach(own, lang, ["lang"])
    out = both.select(
        "lang", "source",
        *[((F.col(f"s{i}") + m * F.col(f"ls{i}") / F.col("ln")) / (n + m)).alias(f"m{i}") for i in range(DIM)],
        *[((n * cov(i, j) + m * cov(i, j, "l")) / (n + m) + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0))).alias(f"c{i}{j}") for i, j in _pairs()],
    )
    for i in range(DIM):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - reduce(lambda a, k: a + F.col(f"f{i}{k}") * F.col(f"f{j}{k}"), range(j), F.lit(0.0))  # noqa: B023
            out = out.withColumn(f"f{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"f{j}{j}"))
    return stage(out.select("lang", "source", *[f"m{i}" for i in range(DIM)], *[f"f{i}{j}" for i, j in _pairs()]), "mcd-estimate")


def _distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance of each row under its group's estimate, as d2."""
    out = attach(rows, estimate, ["lang", "source"])
    for i in range(DIM):
        rest = F.col(_X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"f{i}{k}") * F.col(f"__z{k}")
        out = out.withColumn(f"__z{i}", rest / F.col(f"f{i}{i}"))
    d2 = reduce(lambda a, i: a + F.col(f"__z{i}") * F.col(f"__z{i}"), range(DIM), F.lit(0.0))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def _keep_nearest(rows: DataFrame) -> DataFrame:
    """The COVERAGE share of each group's rows with the smallest d2."""
    limit = rows.groupBy("lang", "source").agg(F.percentile_approx("d2", COVERAGE, F.lit(10_000)).alias("limit"))
    return attach(rows, limit, ["lang", "source"]).where(F.col("d2") <= F.col("limit")).drop("limit", "d2")


def mcd(rows: DataFrame) -> DataFrame:
    """Estimates for rows with lang, source and the vector's columns."""
    centre = rows.groupBy("lang", "source").agg(*[F.percentile_approx(x, 0.5, F.lit(10_000)).alias(f"med{i}") for i, x in enumerate(_X)])
    apart = attach(rows, stage(centre, "mcd-centre"), ["lang", "source"])
    off = [F.abs(F.col(x) - F.col(f"med{i}")) for i, x in enumerate(_X)]
    spread = apart.groupBy("lang", "source").agg(*[F.percentile_approx(d, 0.5, F.lit(10_000)).alias(f"mad{i}") for i, d in enumerate(off)])
    apart = attach(apart, stage(spread, "mcd-spread"), ["lang", "source"])
    d2 = reduce(lambda a, i: a + F.pow(off[i] / F.greatest(MAD_TO_SD * F.col(f"mad{i}"), F.lit(FLOOR[i])), F.lit(2)), range(DIM), F.lit(0.0))
    estimate = _estimate(_keep_nearest(apart.withColumn("d2", d2).select(*rows.columns, "d2")))
    for _ in range(STEPS):
        new = _estimate(_keep_nearest(_distances(rows, estimate)))
        size = reduce(lambda a, i: a + F.log(F.col(f"f{i}{i}")), range(DIM), F.lit(0.0))
        both = attach(new.select("lang", "source", size.alias("new")), estimate.select("lang", "source", size.alias("old")), ["lang", "source"])
        moved = both.agg(F.max(F.abs(F.col("new") - F.col("old")))).first()[0]
        estimate = new
        if moved is None or 2 * moved <= SETTLED:
            break
    return estimate


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def cutoff(distances: DataFrame) -> float:
    """The distance beyond which rows are rejected, from the column `distance` alone.

    Few rows of one normal class lie beyond CHI2_FAR; the logarithms of those that do are cut in two so that the variance
    between the classes is largest, and the cutoff is half-way between the classes' means. Where the classes aren't
    apart by more than halves of a uniform density, there is one class: the cutoff is Tukey's fence over all logarithms.
    """
    logs = distances.where(F.col("distance") > 0).select(F.log("distance").alias("x"))
    quartile = [F.percentile_approx("x", q, F.lit(10_000)) for q in (0.25, 0.75)]
    fence = logs.agg((quartile[1] + FENCE * (quartile[1] - quartile[0])).alias("x")).first()["x"]
    far = logs.where(F.col("x") > math.log(CHI2_FAR)).groupBy(F.floor(F.col("x") / BIN).alias("bin"))
    far = far.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    upto, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    far = far.select(
        F.sum("n").over(upto).alias("n"), F.sum("s").over(upto).alias("s"),
        F.sum("n").over(every).alias("all_n"), F.sum("s").over(every).alias("all_s"), F.sum("q").over(every).alias("all_q"),
    ).where(F.col("n") < F.col("all_n"))
    low, high = F.col("s") / F.col("n"), (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))
    between = F.col("n") * (F.col("all_n") - F.col("n")) / F.pow("all_n", F.lit(2)) * F.pow(high - low, F.lit(2))
    whole = F.col("all_q") / F.col("all_n") - F.pow(F.col("all_s") / F.col("all_n"), F.lit(2))
    best = far.select(between.alias("between"), (between / whole).alias("share"), ((low + high) / 2).alias("x")).agg(F.max(F.struct("between", "share", "x")).alias("b")).first()["b"]
    at = best["x"] if best and best["share"] > TWO_CLASSES else fence
    return math.inf if at is None else max(CHI2_FAR, math.exp(at))


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row a document: its statistics, base_failed, distance (scaled d2, null if the base rules failed) and kept."""
    rows = text_statistics(docs, ["doc_id", "lang", "source"]).withColumn("base_failed", base_failed())
    rows = stage(rows.select("*", *[v.alias(x) for v, x in zip(vector(), _X, strict=True)]), "quality-rows")
    good = rows.where(~F.col("base_failed")).select("lang", "source", *_X)
    estimate = mcd(good)
    scale = _distances(good, estimate).groupBy("lang", "source").agg(F.percentile_approx("d2", 0.5, F.lit(10_000)).alias("mid"))
    out = attach(_distances(rows, estimate), stage(scale, "mcd-scale"), ["lang", "source"])
    distance = F.when(~F.col("base_failed"), F.col("d2") * CHI2_MEDIAN / F.greatest("mid", F.lit(0.5)))
    out = stage(out.withColumn("distance", distance), "quality-distances")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff(out)))


def op8_quality(spark, sf_dir) -> DataFrame:
    return judge_quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
