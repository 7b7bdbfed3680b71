"""Quality rules with risk-controlled thresholds (native DataFrame code).

Each rule rejects a document whose signal lies beyond a cutoff. The cutoffs are
not chosen by hand: for every stratum (language) and signal, each candidate
cutoff of a fixed grid is tested on labelled documents held out for that
purpose. With n good documents in the stratum, k of them rejected, the exact
binomial tail P(Bin(n, a) <= k) is the p-value of "the rule rejects a share a
or more of the good documents"; it is at most d exactly when the exact
(Clopper-Pearson) upper bound at confidence 1 - d lies under a. Bonferroni over all
strata, signals and cutoffs makes all selected cutoffs hold together with
probability 1 - ``delta``; each signal gets an equal share of the risk budget
``alpha``, so the union of the rules stays within ``alpha`` per stratum. Among the
cutoffs that pass, the one with the most rejected bad minus rejected good
documents is taken, and none if that isn't positive. A stratum with too few
labels gets no cutoff and rejects nothing.

Defined results: null text is a text without words; documents without words
fail the base rule; repeated rows are judged alike; labels with a null id or
quality are ignored and repeated labels of one id count once (the lowest);
a null stratum never gets a cutoff; empty tables give empty results; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.llm.tables import bind, written

WS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ALPHA = 0.02
DELTA = 0.05

# signal -> cutoffs; a document is rejected where the signal is over the cutoff.
GRID = {
    "symbol_share": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5),
    "word_length": (8.0, 9.0, 10.0, 12.0, 15.0),
    "repeat_share": (0.02, 0.05, 0.1, 0.15),
    "shortness": (1 / 50, 1 / 30, 1 / 20, 1 / 15),
}


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[ \\t-\\r]+"))


def _window_hashes(words: Column) -> Column:
    def windows(h):
        at = lambda i, k: F.get(h, i + k)
        return F.when(F.size(h) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.size(h) - 5),
            lambda i: F.xxhash64(*[at(i, k) for k in range(5)])))
    return bind(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _covered(windows: Column) -> Column:
    """Words inside five-word windows that occur twice or more, first occurrence included."""
    def slow(g):
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def positions(s):
            same = lambda v, j: F.coalesce(F.get(s, j)["x"] == v["x"], F.lit(False))
            return F.sort_array(F.transform(
                F.filter(s, lambda v, j: same(v, j - 1) | same(v, j + 1)), lambda v: v["i"]))

        def union(p):
            # Each window adds the words up to the next one, five at most.
            return F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))),
                F.lit(0).cast("bigint"), lambda a, x: a + x)
        return bind(bind(ordered, positions), union)
    return bind(windows, lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(slow(g)))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    return bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def base_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = _words(text)

    def per_words(w):
        return F.struct(F.size(w).cast("bigint").alias("n"), _covered(_window_hashes(w)).alias("r"))
    out = docs.select(
        *keep,
        bind(words, per_words).alias("__w"),
        F.char_length(F.translate(text, WS, "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _dup_lines(text).cast("bigint").alias("n_dup_lines"),
        F.size(F.split(text, "\n")).cast("bigint").alias("n_lines"))
    return out.select(*keep, F.col("__w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                      F.col("__w.r").alias("n_repeat_words"), "n_lines")


def with_signals(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (stats.withColumn("base_failed", failed)
            .withColumn("symbol_share", F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)))
            .withColumn("dup_line_share", F.col("n_dup_lines") / F.col("n_lines"))
            .withColumn("word_length", F.col("word_chars") / n)
            .withColumn("repeat_share", F.col("n_repeat_words") / n)
            .withColumn("shortness", 1 / n))


def binomial_tail(k: Column, n: Column, a: float) -> Column:
    """P(Bin(n, a) <= k), for k < n*a; 1 otherwise (the tail is then useless as a p-value).

    Terms follow from each other in logarithms: t(i+1) = t(i) * (n-i)/(i+1) * a/(1-a).
    """
    step = math.log(a) - math.log1p(-a)
    start = F.struct((n * math.log1p(-a)).alias("t"), F.lit(0.0).alias("s"))

    def add(acc, i):
        return F.struct((acc["t"] + F.log((n - i) / (i + 1)) + step).alias("t"),
                        (acc["s"] + F.exp(acc["t"])).alias("s"))
    return F.when(k >= n * a, F.lit(1.0)).otherwise(
        F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), start, add, lambda x: x["s"]))


def select_cutoffs(labelled: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA,
                   grid: dict = GRID) -> DataFrame:
    """Risk-controlled cutoffs: one row per (stratum, signal) that has a valid one.

    ``labelled``: stratum, ``good`` boolean and the signals. All counts come from one
    partial aggregate whose width is the grid, so hot strata are summed where they lie.
    """
    cells = [(s, c) for s, cs in grid.items() for c in cs]
    hit = lambda s, c, g: F.sum(F.when((F.col(s) > c) & (F.col("good") == g), 1).otherwise(0))
    counts = labelled.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(
        F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("n"),
        F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(float(c)).alias("cutoff"),
                           hit(s, c, True).alias("k"), hit(s, c, False).alias("bad"))
                  for s, c in cells]).alias("cells"))
    strata = counts.agg(F.count(F.lit(1)).alias("n_strata"))  # one row
    long = counts.join(F.broadcast(strata)).select(stratum, "n", "n_strata", F.inline("cells"))
    p = binomial_tail(F.col("k"), F.col("n"), alpha / len(grid))
    valid = long.withColumn("p_value", p).where(
        (F.col("p_value") <= F.lit(delta) / (F.col("n_strata") * len(cells)))
        & (F.col("bad") > F.col("k")))
    w = Window.partitionBy(stratum, "signal").orderBy((F.col("bad") - F.col("k")).desc(), F.col("cutoff").desc())
    return valid.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(
        stratum, "signal", "cutoff", "n", "k", "bad", "p_value")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
          delta: float = DELTA, grid: dict = GRID) -> DataFrame:
    """Base counts, signals and verdict of every document (doc_id, text, ``stratum``)."""
    src = docs.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum"))
    # Written once: calibration and verdict both read it, the texts are scanned a single time.
    stats = with_signals(written(base_stats(src, ["doc_id", "stratum"]), "quality-stats"))
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
             .groupBy("doc_id").agg((F.min("quality") > 0).alias("good")))
    labelled = stats.where(~F.col("base_failed")).join(known, "doc_id")
    cutoffs = select_cutoffs(labelled, "stratum", alpha, delta, grid)
    rules = cutoffs.groupBy("stratum").agg(*[
        F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"__{s}") for s in grid])
    judged = stats.join(rules, "stratum", "left")
    broken = [F.coalesce(F.col(s) > F.col(f"__{s}"), F.lit(False)) for s in grid]
    rejected = broken[0]
    for b in broken[1:]:
        rejected = rejected | b
    return judged.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"),
        F.concat_ws(",", *[F.when(b, F.lit(s)) for s, b in zip(grid, broken)]).alias("broken_rules"))
