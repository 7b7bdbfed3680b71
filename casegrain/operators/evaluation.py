"""Summary and extractor metrics: ROUGE-N, corpus BLEU, ROUGE-L, span P/R/F1.

Both token lists of a pair are in one row, so its clipped n-gram overlaps are counted
there, for all orders in one pass over Arrow batches: no gram is shuffled. Pairs that share a key count as one;
theirs are exploded rows counted per (key, gram) with map-side partial aggregation and a full-outer join on
(key, gram) followed by ``least``, so they are never gathered.  ROUGE-L needs an
LCS dynamic program per pair, which has no set-wise form: it runs as an
Arrow-batched pandas UDF over whole token lists (bit-parallel).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions.batches import over_batches
from casegrain.functions.text import col_of, let
from casegrain.session import materialize


def ngrams(toks, n: int) -> Column:
    """Space-joined n-grams of a token array (empty when shorter than n)."""
    if n == 1:
        return col_of(toks)

    def build(t):
        last = F.size(t) - n + 1
        # sequence(1, x) counts down when x < 1, so bound both ends.
        return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last),
                           lambda i: F.array_join(F.slice(t, i, n), " "))
    # Bound once: a column referenced inside a lambda is re-evaluated per element.
    return let(col_of(toks), build)


def _tagged_grams(toks, ns) -> Column:
    """array<struct<n, gram>> over all requested n-gram orders."""
    return F.flatten(F.array(*[F.transform(ngrams(toks, n), _tag_n(n)) for n in ns]))


def _tag_n(n: int):
    return lambda g: F.struct(F.lit(n).cast("bigint").alias("n"), g.alias("gram"))


def gram_counts(pairs: DataFrame, key: str, toks: str, ns) -> DataFrame:
    """(key, n, gram, cnt) for every order in ``ns`` in one explode and one aggregation."""
    return (pairs.select(key, F.explode_outer(_tagged_grams(F.col(toks), ns)).alias("x"))
            .filter(F.col("x").isNotNull())
            .groupBy(key, "x.n", "x.gram").agg(F.count(F.lit(1)).alias("cnt")))


def grams_of(toks: list, n: int) -> Iterator[str]:
    """The grams that :func:`ngrams` gives, without nulls."""
    if None in toks:
        return (g for g in (toks if n == 1 else [" ".join(t for t in toks[i:i + n] if t is not None) for i in range(len(toks) - n + 1)])
                if g is not None)
    return iter(toks) if n == 1 else map(" ".join, zip(*[toks[i:] for i in range(n)]))


def _row_overlap(pairs: DataFrame, key: str, cand: str, ref: str, ns) -> DataFrame:
    """(key, n, overlap) of pairs whose key no other pair has, counted in the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for c, r in zip(batch.column(cand).to_pylist(), batch.column(ref).to_pylist()):
                for n in ns:
                    own = Counter(grams_of(c or [], n))
                    other = Counter(filter(own.__contains__, grams_of(r or [], n)))
                    found.append(sum(min(own[g], k) for g, k in other.items()))
            row = [i for i in range(batch.num_rows) for _ in ns]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row, pa.int64())), pa.array([*ns] * batch.num_rows, pa.int64()),
                                              pa.array(found, pa.int64())], names=[key, "n", "overlap"])
    return over_batches(pairs.select(key, cand, ref), run, f"{key} {dict(pairs.dtypes)[key]}, n long, overlap long")


def _joined_overlap(pairs: DataFrame, key: str, cand: str, ref: str, ns) -> DataFrame:
    """(key, n, overlap) over all pairs of a key: one explode + count per side, one full-outer join on (key, n, gram)."""
    c = gram_counts(pairs, key, cand, ns).withColumnRenamed("cnt", "c")
    r = gram_counts(pairs, key, ref, ns).withColumnRenamed("cnt", "r")
    j = c.join(r, [key, "n", "gram"], "full_outer")
    return j.groupBy(key, "n").agg(
        F.sum(F.least(F.coalesce("c", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("overlap"))


def clipped_overlap(pairs: DataFrame, key: str, cand: str, ref: str, ns=(1,)) -> DataFrame:
    """(key, n, overlap, cand_grams, ref_grams): clipped n-gram matches for all orders at once.

    The per-order sizes come from the row; pairs that share a key have the overlap of them all, those without one none.
    """
    pairs = materialize(pairs.select(key, cand, ref), "overlap-pairs")
    shared = materialize(pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key),
                         "shared-keys")
    agg = _row_overlap(pairs.where(F.col(key).isNotNull()).join(shared, key, "left_anti"), key, cand, ref, ns).unionByName(
        _joined_overlap(pairs.join(shared, key, "left_semi"), key, cand, ref, ns))
    sizes = pairs.select(key, F.explode(F.array(*[F.struct(
        F.lit(n).cast("bigint").alias("n"),
        F.greatest(F.size(cand) - n + 1, F.lit(0)).cast("bigint").alias("cand_grams"),
        F.greatest(F.size(ref) - n + 1, F.lit(0)).cast("bigint").alias("ref_grams")) for n in ns])).alias("s"))
    sizes = sizes.select(key, "s.n", "s.cand_grams", "s.ref_grams")
    return sizes.join(agg, [key, "n"], "left").select(
        key, "n", F.coalesce("overlap", F.lit(0)).cast("bigint").alias("overlap"), "cand_grams", "ref_grams")


def _prf(overlap, cand, ref, digits=9):
    p = F.coalesce(overlap / F.nullif(cand, F.lit(0)), F.lit(0.0))
    r = F.coalesce(overlap / F.nullif(ref, F.lit(0)), F.lit(0.0))
    f = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return [F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1")]


def rouge_n(pairs: DataFrame, key: str, cand: str, ref: str, ns=(1, 2)) -> DataFrame:
    o = clipped_overlap(pairs, key, cand, ref, ns)
    return o.select(key, "n", "overlap", "cand_grams", "ref_grams",
                    *_prf(F.col("overlap").cast("double"), F.col("cand_grams"), F.col("ref_grams")))


def corpus_bleu(pairs: DataFrame, key: str, cand: str, ref: str, max_n: int = 4) -> DataFrame:
    """Geometric mean of clipped precisions n = 1..4 × brevity penalty; 0 if any precision is 0.

    All n-gram orders go through one overlap pass; the lengths are the
    1-gram sizes; one global aggregate (partial per partition, one row out).
    """
    o = clipped_overlap(pairs, key, cand, ref, tuple(range(1, max_n + 1)))
    t = o.agg(*[F.sum(F.when(F.col("n") == n, F.col("overlap"))).alias(f"m{n}") for n in range(1, max_n + 1)],
              *[F.sum(F.when(F.col("n") == n, F.col("cand_grams"))).alias(f"c{n}") for n in range(1, max_n + 1)],
              F.sum(F.when(F.col("n") == 1, F.col("cand_grams"))).alias("c_len"),
              F.sum(F.when(F.col("n") == 1, F.col("ref_grams"))).alias("r_len"))
    ps = [F.coalesce(F.col(f"m{n}") / F.nullif(F.col(f"c{n}"), F.lit(0)), F.lit(0.0)) for n in range(1, max_n + 1)]
    bp = F.when(F.coalesce(F.col("c_len"), F.lit(0)) == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.exp(1 - F.col("r_len") / F.col("c_len"))))
    any_zero = F.greatest(*[p == 0 for p in ps])
    logmean = sum((F.log(F.when(p > 0, p)) for p in ps), F.lit(0.0)) / max_n
    bleu = F.when(any_zero, 0.0).otherwise(bp * F.exp(logmean))
    return t.select(*[F.round(p, 9).alias(f"p{n}") for n, p in enumerate(ps, 1)],
                    F.round(bp, 9).alias("brevity_penalty"), F.round(bleu, 9).alias("bleu"),
                    F.coalesce("c_len", F.lit(0)).cast("bigint").alias("cand_len"),
                    F.coalesce("r_len", F.lit(0)).cast("bigint").alias("ref_len"))


def span_prf(pred: DataFrame, gold: DataFrame, keys=("doc_id", "type", "start", "end")) -> DataFrame:
    """Exact-match span P/R/F1 per type and micro over all types (type = 'ALL')."""
    p = pred.select(*keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    j = p.join(g, list(keys), "full_outer")
    counted = j.select("type",
                       F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1).otherwise(0).alias("tp"),
                       F.when(F.col("_p").isNotNull() & F.col("_g").isNull(), 1).otherwise(0).alias("fp"),
                       F.when(F.col("_p").isNull() & F.col("_g").isNotNull(), 1).otherwise(0).alias("fn"))
    per = counted.rollup("type").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    per = per.withColumn("type", F.coalesce("type", F.lit("ALL")))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return per.select("type", "tp", "fp", "fn", *_prf(tp, tp + fp, tp + fn))


def lcs_of(a, b) -> int:
    """Length of the longest common subsequence, a bit per token of the shorter side.

    Zero bits of the state mark where the length grows; one addition of whole integers carries a row of the table.
    """
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        hit = state & places.get(x, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_of(list(x) if x is not None else [], list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, key: str, cand: str, ref: str) -> DataFrame:
    l = pairs.select(key, lcs_length(F.col(cand), F.col(ref)).alias("lcs"),
                     F.size(cand).alias("cand_len"), F.size(ref).alias("ref_len"))
    return l.select(key, F.col("lcs").cast("bigint").alias("lcs"), F.col("cand_len").cast("bigint").alias("cand_len"),
                    F.col("ref_len").cast("bigint").alias("ref_len"),
                    *_prf(F.col("lcs").cast("double"), F.col("cand_len"), F.col("ref_len")))
