"""Extractive summaries: top sentences by mean TF-IDF of their tokens.

The texts of a document are brought together once. df is a count of distinct tokens, summed in each Arrow batch before it
leaves the task. Every task holds the idf of the ``FREQUENT`` most common tokens; only the rarer tokens of a document are joined with
theirs and come back to it as one row. tf and sentence scores are computed inside the row, so no token occurrence is ever shuffled.
The top-k per document is a window over one document's sentences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions.batches import over_batches, token_bounds, token_texts
from casegrain.functions.text import sentences
from casegrain.session import materialize

# ---- fixed values -----------------------------------------------------------
TOP_K = 3
MIN_SENTENCE_TOKENS = 3
SCORE_DIGITS = 9
FREQUENT = 1 << 17      # tokens whose idf every task holds
# -----------------------------------------------------------------------------


def _words(text: str) -> list[str]:
    return token_texts(text, *token_bounds(text))


def _types(texts: list[str]) -> dict[str, None]:
    """The distinct tokens of a document's texts."""
    return dict.fromkeys(w for t in texts for w in _words(t))


def _token_df(whole: DataFrame, nameless: DataFrame) -> DataFrame:
    """(token, df) over documents; rows without an id (``nameless``) are one document that is never put together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(w for texts in batch.column("_d").to_pylist() for w in _types(texts))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["token", "n"])
    own = over_batches(whole.select("_d"), run, "token string, n long")
    rest = over_batches(nameless.select("_d"), run, "token string, n long").select("token").distinct()
    return own.unionByName(rest.withColumn("n", F.lit(1).cast("bigint"))).groupBy("token").agg(F.sum("n").alias("df"))


def _rare_types(whole: DataFrame, id_col: str, common) -> DataFrame:
    """(id, token): the distinct tokens of every document that are not among the common ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            found = [[w for w in _types(texts) if w not in known] for texts in batch.column("_d").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row, pa.int64())),
                                              pa.array([w for f in found for w in f], pa.string())], names=[id_col, "token"])
    return over_batches(whole.select(id_col, "_d"), run, f"{id_col} {dict(whole.dtypes)[id_col]}, token string")


def sentence_scores(docs: DataFrame, text: str = "text", id_col: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """(id, sent_pos, sentence, n_tokens, score) for sentences with >= 3 tokens."""
    d = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # Rows that share an id are one document.
    whole = materialize(d.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_list("_t").alias("_d")), "summary-texts")
    df = materialize(_token_df(whole, d.where(F.col(id_col).isNull()).select(F.array("_t").alias("_d"))), "summary-df")
    idf = df.select("token", "df", F.log((F.lit(d.count()) + 1) / (F.col("df") + 1)).alias("idf"))
    held = idf.orderBy(F.col("df").desc(), "token").limit(frequent).select("token", "idf").toPandas()
    common = docs.sparkSession.sparkContext.broadcast(dict(zip(held["token"], held["idf"])))
    if len(held) < frequent:
        rows = whole.withColumns({"_w": F.array().cast("array<string>"), "_i": F.array().cast("array<double>")})
    else:
        rare = _rare_types(whole, id_col, common).join(idf.select("token", "idf"), "token").groupBy(id_col).agg(
            F.collect_list(F.struct("token", "idf")).alias("_r")).select(id_col, F.col("_r.token").alias("_w"), F.col("_r.idf").alias("_i"))
        rows = whole.join(rare, id_col, "left").select(id_col, "_d", *[
            F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c) for c, kind in (("_w", "string"), ("_i", "double"))])
    rows = rows.select(id_col, "_d", F.transform("_d", lambda t: sentences(t)).alias("_s"), "_w", "_i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            row, out = [], []
            for at, (own, cut, names, weights) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_d", "_s", "_w", "_i")])):
                tf = Counter(w for t in own for w in _words(t))
                rarer = dict(zip(names, weights))
                score = {w: n * (known[w] if w in known else rarer[w]) for w, n in tf.items()}
                for found in cut:
                    # A line break is in no token, so all sentences are cut into tokens at once.
                    joined = "\n".join(found)
                    starts, ends = token_bounds(joined)
                    each = [score[w] for w in token_texts(joined, starts, ends)]
                    size = np.fromiter(map(len, found), np.int64, len(found))
                    edges = np.searchsorted(starts, np.cumsum(size + 1)).tolist()
                    for pos, (sentence, a, b) in enumerate(zip(found, [0, *edges], edges)):
                        if b - a >= MIN_SENTENCE_TOKENS:
                            row.append(at)
                            out.append((pos, sentence, b - a, sum(each[a:b]) / (b - a)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row, pa.int64())),
                                              *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]],
                                             names=[id_col, "sent_pos", "sentence", "n_tokens", "score"])
    scored = over_batches(rows, run, f"{id_col} {dict(docs.dtypes)[id_col]}, sent_pos long, sentence string, n_tokens long, score double")
    return scored.withColumn("score", F.round("score", SCORE_DIGITS))


def top_sentences(scores: DataFrame, k: int = TOP_K, id_col: str = "doc_id") -> DataFrame:
    """Top-k sentences per document by (score desc, position)."""
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), F.col("sent_pos").asc())
    return (scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def summaries(top: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The chosen sentences in document order, joined by a space."""
    return top.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_pos", "sentence"))),
                                 lambda x: x["sentence"]), " ").alias("summary"))
