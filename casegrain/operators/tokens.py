"""Tokens, offsets, vocabulary ids, fixed-length model windows, sentences.

Design:
* tokens and sentences are regex extractions inside the row;
* offsets are a running sum of tile lengths inside the row;
* the vocabulary is a ``groupBy(token).count()`` with partial aggregation,
  ranked by the exact distributed ordinal;
* ids are looked up in the row: a vocabulary has a bounded size, so every task holds it; words that
  it lacks are cut into the longest entries (no tokenizer is trained: pieces are entries of the counted vocabulary).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions.arrays import prefix_sums
from casegrain.functions.batches import over_batches, token_texts
from casegrain.functions.ordinal import exact_ordinal
from casegrain.functions.text import (
    CLS_ID, FIRST_WORD_ID, MAX_LEN, SEP_ID, UNK_ID, col_of, let, raw_sentences, tiles, tokens, trim_ws,
)
from casegrain.operators import annotations as A

MIN_COUNT = 2
MAX_WORDS = 1 << 20     # size of a vocabulary, which every task holds
HELD_PIECES = 1 << 16   # pieces of texts that a task puts into windows at once, and the last text's


def sentence_rows(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, sent_pos, sentence): trimmed, non-empty, position = match index."""
    return (df.select(id_col, F.posexplode_outer(raw_sentences(text)).alias("sent_pos", "raw"))
            .filter(F.col("raw").isNotNull())
            .select(id_col, F.col("sent_pos").cast("bigint").alias("sent_pos"), trim_ws("raw").alias("sentence"))
            .filter(F.length("sentence") > 0))


def token_rows(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pos, token) over whole texts, lower-cased."""
    return (df.select(id_col, F.posexplode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "token"))
            .filter(F.col("token").isNotNull()))


def offset_array(text) -> Column:
    """Every token of a text as array<struct<token, start, end>>.

    The tiles of a text concatenate back to it, so a token's start is the
    sum of the lengths of the tiles before it.
    """
    def place(tl):
        starts = prefix_sums(F.transform(tl, lambda x: F.length(x)))
        zipped = F.zip_with(tl, starts, lambda x, s: F.struct(
            F.lower(x).alias("token"), s.cast("bigint").alias("start"), (s + F.length(x)).cast("bigint").alias("end")))
        return F.filter(zipped, lambda z: ~z["token"].rlike(r"^[\t\n\x0B\f\r ]"))
    return let(tiles(F.coalesce(col_of(text), F.lit(""))), place)


def token_offsets(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pos, token, start, end): every token of the whole text with [start, end), no shuffle."""
    return (df.select(id_col, F.posexplode_outer(offset_array(text)).alias("pos", "t"))
            .filter(F.col("t").isNotNull())
            .select(id_col, F.col("pos").cast("bigint").alias("pos"), "t.token", "t.start", "t.end"))


def build_vocab(train_docs: DataFrame, text: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """(token, token_id, freq): ids from 1000 by (count desc, token asc), count >= min_count, the first ``max_words``."""
    counts = (train_docs.select(F.explode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))
              .filter(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
              .filter(F.col("freq") >= min_count))
    ranked = exact_ordinal(counts, [F.col("freq").desc(), F.col("token").asc()], out="_rn")
    return ranked.where(F.col("_rn") <= max_words).select("token", (F.col("_rn") + FIRST_WORD_ID - 1).cast("bigint").alias("token_id"),
                         F.col("freq").cast("bigint").alias("freq"))


def with_alphabet(vocab: DataFrame, train_docs: DataFrame, text: str = "text") -> DataFrame:
    """``vocab`` plus every character of the training tokens that is no entry, numbered after the words by character.

    With it, each word of the training alphabet has pieces. The alphabet is bounded by Unicode, so one window numbers it.
    """
    types = train_docs.select(F.explode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("t")).where("t IS NOT NULL").distinct()
    letters = types.select(F.explode_outer(F.split("t", "")).alias("token")).where("token <> ''").groupBy("token").agg(
        F.count(F.lit(1)).alias("freq"))
    new = letters.join(vocab.select("token"), "token", "left_anti")
    last = vocab.agg(F.coalesce(F.max("token_id"), F.lit(FIRST_WORD_ID - 1)).alias("last"))
    numbered = new.withColumn("rn", F.row_number().over(Window.orderBy("token"))).join(F.broadcast(last))
    return vocab.select("token", "token_id", "freq").unionByName(
        numbered.select("token", (F.col("last") + F.col("rn")).cast("bigint").alias("token_id"), "freq"))


class Pieces:
    """Longest-match segmentation by vocabulary entries.

    An entry stands for itself at the start of a word and, as ``##entry``, inside of one: the id of the second is
    that of the first plus the number of entries. Entries are found by their first two characters and lengths, so the walk
    tries only lengths that some entry has. A character that is no entry is a piece with the unknown id.
    """

    def __init__(self, entries: dict[str, int]):
        self.ids, self.inner = entries, len(entries)
        lengths: dict[str, set] = {}
        for e in entries:
            lengths.setdefault(e[:2], set()).add(len(e))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.known: dict[str, tuple[list[int], list[int]]] = {}

    def cut(self, word: str) -> list[int]:
        """Where the pieces of a word begin."""
        out, at = [], 0
        while at < len(word):
            out.append(at)
            step = next((n for n in self.lengths.get(word[at:at + 2], ()) if n <= len(word) - at and word[at:at + n] in self.ids), 1)
            at += step
        return out

    def encode(self, word: str) -> tuple[list[int], list[int]]:
        """Ids and starts of the pieces of a word that is no entry."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            at = self.cut(word)
            pieces = [word[a:b] for a, b in zip(at, [*at[1:], len(word)])]
            got = self.known[word] = ([UNK_ID if p not in self.ids else self.ids[p] + (self.inner if a else 0)
                                       for p, a in zip(pieces, at)], at)
        return got


def _entries(vocab: DataFrame):
    """The vocabulary for every task: at most ``MAX_WORDS`` words and an alphabet, so of bounded size."""
    rows = vocab.select("token", "token_id").toPandas()
    return vocab.sparkSession.sparkContext.broadcast(dict(zip(rows["token"], rows["token_id"].astype(int))))


def encode_window(df: DataFrame, vocab: DataFrame, text: str = "text", id_col: str = "doc_id",
                  offsets: bool = False, marked: str | None = None) -> DataFrame:
    """(id, window_no, input_ids[512], attention_mask[512], n_tokens[, offset_mapping][, rationale_mask[512]]): a row per window.

    Each window holds the start id, 510 ids, the end id and padding. A token of the vocabulary is one id,
    any other the ids of its pieces (:class:`Pieces`), each with its own offsets. ``marked`` names a
    column of sentences: every piece of a token that an occurrence overlaps is 1 in ``rationale_mask``.
    One pass in the row: nothing is shuffled, however common a word is.
    """
    sent = _entries(vocab)
    spark_type = df.schema[id_col]
    wanted = [("input_ids", T.ArrayType(T.IntegerType())), ("attention_mask", T.ArrayType(T.IntegerType()))]
    if offsets:
        wanted.append(("offset_mapping", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    if marked:
        wanted.append(("rationale_mask", T.ArrayType(T.IntegerType())))
    schema = T.StructType([spark_type, T.StructField("window_no", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           *[T.StructField(*w) for w in wanted]])
    cols = [F.col(id_col), F.col(text).alias("_text"),
            (F.col(marked) if marked else F.lit(None).cast("array<string>")).alias("_marked")]

    def windows(keys: pa.Array, texts: list) -> pa.RecordBatch:
        """The rows of some texts, each (ids, starts, ends, marks)."""
        row, no, inside = A.window_rows([len(x[0]) for x in texts])
        out = [keys.take(pa.array(row)), pa.array(no), pa.array(inside), A.lists_of(A.windowed([x[0] for x in texts], inside, CLS_ID, SEP_ID)),
               A.lists_of((np.arange(MAX_LEN) < inside[:, None] + 2).astype(np.int32))]
        if offsets:
            places = pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in texts])) for i in (1, 2)], names=["start", "end"])
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(inside))).astype(np.int32)), places))
        if marked:
            out.append(A.lists_of(A.windowed([x[3] for x in texts], inside)))
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            first, held, texts = 0, 0, []
            for at, (t, sentences) in enumerate(zip(batch.column("_text"), batch.column("_marked"))):
                t = t.as_py()
                starts, ends, mark = A.marked_tokens(t, sentences.as_py())
                found = _encoded(token_texts(t or "", starts, ends), starts, ends, pieces)
                texts.append((*found[:3], mark[found[3]]))
                held += len(found[0])
                # A batch of texts becomes several of windows, so what a task holds doesn't grow with the batch.
                if held >= HELD_PIECES or at + 1 == batch.num_rows:
                    yield windows(batch.column(id_col).slice(first, at + 1 - first), texts)
                    first, held, texts = at + 1, 0, []
    return over_batches(df.select(cols), run, schema)


def _encoded(words: list[str], starts: np.ndarray, ends: np.ndarray, pieces: Pieces):
    """Ids, starts and ends of all pieces, and the token that each belongs to."""
    get = pieces.ids.get
    first = np.array([get(w, -1) for w in words], np.int64)
    rare = np.flatnonzero(first < 0)
    found = [pieces.encode(words[i]) for i in rare.tolist()]
    count = np.ones(len(words), np.int64)
    count[rare] = [len(f[0]) for f in found]
    owner = np.repeat(np.arange(len(words)), count)
    ids, begin, end = first[owner], starts[owner], ends[owner]
    if found:
        at = np.flatnonzero(first[owner] < 0)
        ids[at] = np.concatenate([f[0] for f in found])
        begin[at] = np.minimum(begin[at] + np.concatenate([f[1] for f in found]), end[at])
        inner = at[:-1][owner[at[:-1]] == owner[at[1:]]]         # pieces with another of their token after them
        end[inner] = begin[inner + 1]
    return ids.astype(np.int32), begin, end, owner


def pad_or_truncate(mask_col, length: int = MAX_LEN):
    """A 0/1 array truncated or zero-padded to ``length`` (mask alignment)."""
    m = F.slice(F.coalesce(mask_col, F.array().cast("array<int>")), 1, length)
    return F.concat(m, F.array_repeat(F.lit(0), length - F.size(m)))


def segment_rare(types: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """(token, pieces) of distinct word types: greedy longest vocabulary entries, continuation pieces carry ``##``.

    From each position the longest entry is taken, one character where none fits.
    """
    sent = _entries(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(sent.value)
        for batch in batches:
            words = batch.column("token").to_pylist()
            cuts = [known.cut(w) for w in words]
            out = [[("##" if a else "") + w[a:b] for a, b in zip(at, [*at[1:], len(w)])] for w, at in zip(words, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(out, pa.list_(pa.string()))], names=["token", "pieces"])
    return over_batches(types.select(F.col(token).alias("token")).where("token IS NOT NULL").distinct(), run,
                        "token string, pieces array<string>")
