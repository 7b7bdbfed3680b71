"""Work on Arrow batches: bounded batches, added columns, token bounds of texts.

For steps that need one linear pass with state over a long text (automata, running sums over
spans), which higher-order functions can only express with a pass per element.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_BYTES = "8m"
HELD_WORDS = 1 << 18            # words whose rows a task keeps
SPACES = "\t\n\x0b\f\r "


def over_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_BYTES`` (a session setting), which bounds a task's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def with_array(df: DataFrame, out: str, kind: T.DataType, arrow_kind: pa.DataType, inputs: list[str],
               fn: Callable[..., list]) -> DataFrame:
    """``df`` plus column ``out``: ``fn`` of the row's input values, in one narrow stage."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, kind)])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*[batch.column(c).to_pylist() for c in inputs])
            new = pa.array([fn(*v) for v in values], arrow_kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], new], names=[*names, out])
    return over_batches(df, run, schema)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 white space, 1 letter or number, 2 other."""
    table = np.full(0x110000, 2, np.uint8)
    table[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] in "LN"]] = 1
    table[[ord(c) for c in SPACES]] = 0
    return table


def token_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code point starts and ends of the tokens: runs of letters and numbers, or one other character."""
    kind = _classes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    word = kind == 1
    edge = np.zeros(len(kind) + 2, bool)
    edge[1:-1] = word
    starts = np.flatnonzero((kind == 2) | (word & ~edge[:-2]))
    ends = np.flatnonzero((kind == 2) | (word & ~edge[2:])) + 1
    return starts, ends


def token_texts(text: str, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The tokens, lower-cased."""
    low = text.lower()
    if len(low) != len(text) or "Σ" in text:       # lower case that depends on the place, or is longer
        return [text[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())]
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class WordRows(dict):
    """Word → row of a table that a task keeps; ``make`` gives the rows of many new words at once."""

    def __init__(self, make: Callable[[list[str]], np.ndarray]):
        self.make, self.fresh, self.table = make, [], make([])

    def __missing__(self, word: str) -> int:
        own = self[word] = len(self)
        self.fresh.append(word)
        return own

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of a text's words; those of new words are there when ``whole`` is asked for."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def whole(self) -> np.ndarray:
        """The table, with the rows of all words."""
        if self.fresh:
            new = self.make(self.fresh)
            if len(self.table) < len(self):
                grown = np.empty((max(1024, 2 * len(self)), *new.shape[1:]), new.dtype)
                grown[:len(self) - len(new)] = self.table[:len(self) - len(new)]
                self.table = grown
            self.table[len(self) - len(new):len(self)] = new
            self.fresh = []
        return self.table

    def bounded(self) -> WordRows:
        """Itself, without words if they have become too many; not between ``rows`` and ``whole``."""
        if len(self) > HELD_WORDS:
            self.clear()
        return self
