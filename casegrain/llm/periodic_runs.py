"""Periodic runs of words inside each document: seed and extend along diagonals.

A run is a stretch of consecutive words that repeats itself with smallest period q (words q
apart are identical), of length at least ``max(LEAST, TIMES * q)``, that no neighbouring word extends.
In the plane of positions (i, j) it is a stretch of the diagonal j - i = q.

1. *Index.* Periods are searched in bands (k/2, k], k = 16, 32, 64, ... (the first band holds 1 to 16
   whole). A run of the band matches along its diagonal for at least 2q > k steps (16 in the
   first), so its k-gram at every step stands again q words on: k is the guaranteed overlap.
   Hashes of 2k-grams come from those of k-grams, and only for positions whose k-gram stands
   twice in the document; the rest leaves the index.
2. *Pairs.* Equal k-grams of one document are enumerated in order of place, each with its next
   occurrence; pairs whose lag lies in the band are seeds. The next one is enough: were
   the k-gram of a run found at a lag r < q, both r and q would be periods of k + r >= q + r words, so by
   Fine and Wilf their common divisor would be, too, and q not the smallest. By the same proof the
   lag of a seed is the smallest period of its stretch, and a word that stands n times gives n - 1 pairs, not n^2.
3. *Extension.* A seed grows left and right along its diagonal by comparing the words themselves. A table
   holds the furthest place covered on each lag; a seed before that place belongs to a run already
   found and is not extended again.

A document is one row and its runs never leave it, so nothing is shuffled; the work is n log n in
its length, also for one word a million times over. Hashes have 64 bits; extension compares exact words, so a
collision never makes a run.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes, compared exactly; a null or empty
text has no words, no runs and an empty collapsed text; repeated rows and ids are separate
rows; runs that overlap are all listed, by start and then period; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casegrain.llm.tables import arrow
from casegrain.llm.words import column, column_bytes, mix, slices

LEAST = 24          # words of a run, at least
TIMES = 3           # and its periods, at least
FIRST_GRAM = 16     # the overlap that the two guarantee for every period up to it
SLICE = 1 << 20     # bytes of text handled at once; a longer text stands alone

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FAR = np.uint64(0x9E3779B97F4A7C15)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring grams from theirs; not linear, so no word pattern cancels out."""
    return mix(left * _FAR + (right ^ (right >> np.uint64(29))))


def seeds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of the seeds of a sequence of word numbers, by lag and place.

    Documents may follow each other in ``ids`` if no number is used in two of them.
    """
    n, k = len(ids), FIRST_GRAM
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    for step in (1, 2, 4, 8):
        if len(h) <= step:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = _joined(h[:-step], h[step:])
    at, found = np.arange(len(h)), []
    while len(at):
        order = np.argsort(h, kind="stable")
        place, value = at[order], h[order]
        again = value[1:] == value[:-1]
        left, right = place[:-1][again], place[1:][again]
        lag = right - left
        own = (lag <= k) if k == FIRST_GRAM else (lag <= k) & (lag > k // 2)
        found.append((left[own], lag[own]))
        # Longer grams only where this one stands twice.
        twice = np.zeros(len(value), bool)
        twice[1:] |= again
        twice[:-1] |= again
        back = np.sort(order[twice])
        at, h = at[back], h[back]
        follow = np.searchsorted(at, at + k)
        both = follow < len(at)
        both[both] = at[follow[both]] == at[both] + k
        at, h = at[both], _joined(h[both], h[follow[both]])
        k *= 2
    place = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
    lag = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def _matching(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """Steps from a and b, forward or backward, for which the words are the same."""
    done, size = 0, 32
    room = len(ids) - b if step > 0 else a + 1
    while done < room:
        size = min(size, room - done)
        if step > 0:
            same = ids[a + done:a + done + size] == ids[b + done:b + done + size]
        else:
            same = (ids[a - done - size + 1:a - done + 1] == ids[b - done - size + 1:b - done + 1])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, size = done + size, size * 4
    return done


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start and period."""
    place, lag = seeds(ids)
    if not len(place):
        return []
    # A seed right after one of the same lag is covered by it.
    head = np.ones(len(place), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    furthest: dict[int, int] = {}
    runs = []
    for i, q in zip(place[head].tolist(), lag[head].tolist()):
        if i < furthest.get(q, 0):
            continue
        stop = i + _matching(ids, i, i + q, 1)
        start = i - _matching(ids, i - 1, i - 1 + q, -1)
        furthest[q] = stop
        length = stop + q - start
        if length >= max(least, times * q):
            runs.append((start, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _read(data: bytes, offs: list[int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their numbers (none in two texts) and the place of each text's first word."""
    words, numbers, starts, used = [], [], [0], 0
    for lo, hi in zip(offs[:-1], offs[1:]):
        own, known = data[lo:hi].split(), {}          # bytes split at exactly these six bytes
        numbers.extend([known.setdefault(w, used + len(known)) for w in own])
        used += len(known)
        words.append(own)
        starts.append(len(numbers))
    return words, np.array(numbers, np.int64), np.array(starts, np.int64)


def _repeats(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Runs of every document of ``docs`` (doc_id, text): one row of ``RUNS`` per input row.

    ``collapsed`` holds the words, joined by one space, without those that a run holds after its first period.
    ``least`` words and ``times`` periods (at least 3) bound a run from below; ``least`` is at least 24.
    """
    if least < LEAST or times < TIMES:
        raise ValueError(f"the grams guarantee runs of {LEAST} words and {TIMES} periods or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, offs), keys = column_bytes(column(batch, "text")), column(batch, "doc_id")
            for lo, hi in slices(offs, SLICE):
                part = data[offs[lo]:offs[hi]].tobytes()
                words, ids, starts = _read(part, (offs[lo:hi + 1] - offs[lo]).tolist())
                own: dict[int, list[tuple[int, int, int]]] = {}
                for start, length, period in find_runs(ids, least, times):
                    d = int(np.searchsorted(starts, start, "right")) - 1
                    own.setdefault(d, []).append((start - int(starts[d]), length, period))
                collapsed = [b" ".join(compress(w, ~_repeats(own[d], len(w))) if d in own else w)
                             for d, w in enumerate(words)]
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in own.get(d, ())] for d in range(len(words))]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array(np.diff(starts)), pa.array(runs, pa.list_(_RUN)),
                     pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
    return arrow(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), run, RUNS)
