"""Encoding by distinct chunks: the tokenizers library sees each different chunk of a text once.

Texts are cut, as bytes, where the tokenizer itself always cuts: at ASCII white space, and between ASCII
letters or digits and ASCII punctuation (but not after an apostrophe, which may begin a
contraction). The ids of a text are then the ids of its chunks in order. Natural text repeats its
words, so most chunks are known: they are recognised by a 64-bit hash and their length in
a hash table of numpy arrays, and their ids are copied. New chunks that are one plain word
are encoded many at a time, in one string, and told apart by the tokens that begin or end a word.
The table is emptied when it holds ``capacity`` chunks.

White space is dropped (``spaces=False``) or belongs to the chunk after it (``spaces=True``). With spaces, a text
that has a non-ASCII space goes to the library whole, since runs of both kinds must stay together.
"""

from __future__ import annotations

import re

import numpy as np

from casegrain.llm import words as W

CAPACITY = 1 << 20
PIECE_BYTES = 1 << 20
GROUP = 500

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)   # ASCII punctuation
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
# Bytes that aren't of an ASCII letter or a Latin letter of two bytes (U+00C0 to U+023F without the two signs).
_STRANGE = np.ones(256, bool)
_STRANGE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xC9), *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))]] = False
_ODD_SPACE = re.compile("[\x85\xa0  -     　]")


class _Table:
    """Hash table from 64-bit hashes to chunk numbers, open addressing, on whole arrays."""

    def __init__(self, capacity: int):
        self.mask = np.uint64((1 << (2 * capacity - 1).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.codes = np.zeros(int(self.mask) + 1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        at = h & self.mask
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.codes[at[hit]]
            on = ~hit & (k != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, codes: np.ndarray) -> None:
        """Distinct new hashes."""
        left, at = np.arange(len(h)), h & self.mask
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]
            placed = free & (self.keys[at] == h[left])     # of several for one place, one got it
            self.codes[at[placed]] = codes[left[placed]]
            left, at = left[~placed], (at[~placed] + np.uint64(1)) & self.mask


class _Column:
    """A numpy array that grows at its end by doubling."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        while self.n + len(x) > len(self.room):
            self.room = np.concatenate((self.room, np.zeros_like(self.room)))
        self.room[self.n:self.n + len(x)] = x
        self.n += len(x)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class ChunkEncoder:
    def __init__(self, tokenizer, spaces: bool, capacity: int = CAPACITY):
        self.tokenizer, self.spaces, self.capacity = tokenizer, spaces, capacity
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        if any(not t.startswith("<|") or " " in t for t in added):
            raise ValueError(f"added tokens of another form: {added}")
        self.added = bool(added)
        vocabulary = tokenizer.get_vocab()
        # A plain chunk is one word: its first token begins with the space, or its last has the end mark.
        self.bound = np.zeros(max(vocabulary.values()) + 1, bool)
        self.bound[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if spaces else t.endswith("</w>"))]] = True
        self._empty()

    def _empty(self) -> None:
        self.table = _Table(self.capacity)
        self.ids, self.starts, self.lengths, self.sizes = (_Column(t) for t in (np.int32, np.int64, np.int64, np.int64))

    def _plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_ids(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of chunks that are one word each, and how many each has; None if the words can't be told apart."""
        step = sizes + (not self.spaces)     # without spaces, one is put after each
        stop = np.cumsum(step)
        text = np.full(stop[-1], 0x20, np.uint8)
        inside = np.arange(stop[-1]) - np.repeat(stop - step, step)
        real = inside < np.repeat(sizes, step)
        text[real] = data[(np.repeat(starts, step) + inside)[real]]
        cuts = [0, *stop[GROUP - 1:-1:GROUP].tolist(), int(stop[-1])]
        joined = self._plainly([text[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:])])
        ids = np.concatenate(joined)
        at = np.flatnonzero(self.bound[ids])
        if len(at) != len(starts):
            return None
        edges = np.concatenate((at, [len(ids)])) if self.spaces else np.concatenate(([0], at + 1))
        return ids, np.diff(edges)

    def _learn(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        strange = np.concatenate(([0], np.cumsum(_STRANGE[data])))
        head = starts + self.spaces
        plain = (ends > head) & (strange[ends] == strange[np.minimum(head, ends)])
        if self.spaces:
            plain &= data[starts] == 0x20
        for group in np.array_split(np.flatnonzero(plain), 1 + plain.sum() // (20 * GROUP)):
            got = self._plain_ids(data, starts[group], (ends - starts)[group]) if len(group) else None
            if got is None:
                plain[group] = False
            else:
                self._remember(h[group], *got, (ends - starts)[group])
        other = np.flatnonzero(~plain)
        if len(other):
            found = self._plainly([data[a:b].tobytes().decode() for a, b in zip(starts[other].tolist(), ends[other].tolist())])
            self._remember(h[other], np.concatenate(found), np.array([len(x) for x in found], np.int64),
                           (ends - starts)[other])

    def _remember(self, h: np.ndarray, ids: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> None:
        self.table.add(h, np.arange(len(self.lengths), len(self.lengths) + len(h)))
        self.starts.add(len(self.ids) + np.cumsum(own) - own)
        self.ids.add(ids)
        self.lengths.add(own)
        self.sizes.add(sizes)

    def _spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks of all rows; they never reach over a row's end."""
        starts, ends, _ = W.spans(data, offs, W.NOT_SPACE)
        inner = np.zeros(len(data) + 1, bool)
        a, b = data[:-1], data[1:]
        inner[1:-1] = (_ALNUM[a] & _MARK[b]) | (_MARK[a] & (a != 0x27) & _ALNUM[b])
        inner[offs] = False
        cut = np.flatnonzero(inner)
        if self.added:   # words that may hold an added token such as <|end|> stay whole
            opened = np.flatnonzero((a == 0x3C) & (b == 0x7C))
            whole = np.searchsorted(starts, opened, "right") - 1
            cut = cut[~np.isin(np.searchsorted(starts, cut, "right") - 1, whole)]
        # A cut lies inside a word by its nature: neither side is white space.
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        if not self.spaces:
            return starts, ends
        # White space before a chunk belongs to it; what is left at a row's end is a chunk.
        edge = np.unique(np.concatenate((ends, offs)))
        return edge[:-1], edge[1:]

    def _encode_piece(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        if len(self.lengths) > 0.9 * self.capacity or len(self.ids) > 8 * self.capacity:
            self._empty()
        starts, ends = self._spans(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        size = ends - starts
        h = W.hashes(data, starts, ends, lower=False) | np.uint64(1)   # never 0, the empty mark
        code = self.table.find(h)
        new = np.flatnonzero(code < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            one = new[np.sort(first)]
            if len(self.lengths) + len(one) > self.capacity:   # a piece with very many: room for all of them
                self.table = _grown(self.table, len(self.lengths) + len(one))
            self._learn(data, h[one], starts[one], ends[one])
            code[new] = self.table.find(h[new])
        if not np.array_equal(self.sizes[code], size):
            raise ValueError("two chunks of different length have one hash")
        own = self.lengths[code]
        stop = np.cumsum(own)
        at = np.arange(stop[-1]) + np.repeat(self.starts[code] - (stop - own), own)
        before = np.concatenate(([0], stop))
        return self.ids[at], before[np.searchsorted(starts, offs)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the index of each row's first id (rows + 1)."""
        fine = _with_cuts(data, offs)
        ids, first, total = [], [np.zeros(1, np.int64)], 0
        for lo, hi in W.slices(fine, PIECE_BYTES):
            own, at = self._encode_piece(data[fine[lo]:fine[hi]], fine[lo:hi + 1] - fine[lo])
            ids.append(own)
            first.append(at[1:] + total)
            total += len(own)
        out = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        index = np.concatenate(first)
        if len(fine) == len(offs):
            return out, index
        # Rows that were cut: the index of a row's start is that of the place it starts at.
        kept = np.zeros(len(fine), bool)
        kept[_row_places(fine, offs)] = True
        return out, index[kept]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        offs = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        odd = [i for i, t in enumerate(texts) if self.spaces and _ODD_SPACE.search(t)]
        ids, first = self.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
        out = [ids[first[i]:first[i + 1]] for i in range(len(texts))]
        for i, x in zip(odd, self._plainly([texts[i] for i in odd])):
            out[i] = x
        return out


def _grown(table: _Table, capacity: int) -> _Table:
    out = _Table(capacity)
    used = np.flatnonzero(table.keys)
    out.add(table.keys[used], table.codes[used].astype(np.int64))
    return out


def _with_cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """``offs`` with further places inside rows of over ``PIECE_BYTES``: before white space after a letter or digit."""
    extra = []
    for i in np.flatnonzero(np.diff(offs) > PIECE_BYTES):
        at = offs[i] + PIECE_BYTES
        while at < offs[i + 1]:
            window = data[at - 1:min(at + 65536, offs[i + 1])]
            ok = np.flatnonzero(_ALNUM[window[:-1]] & ~W.NOT_SPACE[window[1:]])
            if len(ok):
                extra.append(at + ok[0])
                at = at + ok[0] + PIECE_BYTES
            else:
                at += 65536
    return np.sort(np.concatenate((offs, np.array(extra, np.int64)))) if extra else offs


def _row_places(fine: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index in ``fine`` of each of ``offs``; empty rows repeat a place, further cuts never do."""
    place = np.searchsorted(fine, offs)
    _, first = np.unique(offs, return_index=True)
    return place + (np.arange(len(offs)) - first[np.searchsorted(offs[first], offs)])
