"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of ranks (base64 bytes and rank per line). Every
byte is written as one printable character (the usual byte-to-character table),
so the ranks become a character vocabulary and a merge list: each token's splits
into two known tokens, in rank order. A text is cut by the pattern into
pieces, each encoded on its own; no special tokens exist, so their strings
are ordinary text. Texts are cut into chunks where the pattern always cuts (``chunks.py``): each distinct
chunk is encoded once, and very long texts are worked off in pieces, so memory is bounded.

``encode`` also gives the byte offset of each token. Tokens partition the bytes of
the text, so the offsets are running sums of token lengths. ``decode``
reverses the byte table. A character whose bytes lie in two tokens is put together
again from the bytes; ``pieces`` gives the text token by token, where such a
character comes with the token that completes it.

Defined results: a null or empty text has no tokens and decodes to no bytes; ids
outside the vocabulary raise an error; bytes that aren't UTF-8 (from ids that no text
gives) become U+FFFD in ``text`` and stay as they are in ``decoded``; repeated rows
are encoded alike; empty tables give empty results; further columns pass through
``encode`` and ``decode`` untouched if named in ``keep``.
"""

from __future__ import annotations

import base64
import codecs
import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from casegrain.llm.chunks import ChunkEncoder
from casegrain.llm.tables import arrow
from casegrain.llm.words import column, column_bytes, slices



def byte_characters() -> list[str]:
    """The printable character of each byte: itself if visible in Latin-1, else the next from U+0100 on."""
    visible = [b for r in (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)) for b in r]
    hidden = [b for b in range(256) if b not in set(visible)]
    table = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """The tokenizer of a rank file, once per worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    char = byte_characters()
    name = {token: "".join(char[b] for b in token) for token in ranks}
    merges = [(name[token[:i]], name[token[i:]])
              for token in sorted(ranks, key=ranks.get)
              for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    t = Tokenizer(models.BPE(vocab={name[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


@functools.lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in id order: one array, the start of each id, its length (-1: no such id)."""
    ranks = read_ranks(path)
    known = {v: k for k, v in ranks.items()}
    top = max(known) + 1
    lengths = np.array([len(known[i]) if i in known else -1 for i in range(top)], np.int64)
    starts = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))[:-1]))
    return np.frombuffer(b"".join(known.get(i, b"") for i in range(top)), np.uint8), starts, lengths


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> ChunkEncoder:
    return ChunkEncoder(tokenizer(path, pattern), spaces=True, capacity=1 << 18)


def encode_texts(texts: list[str], path: str, pattern: str) -> list[np.ndarray]:
    """The ids of each text."""
    return _encoder(path, pattern).encode_texts(texts)


def decode_ids(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes of a run of ids."""
    blob, starts, lengths = byte_table(path)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths) or lengths[ids].min() < 0):
        raise ValueError("an id is not in the vocabulary")
    own = lengths[ids]
    ends = np.cumsum(own)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - (ends - own), own)
    return blob[at]


def pieces(ids: Iterable[int], path: str) -> list[str]:
    """Text of each token; a character split over tokens comes whole with the last of them."""
    blob, starts, lengths = byte_table(path)
    d = codecs.getincrementaldecoder("utf-8")("replace")
    out = [d.decode(blob[starts[i]:starts[i] + lengths[i]].tobytes()) for i in ids]
    if out:
        out[-1] += d.decode(b"", True)
    return out


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offs = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def _kept(df: DataFrame, keep: list[str]) -> list[T.StructField]:
    return [df.schema[c] for c in keep]


def encode(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus ids array<int> and starts array<int> (byte offset of each token)."""
    schema = T.StructType(_kept(df, keep) + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                                             T.StructField("starts", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = byte_table(path)[2]
        for batch in batches:
            texts = column(batch, "__text")
            for lo, hi in slices(column_bytes(texts)[1]):
                ids = encode_texts([x or "" for x in texts.slice(lo, hi - lo).to_pylist()], path, pattern)
                starts = [np.concatenate(([0], np.cumsum(lengths[x])[:-1]))[:len(x)] for x in ids]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [_lists(ids, pa.int32()), _lists(starts, pa.int32())], names=[*keep, "ids", "starts"])
    return arrow(df.select(*keep, df[text].alias("__text")), run, schema)


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` plus ``decoded`` binary; cast it to string for the text."""
    schema = T.StructType(_kept(df, keep) + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = column(batch, "__ids")
            offs = col.offsets.to_numpy().astype(np.int64)
            flat = col.values.to_numpy(zero_copy_only=False)
            for lo, hi in slices(offs - offs[0], 1 << 20):
                out = [decode_ids(flat[offs[i]:offs[i + 1]], path).tobytes() for i in range(lo, hi)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(out, pa.binary())],
                    names=[*keep, "decoded"])
    return arrow(df.select(*keep, df[ids].alias("__ids")), run, schema)
