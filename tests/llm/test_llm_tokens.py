"""Byte-level BPE, wavelet matrix and token shards against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from casegrain.llm import byte_bpe, chunks, token_shards
from casegrain.llm.wavelet import WaveletMatrix, from_bytes, to_bytes

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "\n\n  \t x\r\n", "a\x1c b\x85 c　  d", "it's we'LL 'S", "a" * 20000,
       "word " * 50000, "😀" * 500 + " é́", "<|endoftext|> x", "１２３ ② Ⅷ ǅ", "日本語" * 300, "\x00\x01\x7f"]


def random_texts(n, seed):
    r = random.Random(seed)
    pick = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(128, 0x2FF), r.randrange(0x300, 0xD7FF),
                                 r.randrange(0xE000, 0x1FFFF), 32, 10, 39, 0x1D]))
    return ["".join(pick() for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_reference_in_any_pieces(reference, monkeypatch):
    texts = [t or "" for t in ODD] + random_texts(800, 3)
    for piece in (1 << 20, 50):
        monkeypatch.setattr(chunks, "PIECE_BYTES", piece)
        for t, ids in zip(texts, byte_bpe.encode_texts(texts, RANKS, P.PATTERN)):
            assert ids.tolist() == reference.encode_ordinary(t)
            assert byte_bpe.decode_ids(ids, RANKS).tobytes() == t.encode()


def test_chunk_encoder_with_little_room(monkeypatch):
    """Ids don't depend on what is remembered, on pieces or on empty rows."""
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["", "", *[x or "" for x in ODD], *random_texts(400, 8), "", "İstanbul ǅ don't rock'n'roll !'s (a)b.c", ""]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for piece, capacity in ((1 << 20, 600_000), (64, 200), (7, 3)):
        monkeypatch.setattr(chunks, "PIECE_BYTES", piece)
        got = chunks.ChunkEncoder(t, spaces=False, capacity=capacity).encode_texts(texts)
        assert [x.tolist() for x in got] == want


def test_split_characters_come_whole(reference):
    for t in ["😀é日", *random_texts(50, 5)]:
        ids = reference.encode_ordinary(t)
        parts = byte_bpe.pieces(ids, RANKS)
        assert len(parts) == len(ids) and "".join(parts) == t
    assert any(p == "" for p in byte_bpe.pieces(reference.encode_ordinary("\U0001F9FF"), RANKS))


def test_unknown_id_is_an_error():
    with pytest.raises(ValueError):
        byte_bpe.decode_ids(np.array([60000], np.int32), RANKS)


def test_encode_decode_tables(spark, reference):
    texts = ODD + ["same", "same"]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    enc = byte_bpe.encode(df, RANKS, P.PATTERN, ["doc_id"])
    back = byte_bpe.decode(enc, RANKS, ["doc_id", "ids", "starts"])
    rows = {r["doc_id"]: r for r in back.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i if i else None]
        want = reference.encode_ordinary(t or "")
        assert r["ids"] == want and bytes(r["decoded"]) == (t or "").encode()
        sizes = [len(reference.decode_single_token_bytes(x)) for x in want]
        assert r["starts"] == [sum(sizes[:k]) for k in range(len(sizes))] if len(sizes) < 50 else len(r["starts"]) == len(sizes)
    assert byte_bpe.decode(byte_bpe.encode(df.limit(0), RANKS, P.PATTERN, ["doc_id"]), RANKS, ["doc_id"]).count() == 0


@pytest.mark.parametrize("n,bits", [(0, 4), (1, 1), (513, 16), (5000, 17)])
def test_wavelet_matrix(n, bits):
    r = np.random.default_rng(n)
    ids = r.integers(0, min(1 << bits, 40), n) if n != 5000 else r.integers(0, 1 << bits, n)
    starts = np.array([0, n // 3, n], np.int64)
    raw = to_bytes(WaveletMatrix.of(ids, bits), np.array([5, 9]), np.array([False, True]), starts)
    m, docs, null, back = from_bytes(raw)
    assert m.all().tolist() == ids.tolist() and back.tolist() == starts.tolist() and null.tolist() == [False, True]
    if n:
        at = r.integers(0, n, 200)
        assert m.access(at).tolist() == ids[at].tolist()
        for token in set(ids[:20].tolist()) | {int(ids.max())}:
            lo, hi = sorted(r.integers(0, n + 1, 2).tolist())
            assert m.count(token) == int((ids == token).sum())
            assert m.count(token, lo, hi) == int((ids[lo:hi] == token).sum())
            assert m.find(token).tolist() == np.flatnonzero(ids == token).tolist()
    assert m.count(1 << bits) == 0 and m.find(-1).tolist() == []


def test_shards_give_the_tokenizers_ids_back(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [x for x in ODD if x != "word " * 50000] + random_texts(200, 9)
    rows = [(i * 7 % 1000, x, i) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = str(tmp_path / "shards")
    token_shards.write(df, out, path, shard_tokens=500)
    got = {r["doc_id"]: r for r in token_shards.read_documents(spark, out).collect()}
    start, twos = 0, []
    for d, x, _ in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[d]["start"], got[d]["n_tokens"], zlib.crc32(got[d]["tokens"])) == (start, len(ids), zlib.crc32(raw))
        start += len(ids)
        twos += [(d, k) for k, token in enumerate(ids) if token == 2]   # the end id is also a token of texts
    assert token_shards.count_token(spark, out, 2).agg({"n": "sum"}).first()[0] == len(twos)
    assert sorted(map(tuple, token_shards.find_token(spark, out, 2).collect())) == twos


def test_shards_of_nulls_ties_and_nothing(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "b"), (3, "x"), (3, "a"), (3, "a")], "doc_id long, text string")
    token_shards.write(df, str(tmp_path / "a"), path)
    rows = sorted(token_shards.read_documents(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 3, 3, 3]
    assert rows[1]["tokens"] == rows[2]["tokens"] != rows[3]["tokens"]
    token_shards.write(df.limit(0), str(tmp_path / "b"), path)
    assert token_shards.read_documents(spark, str(tmp_path / "b")).count() == 0


def test_query_digests(spark):
    from casegrain.llm.queries import QUERIES

    rows = QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
