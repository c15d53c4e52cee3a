"""Byte-level BPE: encode by a sentencepiece model written from a rank file, decode by inverse mapping.

The model is serialised here, not trained: every token of the rank file becomes a piece (its bytes
mapped to visible characters), scored by its negative rank, so that sentencepiece's best-score merge
is the lowest-rank merge. Normalisation is the identity. Texts are cut into pre-tokens by a pattern;
a pre-token is encoded once per worker cache and its ids are reused.

Null text counts as empty: no ids, and the hash of nothing.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from bizdiag.llm import worker
from bizdiag.llm.batches import chunks

CACHE_PIECES = 250_000
UNKNOWN = "\ue000"
OUTPUT = "n_tokens long, ids binary, decoded binary"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank; ranks are gapless from 0."""
    found = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks have gaps")
    return [found[i] for i in range(len(found))]


def visible() -> str:
    """A visible character for each byte: printable bytes stand for themselves, the others follow U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; one unknown piece follows them.

    Fields by the public model format: pieces (text, score, kind), trainer (kind 2 is BPE, size, ids
    of special pieces), normaliser (no rules, no prefix, white space as it is).
    """
    table, out = visible(), []
    for rank, token in enumerate(tokens):
        text = token.decode("latin-1").translate(table).encode()
        out.append(_block(1, _block(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, 1)))
    out.append(_block(1, _block(1, UNKNOWN.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    none = (1 << 64) - 1  # -1
    special = _number(40, len(tokens)) + _number(41, none) + _number(42, none) + _number(43, none)
    out.append(_block(2, _number(3, 2) + _number(4, len(tokens) + 1) + special + _block(45, UNKNOWN.encode())))
    out.append(_block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one worker, with a bounded cache of encoded pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        self.tokens = read_ranks(ranks_path)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.split = regex.compile(pattern).findall
        self.table = visible()
        self.cache: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode the pre-tokens that the cache lacks. A pre-token that is a token is that token."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache, new = {}, list(pieces)
        raw = [p.encode() for p in new]
        rest = [i for i, b in enumerate(raw) if b not in self.rank]
        ids = self.model.encode([raw[i].decode("latin-1").translate(self.table) for i in rest], num_threads=1)
        found = dict(zip(rest, ids))
        for i, p in enumerate(new):
            self.cache[p] = np.array(found[i] if i in found else [self.rank[raw[i]]], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split(t) for t in texts]
        self.learn(set().union(*pieces))
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids' tokens."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codec = lru_cache(maxsize=2)(Codec)


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    worker.keeps("bpe", _codec.cache_clear)
    return _codec(ranks_path, pattern)


def _mapped(docs: DataFrame, key: str, text: str, ranks_path: str, pattern: str, schema: str, finish) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = codec(ranks_path, pattern)
        for part in chunks(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            columns = finish([(len(x) // 4, x, own.decode(x), t) for x, t in zip(own.encode(texts), texts)])
            yield pa.RecordBatch.from_arrays([part.column(0), *columns[0]], names=["key", *columns[1]])

    return (
        docs.select(docs[key].alias("key"), docs[text].alias("text"))
        .mapInArrow(run, f"key {kind}, {schema}")
        .withColumnRenamed("key", key)
    )


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the number of ids, the ids (little-endian 32-bit) and the decoded bytes of every whole text."""

    def finish(rows):
        n, ids, raw, _ = zip(*rows) if rows else ((), (), (), ())
        return [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], ["n_tokens", "ids", "decoded"]

    return _mapped(docs, key, text, ranks_path, pattern, OUTPUT, finish)


def digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_decode``, with SHA-256 in place of ids and bytes, so that these never leave the task."""

    def finish(rows):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [
            pa.array([n for n, *_ in rows], pa.int64()),
            pa.array([sha(i) for _, i, _, _ in rows], pa.string()),
            pa.array([sha(b) for _, _, b, _ in rows], pa.string()),
        ], ["n_tokens", "ids_sha256", "decoded_sha256"]

    return _mapped(docs, key, text, ranks_path, pattern, DIGESTS, finish)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_decode``, with ``exact`` (the ids decode to the text's bytes) in place of the bytes."""

    def finish(rows):
        n, ids, raw, texts = zip(*rows) if rows else ((), (), (), ())
        exact = [b == t.encode() for b, t in zip(raw, texts)]
        return [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(exact, pa.bool_())], ["n_tokens", "ids", "exact"]

    return _mapped(docs, key, text, ranks_path, pattern, "n_tokens long, ids binary, exact boolean", finish)
