"""BPE encoding and decoding that reuses content-defined chunks.

Texts are cut where a rolling hash of the last ``WINDOW`` bytes says so, so that texts with a passage in
common have its chunks in common, wherever it stands. A worker encodes each chunk once, however many
documents share it, and keeps it in a bounded cache; so it does with the joins of two chunks.

A chunk's own encoding is wrong about its ends: pre-tokens reach over a cut, and special tokens may be cut in
two. Pre-tokens are matched from left to right without looking back, so from any true start of a pre-token on,
the split depends on what follows alone, and a pre-token that ends ``margin`` bytes before the end of what was
encoded is as in the whole text (``margin`` is the longest special token and what the pattern looks ahead).
A join is therefore repaired by encoding again from the first unsure pre-token of the left side to a little
beyond the cut; where a sure start of that encoding is also a start in the right chunk's own encoding, both
agree from there on, up to the right chunk's unsure end. As long as none agrees, the window doubles, over as
many chunks as it takes, at most to the end of the text. So the ids are those of the whole text.

What is encoded (a chunk or a window) is cut by the pattern and its pre-tokens are looked up in a bounded
cache that the tokenizer fills; text with special tokens, or with characters outside the scripts that all Unicode
versions class alike, goes to the tokenizer as it is.

Null text counts as empty: no ids. Nothing is shuffled, and rows do not depend on one another.
"""

from __future__ import annotations

import hashlib
import json
import os
from bisect import bisect_right
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bizdiag.llm import worker
from bizdiag.llm.batches import chunks as slices
from bizdiag.llm.bpe import visible

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WINDOW = 32
#: Bytes of a chunk: at least, about on average beyond that, at most.
LEAST, MEAN, MOST = 256, 1_024, 8_192
#: Bytes beyond a cut that a join looks at first, and then, before it is left to its text.
REACHES = (64, 256)
#: Bytes that the pattern looks at beyond the end of a match, at most (four characters).
LOOKAHEAD = 16
CACHE_PIECES, CACHE_CHUNKS, CACHE_JOINS = 400_000, 8_000, 16_000
BATCH_BYTES = 1 << 20
#: Blocks whose characters are classed alike by all Unicode versions in use: Latin, Greek, Cyrillic, CJK, Hangul.
_UNSETTLED = regex.compile("[^\\x00-\\u052f\\u3000-\\u9fff\\uac00-\\ud7a3]")
_VALUE = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of each run of ``WINDOW`` bytes: a polynomial, put together from runs of 1, 2, 4, ..."""
    out, span, factor = _VALUE[data], 1, 0x9E3779B1
    while span < WINDOW:
        out = out[:-span] * np.uint32(factor) + out[span:]
        factor, span = factor * factor & 0xFFFFFFFF, 2 * span
    return out


def cuts(text: bytes) -> list[int]:
    """Places where a text is cut, with 0 and its length; all between characters."""
    size = len(text)
    if size <= LEAST:
        return [0, size] if size else [0]
    data, found = np.frombuffer(text, np.uint8), []
    for at in range(0, size, BATCH_BYTES):
        part = data[max(0, at - WINDOW) : at + BATCH_BYTES]
        if len(part) >= WINDOW:
            hit = np.flatnonzero(rolling(part) >> np.uint32(16) < np.uint32(65_536 // (MEAN - LEAST)))
            found.extend((hit + (WINDOW + max(0, at - WINDOW))).tolist())
    out = [0]
    for place in chain(found, (size,)):
        while place - out[-1] > MOST:
            out.append(_between(text, out[-1] + MOST))
        if LEAST <= place - out[-1] and size - place >= LEAST:
            out.append(_between(text, place))
    return [*out, size]


def _between(text: bytes, place: int) -> int:
    """``place`` or the next end of a character."""
    while place < len(text) and text[place] & 0xC0 == 0x80:
        place += 1
    return place


class Recent:
    """A bounded cache of two generations; what is used stays."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Pieces:
    """Ids of pre-tokens, in flat arrays."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.counts = self.sizes = self.begins = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def add(self, pieces: list[str], sizes: list[int], ids: list[list[int]]) -> None:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        begins = len(self.ids) + np.cumsum(counts) - counts
        self.at.update(zip(pieces, range(len(self.counts), len(self.counts) + len(pieces))))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), "<u4", int(counts.sum()))])
        self.counts, self.begins = np.concatenate([self.counts, counts]), np.concatenate([self.begins, begins])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])

    def keep(self, pieces: set[str]) -> None:
        """Forget all but these."""
        names = [p for p in pieces if p in self.at]
        at = np.array([self.at[p] for p in names], np.int64)
        ids = self.gathered(at)
        self.counts, self.sizes, self.ids = self.counts[at], self.sizes[at], ids
        self.begins = np.cumsum(self.counts) - self.counts
        self.at = dict(zip(names, range(len(names))))

    def gathered(self, at: np.ndarray) -> np.ndarray:
        """The ids of pre-tokens, one after the other."""
        counts = self.counts[at]
        first = np.cumsum(counts) - counts
        return self.ids[np.repeat(self.begins[at] - first, counts) + np.arange(int(counts.sum()))]


class Encoded:
    """Ids of a stretch of text, and where its pre-tokens start: in bytes and in ids, with both ends."""

    __slots__ = ("serial", "ids", "starts", "firsts", "tail")

    def __init__(self, serial: int, ids: np.ndarray, starts: np.ndarray, firsts: np.ndarray, margin: int):
        self.serial, self.ids, self.starts, self.firsts = serial, ids, starts, firsts
        #: The first pre-token that may be another one in a longer text.
        self.tail = max(0, int(starts.searchsorted(int(starts[-1]) - margin, "right")) - 1)

    def index(self, place: int) -> int | None:
        """The pre-token that starts at a byte, if one does."""
        k = int(self.starts.searchsorted(place))
        return k if k < len(self.starts) and self.starts[k] == place else None


class Codec:
    """Encoder and decoder of one worker, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        text = Path(path).read_text(encoding="utf-8")
        self._check(json.loads(text))
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(visible())}
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token.encode() if i in added or any(c not in back for c in token) else bytes(back[c] for c in token)
        self.sizes = np.array([len(t) for t in self.tokens])
        names = [f"{i},".encode() for i in range(len(self.tokens))]
        #: Every id in decimal with a comma, filled up with zero bytes.
        self.names = np.array(names).view(np.uint8).reshape(len(names), -1)
        self.special = list(added.values())
        self.margin = max([len(t.encode()) for t in self.special], default=0) + LOOKAHEAD
        self.pieces, self.made = Pieces(), 0
        self.chunks, self.joins = Recent(CACHE_CHUNKS), Recent(CACHE_JOINS)

    @staticmethod
    def _check(file: dict) -> None:
        """Only what the repair of joins is proven for."""
        split = file.get("pre_tokenizer") or {}
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file.get("added_tokens", []))
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not plain:
            raise ValueError("not a byte-level BPE file without prefix space whose added tokens stand by themselves")
        if file.get("normalizer") or file["model"].get("type") != "BPE" or file["model"].get("dropout"):
            raise ValueError("not a plain BPE file without normalisation")

    def _plain(self, text: str) -> bool:
        return (text.isascii() or not _UNSETTLED.search(text)) and not any(s in text for s in self.special)

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where the pre-tokens are in the cache, after encoding those that it lacks."""
        found = np.fromiter(map(self.pieces.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        lacking = np.flatnonzero(found < 0).tolist()
        if lacking:
            new = {pieces[k] for k in lacking}
            if len(self.pieces.at) + len(new) > CACHE_PIECES:
                self.pieces.keep(set(pieces))
                lacking = list(range(len(pieces)))
            names = list(new)
            encoded = self.tokenizer.encode_batch_fast(names, add_special_tokens=False)
            self.pieces.add(names, [len(p.encode()) for p in names], [e.ids for e in encoded])
            found[lacking] = [self.pieces.at[pieces[k]] for k in lacking]
        return found

    def _encoded(self, texts: list[bytes]) -> list[Encoded]:
        """The encoding of each stretch by itself."""
        words = [t.decode() for t in texts]
        split = [self.split(t) if self._plain(t) else None for t in words]
        at = self._places(list(chain.from_iterable(s for s in split if s)))
        ids, starts, firsts = self.pieces.gathered(at), *(np.concatenate([[0], np.cumsum(x[at])]) for x in (self.pieces.sizes, self.pieces.counts))
        rest = iter(self.tokenizer.encode_batch([t for t, s in zip(words, split) if s is None], add_special_tokens=False))
        out, a = [], 0
        for s in split:
            self.made += 1
            if s is None:
                found = next(rest)
                mine, word = np.array(found.ids, "<u4"), np.array(found.word_ids, np.int64)
                edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]])) if len(mine) else np.zeros(1, np.int64)
                places = np.concatenate([[0], np.cumsum(self.sizes[mine])])[edges]
                out.append(Encoded(self.made, mine, places.astype(np.uint32), edges.astype(np.uint32), self.margin))
            else:
                b = a + len(s)
                x, y = int(firsts[a]), int(firsts[b])
                out.append(Encoded(self.made, ids[x:y].copy(), (starts[a : b + 1] - starts[a]).astype(np.uint32), (firsts[a : b + 1] - x).astype(np.uint32), self.margin))
                a = b
        return out

    def _chunks(self, texts: list[bytes]) -> dict[bytes, Encoded]:
        """Every distinct chunk of a batch."""
        out = {t: self.chunks.get(t) for t in set(texts)}
        new = [t for t, found in out.items() if found is None]
        for t, found in zip(new, self._encoded(new)):
            self.chunks.put(t, found)
            out[t] = found
        return out

    def _repair(self, pairs: dict, found: dict[bytes, Encoded]) -> dict:
        """(ids up to the unsure end of the left chunk, ids of the window, pre-token of the right one) of every
        distinct join; None where no start agrees within the greatest reach."""
        out = {k: self.joins.get(k) for k in pairs}
        open_ = [k for k, v in out.items() if v is None]
        for reach in REACHES:
            windows, use = [], []
            for k in open_:
                a, b = pairs[k]
                left, right = found[a], found[b]
                if left.tail and len(b) > reach:
                    use.append((k, left, right, len(a) - int(left.starts[left.tail])))
                    windows.append(a[int(left.starts[left.tail]) :] + b[: _between(b, reach)])
            for (k, left, right, cut), again in zip(use, self._encoded(windows)):
                for at in range(again.tail + 1):
                    place = int(again.starts[at]) - cut
                    if place >= 0 and (to := right.index(place)) is not None and to <= right.tail:
                        out[k] = (int(left.firsts[left.tail]), again.ids[: int(again.firsts[at])], to)
                        self.joins.put(k, out[k])
                        break
            open_ = [k for k in open_ if out[k] is None]
        return out

    def _widened(self, text: bytes, places: list[int], own: list[Encoded], k: int, start: int) -> tuple[list[np.ndarray], int, int]:
        """Ids from the sure pre-token ``start`` of chunk ``k`` to where windows that double agree with a later chunk;
        that chunk (their number, at the end of the text) and its pre-token."""
        ids, from_ = [], start
        if own[k].tail > start:
            from_ = own[k].tail
            ids.append(own[k].ids[int(own[k].firsts[start]) : int(own[k].firsts[from_])])
        begin, reach = places[k] + int(own[k].starts[from_]), REACHES[0]
        while True:
            end = _between(text, min(len(text), places[k + 1] + reach))
            again = self._encoded([text[begin:end]])[0]
            if end == len(text):
                return [*ids, again.ids], len(own), 0
            for at in range(again.tail + 1):
                place = begin + int(again.starts[at])
                if place >= places[k + 1]:
                    into = bisect_right(places, place) - 1
                    to = own[into].index(place - places[into])
                    if to is not None and (to <= own[into].tail or into == len(own) - 1):
                        return [*ids, again.ids[: int(again.firsts[at])]], into, to
            reach *= 2

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each whole text."""
        places = [cuts(t) for t in texts]
        parts = [[t[a:b] for a, b in zip(p, p[1:])] for t, p in zip(texts, places)]
        found = self._chunks(list(chain.from_iterable(parts)))
        pairs = {(found[a].serial, found[b].serial): (a, b) for p in parts for a, b in zip(p, p[1:])}
        joins, out = self._repair(pairs, found), []
        for text, at, p in zip(texts, places, parts):
            own, ids, k, start = [found[x] for x in p], [], 0, 0
            while k < len(own):
                here = own[k]
                join = joins[here.serial, own[k + 1].serial] if k + 1 < len(own) else None
                if k + 1 == len(own):
                    ids.append(here.ids[int(here.firsts[start]) :])
                    k += 1
                elif join and start <= here.tail:
                    ids += [here.ids[int(here.firsts[start]) : join[0]], join[1]]
                    k, start = k + 1, join[2]
                else:
                    more, k, start = self._widened(text, at, own, k, start)
                    ids += more
            out.append(np.concatenate(ids) if ids else np.zeros(0, "<u4"))
        return out

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        written = self.names[ids].ravel()
        return written[written != 0][:-1].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codec = lru_cache(maxsize=2)(Codec)


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    worker.keeps("chunk_bpe", _codec.cache_clear)
    return _codec(path, pattern)


def _mapped(docs: DataFrame, key: str, text: str, path: str, pattern: str, columns: dict[str, tuple[str, pa.DataType]], finish) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = codec(path, pattern)
        for part in slices(batches, most=BATCH_BYTES):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            rows = [finish(own, ids) for ids in own.encode(texts)]
            arrays = [pa.array([row[k] for row in rows], t) for k, (_, t) in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([part.column("key"), *arrays], names=["key", *columns])

    schema = ", ".join(f"{name} {k}" for name, (k, _) in columns.items())
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, {schema}")
    return out.withColumnRenamed("key", key)


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and the ``decoded`` text of every whole text.

    As the tokenizers library encodes with the file at ``path``, without added special tokens, truncation or
    padding, and decodes without skipping special tokens. ``pattern`` is the pattern of the file's pre-tokens.
    """
    columns = {"n_tokens": ("long", pa.int64()), "ids": ("binary", pa.binary()), "decoded": ("string", pa.string())}
    return _mapped(docs, key, text, path, pattern, columns, lambda own, ids: (len(ids), ids.astype("<u4").tobytes(), own.decode(ids)))


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_decode``, with SHA-256 of the decimal ids joined by commas and of the decoded text in UTF-8."""

    def finish(own, ids):
        return len(ids), hashlib.sha256(own.listed(ids)).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

    columns = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _mapped(docs, key, text, path, pattern, columns, finish)
