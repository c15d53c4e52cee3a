"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and their token counts, drawn from a bounded
sample and broadcast. Tier two is a worker's own cache: a pre-token that the table lacks is encoded
once by the tokenizer and remembered, up to a bound. No pre-token is ever shuffled.

Texts are cut by the byte-level pattern. Its character classes follow a Unicode version, so a text
with characters outside well-settled scripts is given whole to the tokenizer instead.
Null text counts as empty: 0 bytes, 0 tokens.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizdiag.llm import worker
from bizdiag.llm.batches import chunks, sampled

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 65_536
FREQUENT = 32_768
CACHE_PIECES = 250_000
#: Latin, Greek and Cyrillic blocks, CJK and Hangul: unchanged between the Unicode versions in use.
_UNSETTLED = regex.compile("[^\\x00-\\u052f\\u3000-\\u9fff\\uac00-\\ud7a3]")


class Counting:
    """Token counts of one worker."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(pattern).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.frequent: dict[str, int] = {}
        self.table: dict[str, int] = {}

    def preload(self, pieces: list[str], counts: list[int]) -> None:
        """Take over the broadcast tier."""
        if len(self.frequent) != len(pieces):
            self.frequent = dict(zip(pieces, counts))
            self.table = dict(self.frequent)

    def lengths(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token, by the library."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        """Encode what both tiers lack."""
        new = [p for p in pieces if p not in self.table]
        if len(self.table) + len(new) > CACHE_PIECES + len(self.frequent):
            self.table = dict(self.frequent)
            new = [p for p in pieces if p not in self.table]
        self.table.update(zip(new, self.lengths(new)))

    def plain(self, text: str) -> bool:
        """Whether pre-tokens may be looked up."""
        return (text.isascii() or not _UNSETTLED.search(text)) and not any(s in text for s in self.special)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        pieces = [self.split(t) if self.plain(t) else None for t in texts]
        self.learn(set().union(*(p for p in pieces if p)))
        get = self.table.__getitem__
        return [self.lengths([t])[0] if p is None else sum(map(get, p)) for t, p in zip(texts, pieces)]


_counting = lru_cache(maxsize=2)(Counting)


def counting(path: str, pattern: str) -> Counting:
    """One for each worker process."""
    worker.keeps("tokens", _counting.cache_clear)
    return _counting(path, pattern)


def frequent_pieces(docs: DataFrame, path: str, pattern: str, key: str, text: str) -> tuple[list[str], list[int]]:
    """At most ``FREQUENT`` pre-tokens with their token counts, from about ``SAMPLE_ROWS`` texts of bounded size."""
    small = docs.filter(F.octet_length(text) <= SAMPLE_BYTES).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        own, seen = counting(path, pattern), Counter()
        for part in chunks(batches):
            for t in part.column("text").to_pylist():
                seen.update(own.split(t))
        pieces = [p for p, n in seen.most_common(FREQUENT) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(own.lengths(pieces), pa.int32())], names=["piece", "n"])

    found = sampled(small, "key", SAMPLE_ROWS).select("text").repartition(1).mapInArrow(run, "piece string, n int").toArrow()
    return found.column("piece").to_pylist(), found.column("n").to_pylist()


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and whether they exceed ``limit``, for every whole text.

    Counts are those of the tokenizers library for the file at ``path``, without added special tokens;
    strings of special tokens inside texts are handled as the library does by default.
    """
    kind = docs.schema[key].dataType.simpleString()
    tier = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, pattern, key, text))

    def run(batches):
        own = counting(path, pattern)
        own.preload(*tier.value)
        for part in chunks(batches):
            column = part.column("text")
            n = own.counts([t or "" for t in column.to_pylist()])
            size = pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), over], names=["key", "n_bytes", "n_tokens", "over_limit"])

    return (
        docs.select(docs[key].alias("key"), docs[text].alias("text"))
        .mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
        .withColumnRenamed("key", key)
    )
