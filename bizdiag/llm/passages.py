"""Removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the least hash of the runs
of ``GRAM`` words in it. Consecutive windows with the same minimiser travel as one packed string to
the bucket of that minimiser; equal windows have equal minimisers and so meet there. In a bucket,
windows are sorted: in a run of equal ones, all in documents above the smallest id are repeats.

Before anything travels, equal windows within one map-side chunk are settled: those in documents
above the chunk's smallest id are repeats whatever else exists, and stay behind. So a passage that a
third of all documents share reaches its bucket once for each chunk, not once for each document.
Runs of words that are frequent in a bounded sample are chosen as minimisers last, so that common
phrases do not make large buckets; the sample affects only the sizes of buckets, never the result.

Windows are compared by 128 bits over 64-bit word hashes. Rows are told apart by id and text, so rows
that repeat an id are judged each by its own text; equal ids are not smaller than each other. Rows
without id neither lose words nor make others lose any. Null text has no words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizdiag.llm import words as W
from bizdiag.llm import worker
from bizdiag.llm.batches import chunks, sampled, splits, unused

WINDOW = 13
GRAM = 2
#: Buckets to each shuffle partition; a task holds one bucket at a time.
BUCKETS = 4
#: Windows that a task holds before it settles what can be settled.
HELD = 400_000
#: Bytes of text that a task packs at once: some 30 times as much memory goes into its words and windows.
CHUNK_BYTES = 2 << 20
#: Bytes of sample text that packed strings are compressed against.
DICTIONARY = 65_536
SAMPLE_ROWS = 2_000
FREQUENT = 16
_BITS = 20
_SENT = "bucket int, doc long, mark int, ranges binary, blob binary"
_NAMES = ["bucket", "doc", "mark", "ranges", "blob"]


def _nothing() -> None:
    """Words are hashed together here and not kept, so what other operators keep in the worker is all that goes."""


def _ranges(doc: np.ndarray, mark: np.ndarray, at: np.ndarray):
    """(doc, mark, starts and lengths of runs of consecutive positions) of each document."""
    if not len(at):
        return
    order = np.lexsort((at, mark, doc))
    doc, mark, at = doc[order], mark[order], at[order]
    other = np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]
    new = other | np.r_[True, at[1:] - at[:-1] > 1]
    first = np.flatnonzero(new)
    pairs = np.stack([at[first], np.diff(np.r_[first, len(at)])], 1).astype("<i4")
    docs = np.flatnonzero(other[first])
    for a, b in zip(docs, np.r_[docs[1:], len(first)]):
        yield int(doc[first[a]]), int(mark[first[a]]), pairs[a:b].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_NAMES)


def _repeats(key: np.ndarray, other: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indices of windows that also start in a document with a smaller id."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    some = order[np.r_[same, False] | np.r_[False, same]]
    if not len(some):
        return some
    some = some[np.lexsort((doc[some], other[some], key[some]))]
    new = np.r_[True, (key[some][1:] != key[some][:-1]) | (other[some][1:] != other[some][:-1])]
    smallest = doc[some][np.flatnonzero(new)][np.cumsum(new) - 1]
    return some[doc[some] > smallest]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text in which a blank or line feed stands between two of them, and nowhere else."""
    marks = np.frombuffer(text, np.uint8)
    between = np.flatnonzero((marks == 32) | (marks == 10))
    return np.r_[0, between + 1], np.r_[between, len(text)]


def pack(part: pa.RecordBatch, buckets: int, frequent: np.ndarray, packer: zstandard.ZstdCompressor):
    """Rows for the buckets from one chunk (doc, mark, text): settled repeats, and packed super-k-mers."""
    worker.keeps("passages", _nothing)
    split = []
    for d, m, t in zip(*part.columns):  # the words of one text at a time
        if d.is_valid and t.is_valid and len(words := t.as_py().encode().split()) >= WINDOW:
            split.append((d.as_py(), m.as_py(), len(words), b" ".join(words)))
    if not split:
        return
    doc_of, mark_of = np.array([x[0] for x in split], np.int64), np.array([x[1] for x in split], np.int32)
    count = np.array([x[2] for x in split])
    joined = b" ".join([x[3] for x in split])
    del split
    first = np.cumsum(count) - count
    begins, ends = _words(joined)
    h = W.spans(joined, begins, ends)
    owner = np.repeat(np.arange(len(count)), count)
    size = len(h) - WINDOW + 1
    valid = owner[:size] == owner[WINDOW - 1 :]
    gram = W.grams(h, GRAM, 1)
    gram = (gram >> np.uint64(1)) | (frequent[gram >> np.uint64(64 - _BITS)].astype(np.uint64) << np.uint64(63))
    least = W.least(gram, WINDOW - GRAM + 1)
    at = np.flatnonzero(valid)
    gone = at[_repeats(W.grams(h, WINDOW, 2)[at], W.grams(h, WINDOW, 3)[at], doc_of[owner[at]])]
    own = owner[gone]
    for doc, mark, pairs in _ranges(doc_of[own], mark_of[own], gone - first[own]):
        yield doc % buckets, doc, mark, pairs, None
    valid[gone] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return
    run = np.flatnonzero(np.r_[True, (at[1:] - at[:-1] > 1) | (least[at[1:]] != least[at[:-1]])])
    start, n = at[run], np.diff(np.r_[run, len(at)])
    bucket = (W.mixed(least[start]) % np.uint64(buckets)).astype(np.int64)
    begin, stop = begins[start], ends[start + n + WINDOW - 2]
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True])
    for a, b in zip(edges[:-1], edges[1:]):
        k = order[a:b]
        own = owner[start[k]]
        text = b"\n".join([joined[x:y] for x, y in zip(begin[k].tolist(), stop[k].tolist())])
        head = np.array([len(k)], "<i8").tobytes() + np.diff(doc_of[own], prepend=0).tobytes() + mark_of[own].tobytes() + (start[k] - first[own]).astype("<i4").tobytes()
        yield int(bucket[order[a]]), None, None, None, packer.compress(head + text)


def unpack(raw: bytes):
    """Arrays of the windows of packed strings: two hashes, document, mark and position."""
    worker.keeps("passages", _nothing)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    doc, mark, at = np.cumsum(np.frombuffer(raw, "<i8", n, 8)), np.frombuffer(raw, "<i4", n, 8 + 8 * n), np.frombuffer(raw, "<i4", n, 8 + 12 * n)
    text = raw[8 + 16 * n :]
    begins, ends = _words(text)  # a blank between words, a line feed between strings
    last = np.flatnonzero(np.frombuffer(text, np.uint8)[ends[:-1]] == 10)  # words before a line feed
    count = np.diff(np.r_[-1, last, len(ends) - 1])
    h = W.spans(text, begins, ends)
    windows = count - WINDOW + 1
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    where = np.repeat(np.cumsum(count) - count, windows) + inside
    return W.grams(h, WINDOW, 2)[where], W.grams(h, WINDOW, 3)[where], np.repeat(doc, windows), np.repeat(mark, windows), np.repeat(at, windows) + inside


def _sample(rows: DataFrame) -> tuple[np.ndarray, bytes]:
    """From a bounded sample: a bit table of runs of words that occur ``FREQUENT`` times or more, and text to compress against."""

    def count(batches):
        seen, text, size = [], [], 0
        for part in chunks(batches):
            lists = [words for t in part.column("text").to_pylist() if t and (words := t.encode().split())]
            joined = b" ".join(map(b" ".join, lists))
            seen.append(W.grams(W.spans(joined, *_words(joined)), GRAM, 1) >> np.uint64(64 - _BITS))
            for words in lists:
                if size < DICTIONARY:
                    text.append(b" ".join(words[:200]))
                    size += len(text[-1])
        slots, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
        packed = pa.array([b"\n".join(text)[:DICTIONARY]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([slots[n >= FREQUENT].astype(np.int64)], pa.list_(pa.int64())), packed], names=["slots", "text"])

    found = sampled(rows, ["doc", "mark"], SAMPLE_ROWS).select("text").repartition(1).mapInArrow(count, "slots array<long>, text binary").first()
    table = np.zeros(1 << _BITS, bool)
    if found:  # else there are no rows
        table[found["slots"]] = True
    return np.packbits(table), bytes(found["text"]) if found else b""


def repeated(docs: DataFrame, mark: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark, ranges): for each text with repeats, the starts and lengths of runs of repeated windows.

    ``mark`` tells apart texts that share an id.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), mark.alias("mark"), F.col(text).alias("text"))
    n = splits(docs)
    buckets = n * BUCKETS
    table = docs.sparkSession.sparkContext.broadcast(_sample(rows))

    def send(batches):
        frequent = np.unpackbits(table.value[0]).astype(bool)
        packer = zstandard.ZstdCompressor(level=5, dict_data=_dictionary(table.value[1]))
        for part in chunks(batches, most=CHUNK_BYTES):
            out, size = [], 0
            for row in pack(part, buckets, frequent, packer):
                out.append(row)
                size += len(row[3] or b"") + len(row[4] or b"")
                if size > 1 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    def settle(batches):
        """One bucket after the other; what is held is cut down to the smallest documents' windows again and again."""
        packed = zstandard.ZstdDecompressor(dict_data=_dictionary(table.value[1]))
        at, held, limit = None, [], HELD

        def settled():
            nonlocal held
            windows = [np.concatenate(x) for x in zip(*held)]
            gone = _repeats(*windows[:3])
            stay = np.ones(len(windows[0]), bool)
            stay[gone] = False
            held = [[x[stay] for x in windows]]
            return [(0, *x, None) for x in _ranges(*(x[gone] for x in windows[2:]))]

        for batch in batches:
            through = batch.filter(pc.is_valid(batch.column("ranges")))
            if through.num_rows:
                yield through.select(_NAMES[1:4])
            full = batch.filter(pc.is_valid(batch.column("blob")))
            for bucket, blob in zip(full.column("bucket").to_pylist(), full.column("blob")):
                done = []
                if bucket != at:
                    done = settled() if held else []
                    at, held, limit = bucket, [], HELD
                held.append(unpack(packed.decompress(blob.as_py())))
                if sum(len(x[0]) for x in held) > limit:
                    done += settled()
                    limit = 2 * len(held[0][0]) + HELD
                if done:
                    yield _batch(done).select(_NAMES[1:4])
        done = settled() if held else []
        if done:
            yield _batch(done).select(_NAMES[1:4])

    sent = rows.mapInArrow(send, _SENT).repartition(n, "bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(settle, "doc long, mark int, ranges binary")
    return found.groupBy("doc", "mark").agg(F.collect_list("ranges").alias("ranges"))


def _dictionary(text: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(text) > 8 else None


def _mark(docs: DataFrame, key: str, text: str) -> Column:
    """0, unless ids repeat: then a hash of the text."""
    again = docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).count()
    return F.hash(text) if again else F.lit(0)


def kept_words(text: str | None, ranges: list[bytes] | None) -> tuple[list[bytes], int]:
    """The words outside the ranges, and the number of those inside."""
    words = (text or "").encode().split()
    if not ranges:
        return words, 0
    gone = np.zeros(len(words) + 1, np.int32)
    for start, n in np.concatenate([np.frombuffer(r, "<i4") for r in ranges]).reshape(-1, 2):
        gone[start] += 1
        gone[start + n + WINDOW - 1] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return [w for w, g in zip(words, gone) if not g], int(gone.sum())


def _cut(docs: DataFrame, key: str, text: str, schema: str, finish) -> DataFrame:
    """``docs`` with columns of ``schema`` made from (text, kept words, number removed) of each row."""
    names = docs.columns
    mark = _mark(docs, key, text)
    doc_, mark_, ranges_ = (unused(n, names) for n in ("_doc", "_mark", "_ranges"))
    rows = docs.withColumn(doc_, F.col(key).cast("long")).withColumn(mark_, mark)
    found = repeated(docs, mark, key, text).select(F.col("doc").alias(doc_), F.col("mark").alias(mark_), F.col("ranges").alias(ranges_))
    joined = rows.join(found.hint("shuffle_hash"), [doc_, mark_], "left").select(*names, ranges_)

    def run(batches):
        for part in chunks(batches, text):
            made = [finish(t, *kept_words(t, r)) for t, r in zip(part.column(text).to_pylist(), part.column(ranges_).to_pylist())]
            columns = {n: part.column(n) for n in names}
            for (name, kind), values in zip(fields, zip(*made)):
                columns[name] = pa.array(values, kind)
            yield pa.RecordBatch.from_arrays([columns[n] for n in out.names], names=out.names)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    added = T.StructType.fromDDL(schema)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in added]
    new = {f.name for f in added}
    out = T.StructType([f for f in docs.schema if f.name not in new] + list(added))
    return joined.mapInArrow(run, out)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and the SHA-256 of the kept words joined by one blank."""

    def finish(_, kept, removed):
        return len(kept) + removed, removed, hashlib.sha256(b" ".join(kept)).hexdigest()

    made = _cut(docs.select(key, text), key, text, "n_words long, n_removed long, kept_sha256 string", finish)
    return made.select(key, "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``.

    A text that loses nothing stays as it is; else its kept words are joined by one blank.
    """

    def finish(whole, kept, removed):
        return (b" ".join(kept).decode() if removed else whole,)

    return _cut(docs, key, text, f"{text} string", finish).select(docs.columns)
