"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ``ORDER``, with counts frozen after training. A byte is
coded in the longest context known; a byte new there costs an escape (method C: as many escapes as
distinct bytes) and is coded in the next shorter context, without the bytes already ruled out; below
order 0 all remaining bytes are equally likely. The language with the shortest exact code wins; the
score is its share when code lengths are taken as log-likelihoods under equal priors.

Trees are fitted on about ``TRAIN_ROWS`` texts of each language, of at most ``TRAIN_BYTES`` bytes; a language with
fewer such texts also learns from the beginnings of its longer ones. No language is left out. A language's
code lengths do not depend on the others, so models hold ``LANGUAGES`` languages each and grow with their
number, not its square. Every whole text is scored. The code lengths of all (ORDER + 1)-grams seen in training are
tabled; others are worked out when they occur.

Null text and text without a letter are ``und`` with score 0 (null code length if there are no bytes).
Rows without id are scored but neither held out nor learned from. Without any labelled row all is ``und``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizdiag.llm import worker
from bizdiag.llm.batches import chunks, unused

ORDER = 4
TRAIN_ROWS = 400
TRAIN_BYTES = 65_536
LANGUAGES = 64
UNKNOWN = "und"
#: Texts scored at once; about 80 bytes are held for each of theirs.
CHUNK_BYTES = 512 << 10
_MASK = [np.uint64((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-gram that ends at each byte, as a number, and where each text starts. Texts begin after zero bytes."""
    pad = bytes(ORDER)
    raw = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8).astype(np.uint64)
    out = np.zeros(len(raw) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        out = out << np.uint64(8) | raw[k : len(raw) - ORDER + k]
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size + ORDER)
    real = np.ones(len(out), bool)
    for k in range(ORDER):  # the zero bytes between texts are context only
        real[(ends - 1 - k)[ends - 1 - k < len(out)]] = False
    return out[real], np.cumsum(size) - size


class Model:
    """Frozen trees of all languages. ``counts``: one row for each gram seen, one column for each language."""

    def __init__(self, languages: list[str], seen: np.ndarray, counts: np.ndarray):
        self.languages = languages
        self.gram, self.count, self.context, self.total, self.kinds = [], [], [], [], []
        for k in range(ORDER + 1):
            gram, where = np.unique(seen & _MASK[k], return_inverse=True)
            count = np.zeros((len(gram), len(languages)))
            np.add.at(count, where, counts)
            context, owner = np.unique(gram >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), len(languages))), np.zeros((len(context), len(languages)))
            np.add.at(total, owner, count)
            np.add.at(kinds, owner, count > 0)
            for held, new in zip((self.gram, self.count, self.context, self.total, self.kinds), (gram, count, context, total, kinds)):
                held.append(new)
        # of each context: the counts, in its next shorter context, of the bytes it knows
        self.ruled = [None]
        for k in range(1, ORDER + 1):
            shorter = np.searchsorted(self.gram[k - 1], self.gram[k] & _MASK[k - 1])
            ruled = np.zeros_like(self.total[k])
            np.add.at(ruled, np.searchsorted(self.context[k], self.gram[k] >> np.uint64(8)), np.where(self.count[k] > 0, self.count[k - 1][shorter], 0))
            self.ruled.append(ruled)
        bits = max(10, int(4 * len(self.gram[ORDER])).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.slot_row = np.zeros(1 << bits, np.int32)
        self._fill()
        self.cost = self.lengths(self.gram[ORDER]).astype(np.float32)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _fill(self) -> None:
        left = np.arange(len(self.gram[ORDER]))
        slot = self._slot(self.gram[ORDER])
        while len(left):
            slot_left, first = np.unique(slot[left], return_index=True)
            free = self.slot_key[slot_left] == np.iinfo(np.uint64).max
            put = left[first[free]]
            self.slot_key[slot[put]], self.slot_row[slot[put]] = self.gram[ORDER][put], put
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) % len(self.slot_key)

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return at, table[at] == x

    def lengths(self, g: np.ndarray) -> np.ndarray:
        """Exact code length in bits of the last byte of each gram, for each language."""
        shape = (len(g), len(self.languages))
        out, open_ = np.zeros(shape), np.ones(shape, bool)
        minus, fewer = np.zeros(shape), np.zeros(shape)  # what the longer context rules out
        for k in range(ORDER, -1, -1):
            part = g & _MASK[k]
            at, known = self._find(self.context[k], part >> np.uint64(8))
            total, kinds = (np.where(known[:, None], x[k][at], 0) for x in (self.total, self.kinds))
            at_gram, hit = self._find(self.gram[k], part)
            count = np.where(hit[:, None], self.count[k][at_gram], 0)
            escapes = kinds - fewer
            whole = total - minus + escapes
            coded, passed = open_ & (count > 0), open_ & (count == 0) & (escapes > 0)
            out[coded] += np.log2(whole[coded]) - np.log2(count[coded])
            out[passed] += np.log2(whole[passed]) - np.log2(escapes[passed])
            open_ &= count == 0
            if k:
                minus, fewer = np.where(known[:, None], self.ruled[k][at], 0), kinds
            else:
                fewer = kinds
        out += np.where(open_, np.log2(np.maximum(256 - fewer, 1)), 0)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (none empty) for each language."""
        g, starts = grams(texts)
        slot, row, left = self._slot(g), np.full(len(g), -1, np.int32), None
        none = np.iinfo(np.uint64).max
        while True:
            some = slot if left is None else slot[left]
            key, wanted = self.slot_key[some], g if left is None else g[left]
            hit = key == wanted
            if left is None:
                row[hit] = self.slot_row[some[hit]]
                left = np.flatnonzero(~hit & (key != none))
            else:
                row[left[hit]] = self.slot_row[some[hit]]
                left = left[~hit & (key != none)]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) % len(self.slot_key)
        cost = self.cost[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            kinds, where = np.unique(g[new], return_inverse=True)
            cost[new] = self.lengths(kinds)[where]
        return np.add.reduceat(cost, starts, axis=0, dtype=np.float64)


def held_out(key: str) -> F.Column:
    """Rows that are not learned from: the checksum of the id leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[Model]:
    """Models of all languages in ``lang``, in the order of their names, from rows that are not held out."""
    rows = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & ~held_out(key) & (F.octet_length(text) > 0))
    long = F.octet_length(text) > TRAIN_BYTES
    piece = F.when(long, F.substring(text, 1, TRAIN_BYTES // 4)).otherwise(F.col(text))  # a character has at most 4 bytes
    rows = rows.select(F.col(key).cast("string").alias("id"), piece.alias("text"), long.alias("long"), F.col(lang).cast("string").alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).collect()
    sizes = sorted(sizes, key=lambda r: r["lang"])
    return [_trained(rows, sizes[i : i + LANGUAGES]) for i in range(0, len(sizes), LANGUAGES)]


def _trained(rows: DataFrame, sizes: list) -> Model:
    """A model of the languages in ``sizes``."""
    names = [r["lang"] for r in sizes]
    share = F.lit(False)
    number = F.lit(-1)
    for i, r in enumerate(sizes):
        part = lambda want, there: min(1 << 30, int(want / max(1, there) * (1 << 30)))
        mine = F.col("lang") == r["lang"]
        most = F.when(F.col("long"), part(max(0, TRAIN_ROWS - r["short"]), r["long"])).otherwise(part(TRAIN_ROWS, r["short"]))
        share = share | (mine & (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < most))
        number = F.when(mine, i).otherwise(number)

    def count(batches):
        for part in chunks(batches):
            number_ = part.column("number").to_numpy()
            for k in np.unique(number_):
                g, n = np.unique(grams([t.encode() for t in part.filter(pa.array(number_ == k)).column("text").to_pylist()])[0], return_counts=True)
                columns = [pa.array(np.full(len(g), k, np.int32)), pa.array(g.astype(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "gram", "n"])

    some = rows.filter(share).select("text", number.alias("number")).mapInArrow(count, "number int, gram long, n long")
    found = some.groupBy("number", "gram").agg(F.sum("n").alias("n")).toArrow()
    seen, where = np.unique(found.column("gram").to_numpy().astype(np.uint64), return_inverse=True)
    counts = np.zeros((len(seen), len(names)))
    counts[where, found.column("number").to_numpy()] = found.column("n").to_numpy()
    return Model(names, seen, counts)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred``, ``score`` and ``bits_per_byte`` of the best language's code.

    Columns of these names are replaced. Runs jobs when called (training).
    """
    models = train(docs, key, text, lang)
    own = docs.drop("held_out", "lang_pred", "score", "bits_per_byte").withColumn("held_out", held_out(key))
    if not models:
        return own.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    # the tables are laid out on the worker: what is broadcast is the bounded count table alone
    shared = docs.sparkSession.sparkContext.broadcast([(m.languages, m.gram[ORDER], m.count[ORDER].astype(np.int32)) for m in models])
    names, name = own.columns, uuid.uuid4().hex
    letters = unused("_letters", names)

    def run(batches):
        trees = _models_of(name, shared)
        languages = [x for t in trees for x in t.languages]
        for part in chunks(batches, text, CHUNK_BYTES):
            raw = [(t or "").encode() for t in part.column(text).to_pylist()]
            pred, score, rate = [UNKNOWN] * len(raw), [0.0] * len(raw), [None] * len(raw)
            full = [i for i, t in enumerate(raw) if t]
            if full:
                bits = np.concatenate([t.bits([raw[i] for i in full]) for t in trees], 1)
                best = bits.argmin(1)
                least = bits[np.arange(len(full)), best]
                chance = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
                lettered = part.column(letters).to_pylist()
                for i, b, c, n in zip(full, best, chance, least):
                    rate[i] = float(n) / len(raw[i])
                    if lettered[i]:
                        pred[i], score[i] = languages[b], float(c)
            columns = [part.column(n) for n in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "bits_per_byte"])

    from pyspark.sql import types as T

    added = T.StructType.fromDDL("lang_pred string, score double, bits_per_byte double")
    return own.withColumn(letters, F.col(text).rlike(r"\p{L}")).mapInArrow(run, T.StructType(list(own.schema) + list(added)))


_models: dict = {}


def _models_of(name: str, shared) -> list[Model]:
    """The broadcast models, laid out once for each worker process."""
    worker.keeps("language", _models.clear)
    if name not in _models:
        _models.clear()
        _models[name] = [Model(*x) for x in shared.value]
    return _models[name]
