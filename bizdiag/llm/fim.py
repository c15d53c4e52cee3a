"""Fill-in-middle: texts cut into prefix, middle and suffix at line ends, in one of two orders.

A text is matched once, as a whole, against a repeated group of units (lines). The ``regex`` library
keeps every repetition of a group, so ``ends(1)`` of that one match gives the number of units and the
place of both cuts; nothing is iterated over. Units and offsets are of code points.

What is drawn depends on the seed and the id alone: h1 to h4 are the first four groups of eight digits of
the SHA-256 of ``<seed>:<id>``. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units,
the middle after the larger, the suffix is the rest. h3 decides whether a text is transformed at all and h4
its form:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is; also for empty texts and texts that contain a mark

Null text counts as empty. A null id is drawn for as if its digits were none. Rows that repeat an id and a
text get the same result. A mark never overlaps another one, so the first mark after the leading one ends
its part, and the text can be put together again from output and form alone.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from bizdiag.llm.batches import chunks

UNITS = r"([^\n]*\n|[^\n]+)*"
#: Fixed marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_COLUMNS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}


@lru_cache(maxsize=8)
def _pattern(units: str):
    return regex.compile(units)


def draws(seed: int, key) -> tuple[int, int, int, int]:
    """The four numbers that belong to an id."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[8 * k : 8 * k + 8], 16) for k in range(4))


def transform(text: str, key, seed: int = 7, rate: int = 100, spm: int = 50, units: str = UNITS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, length of the prefix, length of the middle, output) of one text.

    ``rate``: how many of 100 texts are transformed; ``spm``: how many of 100 transformed ones are ``spm``.
    """
    found = _pattern(units).fullmatch(text)
    if found is None:
        raise ValueError("the units do not cover the text")
    ends = found.ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == PLAIN:
        return output
    lead, other = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(lead).split(other, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == PSM else (two, one)
    return prefix + middle + suffix


def _mapped(docs: DataFrame, key: str, text: str, seed: int, rate: int, spm: int, units: str, added: dict[str, str], finish) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    columns = _COLUMNS | added

    def run(batches):
        for part in chunks(batches):
            keys, texts = part.column("key").to_pylist(), part.column("text").to_pylist()
            rows = [transform(t or "", k, seed, rate, spm, units) for k, t in zip(keys, texts)]
            rows = [(*row[:4], *finish(row[4], row[1])) for row in rows]
            values = list(zip(*rows)) or [()] * len(columns)
            kinds = {"long": pa.int64(), "string": pa.string()}
            arrays = [pa.array(v, kinds[k]) for v, k in zip(values, columns.values())]
            yield pa.RecordBatch.from_arrays([part.column("key"), *arrays], names=["key", *columns])

    schema = ", ".join(f"{name} {k}" for name, k in columns.items())
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, {schema}")
    return out.withColumnRenamed("key", key)


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, key: str = "doc_id", text: str = "text", units: str = UNITS
) -> DataFrame:
    """``key``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output`` of every row."""
    return _mapped(docs, key, text, seed, rate, spm, units, {"output": "string"}, lambda output, form: (output,))


def restore(rows: DataFrame, form: str = "form", output: str = "output", into: str = "restored") -> DataFrame:
    """``rows`` with the text that each output was made from; null where form or output is null."""
    names = {c: f"c{k}" for k, c in enumerate(rows.columns)}

    def run(batches):
        for part in chunks(batches, names[output]):
            both = zip(part.column(names[output]).to_pylist(), part.column(names[form]).to_pylist())
            found = pa.array([None if o is None or f is None else restored(o, f) for o, f in both], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "found"])

    plain = rows.toDF(*names.values())
    schema = StructType([*[StructField(f.name, f.dataType) for f in plain.schema], StructField("found", StringType())])
    kept = [c for c in rows.columns if c != into]
    out = plain.mapInArrow(run, schema)
    return out.select(*[out[names[c]].alias(c) for c in kept], out["found"].alias(into))


def digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``fill_in_middle``, with SHA-256 of the output and of the text restored from it, so that texts never leave the task."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    finish = lambda output, form: (sha(output), sha(restored(output, form)))
    return _mapped(docs, key, text, seed, rate, spm, UNITS, {"output_sha256": "string", "restored_sha256": "string"}, finish)
