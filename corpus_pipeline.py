"""Corpus pipeline: language, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. Stages are independent of each other: each judges all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written
from bizdiag.llm import bpe, language, mixing, near_text, passages
from bizdiag.llm.batches import unused

#: A text that every learned language codes in more bits a byte than this is in none of them. Plain
#: text of a learned language takes 2 to 3, and short text that is mostly a key or a token up to 8.
FOREIGN_BITS = 12.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null, letterless and foreign texts go."""
    found = language.identify(docs)
    keep = (F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") < FOREIGN_BITS)
    return found.filter(keep).select(docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` with an id that ``gone`` does not list.

    Most rows that stay are told by a bit table of ``gone`` (broadcast, at most 65,536 rows) and go into no
    shuffle. Of the others, ids alone tell the few that only share a bit with a removed one; texts meet just these.
    """
    word, bits = (unused(n, docs.columns) for n in ("_word", "_bits"))
    slot = F.pmod(F.xxhash64(F.lit(43), F.col("doc_id").cast("long")), F.lit(near_text.BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    table = gone.select(F.shiftright(slot, 6).alias(word), bit.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    rows = docs.filter("doc_id is not null").withColumn(word, F.shiftright(slot, 6))
    marked = rows.join(F.broadcast(table), word, "left")
    listed = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    by_chance = written(marked.filter(listed).select("doc_id").join(gone, "doc_id", "left_anti").distinct())
    found = marked.filter(listed).select(docs.columns).join(by_chance, "doc_id", "left_semi")
    return marked.filter(~listed).select(docs.columns).unionByName(found.select(docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; rows without id all stay.

    Of rows that repeat an id one stays, by a hash of the text.
    """
    found = near_text.near_duplicates(docs)
    each = found.filter("doc_id is not null").groupBy("doc_id")
    ids = written(each.agg(F.bool_or("kept").alias("stays"), F.count_if("kept").alias("copies")))
    kept = _without(docs, ids.filter("not stays").select("doc_id"))
    if ids.filter("copies > 1").limit(1).count():
        row = F.struct(*[F.col(c) for c in docs.columns])
        first = F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns)))  # the same row in every run
        kept = kept.groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return kept.unionByName(docs.filter("doc_id is null")).select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those left without a word go."""
    out = passages.without_repeats(docs).filter(F.col("text").rlike(r"[^ \t-\r]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.mix(docs).orderBy("position").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("near_text", one_of_each_group),
    ("passages", without_repeats),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Trained models, hashing and merges are not SQL; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
