"""Near-duplicate texts by SetSketch registers.

A text's set holds the hashes of its distinct runs of five words (a shorter text's whole sequence is
its only run). Each of ``REGISTERS`` registers holds the exponentially spaced, truncated minimum of
the set's hashes under one hash function: floor(1 - log_base(minimum of exponential values)). The
registers of a union are the greater of both, so sketches merge; equal registers are the more likely
the more alike two sets are. Bands of registers give candidate buckets. Candidates are estimated
jointly by the likelihood of their greater, lesser and equal registers given both set sizes, and what
is not clearly below the threshold is verified on the full sets.

Equal sets are one node. A first pass over a few bands compares each node with the smallest one that it
shares a bucket with; linked ones form components. Links within a component change nothing, so from
then on only buckets that hold several components are looked at: first all of a bucket against one of
its nodes, another one in each bucket, so that near copies of one text meet many of each other; then, in
blocks, everything that is not in a bucket's largest component against all of it. So near copies cost
about one comparison each, yet no link between components is lost to a cap.

Null and blank texts have an empty set and no links. Rows with the same id are one node. Rows without
id are never linked; they are kept, with a null component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written
from bizdiag.llm import words as W
from bizdiag.llm.batches import chunks, groups
from bizdiag.llm.components import components

WORDS = 5
BANDS, BAND = 32, 5
#: Bands of the first pass, which finds most links.
FIRST_BANDS = 8
REGISTERS = BANDS * BAND
BASE, RATE = 1.2, 20.0
#: A pair at the threshold is estimated this far below it about once in 100,000 times.
SLACK = 0.15
BLOCK = 256
#: Texts that are sketched or verified at once, and rows that are verified beside one copy of their hub's text.
CHUNK_BYTES = 512 << 10
GROUP = 256
#: Bits of the table that keeps texts out of a shuffle which no pair asks for: 64 a row, so at most 65,536 rows.
BITS = 1 << 22

_rng = np.random.default_rng(20_240_229)
_FACTOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the set of a text; A-Z count as a-z."""
    found = (text or "").encode().lower().split()
    return np.unique(W.grams(W.hashes([found]), min(WORDS, len(found)), len(found) if len(found) < WORDS else 0)) if found else np.zeros(0, np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set; no set may be empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    least, held = np.empty((REGISTERS, len(sets)), np.uint64), np.empty_like(every)
    for k in range(REGISTERS):
        np.multiply(every, _FACTOR[k], out=held)
        held += _OFFSET[k]
        least[k] = np.minimum.reduceat(held, starts)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The most likely similarity (in hundredths' steps) of each pair of register rows, given both set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (size_a / (size_a + size_b))[:, None]
    v, grid = 1 - u, np.linspace(0, 1, 101)[None, :]
    chance = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(u - v * grid), chance(v - u * grid)
    value = more * np.log(up) + less * np.log(down) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, 1e-12))
    value = np.where(grid <= np.minimum(u / v, v / u) + 1e-9, value, -np.inf)
    return value.argmax(1) / 100


def band_keys(regs: np.ndarray) -> np.ndarray:
    """The bucket of each band: the band's number and its registers' bytes."""
    bands = regs.reshape(len(regs), BANDS, BAND).astype(np.int64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.int64), bands.shape[:2]).copy()
    for k in range(BAND):
        key = key << 8 | bands[:, :, k]
    return key


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, print, regs) of every row: size of the set, its fingerprint and registers (null if empty)."""

    def run(batches):
        for part in chunks(batches, most=CHUNK_BYTES):
            sets = [shingles(t) for t in part.column("text").to_pylist()]
            prints, regs, full = [None] * len(sets), [None] * len(sets), [i for i, s in enumerate(sets) if len(s)]
            if full:
                for i, r in zip(full, registers([sets[i] for i in full])):
                    prints[i], regs[i] = hashlib.md5(sets[i].tobytes()).digest(), r.tobytes()
            columns = [part.column("id"), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "print", "regs"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, print binary, regs binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _likely(a, b, na, nb, percent: int) -> np.ndarray:
    """Which pairs may reach the threshold."""
    out = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    some = np.flatnonzero(out)
    if len(some):
        out[some] = estimate(a[some], b[some], na[some], nb[some]) >= percent / 100 - SLACK
    return out


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches leave in question."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))

    def run(batches):
        for p in batches:
            if p.num_rows:
                sizes = [p.column(c).to_numpy() for c in ("n_a", "n_b")]
                ok = _likely(_matrix(p.column("regs_a")), _matrix(p.column("regs_b")), *sizes, percent)
                yield p.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _asked_for(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` without most of those whose ``id`` is not among ``ids``, by a bit table that is broadcast.

    Its size is fixed; the more ids there are, the more other texts pass, which the join that follows drops.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.lit(41), c), F.lit(BITS))
    word, bit = F.shiftright(slot("id"), 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(41, id), {BITS}) & 63 as int))")
    table = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    passed = texts.withColumn("word", word).join(F.broadcast(table), "word").filter(F.col("bits").bitwiseAND(bit) != 0)
    return passed.select(texts.columns)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    Pairs are dealt into groups of about ``GROUP`` of one ``a``, whose text is sent once to each group, so that a hub
    of most pairs is many groups.
    """
    pairs = written(pairs)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    leads = dealt.groupBy("a", "part").count().select("a", "part", F.lit(None).cast("long").alias("b"))
    wanted = leads.unionByName(dealt).withColumn("id", F.coalesce("b", "a"))
    rows = wanted.join(_asked_for(texts, wanted.select("id")), "id").select("a", "part", "b", "text")

    def run(batches):
        at, held = None, []  # a hub has several texts if rows repeat its id
        for p in chunks(batches, most=CHUNK_BYTES):
            found = []
            for a, part, b, text in zip(*(c.to_pylist() for c in p.columns)):
                if (a, part) != at:
                    at, held = (a, part), []
                own = shingles(text)
                if b is None:  # comes first in its group
                    held.append(own)
                    continue
                for lead in held:
                    both = len(np.intersect1d(lead, own, assume_unique=True))
                    if 100 * both >= percent * (len(lead) + len(own) - both):
                        found.append((a, b))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _relabelled(rows: DataFrame, found: DataFrame, column: str, into: str) -> DataFrame:
    """``into``: the component of ``column``, or itself."""
    named = found.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return rows.join(named, F.col(column) == F.col("_id"), "left").withColumn(into, F.coalesce("_component", column)).drop("_id", "_component")


def _added(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) of the components that ``found`` and ``links`` make together: stars, and links between their centres."""
    moved = _relabelled(_relabelled(links, found, "a", "ca"), found, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return moved.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))


def _bucketed(nodes: DataFrame, bands: int) -> DataFrame:
    """(key, id, comp): each node in the buckets of its first ``bands`` bands."""

    def run(batches):
        for p in batches:
            if p.num_rows:
                keys = band_keys(_matrix(p.column("regs")))[:, :bands]
                own = [pa.array(np.repeat(p.column(c).to_numpy(), bands)) for c in ("id", "comp")]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *own], names=["key", "id", "comp"])

    return nodes.select("id", "comp", "regs").mapInArrow(run, "key long, id long, comp long")


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, hub): buckets that hold several components, and one of their nodes, another one in each bucket."""
    hub = F.min_by("id", F.xxhash64("key", "id"))
    sides = rows.groupBy("key").agg(hub.alias("hub"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    return sides.filter("x <> y").select("key", "hub")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, comp) of buckets that hold several components, with ``own``, their block, and the numbers of blocks.

    A bucket's largest component is dealt into ``mains`` blocks, all else into ``lefts``, numbered before them.
    """
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sides = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("size")).filter("size > most")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sides = sides.select("key", "main", blocks(F.col("size") - F.col("most")).alias("lefts"), blocks(F.col("most")).alias("mains"))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    own = F.when(F.col("comp") == F.col("main"), F.col("lefts") + spread("mains")).otherwise(spread("lefts"))
    return rows.join(sides, "key").select("key", "id", "comp", own.alias("own"), "lefts", "mains")


def _blocks(dealt: DataFrame) -> DataFrame:
    """Dealt rows, once for each pair (i, j) of blocks that they are to meet in; any two components meet in one of them.

    Nothing is compared inside the largest component, so its rows only meet the blocks of the others.
    """
    last = F.when(F.col("own") < F.col("lefts"), F.col("lefts") + F.col("mains")).otherwise(F.col("lefts")) - 1
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return both.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("lefts", "mains", "other")


def _in_question(dealt: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, own, id, comp): rows of blocks that have a likely partner of another component there.

    dealt: with n and regs of each row. A pair counts in the bucket of the first band that it shares.
    """
    ready = _blocks(dealt).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def run(batches):
        for block in groups(batches, ["key", "i", "j"]):
            ids, comp, n, own = (block.column(c).to_numpy() for c in ("id", "comp", "n", "own"))
            if len(ids) < 2 or (comp == comp[0]).all():
                continue
            regs, band = _matrix(block.column("regs")), block.column("key")[0].as_py() >> 8 * BAND
            within = block.column("i")[0] == block.column("j")[0]
            wanted = np.zeros(len(ids), bool)
            for x in range(len(ids) - 1):
                y = np.arange(x + 1, len(ids))
                y = y[(comp[y] != comp[x]) & (within | (own[y] != own[x]))]
                same = regs[y] == regs[x]
                ok = same.sum(1) > REGISTERS // 2  # far below any pair in question
                y, same = y[ok], same[ok]
                y = y[same.reshape(-1, BANDS, BAND).all(2).argmax(1) == band]
                if len(y):
                    k = np.full(len(y), x)
                    y = y[_likely(regs[k], regs[y], n[k], n[y], percent)]
                    wanted[y] = True
                    wanted[x] |= len(y) > 0
            if wanted.any():
                yield block.select(["key", "i", "j", "own", "id", "comp"]).filter(pa.array(wanted)).to_batches()[0]

    return ready.mapInArrow(run, "key long, i int, j int, own int, id long, comp long")


def _short_sets(texts: DataFrame) -> DataFrame:
    """(id, n, short): the set's size, and its hashes cut to 32 bits."""

    def run(batches):
        for p in chunks(batches, most=CHUNK_BYTES):
            sets = [shingles(t) for t in p.column("text").to_pylist()]
            short = [np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([p.column("id"), pa.array(map(len, sets), pa.int64()), pa.array(short, pa.binary())], names=["id", "n", "short"])

    return texts.mapInArrow(run, "id long, n long, short binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of their incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    at = place[column]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, len(shared), 4_096):
        part = (at >= start) & (at < start + 4_096)
        table = np.zeros((len(sets), min(4_096, len(shared) - start)), np.float32)
        table[owner[part], at[part] - start] = 1
        out += table @ table.T
    return out.astype(np.int64)


def joining(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of a block that are to be verified: a spanning forest of the sure ones, and all that are in doubt between its trees.

    ``sets`` are cut to 32 bits. Hashes of a set that became one are added to the overlap, so no pair is missed.
    A pair is sure if it also passes without the hashes that different shingles can share by chance (more
    happens less than once in 10^11 pairs); a pair in doubt takes no other's place.
    """
    lost = n - np.array([len(x) for x in sets])
    both = overlaps(sets)
    order = comp[:, None] < comp[None, :]
    reached = lambda k: 100 * k >= percent * (n[:, None] + n[None, :] - k)
    chance = n[:, None] * (n[None, :] / 2.0**32)
    by_chance = np.where(chance < 1e-6, 1, np.where(chance < 1e-4, 2, np.ceil(chance + 10 * np.sqrt(chance) + 4)))
    possible = reached(both + np.minimum(lost[:, None], lost[None, :])) & order
    sure = reached(both - by_chance) & possible
    parent: dict[int, int] = {}

    def root(c):
        while c in parent:
            c = parent[c]
        return c

    x, y = np.nonzero(sure)
    _, first = np.unique(np.stack([comp[x], comp[y]], 1), axis=0, return_index=True)
    pairs = []
    for k in first:
        p, q = root(int(comp[x[k]])), root(int(comp[y[k]]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            pairs.append((int(ids[x[k]]), int(ids[y[k]])))
    tree = np.array([root(int(c)) for c in comp])
    x, y = np.nonzero(possible & ~sure & (tree[:, None] != tree[None, :]))
    return pairs + list(zip(ids[x].tolist(), ids[y].tolist()))


def _across(dealt: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that join components of the same bucket: of all that reach the threshold, a spanning forest of each block, and those in doubt.

    Nothing is emitted for each sure pair: blocks get the sets of their rows and compare them on the spot, by
    32 bits of each hash and so that no pair is missed. What they find is yet to be verified.
    """
    wanted = written(_in_question(dealt, percent))
    ids = wanted.select("id").distinct()
    sets = _short_sets(_asked_for(texts, ids).join(ids, "id"))
    ready = wanted.join(sets, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def run(batches):
        for block in groups(batches, ["key", "i", "j"]):
            ids, comp, n = (block.column(c).to_numpy() for c in ("id", "comp", "n"))
            sets_ = [np.frombuffer(x, "<u4") for x in block.column("short").to_pylist()]
            pairs = joining(ids, comp, n, sets_, percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])

    return ready.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Rows are linked where 100 * intersection >= ``percent`` * union of their sets (``percent`` 75 or
    more); ``component_id`` is the smallest id reachable. Runs jobs when called.
    """
    every = written(sketches(docs, key, text))
    known = every.filter("id is not null and print is not null")
    classes = written(known.groupBy("print").agg(F.min("id").alias("rep")))
    # rows of one id with several sets: their classes are one component
    members = known.select("id", "print").join(classes, "print").select("id", "rep")
    shared = members.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).filter("b <> top").select("id", "b")
    same = members.join(shared, "id").filter("rep <> b").select(F.col("rep").alias("a"), "b")
    nodes = written(known.join(classes, "print").filter("id = rep").groupBy("print").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")).select("id", "n", "regs"))

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    if known.groupBy("id").count().filter("count > 1").limit(1).count():
        texts = texts.distinct()  # else rows that repeat an id would meet each other's repeats

    # a few bands: each node against the smallest one that it shares a bucket with
    rows = _bucketed(nodes.withColumn("comp", F.col("id")), FIRST_BANDS)
    full = rows.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1").select("key", "hub")
    pairs = rows.join(full, "key").filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = _estimated(pairs, nodes, percent).groupBy("b").agg(F.min("a").alias("a"))
    found = components(_verified(first.select("a", "b"), texts, percent).unionByName(same))

    # all bands, but only buckets that hold several components: each node against one there
    rows = _bucketed(_relabelled(nodes, found, "id", "comp"), BANDS)
    open_rows = written(rows.join(_mixed(rows), "key"))
    pairs = open_rows.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = _relabelled(_relabelled(pairs, found, "a", "ca"), found, "b", "cb").filter("ca <> cb").select("a", "b")
    found = components(_added(_verified(_estimated(pairs, nodes, percent), texts, percent), found))

    # buckets that still hold several: everything across their components
    rows = _relabelled(open_rows.select("key", "id"), found, "id", "comp")
    dealt = written(_dealt(rows)).join(nodes, "id")
    found = components(_added(_verified(_across(dealt, texts, percent), texts, percent), found))

    labelled = _relabelled(every.join(classes, "print", "left"), found, "rep", "component")
    component = F.when(F.col("print").isNull(), F.col("id")).otherwise(F.col("component"))
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(component)
    return labelled.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
