"""Language, near-duplicates, passages, mixing and the pipeline against brute force."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction
from math import ceil, floor, log2

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bizdiag.functions.lineage import written
from bizdiag.llm import components, language, mixing, near_text, passages, queries
from bizdiag.llm import words as W

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, component int, rep string, ranges string"
#: Names that operators use inside.
SCHEMA += "".join(f", {c} int" for c in "g s first next start share period slots k b a key row _n _b _g _letters _cell _at _doc _mark _ranges _copies n regs comp".split())


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, 2, "x", "y", *[3] * (SCHEMA.count(",") - 8)) for i, t, lang, s in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, odd texts, ties and repeated ids."""
    rng = random.Random(5)
    rows, base = [], [prose(rng, rng.randrange(30, 160)) for _ in range(40)]
    for k, words in enumerate(base):
        rows.append((k, " ".join(words)))
    shared = prose(rng, 40)
    for k in range(40, 160):
        words = list(rng.choice(base))
        if k % 3 == 0:
            words[rng.randrange(len(words))] = "CHANGED"
        if k % 3 == 1:
            words += prose(rng, rng.randrange(1, 60))
        if k % 5 == 0:
            words[3:3] = shared
        rows.append((k, ("\n" if k % 2 else " ").join(words).upper() if k % 7 == 0 else " ".join(words)))
    hot = prose(rng, 60)
    for k in range(160, 260):  # many near copies of one text
        words = list(hot)
        words[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(words)))
    odd = [None, "", " \t\n", "one", "ONE", "two words", "a b c d e", "A B C D E", "a b c d e f", "é à ü", "x" * 20_000, " ".join(["same"] * 300), " ".join(["same"] * 200)]
    rows += [(300 + k, t) for k, t in enumerate(odd)]
    rows += [(5, rows[5][1]), (6, "quite another text under an id that is taken already"), (None, rows[0][1]), (None, None)]
    return [(i, t, "en" if t else None, f"s{(i or 0) % 3}") for i, t in rows]


def text_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [(i, text_set(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def test_near_duplicates(spark, corpus):
    got = near_text.near_duplicates(frame(spark, corpus)).collect()
    want = brute_components(corpus)
    expected = sorted(((i, len(text_set(t)), want.get(i), i is None or want[i] == i) for i, t, *_ in corpus), key=str)
    assert sorted((tuple(r) for r in got), key=str) == expected
    assert near_text.near_duplicates(frame(spark, corpus).limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 16])
def test_buckets_are_compared_across_components(spark, monkeypatch, corpus, block):
    """What a block finds joins the same components as all pairs that reach the threshold."""
    monkeypatch.setattr(near_text, "BLOCK", block)
    rows = [r for r in corpus if r[0] is not None and r[0] >= 160 and text_set(r[1])]
    sets = [near_text.shingles(t) for _, t, *_ in rows]
    regs = near_text.registers(sets)
    keys = near_text.band_keys(regs)
    data = [(int(k), r[0], r[0], len(s), bytearray(x.tobytes())) for r, s, x, own in zip(rows, sets, regs, keys) for k in own]
    df = spark.createDataFrame(data, "key long, id long, comp long, n long, regs binary")
    texts = spark.createDataFrame([r[:2] for r in rows], "id long, text string")
    dealt = near_text._dealt(df.select("key", "id", "comp")).join(df.select("id", "n", "regs").distinct(), "id")
    links = [tuple(r) for r in near_text._across(dealt, texts, 75).collect()]
    full = {r[0]: text_set(r[1]) for r in rows}
    assert all(100 * len(full[a] & full[b]) >= 75 * len(full[a] | full[b]) for a, b in links)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == c for i, c in brute_components(rows).items())


def test_near_copies_that_do_not_link(spark, monkeypatch):
    """A large group whose members are alike, but mostly not by 0.75, beside pairs just above it."""
    rng = random.Random(9)
    base, rows = prose(rng, 120, 5_000), []
    for k in range(240):
        words = list(base)
        for at in rng.sample(range(120), 6):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words), "en", "s"))
    for k in range(0, 60, 3):  # 116 shingles, 16 of them others: 100 / 132
        words = rows[k][1].split()
        for at in (4, 30, 60):
            words[at] = f"y{k}_{at}"
        rows.append((1_000 + k, " ".join(words), "en", "s"))
    monkeypatch.setattr(near_text, "BLOCK", 32)
    monkeypatch.setattr(near_text, "GROUP", 8)
    want = brute_components([r for r in rows])
    got = {r.doc_id: r.component_id for r in near_text.near_duplicates(frame(spark, rows)).collect()}
    assert got == {r[0]: want.get(r[0], r[0]) for r in rows}
    assert len(set(got.values())) > 20


def test_blocks_meet_once(spark, monkeypatch):
    """Any two rows of different components meet in one pair of blocks; the largest component's rows are not compared with each other."""
    monkeypatch.setattr(near_text, "BLOCK", 8)
    rows = [(7, i, 0 if i < 60 else i) for i in range(90)]
    dealt = near_text._blocks(near_text._dealt(spark.createDataFrame(rows, "key long, id long, comp long"))).collect()
    met = defaultdict(int)
    cells = defaultdict(list)
    for r in dealt:
        cells[r.i, r.j].append(r)
    for (i, j), held in cells.items():
        for x in held:
            for y in held:
                if x.id < y.id and x.comp != y.comp and (i == j or x.own != y.own):
                    met[x.id, y.id] += 1
    assert met == {(a, b): 1 for a in range(90) for b in range(max(60, a + 1), 90)}
    assert len(dealt) == 60 * 4 + 30 * (4 + 8)


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9_000, n)).astype(np.uint32) for n in (5, 6_000, 5_000, 1, 7_000)]
    got = near_text.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3_000, dtype=np.uint64)
    a, b, both = x[:2_000], x[500:], x
    regs = near_text.registers([a, b, both])
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    found = near_text.estimate(regs[:1], regs[1:2], np.array([2_000]), np.array([2_500]))[0]
    assert abs(found - 0.5) < 0.12


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 99), (99, 101), (7, 7), (200, 200)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and got[100] == got[101] == 99
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "written", lambda df: tables.append(0) or written(df))
    stars = [(1, k) for k in range(10, 20)] + [(k, 2) for k in range(30, 40)] + [(5, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {k: 1 if k < 20 else 2 for k in [*range(10, 20), *range(30, 40)]} and len(tables) == 1
    # links between members of known stars take one round that joins the centres, whatever members they name
    more, found = spark.createDataFrame([(15, 35), (39, 60)], "a long, b long"), spark.createDataFrame(list(got.items()), "id long, component long")
    got = {r.id: r.component for r in components.components(near_text._added(more, found)).collect()}
    assert got == {k: 1 for k in [2, *range(10, 20), *range(30, 40), 60]} and len(tables) <= 4


def brute_passages(rows):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (t or "").encode().split()
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k : k + 13]), i)
    out = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - 12):
            if i is not None and first[tuple(words[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_passages_let_go_of_what_other_operators_keep_in_a_worker():
    import numpy as np
    import pyarrow as pa
    import zstandard

    from bizdiag.llm import words

    text = " ".join(map(str, range(40)))
    part = pa.record_batch([pa.array([1, 2, None]), pa.array([0, 0, 0], pa.int32()), pa.array([text, None, text])], names=["doc", "mark", "text"])
    packer, frequent = zstandard.ZstdCompressor(), np.zeros(1 << passages._BITS, bool)
    words.hashes([[b"kept"]])
    blobs = [row[4] for row in passages.pack(part, 4, frequent, packer)]
    assert not words._cache
    words.hashes([[b"kept"]])
    windows = [passages.unpack(zstandard.ZstdDecompressor().decompress(b)) for b in blobs]
    assert not words._cache
    assert sorted(at for w in windows for at in w[4]) == list(range(40 - passages.WINDOW + 1))


def test_passages(spark, corpus):
    df = frame(spark, corpus)
    want = brute_passages(corpus)
    assert sorted((tuple(r) for r in passages.digests(df.repartition(5)).collect()), key=str) == want
    assert sum(r[2] for r in want) > 1_000
    cut = passages.without_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(corpus)
    assert passages.digests(df.limit(0)).count() == 0


def test_words_are_hashed_alike_wherever_they_lie():
    found = [b"", b"a", b"\0", b"b" * 7, b"b" * 8, b"b" * 9, b"b" * 63, b"b" * 64, b"b" * 65, b"b" * 5_000, b"b" * 4_999 + b"c", "ä中".encode(), b"\xff" * 8]
    found += [b"w%d" % i for i in range(5_000)]
    hashes = {}
    for order in (found, found[::-1]):
        text, stop = b" ".join(order), np.cumsum([len(w) + 1 for w in order]) - 1
        start = stop - [len(w) for w in order]
        for w, h in zip(order, W.spans(text, start, stop).tolist()):
            assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(found)


def test_frequent_runs_do_not_change_the_result(spark, corpus, monkeypatch):
    monkeypatch.setattr(passages, "FREQUENT", 1)
    monkeypatch.setattr(passages, "HELD", 10)
    monkeypatch.setattr(W, "CACHE_WORDS", 10)
    assert sorted((tuple(r) for r in passages.digests(frame(spark, corpus)).collect()), key=str) == brute_passages(corpus)


def plain_length(model, history: bytes, symbol: int, k: int) -> float:
    """Code length of one byte by the definition: escapes down the contexts, with exclusion."""
    count = defaultdict(lambda: defaultdict(int))
    for gram, n in zip(model.gram[language.ORDER].tolist(), model.count[language.ORDER][:, k].tolist()):
        raw = gram.to_bytes(language.ORDER + 1, "big")
        for order in range(language.ORDER + 1):
            if n:
                count[raw[language.ORDER - order : language.ORDER]][raw[-1]] += n
    ruled, bits = set(), 0.0
    for order in range(language.ORDER, -1, -1):
        here = {s: n for s, n in count[history[len(history) - order :] if order else b""].items() if s not in ruled}
        if not here:
            continue
        whole = sum(here.values()) + len(here)
        if symbol in here:
            return bits + log2(whole / here[symbol])
        bits += log2(whole / len(here))
        ruled |= set(here)
    return bits + log2(256 - len(ruled))


def test_code_lengths_are_exact():
    texts = {0: [b"the cat sat on the mat", b"a cat"], 1: [b"el gato y la gata", b""]}
    seen, counts = [], []
    for k, group in texts.items():
        g, n = np.unique(language.grams(group)[0], return_counts=True)
        seen.append(g)
        counts.append((k, g, n))
    every = np.unique(np.concatenate(seen))
    table = np.zeros((len(every), 2))
    for k, g, n in counts:
        table[np.searchsorted(every, g), k] = n
    model = language.Model(["en", "es"], every, table)
    for text in (b"the cat", b"gato", b"zq\xff the", b"t"):
        padded = bytes(language.ORDER) + text
        got = model.bits([text, b"cat"])[0]
        for k in range(2):
            want = sum(plain_length(model, padded[i : i + language.ORDER], padded[i + language.ORDER], k) for i in range(len(text)))
            assert got[k] == pytest.approx(want, rel=1e-5)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op1_language(spark, SF)
    right = out.join(docs, "doc_id").groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share"))
    assert out.count() == docs.count() and all(r.share > 0.97 for r in right.collect())


def test_language_of_odd_rows(spark, corpus):
    odd = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "12 34 !", None, "s"), (4, "hello world", "en", "s"), (None, "hello", "en", "s"), (4, "hello world", "en", None)]
    got = {r.doc_id: r for r in language.identify(frame(spark, odd)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[3].score == 0.0
    assert got[4].lang_pred == "en" and got[4].score == 1.0
    unlabelled = language.identify(frame(spark, [(1, "some text", None, "s")])).collect()
    assert unlabelled[0].lang_pred == "und" and language.identify(frame(spark, odd).limit(0)).count() == 0


def test_a_false_candidate_takes_no_true_links_place():
    """Rows 1 and 3 pass by 32 bits only, thanks to one shared by chance; rows 2 and 4 of the same components are a true link."""
    one, two = np.arange(100, dtype="<u4"), np.arange(1_000, 1_100, dtype="<u4")
    by_chance = np.r_[one[:86], np.arange(500, 514, dtype="<u4")]  # 86 of 114 shared by 32 bits: 85 of 115 are not enough
    args = np.array([1, 2, 3, 4]), np.array([1, 1, 3, 3]), np.array([100, 100, 100, 100])
    assert sorted(near_text.joining(*args, [one, two, by_chance, two], 75)) == [(2, 4)]
    near = np.r_[two[:86], np.arange(1_200, 1_214, dtype="<u4")]
    assert sorted(near_text.joining(*args, [one, two, by_chance, near], 75)) == [(1, 3), (2, 4)]


def test_language_leaves_no_class_out(spark, monkeypatch):
    """More languages than a model holds, and one that has only long texts."""
    rng = random.Random(9)
    letters = {f"l{k}": [chr(0x400 + 8 * k + j) for j in range(8)] for k in range(6)}
    write = lambda name, n: " ".join("".join(rng.choices(letters[name], k=4)) for _ in range(n))
    rows = [(100 * k + j, write(name, 30_000 if k == 4 else 20), name, "s") for k, name in enumerate(letters) for j in range(8 if k == 4 else 40)]
    rows += [(9_000 + k, write(name, 20), None, "s") for k, name in enumerate(letters)]
    one = {r.doc_id: r for r in language.identify(frame(spark, rows)).collect()}
    assert [one[9_000 + k].lang_pred for k in range(6)] == list(letters)
    monkeypatch.setattr(language, "LANGUAGES", 2)
    several = {r.doc_id: r for r in language.identify(frame(spark, rows)).collect()}
    assert {k: (r.lang_pred, round(r.bits_per_byte, 4)) for k, r in several.items()} == {k: (r.lang_pred, round(r.bits_per_byte, 4)) for k, r in one.items()}


def plain_schedule(shares, slots):
    """Earliest deadline first, slot by slot, without periods."""
    total, done, out = sum(shares), [0] * len(shares), []
    for t in range(slots):
        ready = [(-(-(done[i] + 1) * total // a), i) for i, a in enumerate(shares) if done[i] * total // a <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
        assert all(abs(d - a * (t + 1) / total) < 1 for d, a in zip(done, shares))
    return out


@pytest.mark.parametrize("shares", [[1], [3, 2, 1], [17, 1, 1, 5], [1, 1, 1]])
def test_period_is_the_slot_by_slot_schedule(shares):
    slots = mixing.period(shares)
    order = sorted((s, i) for i, x in enumerate(slots) for s in x)
    assert [i for _, i in order] * 2 == plain_schedule(shares, 2 * sum(shares))


def test_mix(spark):
    rows = [(k, "t", "en", None if k % 9 == 0 else f"s{min(k % 7, 3)}") for k in range(900)] + [(None, None, None, "s1"), (3, "t", "en", "s1")]
    df = frame(spark, rows)
    got = mixing.mix(df, {"s3": 5, "s1": 2}, block_rows=4).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert all(r.release <= r.slot < r.deadline for r in got)
    place = {(r.source, r.block): r.slot for r in got}
    blocks = defaultdict(int)
    for s, _ in place:
        blocks[s] += 1
    # one slot at a time, a new phase whenever a source ends
    share = {"s3": 5, "s1": 2}
    sizes = defaultdict(int)
    for _, _, _, s in rows:
        sizes[s] += 1
    names = sorted(sizes, key=lambda s: (-sizes[s], s is not None, s or ""))
    left, start, want, nexts = dict(blocks), 0, {}, defaultdict(int)
    while any(left.values()):
        active = [s for s in names if left[s]]
        for t, i in enumerate(plain_schedule([share.get(s, 1) for s in active], 3_000)):
            s = active[i]
            want[s, nexts[s]] = start + t
            nexts[s] += 1
            left[s] -= 1
            if not left[s]:
                start += t + 1
                break
    assert place == want
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df).count() == len(rows)


def test_mix_pools_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    got = mixing.mix(frame(spark, [(k, "t", "en", f"s{k % 5}") for k in range(200)]), block_rows=8).collect()
    assert sorted(r.position for r in got) == list(range(200))


def test_mix_keeps_the_weight_of_every_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 8)
    monkeypatch.setattr(mixing, "CELL_ROWS", 150)
    size = {**{f"s{k}": 30 + k for k in range(40)}, "heavy": 61, None: 47}
    share = {"heavy": 12, "s5": 3, None: 2}
    rows = [(None if s is None else k, "t", "en", s) for s in size for k in range(size[s])]
    got = mixing.mix(frame(spark, rows), share, block_rows=4).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    blocks = {s: -(-n // 4) for s, n in size.items()}
    place = {(r.source, r.block): r for r in got}
    assert sorted(r.slot for r in place.values()) == list(range(sum(blocks.values()))) and set(place) == {(s, k) for s, n in blocks.items() for k in range(n)}
    dealt = lambda v: sum(min(Fraction(n), share.get(s, 1) * v) for s, n in blocks.items())
    for (s, k), r in place.items():
        a = share.get(s, 1)
        assert (r.release, r.deadline) == (floor(dealt(Fraction(k, a))), ceil(dealt(Fraction(k + 1, a))))
        # a few slots beside the fluid schedule: of the heavy source, far less than a block of its own
        assert r.release - 4 <= r.slot < r.deadline + 4
    assert all(r.position // 4 <= r.slot for r in got)
    assert sorted(r.position for r in mixing.mix(frame(spark, rows), block_rows=4).collect()) == list(range(len(rows)))
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, rows), {"s3": 0})


def test_pipeline_keeps_what_brute_force_keeps(spark, corpus):
    docs = frame(spark, [(i, t, "en", s) for i, t, _, s in corpus]).select("doc_id", "text", "lang", "source", "n_chars")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, SF)
    assert known.columns == names
    kept = [(r.doc_id, r.text, r.lang, r.source) for r in known.collect()]
    judged = [(r.doc_id, r.text) for r in language.identify(docs).collect() if r.lang_pred != "und" and r.bits_per_byte < 12]
    assert sorted((r[:2] for r in kept), key=str) == sorted(judged, key=str) and len(kept) > 0.95 * len(corpus)
    one = stages["near_text"](spark, known, SF)
    want = brute_components(kept)
    got = [(r.doc_id, r.text) for r in one.collect()]
    assert one.columns == names and sorted(i for i, _ in got if i is not None) == sorted(i for i, c in want.items() if i == c)
    cut = stages["passages"](spark, one, SF)
    digests = [x for x in brute_passages(got) if x[1] > x[2]]
    words = [(r.doc_id, hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest(), r.n_chars == len(r.text)) for r in cut.collect()]
    assert cut.columns == names and sorted(words, key=str) == sorted(((i, h, True) for i, _, _, h in digests), key=str)
    mix = stages["mixing"](spark, cut, SF)
    assert mix.columns == names and mix.count() == len(words)
    out = stages["bpe"](spark, mix, SF).collect()
    assert len(out) == len(words) and all(r.exact for r in out)


def test_pipeline_runs_on_a_table(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count() + 1
