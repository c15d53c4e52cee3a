"""Chunk-reusing BPE against the library, whitening against numpy, fill-in-middle against its definition."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bizdiag.llm import chunk_bpe, fim, qd, queries, whitening

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = [
    None, "", " ", "one", "a" * 5_000, " " * 3_000 + "x", "\n" * 700, "foo  <|endoftext|>  bar" * 100, "x" * 130 + "<|endoftext|>" * 300,
    "it's we'll they're " * 200, "日本語テキスト" * 500, "é" * 3_000, "١٢٣ अनुवाद भाषा " * 200, "a" * 20_000 + " " + "b" * 10_000, "😀" * 900,
    "\r\n\t " * 800, "' re 's" * 300, "1234567890" * 400, "same text here", "same text here",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def jumbled(rng, n):
    kinds = [" ", "  ", "\n", "a", "the", "'re", "'", "é", "日", "<|endoftext|>", "<|endof", "text|>", "12", "!!", "\t", "word" * 9, " " * 17]
    return "".join(rng.choice(kinds) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1, "x") for i, t in enumerate(ODD)] + [(None, "no id\nbut lines\n", "clash", 1, "x"), (3, "one", "again", 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n int, form string")


def small_chunks(monkeypatch):
    for name, value in {"LEAST": 33, "MEAN": 48, "MOST": 90, "REACHES": (4, 24), "CACHE_PIECES": 50, "CACHE_CHUNKS": 20, "CACHE_JOINS": 10}.items():
        monkeypatch.setattr(chunk_bpe, name, value)


@pytest.mark.parametrize("small", [False, True])
def test_chunks_encode_as_the_whole_text(monkeypatch, small):
    if small:
        small_chunks(monkeypatch)
    rng, tok = random.Random(3), library()
    texts = [t or "" for t in ODD] + [jumbled(rng, rng.randrange(1, 900)) for _ in range(120)]
    texts += [t[5:] + t[:5] for t in texts]
    own = chunk_bpe.Codec(PATH, PATTERN)
    got = [ids for k in range(0, len(texts), 20) for ids in own.encode([t.encode() for t in texts[k : k + 20]])]
    want = tok.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]
    assert [own.decode(g) for g in got] == tok.decode_batch([w.ids for w in want], skip_special_tokens=False)
    odd = np.array([30, 188, 199, 50256, 1], "<u4")  # bytes that are no text
    assert own.decode(odd) == tok.decode(odd.tolist(), skip_special_tokens=False)


def test_shared_chunks_are_encoded_once():
    rng = random.Random(4)
    words = [f"w{rng.randrange(5_000)}" for _ in range(8_000)]
    text = " ".join(words)
    own = chunk_bpe.Codec(PATH, PATTERN)
    own.encode([text.encode()])
    before = own.made
    own.encode([text.encode()])
    assert own.made == before
    own.encode([f"another beginning {text}".encode()])
    assert own.made - before < 12  # the first chunk or two, and their joins
    parts = chunk_bpe.cuts(text.encode())
    assert parts[0] == 0 and parts[-1] == len(text) and all(b - a >= chunk_bpe.LEAST for a, b in zip(parts, parts[1:]))
    assert chunk_bpe.cuts(b"") == [0] and len(parts) > 10
    assert all(text.encode()[: c].decode(errors="strict") is not None for c in chunk_bpe.cuts(("é" * 9_000).encode()) for text in ["é" * 9_000])


def test_chunk_query_and_frame(spark, docs):
    tok = library()
    got = sorted((tuple(r) for r in chunk_bpe.encode_decode(docs, PATH, PATTERN).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), bytearray(np.array(ids, "<u4").tobytes()), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert chunk_bpe.encode_decode(docs.limit(0), PATH, PATTERN).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_chunk_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        chunk_bpe.Codec(public_tokenizers.path("word_bpe_49k.json"), PATTERN)


def _check_solver(r, count, close=1e-12):
    values, z = qd.leading(r, count)
    want = np.linalg.eigvalsh(r.T @ r)[::-1][:count]
    scale = max(want.max(initial=0.0), 1e-300)
    assert np.abs(values - want).max() <= close * scale
    some = values > 1e-20 * scale
    z = z[:, some]
    assert np.abs(z.T @ z - np.eye(z.shape[1])).max(initial=0.0) < 1e-11
    assert np.abs(r.T @ (r @ z) - z * values[some]).max(initial=0.0) <= 1e-12 * scale * len(r)


def test_qd_solver():
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    alike = [5.0] * 6 + [1.0] * 14
    near = [5, 5 - 1e-9, 5 - 2e-9, 5 - 1e-12, 5, 5] + [1.0] * 14
    wilkinson = np.diag([abs(k) + 12.0 for k in range(-10, 11)]) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    for r in (
        np.triu(rng.standard_normal((64, 64))), np.eye(8) * 3, np.diag(alike) @ turn, np.diag(near) @ turn, np.zeros((5, 5)), np.array([[3.0]]),
        np.diag(10.0 ** -np.arange(20)) @ turn, np.linalg.cholesky(wilkinson).T, np.outer(np.arange(9.0), np.ones(9)), 1e150 * np.triu(np.ones((4, 4))),
    ):
        _check_solver(r, 4)
    for _ in range(60):
        n = rng.integers(1, 12)
        _check_solver(rng.integers(0, 3, (n, n)).astype(float), 4)
    a, b, v = qd.bidiagonal(r := rng.standard_normal((30, 30)))
    assert np.abs(v.T @ v - np.eye(30)).max() < 1e-13
    assert np.allclose(np.sqrt(qd.dqds(a * a, b * b)), np.linalg.svd(r, compute_uv=False), rtol=1e-13)


def brute_whitening(x, rows, components=4):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = (rows - sums / n) @ vectors / np.sqrt(values)
    return n, ((n * rows - sums) ** 2).sum(1), white, values / np.trace(centred.T @ centred / n)


def check_whitening(got, ids, x):
    n, deviation, white, shares = brute_whitening(x, x)
    k = white.shape[1]
    assert len(got) == len(ids) * k
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    for component in range(1, k + 1):
        ours = np.array([found[i, d][component]["whitened"] for i, d in zip(ids, deviation.tolist())])
        assert min(np.abs(ours - white[:, component - 1]).max(), np.abs(ours + white[:, component - 1]).max()) < 1e-8
    for r in got:
        assert r["n"] == n and abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-10 and 0 <= r["identity_error"] < 1e-9


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    check_whitening(queries.op12_whitening(spark, SF).collect(), [r.vec_id for r in rows], x)


def test_whitening_of_awkward_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fine = [[float(np.float32(c)) for c in v] for v in rng.normal(scale=[9, 7, 5, 3, 1, 0.5], size=(300, 6))]
    fine += [fine[0]] * 200 + [[-0.0, 0.001, -0.001, 0.0, 100.0, -200.0]]
    rows = list(enumerate(fine)) + [(None, fine[1]), (3, fine[3])]
    odd = [None, [], [1.0, None] + [0.0] * 4, [float("nan")] + [1.0] * 5, [float("inf")] * 6, [1.0, 2.0], [3e38] * 6]
    table = spark.createDataFrame([(i, v, 1, 2, 3.0, "s") for i, v in rows + [(5_000 + k, v) for k, v in enumerate(odd)]],
        "vec_id long, embedding array<float>, key int, component int, whitened double, x string").repartition(5)
    x = np.floor(256 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    monkeypatch.setattr(whitening, "BLOCK", 64)
    monkeypatch.setattr(whitening, "FAN", 2)
    check_whitening(whitening.whitened(table).collect(), [i for i, _ in rows], x)
    none = whitening.whitened(table.limit(0))
    assert none.count() == 0 and none.columns == whitening.whitened(table.filter("vec_id < 9")).columns
    assert whitening.whitened(table.filter("vec_id = 0")).count() == 0  # one vector: nothing varies
    assert whitening.whitened(table.filter("vec_id >= 5000")).count() == 0  # of one length each: no variance
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whitened(flat).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_deviation_beyond_64_bits():
    centre = whitening.Centre(3, [3, 3])
    assert centre.deviation(np.array([[1, 2], [1 << 40, 0]])) == [9, None]
    huge = whitening.Centre(1 << 20, [0, 0])
    assert huge.deviation(np.array([[1 << 10, 1], [1 << 11, 0]])) == [(1 << 60) + (1 << 40), 1 << 62]


def test_packed_rows():
    x = np.array([[0, 127, -128], [128, 0, 0], [-129, 1, 1], [1 << 20, -1, 0], [0, 0, -(1 << 31)], [1 << 40, 0, 0]])
    rows = whitening.packed(x)
    assert [len(r) // 3 for r in rows] == [1, 2, 2, 4, 4, 8]
    import pyarrow as pa

    assert (whitening.unpacked(pa.array(rows, pa.binary()), 3) == x).all()


def brute_fim(key, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digits = len(units), hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark, docs):
    lines = ["a\nb\nc", "\n", "\n\n\n", "é\n日本\n😀\n", "<\nP\n<S\n>M>", "x<P>y\n", "a\n<M>", "\n".join(f"line {k}" for k in range(500)), "\r\n\r\nz", "z" * 9_000 + "\n"]
    more = spark.createDataFrame([(100 + 7 * k + j, t, "c", 1, "f") for j in range(6) for k, t in enumerate(lines)], docs.schema)
    table = docs.filter("doc_id is not null").unionByName(more)
    got = sorted((tuple(r) for r in fim.fill_in_middle(table).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute_fim(r.doc_id, r.text or "")) for r in table.collect()), key=str)
    back = fim.restore(fim.fill_in_middle(table), into="text").select("doc_id", "text")
    assert sorted(map(str, back.collect())) == sorted(map(str, table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(table.limit(0)).count() == 0 and fim.restore(fim.fill_in_middle(table.limit(0))).count() == 0
    none = fim.fill_in_middle(docs.filter("doc_id is null")).collect()
    assert len(none) == 1 and fim.restored(none[0].output, none[0].form) == "no id\nbut lines\n"
    assert {r.form for r in fim.fill_in_middle(table, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(table, spm=0).collect()} == {"plain", "psm"}
    with pytest.raises(ValueError):
        fim.transform("ab", 1, units=r"(a)*")


def test_fill_in_middle_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = queries.op13_fill_in_middle(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, prefix, middle, output = brute_fim(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(texts[r.doc_id]))


def test_ids_are_listed_in_decimal():
    own = chunk_bpe.codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    last = len(own.tokens) - 1
    for ids in ([], [0], [10, 0, 100, last, 7], list(range(1_000))):
        assert own.listed(np.array(ids, "<u4")) == ",".join(map(str, ids)).encode()
