"""URL filters, sharding, token counts and BPE against brute force, on frames with awkward rows."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bizdiag.llm import bpe, rows, shards, tokens, urls

PATTERN = public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "one", "don't  stop\n\n now", "Été à l'œil <|endoftext|> end<|endoftext|>", "x" * 30_000, "ab " * 9_000,
    "日本語 テキスト", "😀 and ꟎ odd", "\t\r\n", "0123 456 7.8", "same text here", "same text here",
]


@pytest.fixture(scope="module")
def texts(spark):
    data = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "clash", 1), (3, "one", "again", 2)]
    return spark.createDataFrame(data, "doc_id long, text string, key string, n_tokens int")


def test_token_counts_are_the_librarys(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(map(tuple, tokens.token_counts(texts, path, PATTERN, 5).collect()), key=str)
    want = []
    for r in texts.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 5))
    assert got == sorted(want, key=str)
    assert tokens.token_counts(texts.limit(0), path, PATTERN, 5).count() == 0


def test_cache_overflow_keeps_counts_right(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    own = tokens.Counting(path, PATTERN)
    texts = ["alpha beta gamma", "delta epsilon zeta eta", "alpha", "", "theta iota kappa lambda mu"]
    want = [len(e.ids) for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [own.counts([t])[0] for t in texts] == want


def test_bpe_equals_tiktoken_and_round_trips(spark, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode_decode(texts, path, PATTERN).collect()
    digests = sorted((tuple(r) for r in bpe.digests(texts, path, PATTERN).collect()), key=str)
    want = []
    for r in texts.collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        raw = (r.text or "").encode()
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert digests == sorted(want, key=str)
    assert sorted(bytes(r.decoded) for r in out) == sorted((t.text or "").encode() for t in texts.collect())
    assert bpe.digests(texts.limit(0), path, PATTERN).count() == 0


def _brute_capacity(sizes, n):
    """Smallest capacity for which greedy filling needs at most n shards, a larger group being one alone."""

    def needed(c):
        count, room = 0, 0
        for s in sizes:
            if s > room or count == 0:
                count, room = count + 1, max(c, s)
            room = room - s if s <= c else 0
        return count

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("grid", [16, 16_384])
@pytest.mark.parametrize("hot", [0, 1_000_000])
def test_minimax_cuts_are_exact(spark, monkeypatch, grid, hot):
    monkeypatch.setattr(shards, "GRID", grid)
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 900, 3_000)]
    sizes[1_200] += hot
    ends = np.cumsum(sizes)
    df = spark.createDataFrame([(s, int(e)) for s, e in zip(sizes, ends)], "size long, end long")
    capacity, cuts = shards.minimax_cuts(df, 7, int(ends[-1]))
    assert capacity == _brute_capacity(sizes, 7)
    assert cuts[-1] == ends[-1] and len(cuts) <= 7 and set(cuts) <= set(ends.tolist())
    for a, b in zip([0, *cuts], cuts):
        assert b - a <= capacity or b - a == sizes[1_200]


def test_shards(spark, texts):
    out = shards.shard_documents(texts, 4).collect()
    assert len(out) == texts.count()
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values()) and set(sizes) <= set(range(4))
    by_id = {r.doc_id: r for r in out}
    assert by_id[12].shard == by_id[13].shard  # equal texts stay together
    assert by_id[0].size == 8 and by_id[0].text_crc32 is None and by_id[1].text_crc32 == 0
    assert by_id[6].size == 30_008 and by_id[6].text_crc32 == zlib.crc32(b"x" * 30_000)
    assert shards.shard_documents(texts.limit(0), 4).count() == 0


def test_numbered_is_gapless(spark):
    df = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), "id")
    got = {}
    for r in rows.numbered(df, ["g"], ["id"], "n", 5_000_000).collect():
        got.setdefault(r.g, []).append(r.n)
    assert len(got) == 3 and all(sorted(v) == list(range(len(v))) for v in got.values())


URLS = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/x?q=http://b.org/fr/", "x://notnet/", "x://example.com/de/",
    "x://m.example.com/de", "x://m.example.com/de/1", "x://q.org/fr/#t", "x://q.org/en/", "x://u@h.net:80/", "x://ÄNET.net/en/", "x://a..net/", "x://.net/",
    "x://a.net./", "http://a.net/", "x://a\nb.net/c", "x://example.net/en/" + "p" * 5_000,
]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _brute_judge(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = "".join(c.lower() if c in urls.UPPER else c for c in rest[:n]), rest[n:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, otherwise))
    return host, path, best[2], best[3]


def test_urls_equal_brute_force(spark):
    more = [("block", "", "/x"), ("allow", "b.a.net", "/"), ("block", "a.net", "/c/d"), ("allow", "a.net", "/c"), ("block", "com", "/")]
    some = [f"x://{h}/{p}" for h in ("a.net", "b.a.net", "c.b.a.net", "aa.net", "a.com", "net", "z.org") for p in ("", "c", "c/d", "c/de", "x", "fr/")]
    data = [(i, u, "h", "r") for i, u in enumerate(URLS + some)] + [(None, "x://a.net/c", "h", "r")] + [(7_000 + i, "x://a.net/hot", "h", "r") for i in range(500)]
    df = spark.createDataFrame(data, "page_id long, url string, host string, rule string")
    for rules in (RULES, more, []):
        got = sorted((tuple(r) for r in urls.judge(df, rules).collect()), key=str)
        assert got == sorted(((i, *_brute_judge(u, rules)) for i, u, _, _ in data), key=str)
    assert urls.judge(df.limit(0), RULES).count() == 0
