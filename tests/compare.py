"""Compare registered queries with their SQL in DuckDB.

Usage: python tests/compare.py [--sf DIR] [--timing FILE] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    """One form for equal values of both engines."""
    from decimal import Decimal

    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float, Decimal)):
        v = float(v)
        return None if math.isnan(v) else v
    return str(v)


def key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, query, text: str, sf: str) -> str:
    """Empty when equal, else what differs."""
    from bizdiag.functions.lineage import scratch

    with scratch(spark):
        return _compare(query(spark, sf), con, text)


def _compare(df, con, text: str) -> str:
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    rel = con.execute(text)
    columns = [d[0] for d in rel.description]
    if sorted(columns) != names:
        return f"columns {names} / {sorted(columns)}"
    at = [columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    if got == want:
        return "" if got else "EMPTY"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}; only spark {[r for r in got if r not in set(want)][:2]}; only sql {[r for r in want if r not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    diff = sorted({names[i] for g, w in bad for i in range(len(names)) if g[i] != w[i]})
    return f"{len(bad)} of {len(got)} rows differ in {diff}; {names}; spark {bad[0][0]} sql {bad[0][1]}"


def main(args: list[str]) -> int:
    from bizdiag.plans import registry
    from bizdiag.session import local_session

    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark, con, failed = local_session(), duck(sf), 0
    queries, oracles = registry.queries(), registry.oracles()
    for name, q in queries.items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, q, oracles[name], sf)
            else:
                result = f"(rows only: {q(spark, sf).count()})"
        except Exception as e:  # noqa: BLE001 - reported, and counted as a failure
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if result and not result.startswith("(rows only"):
            failed += 1
        print(f"{name}: {result or 'ok'} [{time.time() - t:.1f}s]", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
