"""Exact ranks and quantiles against brute force."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from bizdiag.functions import ordering
from bizdiag.functions.ordering import quantiles, value_cell, with_order_number, with_rank


def rows(seed, n, hot):
    """One group holds most rows; many values tie."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rnd.random() < hot else rnd.choice("abc")
        v = rnd.choice([None, 0.0, 0.0, -1.5, round(rnd.gauss(0, 1000), 2), round(rnd.random(), 6)])
        out.append((group, f"Merchant#{i:06d}", v))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_and_percentile_equal_brute_force(spark, seed):
    data = rows(seed, 700, 0.6)
    df = spark.createDataFrame(data, "g string, k string, v double")
    got = {r.k: (r.rk, r.pc) for r in with_rank(df, ["g"], "v", "rk", "pc").collect()}
    assert len(got) == len(data)
    for g, k, v in data:
        same = [x for h, _, x in data if h == g and x is not None]
        if v is None:
            assert got[k] == (None, None)
            continue
        assert got[k][0] == 1 + sum(x > v for x in same)
        average = sum(x < v for x in same) + (sum(x == v for x in same) + 1) / 2
        assert got[k][1] == pytest.approx(average / len(same), abs=1e-12)


@pytest.mark.parametrize("seed", [3, 4])
def test_quantiles_equal_linear_interpolation(spark, seed):
    data = rows(seed, 500, 0.7)
    df = spark.createDataFrame(data, "g string, k string, v double")
    got = {r.g: r for r in quantiles(df, ["g"], "v", {"q10": 0.1, "q75": 0.75, "q1": 1.0}).collect()}
    for g in {r[0] for r in data}:
        values = [v for h, _, v in data if h == g and v is not None]
        assert got[g].n_values == len(values)
        for name, q in (("q10", 0.1), ("q75", 0.75), ("q1", 1.0)):
            assert got[g][name] == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_quantiles_narrow_down_to_close_and_far_values(spark, monkeypatch):
    """Splits of four cells at a time, never by value: values one bit apart, of any size, and long ties."""
    monkeypatch.setattr(ordering, "_SPLIT", 4.0)
    monkeypatch.setattr(ordering, "_FEW", 1)
    rnd = random.Random(9)
    close = [float(np.nextafter(1.0, 2.0) + k * 2.0**-52) for k in range(40)]
    groups = {
        "close": close, "tie": [3.25] * 90 + [3.5], "one": [-7.0], "two": [0.0, 1e300],
        "far": [rnd.choice([-1, 1]) * 2.0 ** rnd.uniform(-80, 90) for _ in range(120)], None: [1.0, 2.0, 2.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("tie", float("inf"))]
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"q0": 0.0, "q30": 0.3, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = {r.g: r for r in quantiles(df, ["g"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n_values == len(vs)
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, q), rel=1e-14)
    assert quantiles(df.limit(0), ["g"], "v", wanted).count() == 0


def test_quantiles_of_all_rows_and_of_levels_in_a_column(spark):
    df = spark.range(10_001).select((F.col("id") * F.col("id")).cast("decimal(18,2)").alias("v"), (F.col("id") % 3 / 2).alias("q"))
    assert quantiles(df, [], "v", {"m": 0.5}).first().asDict() == {"n_values": 10_001, "m": 25_000_000.0}
    got = {r.q: r.x for r in quantiles(df, ["q"], "v", {"x": F.col("q")}).collect()}
    for q in (0.0, 0.5, 1.0):
        assert got[q] == pytest.approx(np.quantile([i * i for i in range(10_001) if i % 3 / 2 == q], q))


def test_order_number_splits_ties_by_label(spark):
    rnd = random.Random(5)
    data = [(f"Supplier#{i:05d}", float(rnd.choice([0, 0, 0, 5, 7]))) for i in range(400)]
    data += [(None, 0.0), ("", 5.0), ("Ä", 7.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.n for r in with_order_number(df, [], "v", "k", "n").collect()}
    want = sorted(data, key=lambda r: (-r[1], r[0] is None, (r[0] or "").encode()))
    assert got == {k: i for i, (k, _) in enumerate(want, 1)}


def test_order_number_within_groups_and_of_nothing(spark):
    rnd = random.Random(6)
    data = [(rnd.choice("ab") if i % 9 else None, f"k{i:04d}", rnd.choice([None, 1.0, 2.0])) for i in range(300)]
    df = spark.createDataFrame(data, "g string, k string, v double")
    got = {r.k: r.n for r in with_order_number(df, ["g"], "v", "k", "n").collect()}
    for g in ("a", "b", None):
        want = sorted((r for r in data if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        assert [got[k] for _, k, _ in want] == list(range(1, len(want) + 1))
    assert with_order_number(df.limit(0), [], "v", "k", "n").count() == 0


def test_a_tie_of_like_labels_splits(spark):
    """A tie of 200,000 long labels that differ at their end, and one other: each range holds a few per cent."""
    label = F.when(F.col("id") == 0, "odd").otherwise(F.concat(F.lit("a long common beginning "), F.lpad(F.col("id").cast("string"), 9, "0")))
    df = spark.range(200_001).select(label.alias("k"), F.lit(5).alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_order_number(df, [], "v", "k", "n")
        sizes = df.orderBy(F.desc("v"), "k").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert sizes < 0.05 * 200_001
        assert out.where("k = 'odd'").first().n == 200_001
        assert out.where("n = try_cast(substring(k, 25) as int)").count() == 200_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_cells_hold_few_values_whatever_the_unit(spark):
    df = spark.range(200_000).select((F.col("id") / 4e11 + 5e-7).alias("v"))
    cells = df.groupBy(value_cell(F.col("v")).alias("c")).count()
    assert cells.agg(F.max("count")).first()[0] < 0.01 * 200_000
    rng = random.Random(8)
    values = sorted({0.0, *(rng.choice([-1, 1]) * 2.0 ** rng.uniform(-110, 70) for _ in range(4_000)), *(2.0**k for k in range(-100, 70)), 1e-300, -1e300})
    got = {r.v: r.c for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", value_cell(F.col("v")).alias("c")).collect()}
    ordered = [got[v] for v in values]
    assert ordered == sorted(ordered)
