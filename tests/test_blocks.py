"""Block products and combinations against pandas and itertools."""

import itertools
import math
import random
from datetime import date as D
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookweave.operators import blocks


def returns(n_tickers, n_days, gaps, seed=3):
    rng = random.Random(seed)
    common = [rng.gauss(0, 0.01) for _ in range(n_days)]
    return [(f"T{k:03d}", D(2020, 1, 1) + timedelta(i), None if rng.random() < gaps else common[i] * (k % 3) + rng.gauss(0.001, 0.02)) for k in range(n_tickers) for i in range(n_days)]


def test_correlation_equals_pandas_over_blocks_and_spans(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WIDE", 4)
    monkeypatch.setattr(blocks, "LONG", 30)
    rows = returns(11, 200, 0.2) + [("FLAT", D(2020, 1, 1) + timedelta(i), 0.01) for i in range(50)] + [("ONE", D(2020, 1, 5), 0.3), ("NONE", D(2020, 1, 5), None)]
    df = spark.createDataFrame(rows, "ticker string, d date, r double").repartition(5)
    wide = pd.DataFrame(rows, columns=["ticker", "d", "r"]).pivot(index="d", columns="ticker", values="r").astype(float)
    want = wide.corr(min_periods=2)
    got = {(r.i, r.j): r for r in blocks.correlation(df).collect()}
    for i, j in itertools.product(wide.columns, repeat=2):
        n = int((wide[i].notna() & wide[j].notna()).sum())
        assert ((i, j) in got) == (n > 0)
        if n:
            r, w = got[i, j], want.loc[i, j]
            assert r.n == n
            assert (r["corr"] is None) if "FLAT" in (i, j) or n < 2 else r["corr"] == pytest.approx(w, abs=1e-12)
    assert blocks.correlation(df.limit(0)).count() == 0


def test_pair_sums_by_group(spark):
    rows = [(g, *r) for g in ("x", None) for r in returns(3, 40, 0.1, seed=len(g or ""))]
    df = spark.createDataFrame(rows, "g string, ticker string, d date, r double")
    got = blocks.pair_sums(df.where("g is not null"), ("g",)).withColumn("c", blocks.covariance()).collect()
    wide = pd.DataFrame([r[1:] for r in rows if r[0]], columns=["ticker", "d", "r"]).pivot(index="d", columns="ticker", values="r").astype(float)
    assert {(r.i, r.j): r.c for r in got} == pytest.approx({(i, j): wide[[i, j]].dropna().cov().loc[i, j] if i != j else wide[i].var() for i in wide for j in wide}, abs=1e-15)


def test_members_are_combinations_in_order():
    for n, size in ((5, 2), (7, 3), (6, 6), (9, 4), (12, 1)):
        want = list(itertools.combinations(range(n), size))
        assert [tuple(m) for m in blocks.members(np.arange(math.comb(n, size)), n, size)] == want


@pytest.mark.parametrize("size", [2, 3, 4])
def test_combination_risk_equals_pandas(spark, size):
    rows = returns(6, 80, 0.02) + [("SHORT", D(2020, 1, 1) + timedelta(i), 0.01) for i in range(29)] + [("OTHER", D(2020, 1, 1), 0.5)]
    df = spark.createDataFrame(rows, "ticker string, d date, r double")
    keys = df.select("ticker").where("ticker <> 'T005'").unionByName(spark.createDataFrame([("GONE",)], "ticker string"))
    got, told = blocks.combination_risk(df, keys, size)
    wide = pd.DataFrame(rows, columns=["ticker", "d", "r"]).pivot(index="d", columns="ticker", values="r").astype(float)[[f"T{k:03d}" for k in range(5)]].dropna()
    assert told["eligible"] == 5 and told["common"] == len(wide) and told["evaluated"] == math.comb(5, size) and told["skipped"] == 0
    got = {r.combo: r for r in got.collect()}
    assert len(got) == math.comb(5, size)
    for group in itertools.combinations(wide.columns, size):
        r, x = got["+".join(group)], wide[list(group)].mean(axis=1)
        cut, w = x.quantile(0.05), (1 + x).cumprod()
        want = (len(x), x.mean() * 252, x.std() * 252**0.5, max(0, -cut), max(0, -x[x <= cut].mean()), w.iloc[-1] - 1, (w / w.cummax().clip(lower=1) - 1).min())
        assert (r.n, r.annual_return, r.volatility, r["var"], r.es, r.growth, r.max_drawdown) == pytest.approx(want)


def test_combinations_are_counted_before_they_are_made(spark):
    df = spark.createDataFrame(returns(8, 31, 0), "ticker string, d date, r double")
    keys = df.select("ticker")
    for size, limit, reason in ((9, 100, "too few eligible tickers"), (4, 60, "more combinations than the limit")):
        got, told = blocks.combination_risk(df, keys, size, limit=limit)
        assert got.count() == 0 and told["reason"] == reason and told["evaluated"] == 0
    late = df.withColumn("d", F.when(F.col("ticker") == "T001", F.date_add("d", 5)).otherwise(F.col("d")))
    got, told = blocks.combination_risk(late, keys, 2)
    assert got.count() == 0 and told["reason"] == "too few common days" and told["skipped"] == 28
    with pytest.raises(ValueError):
        blocks.combination_risk(df, keys, 1)


def test_a_total_loss_does_not_compound(spark):
    rows = [(k, D(2020, 1, 1) + timedelta(i), -1.5 if i == 7 else 0.01) for k in "AB" for i in range(40)]
    got, _ = blocks.combination_risk(spark.createDataFrame(rows, "ticker string, d date, r double"), spark.createDataFrame([("A",), ("B",)], "ticker string"), 2)
    (r,) = got.collect()
    assert not r.compounds and r.growth is None and r.max_drawdown is None and r.volatility > 0
