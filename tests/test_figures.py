"""Figures worked out by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bookweave.functions import scalars
from bookweave.operators import blocks, ledger, market, normalise, review, scenario
from bookweave.operators.components import connected_components
from bookweave.plans import valuation
from bookweave.sources import readers

D = dt.date


def trades(spark, rows):
    return spark.createDataFrame([(b, t, d, i, q, p, 0.0) for i, (b, t, d, q, p) in enumerate(rows)], "book long, ticker string, d date, seq long, q double, px double, fee double")


def test_ledger_of_three_trades(spark):
    t = trades(spark, [(1, "X", D(2024, 1, 1), 10.0, 5.0), (1, "X", D(2024, 1, 2), 10.0, 7.0), (1, "X", D(2024, 1, 3), -5.0, 10.0)])
    p = ledger.positions(t).first()
    assert (p.qty, p.basis, p.avg_cost, p.realised) == pytest.approx((15, 90, 6, 20))
    flows = spark.createDataFrame([(1, D(2024, 1, 1), 0, "DEPOSIT", 200.0)], "book long, d date, seq long, kind string, amt double")
    cash = ledger.cash_log(t, flows).groupBy("book").agg(F.sum("change").alias("cash"))
    held = ledger.positions(t).withColumns({"value": F.col("qty") * 8, "exposure": F.col("qty") * 8, "cost": F.col("basis"), "unrealised": F.col("qty") * 8 - F.col("basis")})
    total = valuation.totals(held, cash).first()
    assert (total.equity, total.cash, total.cost_basis, total.realised, total.unrealised) == pytest.approx((250, 130, 90, 20, 30))


def test_replay_of_a_long_segment(spark):
    rows = [(1, "A", 0, 10.0, 100.0)]
    for i in range(20_000):
        rows.append((1, "A", 2 * i + 1, -5.0, 7.0))
        rows.append((1, "A", 2 * i + 2, 5.0, 50.0 + i % 90))
    basis, qty = 0.0, 0.0
    for _, _, _, q, px in rows:
        basis, qty = (basis + q * px, qty + q) if q > 0 else (basis * (qty + q) / qty, qty + q)
    df = spark.createDataFrame(rows, "book int, ticker string, seq int, q double, px double").selectExpr("*", "date'2020-01-01' as d")
    last = ledger.positions(df).first()
    assert last.qty == qty and abs(last.basis / basis - 1) < 1e-9


def test_replay_equals_fold(spark):
    rng = random.Random(1)
    rows = [(b, "X", D(2024, 1, 1) + dt.timedelta(i), float(rng.choice([-3, -2, -1, 1, 2, 3])), float(rng.randint(1, 50))) for b in range(30) for i in range(40)]
    want = {}
    for b, _, _, q, p in rows:
        qty, basis, gain = want.get(b, (0.0, 0.0, 0.0))
        new = qty + q
        if qty * q < 0:
            gain += min(abs(q), abs(qty)) * (p - basis / abs(qty)) * (1 if qty > 0 else -1)
            basis = 0 if new == 0 else abs(new) * p if qty * new < 0 else basis * abs(new) / abs(qty)
        else:
            basis += abs(q) * p
        want[b] = (new, basis, gain)
    for r in ledger.positions(trades(spark, rows)).collect():
        assert (r.qty, r.basis, r.realised) == pytest.approx(want[r.book], abs=1e-9)


def test_splits_come_before_trades_of_their_day(spark):
    t = trades(spark, [(1, "X", D(2024, 1, 1), 10.0, 100.0), (1, "X", D(2024, 1, 5), 10.0, 50.0)])
    s = spark.createDataFrame([("X", D(2024, 1, 5), 2.0)], "ticker string, d date, ratio double")
    p = ledger.positions(t, s).first()
    assert (p.qty, p.basis, p.avg_cost) == pytest.approx((30, 1500, 50))


def test_risk_of_four_returns(spark):
    df = spark.createDataFrame([("A", D(2024, 1, i + 1), r) for i, r in enumerate((-0.1, 0.05, -0.02, 0.03))], "ticker string, d date, r double")
    m = market.series_metrics(df, "ticker").first()
    assert (m["var"], m.es, m.max_drawdown) == pytest.approx((0.088, 0.1, -0.1))


def test_two_correlated_assets_share_risk(spark):
    rows = [(t, D(2024, 1, i + 1), r * k) for i, r in enumerate((0.01, -0.02, 0.03, 0.0)) for t, k in (("A", 1), ("B", 2))]
    df = spark.createDataFrame(rows, "ticker string, d date, r double")
    w = spark.createDataFrame([("g", "A", 0.6), ("g", "B", 0.4)], "group string, ticker string, w double")
    share = {r.ticker: r.share for r in market.risk_contribution(df, w).collect()}
    assert share == pytest.approx({"A": 3 / 7, "B": 4 / 7})
    flat = df.withColumn("r", F.lit(0.01))
    assert {r["corr"] for r in blocks.correlation(flat).collect()} == {None}


def test_as_of_does_not_look_ahead(spark):
    left = spark.createDataFrame([("E", D(2024, 1, d)) for d in (1, 3, 5)], "ccy string, d date")
    right = spark.createDataFrame([("E", D(2024, 1, 2), 1.1), ("E", D(2024, 1, 4), -1.0), ("E", D(2024, 1, 6), 9.0)], "ccy string, d date, rate double")
    assert [r.rate for r in market.as_of(left, right, "ccy", "d", "rate").orderBy("d").collect()] == [None, 1.1, 1.1]


def test_scenarios(spark):
    p = spark.createDataFrame([(1, "X", 10.0, 20.0, 15.0, 0.0, 5.0, None), (1, "Y", -4.0, 10.0, 12.0, 0.0, None, -2.0)], "book long, ticker string, qty double, px double, avg_cost double, realised double, duration double, sensitivity double")
    steps = spark.createDataFrame(
        [("a", 1, "resize", "X", 0.5), ("a", 2, "set_quantity", "Y", 2.0), ("b", 1, "rate_shock", None, 100.0), ("c", 1, "melt", "X", 1.0), ("d", 1, "resize", "X", 0.1), ("d", 2, "price_shock", "X", -100.0)],
        "scenario string, step int, action string, ticker string, amount double",
    )
    out = {(r.scenario, r.ticker): r for r in scenario.run(p, steps).collect()}
    assert {k[0] for k in out} == {"a", "b"}
    x, y = out["a", "X"], out["a", "Y"]
    assert (x.qty, x.cash_change, x.realised, x.avg_cost) == pytest.approx((5, 100, 25, 15))
    assert (y.qty, y.cash_change, y.realised, y.avg_cost) == pytest.approx((2, -60, 8, 10))
    assert (out["b", "X"].px, out["b", "Y"].px) == pytest.approx((19, 9.8))
    assert {(r.scenario, r.reason) for r in scenario.invalid_steps(steps).collect()} == {("c", "unknown action"), ("d", "amount out of bounds")}


def test_look_through(spark):
    h = spark.createDataFrame([(1, "F", 1000.0), (1, "S", 500.0), (1, "BAD", 10.0)], "book long, ticker string, value double")
    c = spark.createDataFrame([("F", "S", "0.25"), ("F", "T", "0.5"), ("BAD", "S", "0.9"), ("BAD", "T", "0.2")], "parent string, constituent string, weight string").withColumn("weight", F.col("weight").cast("decimal(19,18)"))
    out = {r.security: (r.direct, r.indirect) for r in review.look_through(h, c).collect()}
    assert out == {"S": (500.0, 250.0), "T": (0.0, 500.0), "BAD": (10.0, 0.0)}
    assert {r.parent: r.state for r in review.coverage(c).collect()} == {"F": "partial", "BAD": "overweight"}


def test_identity_over_shared_identifiers(spark):
    rows = [(1, ["isin:A"]), (2, ["isin:A", "sedol:B"]), (3, ["sedol:B"]), (4, ["isin:C"]), (5, []), (6, ["isin:D", "isin:C"])]
    df = spark.createDataFrame(rows, "row_id long, ids array<string>")
    c = review.identity(df)
    assert {r.row_id: r.component for r in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}
    assert [r.component for r in review.conflicting(df, c).collect()] == [4]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from bookweave.operators import components

    rounds, real = [], components.stage_table
    monkeypatch.setattr(components, "stage_table", lambda df, label: rounds.append(label) or real(df, label))
    got = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long"))
    assert got.agg(F.count("*"), F.max("component")).first()[:] == (1001, 0)
    assert rounds.count("edges") <= 4 and len(rounds) <= 24


def test_numbers_dates_and_weights(spark):
    df = spark.createDataFrame([(v,) for v in ("$1,234.50", "(12)", " 5 % ", "n/a", "", None, "abc", "1e3", "-7", "inf")], "v string")
    assert [r[0] for r in df.select(scalars.clean_number(F.col("v"))).collect()] == [1234.5, -12, 5, None, None, None, None, 1000, -7, None]
    df = spark.createDataFrame([(v,) for v in ("2024-02-29", "2024-02-30", "29/02/2024", "20240229", "2024-02-29T10:00:00")], "v string")
    assert [r[0] for r in df.select(scalars.iso_date(F.col("v"))).collect()] == [D(2024, 2, 29), None, None, None, D(2024, 2, 29)]
    df = spark.createDataFrame([("12.5%", "percent"), ("0.125", "decimal"), ("12.5", None), ("101", "percent"), ("-1", "decimal")], "v string, u string")
    assert [float(r[0]) if r[0] is not None else None for r in df.select(scalars.weight(F.col("v"), F.col("u"))).collect()] == [0.125, 0.125, None, None, None]


def test_exports_and_monthly_rates(spark, tmp_path):
    readers.safe_export(spark.createDataFrame([("=1+1", 1), ("ok", 2)], "t string, n int"), str(tmp_path / "out"))
    assert {r.t for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()} == {"'=1+1", "ok"}
    rates, bad = readers.monthly_rates(spark.createDataFrame([("2024-01-01", "5"), ("2024-02-01", "x"), ("2024-03-01", "1"), ("2024-03-09", "2")], "date string, level string"))
    assert rates.count() == 1 and {r.issue for r in bad.collect()} == {"bad level", "duplicate month"}


def test_private_columns_go(spark):
    df = spark.createDataFrame([(1, "acc", (2, "t1"))], "n int, account string, x struct<v:int,transaction_id:string>")
    assert normalise.redact(df).schema.simpleString() == "struct<n:int,x:struct<v:int>>"


def test_private_fields_go_at_every_depth(spark):
    df = spark.sql("""select 1 as k, 'x' as account, map('raw', named_struct('v', 1), 'kept', named_struct('v', 2)) as m,
        array(named_struct('source', 's', 'deep', array(named_struct('record_id', 7, 'q', 3)))) as rows, named_struct('name', 'n') as only""")
    got = normalise.redact(df)
    row = got.first()
    assert got.columns == ["k", "m", "rows"]
    assert row.m["kept"].v == 2 and "raw" not in row.m
    assert row.rows[0].asDict(True) == {"deep": [{"q": 3}]}


def test_books_are_scaled_to_a_volatility(spark):
    state = spark.createDataFrame(
        [("calm", 0.05, 100.0, 100.0, 300.0, 400.0), ("full", 0.05, 100.0, 100.0, 0.0, 100.0), ("wild", 0.6, 100.0, 100.0, 0.0, 100.0), ("flat", 0.0, 1.0, 1.0, 0.0, 1.0)],
        "name string, volatility double, net double, gross double, cash double, equity double",
    )
    got = {r.name: r for r in scenario.to_target(state, 15.0).collect()}
    assert got["calm"].status == "ok" and abs(got["calm"].cash_after - 100) < 1e-9 and abs(got["calm"].gross_after - 300) < 1e-9
    assert got["full"].status == "refused: needs leverage" and got["full"].cash_after is None
    assert abs(got["wild"].scale - 0.25) < 1e-12 and abs(got["wild"].cash_after - 75) < 1e-9
    assert got["flat"].status == "refused: no volatility"
    lent = scenario.to_target(state.where("name = 'full'"), 0.15, leverage=True).first()
    assert lent.status == "ok" and abs(lent.cash_after + 200) < 1e-9


def test_tickers_and_currencies_of_input(spark):
    df = spark.createDataFrame([(" na ", "US Dollar"), ("<na>", "GBp"), ("none", "pounds"), ("eth", "n/a"), (None, "GB Pence"), ("", "chf")], "t string, c string")
    got = df.select(scalars.ticker(F.col("t")).alias("t"), scalars.currency(F.col("c")).alias("c")).collect()
    assert [r.t for r in got] == ["NA", "", "", "ETH-USD", "", ""]
    assert [r.c for r in got] == ["USD", "GBP", "GBP", "USD", "GBX", "CHF"]
