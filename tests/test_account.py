"""Daily account paths against figures made by hand and a day-by-day fold."""

import math
import random
from datetime import date as D
from datetime import timedelta

import pytest

from bookweave.operators import account

DAYS = [D(2025, 1, d) for d in (1, 2, 3, 6)]
TRADE = "book string, ticker string, ccy string, d date, q double, paid double"
FLOW = "book string, d date, kind string, amt double"


def inputs(spark, prices, rates=(), trades=(), flows=()):
    """marks and the frames of trades (book, ticker, ccy, d, q, paid) and flows."""
    t = spark.createDataFrame(list(trades), TRADE)
    f = spark.createDataFrame(list(flows), FLOW)
    p = spark.createDataFrame([(k, d, float(x)) for k, d, x in prices], "ticker string, d date, px double")
    r = spark.createDataFrame([(c, d, float(x)) for c, d, x in rates], "ccy string, d date, rate double")
    s = spark.createDataFrame(sorted({(x[1], x[2]) for x in trades} | {(k, "USD") for k, *_ in prices if not any(x[1] == k for x in trades)}), "ticker string, ccy string")
    return account.marks(p, r, s, t.select("d").unionByName(f.select("d"))), t, f


def path_of(spark, *args, opening=None, **more):
    worth, t, f = inputs(spark, *args, **more)
    own = account.runs(account.changes_of(t, f))
    start = None if opening is None else spark.createDataFrame([("b", float(opening))], "book string, opening double")
    return account.daily_path(own, account.external_of(f), worth, start), own, worth, t


def attributed(path, own, worth, cash, mode):
    chosen = account.segments(path)
    days = account.linked(path, chosen)
    got = account.contributions(own, cash, worth, days).where(f"mode = '{mode}'").collect()
    grown = math.prod(1 + r.r for r in days.where(f"mode = '{mode}' and r is not null").collect()) - 1
    return {r.ticker: r.contribution for r in got}, grown, chosen.where(f"mode = '{mode}'").collect()[0]


def test_cash_weight_and_linking_reconcile(spark):
    prices = [("A", d, x) for d, x in zip(DAYS, (100, 90, 81, 100), strict=True)]
    path, own, worth, t = path_of(spark, prices[:3], trades=[("b", "A", "USD", DAYS[0], 1.0, -100.0)], flows=[("b", DAYS[0], "DEPOSIT", 200.0)])
    assert [r.equity for r in path.orderBy("d").collect()] == [200, 190, 181]
    spent = t.select("book", "ticker", "d", t.paid.alias("spent"))
    got, grown, _ = attributed(path, own, worth, spent, "period")
    assert got["A"] == pytest.approx(-0.095) and grown == pytest.approx(-0.095)
    path, own, worth, t = path_of(spark, prices, trades=[("b", "A", "USD", DAYS[0], 1.0, -100.0)], flows=[("b", DAYS[0], "DEPOSIT", 200.0)])
    spent = t.select("book", "ticker", "d", t.paid.alias("spent"))
    got, grown, seg = attributed(path, own, worth, spent, "drawdown")
    assert (seg.start, seg.end) == (DAYS[0], DAYS[2]) and got["A"] == pytest.approx(-0.095) and grown == pytest.approx(-0.095)
    assert attributed(path, own, worth, spent, "period")[1] == pytest.approx(0)


def lots_path(spark, lots, prices):
    """Lots as dated holdings: no cash, entries at the mark of their day come from outside."""
    worth, t, _ = inputs(spark, prices, trades=[("b", k, "USD", d, q, 0.0) for k, d, q in lots])
    zero = [("b", "CASH:USD", min(d for _, d, _ in lots), 0.0)]
    own = account.runs(t.select("book", "ticker", "d", "q").unionByName(spark.createDataFrame(zero, "book string, ticker string, d date, q double")))
    entered = t.join(worth, ["ticker", "d"]).selectExpr("book", "ticker", "d", "q * mark as external")
    path = account.daily_path(own, entered.groupBy("book", "d").agg({"external": "sum"}).withColumnRenamed("sum(external)", "external"), worth)
    return path, own, worth, entered.selectExpr("book", "ticker", "d", "-external as spent")


def test_lots_bring_no_phantom_return(spark):
    path, *_ = lots_path(spark, [("A", DAYS[0], 1.0), ("A", DAYS[1], 2.0)], [("A", d, 100) for d in DAYS])
    rows = path.orderBy("d").collect()
    assert [r.equity for r in rows] == [100, 300, 300, 300] and [r.r for r in rows] == [None, 0, 0, 0]


def test_added_lots_are_no_contribution(spark):
    path, own, worth, spent = lots_path(spark, [("A", DAYS[0], 1.0), ("A", DAYS[1], 2.0)], [("A", d, x) for d, x in zip(DAYS, (100, 110, 121, 121), strict=True)])
    got, grown, _ = attributed(path, own, worth, spent, "period")
    assert got["A"] == pytest.approx(0.21) and grown == pytest.approx(0.21)


def test_opening_cash_and_the_first_day(spark):
    path, *_ = path_of(spark, [("A", d, 110) for d in DAYS], trades=[("b", "A", "USD", DAYS[0], 1.0, -100.0)], opening=100)
    rows = path.orderBy("d").collect()
    assert rows[0].r == pytest.approx(0.1) and rows[-1].equity == 110


def test_weekend_prices_are_left_out_and_rates_hold(spark):
    sat = D(2025, 1, 4)
    path, *_ = path_of(spark, [("A", DAYS[0], 10), ("A", sat, 99), ("A", DAYS[3], 12)], rates=[("EUR", DAYS[0], 1.0), ("EUR", sat, 1.5)], trades=[("b", "A", "EUR", DAYS[0], 2.0, -20.0)], flows=[("b", DAYS[0], "DEPOSIT", 50.0)])
    assert [(r.d, r.equity) for r in path.orderBy("d").collect()] == [(DAYS[0], 50.0), (DAYS[1], 50.0), (DAYS[2], 50.0), (DAYS[3], 50 + (24 - 20) * 1.5)]


def test_refusals(spark):
    prices = [("A", d, 100) for d in DAYS] + [("LATE", DAYS[2], 5)]
    rates = [("EUR", DAYS[1], 1.1)]
    trades = [
        ("ok", "A", "USD", DAYS[0], 1.0, -100.0), ("after", "A", "USD", D(2025, 1, 7), 1.0, -1.0), ("unpriced", "NONE", "USD", DAYS[0], 1.0, -1.0), ("unmarked", "LATE", "USD", DAYS[0], 1.0, -1.0),
        ("rates", "EURO", "EUR", DAYS[0], 1.0, -1.0), ("nowhere", "X", "XXX", DAYS[0], 1.0, -1.0), ("short", "A", "USD", DAYS[0], 1.0, -301.0), ("few", "A", "USD", DAYS[2], 1.0, -100.0),
    ]
    flows = [(b, d, "DEPOSIT", 200.0) for b, d in (("ok", DAYS[0]), ("unmarked", DAYS[0]), ("flows only", DAYS[0]), ("short", DAYS[0]), ("few", DAYS[2]))]
    worth, t, f = inputs(spark, [*prices, ("EURO", DAYS[0], 1), ("X", DAYS[0], 1)], rates, trades, flows)
    worth = worth.where("ticker <> 'NONE'")
    early = account.refusals(t, f, worth)
    kept = lambda df: df.join(early, "book", "left_anti")
    path = account.daily_path(account.runs(kept(account.changes_of(t, f))), kept(account.external_of(f)), worth)
    got = {r.book: r.reason for r in early.unionByName(account.path_refusals(path)).collect()}
    assert got == {
        "after": "events after the market history", "unpriced": "missing prices", "unmarked": "missing marks", "rates": "incomplete rates", "nowhere": "incomplete rates",
        "flows only": "no trades", "short": "negative equity", "few": "too few valuations",
    }


def test_paths_and_attribution_equal_a_fold_by_day(spark):
    rng = random.Random(11)
    days = [d for k in range(120) if (d := D(2024, 1, 1) + timedelta(k)).weekday() < 5]
    px, eur = {}, {}
    for k in "ABC":
        x = 50.0
        for d in days:
            x *= math.exp(rng.gauss(0, 0.02))
            if rng.random() < 0.8 or d == days[0]:
                px[k, d] = x
    for d in days:
        if rng.random() < 0.6 or d == days[0]:
            eur[d] = 1.1 + rng.gauss(0, 0.02)
    ccy = {"A": "USD", "B": "EUR", "C": "USD"}
    trades = [(b, k, ccy[k], d, q, -q * 50 - 1) for b in ("b1", "b2") for _ in range(40) for k in [rng.choice("ABC")] for d in [rng.choice(days[2:])] for q in [float(rng.randint(-3, 6))]]
    flows = [(b, days[0], "DEPOSIT", 50000.0) for b in ("b1", "b2")] + [("b1", rng.choice(days[1:]), rng.choice(["DEPOSIT", "WITHDRAWAL", "DIVIDEND"]), 300.0) for _ in range(9)]
    worth, t, f = inputs(spark, [(k, d, x) for (k, d), x in px.items()], [("EUR", d, x) for d, x in eur.items()], trades, flows)
    own = account.runs(account.changes_of(t, f))
    path = account.daily_path(own, account.external_of(f), worth)
    chosen = account.segments(path)
    weights = account.linked(path, chosen)
    cash = worth.where("ticker like 'CASH:%'").selectExpr("substr(ticker, 6) as ccy", "d", "mark")
    spent = t.join(cash, ["ccy", "d"]).selectExpr("book", "ticker", "d", "paid * mark as spent")
    parts = {(r.book, r["mode"], r.ticker): r.contribution for r in account.contributions(own, spent, worth, weights).collect()}
    rows, where = {}, {(r.book, r["mode"]): r for r in chosen.collect()}
    for r in path.orderBy("d").collect():
        rows.setdefault(r.book, []).append(r)
    for b in ("b1", "b2"):
        fold, held, native, last, rate, before = [], dict.fromkeys("ABC", 0.0), {"USD": 0.0, "EUR": 0.0}, {}, {"USD": 1.0}, 0.0
        worn = dict.fromkeys("ABC", 0.0)
        for d in days:
            rate["EUR"] = eur.get(d, rate.get("EUR"))
            paid = dict.fromkeys("ABC", 0.0)
            for book, k, c, day, q, p in trades:
                if (book, day) == (b, d):
                    held[k] += q
                    native[c] += p
                    paid[k] += p * rate[c]
            outside = 0.0
            for book, day, kind, amt in flows:
                if (book, day) == (b, d):
                    x = -amt if kind == "WITHDRAWAL" else amt
                    native["USD"] += x
                    outside += x if kind != "DIVIDEND" else 0
            for k in "ABC":
                last[k] = px.get((k, d), last.get(k))
            value = {k: held[k] * last[k] * rate[ccy[k]] for k in "ABC"}
            equity = sum(native[c] * rate[c] for c in native) + sum(value.values())
            fold.append((d, equity, outside, (equity - before - outside) / before if before else None, {k: value[k] - worn[k] + paid[k] for k in "ABC"}, before))
            before, worn = equity, value
        assert [r.d for r in rows[b]] == [x[0] for x in fold]
        wealth, top = 1.0, 1.0
        for r, (_, equity, outside, ret, _, prior) in zip(rows[b], fold, strict=True):
            wealth *= 1 + (ret or 0)
            top = max(top, wealth)
            assert (r.equity, r.external, r.before, r.wealth) == pytest.approx((equity, outside, prior, wealth)) and r.drawdown == pytest.approx(wealth / top - 1, abs=1e-12)
            assert (r.r is None) == (ret is None) and (ret is None or r.r == pytest.approx(ret, abs=1e-12))
        for mode in ("period", "drawdown"):
            seg, link, total, part = where[b, mode], 1.0, 0.0, dict.fromkeys("ABC", 0.0)
            inside = [x for x in fold if seg.start < x[0] <= seg.end]
            for _, _, _, ret, pnl, prior in inside:
                for k in "ABC":
                    part[k] += pnl[k] / prior * link
                total += (ret - sum(pnl.values()) / prior) * link
                link *= 1 + ret
            assert {k: parts.get((b, mode, k), 0.0) for k in "ABC"} == pytest.approx(part, abs=1e-12)
            assert sum(part.values()) + total == pytest.approx(link - 1, abs=1e-9)
