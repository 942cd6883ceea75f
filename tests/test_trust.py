"""Statuses of books, case by case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bookweave.operators import trust

AS_OF, FRESH = "2024-06-30", dt.date(2024, 6, 28)


def told(spark, positions=(), prices=(("A", FRESH),), rates=(), cash=(), sample=None, available=True, policy=None):
    """Statuses and issues of book b."""
    p = spark.createDataFrame([("b", *x) for x in positions], "book string, ticker string, ccy string, px double, value double, assumed boolean")
    issues, statuses = trust.diagnose(
        p, spark.createDataFrame(list(prices), "ticker string, day date"), spark.createDataFrame(list(rates), "ccy string, rate double, day date, invalid long, gap long"),
        spark.createDataFrame([("b", *x) for x in cash], "book string, ccy string, amount double"), spark.createDataFrame([("b", *(sample or (0, 300, 100.0)))], "book string, missing long, common long, equity double"),
        spark.createDataFrame([("b", available)], "book string, available boolean"), AS_OF, policy,
    )
    (s,) = statuses.collect()
    return (s.valuation, s.risk, s.performance), sorted((r.code, r.about) for r in issues.collect())


GOOD = ("A", "USD", 10.0, 100.0, False)


@pytest.mark.parametrize(
    ("case", "statuses", "issues"),
    [
        ({"positions": [GOOD]}, ("checked", "checked", "checked"), []),
        ({"positions": [GOOD], "prices": [("A", dt.date(2024, 6, 24))]}, ("warning", "limited", "warning"), [("price_stale", "A")]),
        ({"positions": [GOOD], "prices": [("A", dt.date(2024, 7, 1))]}, ("warning", "limited", "warning"), [("price_future", "A")]),
        ({"positions": [GOOD], "prices": [("OTHER", FRESH)]}, ("warning", "limited", "warning"), [("price_date_unknown", "A")]),
        ({"positions": [("A", "USD", None, None, False)]}, ("blocked", "unavailable", "unavailable"), [("price_missing", "A")]),
        ({"positions": [("A", "USD", 10.0, 100.0, True)]}, ("warning", "limited", "warning"), [("currency_assumed", None)]),
        ({"positions": [("A", "EUR", 10.0, 100.0, False)], "rates": [("EUR", 1.1, FRESH, 0, 3)]}, ("checked", "checked", "checked"), []),
        ({"positions": [("A", "EUR", 10.0, 100.0, False)]}, ("blocked", "unavailable", "unavailable"), [("fx_missing_invalid", "EUR")]),
        ({"positions": [("A", "GBX", 10.0, 100.0, False)], "rates": [("GBP", 1.1, dt.date(2024, 6, 20), 0, 3)]}, ("blocked", "unavailable", "unavailable"), [("fx_stale", "GBX")]),
        ({"positions": [GOOD], "cash": [("EUR", 5.0), ("JPY", 0.0)], "rates": [("EUR", 1.1, FRESH, 2, 30)]}, ("checked", "limited", "warning"), [("fx_history_gap", "EUR"), ("fx_history_invalid", "EUR")]),
        ({"positions": [GOOD], "sample": (0, 29, 100.0)}, ("checked", "limited", "checked"), [("risk_short_sample", None)]),
        ({"positions": [GOOD], "sample": (1, 300, 100.0)}, ("checked", "unavailable", "checked"), [("risk_coverage", None)]),
        ({"positions": [GOOD], "sample": (0, 300, -1.0)}, ("checked", "unavailable", "checked"), [("risk_coverage", None)]),
        ({"positions": [GOOD], "available": False}, ("checked", "checked", "unavailable"), [("account_performance_unavailable", None)]),
        ({"cash": [("USD", 5.0)]}, ("checked", "checked", "checked"), [("no_securities", None)]),
    ],
)
def test_statuses(spark, case, statuses, issues):
    assert told(spark, **case) == (statuses, issues)


def test_policies_are_sane():
    with pytest.raises(ValueError):
        trust.Policy(observations=1)


def test_common_days_equal_a_count_by_day(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(20)]
    returns = [(t, d, None if (i * k) % 5 == 3 else 0.1) for k, t in enumerate("ABC", 1) for i, d in enumerate(days)] + [("ONE", days[0], 0.2)]
    books = {"x": "A", "y": "AB", "z": "ABC", "w": ("A", "ONE"), "v": ("B", "GONE")}
    required = [(b, t) for b, ts in books.items() for t in ts]
    got = {r.book: (r.missing, r.common) for r in trust.common_days(spark.createDataFrame(returns, "ticker string, d date, r double"), spark.createDataFrame(required, "book string, ticker string")).collect()}
    good = {(t, d) for t, d, r in returns if r is not None}
    for b, ts in books.items():
        assert got[b] == (sum(sum(x == t for x, _ in good) < 2 for t in ts), sum(all((t, d) in good for t in ts) for d in days))
