"""Queries on what may be relied on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweave.operators import market, trust
from bookweave.plans import risk
from bookweave.plans.registry import query
from bookweave.plans.scratch import stage_table
from bookweave.plans.valuation import FOLD, accounts, base_trades, cash_of, native_cash, prices_of, refused_books, value_positions
from bookweave.sources import tables

AS_OF = "2001-11-08"
#: The statuses in SQL. The price of Brand#25 has no day, that of Brand#31 is lacking in each thirteenth book, euro rates of each 14th are no rates, and each eleventh book has no currencies of its own.
SQL = FOLD + risk.RETURNS + """
, lastpx AS (SELECT ticker, CASE WHEN ticker = 'Brand#25' THEN NULL ELSE max(d) END AS day FROM price GROUP BY ticker
), given AS (SELECT ccy, d, CASE WHEN day(d) = 14 AND ccy = 'EUR' THEN -1.0 ELSE rate END AS rate FROM fx
), sound AS (SELECT ccy, d, rate, d - lag(d) OVER (PARTITION BY ccy ORDER BY d) AS gap FROM given WHERE rate > 0
), rates AS (SELECT ccy, max(d) AS day, max(gap) AS gap, (SELECT count(*) FROM given g WHERE g.ccy = s.ccy AND rate <= 0) AS invalid FROM sound s GROUP BY ccy
), held AS (SELECT v.book, v.ticker, s.ccy, CASE WHEN v.book % 13 <> 0 OR v.ticker <> 'Brand#31' THEN v.px END AS px, v.value FROM valued v JOIN security s USING (ticker) WHERE v.qty <> 0
), native AS (
  SELECT book, ccy, sum(x) AS amount FROM (SELECT book, ccy, paid AS x FROM dated UNION ALL SELECT book, 'USD', CASE WHEN kind = 'WITHDRAWAL' THEN -amt ELSE amt END FROM flow) WHERE book NOT IN (SELECT book FROM refused) GROUP BY ALL
), need AS (SELECT DISTINCT book, ccy FROM (SELECT book, ccy FROM held UNION ALL SELECT book, ccy FROM native WHERE abs(amount) > 1e-12) WHERE ccy <> 'USD'
), fxall2 AS (SELECT ccy, d, rate FROM given WHERE rate > 0 AND ccy <> 'USD' UNION ALL SELECT 'GBX', d, rate / 100 FROM given WHERE ccy = 'GBP'
), fspan AS (SELECT ccy, min(d) AS a, max(d) AS z FROM fxall2 GROUP BY ccy
), fgrid AS (SELECT ccy, CAST(g AS DATE) AS d FROM fspan, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS t(g)
), ffill AS (SELECT g.ccy, g.d, last_value(f.rate IGNORE NULLS) OVER (PARTITION BY g.ccy ORDER BY g.d ROWS UNBOUNDED PRECEDING) AS rate FROM fgrid g LEFT JOIN fxall2 f ON f.ccy = g.ccy AND f.d = g.d
), cashret AS (SELECT 'CASH:' || ccy AS ticker, d, rate / lag(rate) OVER (PARTITION BY ccy ORDER BY d) - 1 AS r FROM ffill WHERE isodow(d) < 6
), allret AS (SELECT ticker, d FROM good UNION ALL SELECT ticker, d FROM cashret WHERE r IS NOT NULL
), must AS (SELECT book, ticker FROM held UNION SELECT book, 'CASH:' || ccy FROM native WHERE ccy <> 'USD' AND abs(amount) > 1e-12
), size_ AS (SELECT book, count(*) AS n FROM must GROUP BY book
), lack AS (SELECT book, count(*) AS missing FROM must LEFT JOIN (SELECT ticker, count(*) AS k FROM allret GROUP BY ticker) USING (ticker) WHERE coalesce(k, 0) < 2 GROUP BY book
), common AS (SELECT book, count(*) AS common FROM (SELECT book, d FROM must JOIN allret USING (ticker) JOIN size_ USING (book) GROUP BY book, d, n HAVING count(*) = n) GROUP BY book
), books AS (SELECT DISTINCT book FROM pos
), sample AS (
  SELECT b.book, coalesce(missing, 0) AS missing, coalesce(common, 0) AS common, coalesce(cash, 0) + coalesce(net, 0) AS equity FROM books b LEFT JOIN lack USING (book) LEFT JOIN common USING (book) LEFT JOIN money USING (book) LEFT JOIN (SELECT book, sum(value) AS net FROM valued GROUP BY book) USING (book)
), issue AS (
  SELECT book, CASE WHEN NOT coalesce(px > 0 AND value IS NOT NULL, false) THEN 'price_missing' WHEN day IS NULL THEN 'price_date_unknown' WHEN DATE '2001-11-08' < day THEN 'price_future' WHEN DATE '2001-11-08' - day > 5 THEN 'price_stale' END AS code FROM held LEFT JOIN lastpx USING (ticker)
  UNION ALL SELECT DISTINCT book, 'currency_assumed' FROM held WHERE book % 11 = 0
  UNION ALL SELECT book, CASE WHEN r.day IS NULL THEN 'fx_missing_invalid' WHEN DATE '2001-11-08' < r.day THEN 'fx_future' WHEN DATE '2001-11-08' - r.day > 5 THEN 'fx_stale' END FROM need n LEFT JOIN rates r ON r.ccy = CASE WHEN n.ccy = 'GBX' THEN 'GBP' ELSE n.ccy END
  UNION ALL SELECT book, 'fx_history_invalid' FROM need n JOIN rates r ON r.ccy = CASE WHEN n.ccy = 'GBX' THEN 'GBP' ELSE n.ccy END WHERE invalid > 0
  UNION ALL SELECT book, 'fx_history_gap' FROM need n JOIN rates r ON r.ccy = CASE WHEN n.ccy = 'GBX' THEN 'GBP' ELSE n.ccy END WHERE gap > 5
  UNION ALL SELECT book, CASE WHEN equity <= 0 OR missing > 0 OR common < 2 THEN 'risk_coverage' WHEN common < 30 THEN 'risk_short_sample' END FROM sample
  UNION ALL SELECT book, 'account_performance_unavailable' FROM books WHERE book % 3 <> 0
  UNION ALL SELECT book, 'no_securities' FROM books WHERE book NOT IN (SELECT book FROM held)
), told AS (SELECT book, code FROM issue WHERE code IS NOT NULL)"""


def _diagnosed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    trades = base_trades(spark, sf_dir)
    p = value_positions(spark, sf_dir, trades).select("book", "ticker", "ccy", "qty", "px", "value")
    prices = prices_of(trades)
    held = p.where("qty <> 0").select("book", "ticker", "ccy", F.when((F.col("book") % 13 != 0) | (F.col("ticker") != "Brand#31"), F.col("px")).alias("px"), "value", (F.col("book") % 11 == 0).alias("assumed"))
    last = market.latest(prices, "ticker", "d", "px").select("ticker", F.when(F.col("ticker") != "Brand#25", F.col("d")).alias("day"))
    given = tables.fx(spark, sf_dir).withColumn("rate", F.when((F.dayofmonth("d") == 14) & (F.col("ccy") == "EUR"), -1.0).otherwise(F.col("rate")))
    sound = market.latest(given.where("rate > 0"), "ccy", "d", "rate").withColumnRenamed("d", "day")
    found = market.fx_issues(given, 0)
    counts = found.groupBy("ccy").agg(F.max(F.when(F.col("code") == "invalid history", F.col("n"))).alias("invalid"), F.max(F.when(F.col("code") == "history gap", F.col("n"))).alias("gap"))
    rates = sound.join(counts, "ccy", "left").na.fill(0, ["invalid", "gap"])
    cash = native_cash(accounts(trades), tables.flows(spark, sf_dir)).join(refused_books(trades), "book", "left_anti").withColumnRenamed("cash", "amount")
    foreign = market.calendar_fill(market.with_base(given).where("ccy <> 'USD'"), "ccy", "d", "rate")
    returns = risk.daily_returns(spark, sf_dir, prices).select("ticker", "d", "r").unionByName(market.returns(foreign, "ccy", "d", "rate").select(F.concat(F.lit("CASH:"), "ccy").alias("ticker"), "d", "r"))
    required = held.select("book", "ticker").unionByName(cash.where("ccy <> 'USD' and abs(amount) > 1e-12").select("book", F.concat(F.lit("CASH:"), "ccy").alias("ticker"))).distinct()
    books = p.groupBy("book").agg(F.sum("value").alias("net"))
    equity = F.coalesce("cash", F.lit(0.0)) + F.coalesce("net", F.lit(0.0))
    sample = books.join(cash_of(spark, sf_dir, trades), "book", "left").join(trust.common_days(returns, required), "book", "left")
    sample = sample.select("book", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("common", F.lit(0)).alias("common"), equity.alias("equity"))
    performance = books.select("book", (F.col("book") % 3 == 0).alias("available"))
    return trust.diagnose(held, last, rates, cash, stage_table(sample, "sample"), performance, AS_OF)


@query(SQL + """
, f AS (SELECT book, bool_or(code IN ('price_missing', 'fx_missing_invalid', 'fx_stale', 'fx_future')) AS blocked, bool_or(code LIKE 'price%' OR code IN ('currency_assumed', 'fx_missing_invalid', 'fx_stale', 'fx_future')) AS v, bool_or(code LIKE 'price%' OR code LIKE 'fx%' OR code = 'currency_assumed') AS p,
  bool_or(code IN ('price_date_unknown', 'price_future', 'price_stale', 'fx_history_invalid', 'fx_history_gap', 'currency_assumed', 'risk_coverage', 'risk_short_sample')) AS r, bool_or(code = 'risk_coverage') AS u, bool_or(code = 'account_performance_unavailable') AS a FROM told GROUP BY book)
SELECT book, CASE WHEN blocked THEN 'blocked' WHEN v THEN 'warning' ELSE 'checked' END AS valuation, CASE WHEN blocked OR u THEN 'unavailable' WHEN r THEN 'limited' ELSE 'checked' END AS risk,
  CASE WHEN blocked OR a THEN 'unavailable' WHEN p THEN 'warning' ELSE 'checked' END AS performance FROM books LEFT JOIN f USING (book)
""")
def fin15_trust_statuses(spark, sf_dir):
    """Whether valuation, risk and account performance of each book may be relied on."""
    return _diagnosed(spark, sf_dir)[1]


@query(SQL + " SELECT code, count(*) AS n, count(DISTINCT book) AS books FROM told GROUP BY code")
def dq10_fin15_issues(spark, sf_dir):
    """How often each issue is met, ages of prices and rates included."""
    return _diagnosed(spark, sf_dir)[0].groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("book").alias("books"))
