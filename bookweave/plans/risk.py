"""Queries on prices, rates, returns and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweave.operators import blocks, market
from bookweave.plans.registry import query, rounded
from bookweave.plans.scratch import stage_table
from bookweave.plans.valuation import FOLD, value_positions
from bookweave.sources import tables

FXALL = """
, fxall AS (
  SELECT ccy, d, rate FROM fx UNION ALL SELECT 'GBX', d, rate / 100 FROM fx WHERE ccy = 'GBP'
)"""
FILLED = """
, span AS (SELECT ticker, min(d) AS a, max(d) AS z FROM price GROUP BY ticker
), grid AS (
  SELECT ticker, CAST(g AS DATE) AS d FROM span, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS t(g)
), filled AS (
  SELECT g.ticker, g.d, last_value(p.px IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.d ROWS UNBOUNDED PRECEDING) AS px, p.px IS NOT NULL AS observed
  FROM grid g LEFT JOIN price p ON p.ticker = g.ticker AND p.d = g.d
), cal AS (SELECT * FROM filled WHERE isodow(d) < 6
)"""
RETURNS = FILLED + """
, ret AS (
  SELECT ticker, d, px / lag(px) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM cal
), good AS (SELECT * FROM ret WHERE r IS NOT NULL
)"""


def daily_returns(spark, sf_dir, prices: DataFrame | None = None) -> DataFrame:
    """Returns of every ticker over its own business-day calendar, prices filled forward; prices: where they are there already."""
    return market.returns(market.calendar_fill(tables.prices(spark, sf_dir) if prices is None else prices, "ticker", "d", "px"))


@query(FXALL + """
SELECT t.book, t.seq, t.ticker, CAST(t.d AS VARCHAR) AS d, s.ccy, round(f.rate, 6) AS rate
FROM trade t JOIN security s USING (ticker) ASOF LEFT JOIN fxall f ON f.ccy = s.ccy AND f.d <= t.d
""")
def jn1_fx_as_of_trade(spark, sf_dir):
    t = tables.trades(spark, sf_dir).join(tables.securities(spark, sf_dir).select("ticker", "ccy"), "ticker").select("book", "seq", "ticker", "d", "ccy")
    return rounded(market.as_of(t, market.with_base(tables.fx(spark, sf_dir)), "ccy", "d", "rate"), 6)


@query(FXALL + """
, days AS (SELECT DISTINCT d FROM price), c AS (SELECT DISTINCT ccy FROM fxall)
SELECT g.ccy, CAST(g.d AS VARCHAR) AS d, round(f.rate, 6) AS rate FROM (SELECT days.d, c.ccy FROM days, c) g ASOF LEFT JOIN fxall f ON f.ccy = g.ccy AND f.d <= g.d
""")
def jn2_aligned_fx(spark, sf_dir):
    fx = market.with_base(tables.fx(spark, sf_dir))
    codes = F.explode(F.array(*(F.lit(c) for c, _ in tables.CURRENCIES)))
    grid = tables.prices(spark, sf_dir).select("d").distinct().select("d", codes.alias("ccy"))
    return rounded(market.as_of(grid, fx, "ccy", "d", "rate").select("ccy", "d", "rate"), 6)


@query(FXALL + """
SELECT ccy, round(arg_max(rate, d), 6) AS rate, CAST(max(d) AS VARCHAR) AS d FROM fxall GROUP BY ccy
""")
def jn3_latest_fx(spark, sf_dir):
    return rounded(market.latest(market.with_base(tables.fx(spark, sf_dir)), "ccy", "d", "rate"), 6)


@query("""
, direct AS (SELECT * FROM fx WHERE ccy <> 'EUR'), reverse AS (SELECT ccy, d, 1 / rate AS rate FROM fx WHERE ccy IN ('EUR', 'GBP'))
SELECT ccy, CAST(d AS VARCHAR) AS d, round(rate, 6) AS rate FROM direct
UNION ALL SELECT ccy, CAST(d AS VARCHAR), round(1 / rate, 6) FROM reverse WHERE ccy = 'EUR'
""")
def src6_inverted_fx(spark, sf_dir):
    fx = tables.fx(spark, sf_dir)
    reverse = fx.where("ccy in ('EUR', 'GBP')").withColumn("rate", 1 / F.col("rate"))
    return rounded(market.invert_missing(fx.where("ccy <> 'EUR'"), reverse), 6)


@query("""
, p AS (SELECT ticker, arg_max(px, d) AS px FROM price WHERE ticker NOT LIKE '%3' GROUP BY ticker), u AS (SELECT ticker, avg(px) AS px FROM trade WHERE ticker LIKE '%3' AND ticker NOT LIKE '%33' GROUP BY ticker)
SELECT s.ticker, round(coalesce(p.px, u.px), 4) AS px, CASE WHEN p.px IS NOT NULL THEN 'market' WHEN u.px IS NOT NULL THEN 'user' ELSE 'missing' END AS price_source
FROM security s LEFT JOIN p USING (ticker) LEFT JOIN u ON u.ticker = s.ticker
""")
def jn4_resolved_prices(spark, sf_dir):
    from bookweave.plans.valuation import resolve_prices

    latest = market.latest(tables.prices(spark, sf_dir).where("ticker not like '%3'"), "ticker", "d", "px")
    given = tables.trades(spark, sf_dir).where("ticker like '%3' and ticker not like '%33'").groupBy("ticker").agg(F.avg("px").alias("px"))
    return rounded(resolve_prices(tables.securities(spark, sf_dir).select("ticker"), latest, given))


@query(FXALL + """
SELECT p.ticker, CAST(p.d AS VARCHAR) AS d, round(p.px * f.rate, 4) AS px FROM price p JOIN security USING (ticker) ASOF JOIN fxall f ON f.ccy = security.ccy AND f.d <= p.d WHERE isodow(p.d) < 6
""")
def jn5_base_prices(spark, sf_dir):
    p = tables.prices(spark, sf_dir).where(F.weekday("d") < 5).join(tables.securities(spark, sf_dir).select("ticker", "ccy"), "ticker")
    p = market.as_of(p, market.with_base(tables.fx(spark, sf_dir)), "ccy", "d", "rate").where("rate is not null")
    return rounded(p.select("ticker", "d", (F.col("px") * F.col("rate")).alias("px")))


@query(FILLED + " SELECT ticker, CAST(d AS VARCHAR) AS d, round(px, 4) AS px, observed FROM cal")
def jn6_calendar(spark, sf_dir):
    return rounded(market.calendar_fill(tables.prices(spark, sf_dir), "ticker", "d", "px"))


@query(RETURNS + """
, w AS (SELECT ticker, d, r, product(1 + r) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) AS wealth FROM good)
SELECT ticker, CAST(d AS VARCHAR) AS d, round(r, 6) AS r, round(wealth, 6) AS wealth,
  round(wealth / greatest(1, max(wealth) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1, 6) AS drawdown FROM w
""")
def win1_win2_win3_path(spark, sf_dir):
    return rounded(market.wealth(daily_returns(spark, sf_dir), "ticker").select("ticker", "d", "r", "wealth", "drawdown"), 6)


@query(RETURNS + """
, c AS (SELECT ticker, quantile_cont(r, 0.05) AS cut FROM good GROUP BY ticker
), w AS (SELECT ticker, d, r, product(1 + r) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) AS wealth FROM good
), dd AS (SELECT *, wealth / greatest(1, max(wealth) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1 AS x FROM w)
SELECT ticker, count(r) AS n, round(avg(r) * 252, 4) AS annual_return, round(stddev_samp(r) * sqrt(252), 4) AS volatility,
  round((avg(r) - (pow(1.02, 1.0 / 252) - 1)) * sqrt(252) / stddev_samp(r), 4) AS sharpe, round(greatest(0, -min(cut)), 4) AS var,
  round(greatest(0, -avg(CASE WHEN r <= cut THEN r END)), 4) AS es, round(CASE WHEN min(r) > -1 THEN product(1 + r) - 1 END, 4) AS growth, round(CASE WHEN min(r) > -1 THEN min(x) END, 4) AS max_drawdown, min(r) > -1 AS compounds
FROM dd JOIN c USING (ticker) GROUP BY ticker
""")
def agg5_agg6_asset_metrics(spark, sf_dir):
    return rounded(market.series_metrics(daily_returns(spark, sf_dir), "ticker", rf=0.02))


@query(RETURNS + """
SELECT a.ticker AS i, b.ticker AS j, count(*) AS n, round(CASE WHEN stddev_samp(a.r) * stddev_samp(b.r) <> 0 THEN covar_samp(a.r, b.r) / (stddev_samp(a.r) * stddev_samp(b.r)) END, 4) AS corr
FROM good a JOIN good b ON a.d = b.d GROUP BY a.ticker, b.ticker
""")
def agg7_correlation(spark, sf_dir):
    return rounded(blocks.correlation(stage_table(daily_returns(spark, sf_dir), "returns")))


FULL_DAYS = """
, need AS (SELECT grp, count(*) AS n FROM weights GROUP BY grp
), own AS (SELECT grp, ticker, w, d, r FROM good JOIN weights USING (ticker)
), days AS (SELECT grp, d FROM own JOIN need USING (grp) GROUP BY grp, d, n HAVING count(*) = n
), full_ AS (SELECT own.* FROM own JOIN days USING (grp, d)
)"""
WEIGHTS = """
, weights AS (SELECT ccy AS grp, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY ccy) AS w FROM security
)""" + FULL_DAYS


def equal_weights(spark, sf_dir) -> DataFrame:
    w = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("ccy"))
    return tables.securities(spark, sf_dir).select(F.col("ccy").alias("group"), "ticker", w.alias("w"))


@query(RETURNS + WEIGHTS + """
, cov AS (SELECT a.grp, a.ticker AS i, b.ticker AS j, min(b.w) AS wj, min(a.w) AS wi, covar_samp(a.r, b.r) * 252 AS c FROM full_ a JOIN full_ b ON a.grp = b.grp AND a.d = b.d GROUP BY a.grp, a.ticker, b.ticker
), part AS (SELECT grp, i, min(wi) AS w, sum(c * wj) AS cw FROM cov GROUP BY grp, i
), tot AS (SELECT grp, sum(cw * w) AS v FROM part GROUP BY grp HAVING sum(cw * w) > 0)
SELECT grp AS "group", i AS ticker, round(w, 4) AS w, round(sqrt(v), 4) AS sigma, round(cw / sqrt(v), 4) AS marginal, round(w * cw / sqrt(v), 4) AS component, round(w * cw / v, 4) AS share
FROM part JOIN tot USING (grp)
""")
def agg8_risk_contribution(spark, sf_dir):
    return rounded(market.risk_contribution(stage_table(daily_returns(spark, sf_dir), "returns"), equal_weights(spark, sf_dir)))


def book_returns(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(group, d, r): the weighted return of each group on its complete days."""
    own = market.complete_days(rows.select("ticker", "d", "r"), weights, group="group").join(weights, ["group", "ticker"])
    return own.groupBy("group", "d").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


@query(RETURNS + WEIGHTS + """ SELECT grp AS "group", CAST(d AS VARCHAR) AS d, round(sum(w * r), 6) AS r FROM full_ GROUP BY grp, d """)
def agg9_book_returns(spark, sf_dir):
    return rounded(book_returns(daily_returns(spark, sf_dir), equal_weights(spark, sf_dir)), 6)


@query(RETURNS + """
, n AS (SELECT ticker, count(*) AS n FROM good GROUP BY ticker)
SELECT s.ccy, count(*) AS required, count(*) FILTER (coalesce(n, 0) < 2) AS missing,
  CASE WHEN count(*) FILTER (coalesce(n, 0) < 2) > 0 THEN 'missing returns' WHEN min(n) < 30 THEN 'short history' ELSE 'complete' END AS reason
FROM security s LEFT JOIN n USING (ticker) GROUP BY s.ccy
""")
def agg11_coverage(spark, sf_dir):
    n = daily_returns(spark, sf_dir).where("r is not null").groupBy("ticker").agg(F.count("r").alias("n"))
    s = tables.securities(spark, sf_dir).join(n, "ticker", "left")
    lacking = F.count_if(F.coalesce("n", F.lit(0)) < 2)
    reason = F.when(lacking > 0, "missing returns").when(F.min("n") < 30, "short history").otherwise("complete")
    return s.groupBy("ccy").agg(F.count(F.lit(1)).alias("required"), lacking.alias("missing"), reason.alias("reason"))


ELIGIBLE = RETURNS + """
, k AS (SELECT ticker FROM good WHERE ticker IN (SELECT ticker FROM security) GROUP BY ticker HAVING count(*) >= 30
), common AS (SELECT d FROM good WHERE ticker IN (FROM k) GROUP BY d HAVING count(*) = (SELECT count(*) FROM k)
), full_ AS (SELECT * FROM good WHERE ticker IN (FROM k) AND d IN (FROM common)
)"""
COMBO = ELIGIBLE + """
, combo AS ({members}
), cut AS (SELECT combo, quantile_cont(r, 0.05) AS cut FROM combo GROUP BY combo
), grown AS (SELECT combo, d, sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (PARTITION BY combo ORDER BY d) AS w FROM combo
), down AS (SELECT combo, min(x) AS x FROM (SELECT combo, exp(w - greatest(0, max(w) OVER (PARTITION BY combo ORDER BY d))) - 1 AS x FROM grown) GROUP BY combo
), stat AS (SELECT combo, count(*) AS n, avg(r) * 252 AS annual_return, stddev_samp(r) * sqrt(252) AS volatility, greatest(0, -min(cut)) AS var, greatest(0, -avg(CASE WHEN r <= cut THEN r END)) AS es,
    CASE WHEN min(r) > -1 THEN min(x) END AS max_drawdown
  FROM combo JOIN cut USING (combo) JOIN down USING (combo) GROUP BY combo HAVING count(*) >= 30
)"""
PAIRS = COMBO.format(members="SELECT a.ticker || '+' || b.ticker AS combo, a.d, (a.r + b.r) / 2 AS r FROM full_ a JOIN full_ b ON a.d = b.d AND a.ticker < b.ticker")
TRIPLES = COMBO.format(members="SELECT a.ticker || '+' || b.ticker || '+' || c.ticker AS combo, a.d, (a.r + b.r + c.r) / 3 AS r FROM full_ a JOIN full_ b ON a.d = b.d AND a.ticker < b.ticker JOIN full_ c ON c.d = a.d AND b.ticker < c.ticker")
FOURS = COMBO.format(members="SELECT a.ticker || '+' || b.ticker || '+' || c.ticker || '+' || e.ticker AS combo, a.d, (a.r + b.r + c.r + e.r) / 4 AS r FROM full_ a JOIN full_ b ON a.d = b.d AND a.ticker < b.ticker JOIN full_ c ON c.d = a.d AND b.ticker < c.ticker JOIN full_ e ON e.d = a.d AND c.ticker < e.ticker")
SHOWN = " SELECT combo, n, round(annual_return, 4) AS annual_return, round(volatility, 4) AS volatility, round(var, 4) AS var, round(es, 4) AS es, round(max_drawdown, 4) AS max_drawdown FROM stat"


def _risk_of(spark, sf_dir, size: int) -> tuple[DataFrame, dict]:
    return blocks.combination_risk(stage_table(daily_returns(spark, sf_dir), "returns"), tables.securities(spark, sf_dir), size)


def _shown(spark, sf_dir, size: int) -> DataFrame:
    return rounded(_risk_of(spark, sf_dir, size)[0].select("combo", "n", "annual_return", "volatility", "var", "es", "max_drawdown"))


@query(PAIRS + SHOWN)
def jn14_agg18_combination_risk(spark, sf_dir):
    """Risk of all pairs of tickers."""
    return _shown(spark, sf_dir, 2)


@query(TRIPLES + SHOWN)
def agg18_triples(spark, sf_dir):
    """Risk of all combinations of three tickers."""
    return _shown(spark, sf_dir, 3)


@query(FOURS + SHOWN)
def agg18_fours(spark, sf_dir):
    """Risk of all combinations of four tickers."""
    return _shown(spark, sf_dir, 4)


@query(ELIGIBLE + """
, n AS (SELECT count(*) AS n, (SELECT count(*) FROM common) AS c FROM k
), s AS (SELECT size, n, c, CASE size WHEN 2 THEN n * (n - 1) / 2 WHEN 3 THEN n * (n - 1) * (n - 2) / 6 WHEN 4 THEN n * (n - 1) * (n - 2) * (n - 3) / 24 WHEN 9 THEN n * (n - 1) / 2 * (n - 2) / 3 * (n - 3) / 4 * (n - 4) / 5 * (n - 5) / 6 * (n - 6) / 7 * (n - 7) / 8 * (n - 8) / 9 ELSE 0 END AS total
  FROM n, (VALUES (2), (3), (4), (9), (99)) AS v(size))
SELECT size, n AS eligible, CAST(round(total) AS BIGINT) AS candidates, CAST(CASE WHEN size <= n AND total <= 100000 AND c >= 30 THEN total ELSE 0 END AS BIGINT) AS evaluated,
  CAST(CASE WHEN size <= n AND total <= 100000 AND c < 30 THEN total ELSE 0 END AS BIGINT) AS skipped, CASE WHEN size <= n AND total <= 100000 THEN c ELSE 0 END AS common,
  CASE WHEN size > n THEN 'too few eligible tickers' WHEN total > 100000 THEN 'more combinations than the limit' WHEN c < 30 THEN 'too few common days' END AS reason FROM s
""")
def agg18_coverage(spark, sf_dir):
    """For sizes of combinations: how many there are, are evaluated or skipped, and why not."""
    returns = stage_table(daily_returns(spark, sf_dir), "returns")
    told = [blocks.combination_risk(returns, tables.securities(spark, sf_dir), size)[1] for size in (2, 3, 4, 9, 99)]
    return spark.createDataFrame([tuple(t.values()) for t in told], "size int, eligible long, candidates long, evaluated long, skipped long, common long, reason string")


@query(PAIRS + " SELECT arg_min(combo, (volatility, combo)) AS calmest, arg_min(combo, (var, combo)) AS least_var, arg_min(combo, (es, combo)) AS least_es, arg_min(combo, (-max_drawdown, combo)) AS least_drawdown, arg_min(combo, (-es, combo)) AS worst_es FROM stat")
def srt3_best_combinations(spark, sf_dir):
    """The pair of least volatility, VaR, expected shortfall and drawdown, and that of most expected shortfall; ties to the first by name."""
    c = _risk_of(spark, sf_dir, 2)[0]
    pick = lambda x: F.min_by("combo", F.struct(x, "combo"))
    return c.agg(pick("volatility").alias("calmest"), pick("var").alias("least_var"), pick("es").alias("least_es"), F.min_by("combo", F.when(F.col("max_drawdown").isNotNull(), F.struct(-F.col("max_drawdown"), "combo"))).alias("least_drawdown"), pick(-F.col("es")).alias("worst_es"))


@query(PAIRS + " SELECT combo, round(volatility, 4) AS volatility FROM stat ORDER BY stat.volatility, combo LIMIT 20")
def srt4_ranked_combinations(spark, sf_dir):
    c = _risk_of(spark, sf_dir, 2)[0].orderBy("volatility", "combo").limit(20)
    return rounded(c.select("combo", "volatility"))


@query(PAIRS + " SELECT split_part(combo, '+', 1) AS a, split_part(combo, '+', 2) AS b, round(es, 4) AS es FROM stat UNION ALL SELECT split_part(combo, '+', 2), split_part(combo, '+', 1), round(es, 4) FROM stat")
def pub4_pair_matrix(spark, sf_dir):
    ends = F.split("combo", r"\+")
    one = _risk_of(spark, sf_dir, 2)[0].select(ends[0].alias("a"), ends[1].alias("b"), "es")
    return rounded(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "es")))


def month_growth(rows: DataFrame, key: str = "ticker") -> DataFrame:
    """Compounded return per key and month, each key's first and last month left out."""
    m = rows.where("r is not null").groupBy(key, F.trunc("d", "MM").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("r"))
    ends = m.groupBy(key).agg(F.min("month").alias("a"), F.max("month").alias("z"))
    return m.join(ends, key).where("month > a and month < z").select(key, "month", "r")


def rate_changes(rates: DataFrame) -> DataFrame:
    """Difference to the month before only; a gap gives null."""
    before = rates.select(F.add_months("month", 1).alias("month"), F.col("level").alias("before"))
    return rates.join(before, "month", "left").select("month", "level", (F.col("level") - F.col("before")).alias("change"))


MONTHS = RETURNS + """
, m AS (SELECT ticker, date_trunc('month', d)::DATE AS month, product(1 + r) - 1 AS r FROM good GROUP BY ALL
), mm AS (SELECT * FROM m QUALIFY month > min(month) OVER (PARTITION BY ticker) AND month < max(month) OVER (PARTITION BY ticker)
), level AS (SELECT * FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*)::DOUBLE / 10 AS level FROM orders GROUP BY 1) WHERE month <> DATE '1997-07-01'
), ch AS (SELECT month, level, CASE WHEN lag(month) OVER (ORDER BY month) + INTERVAL 1 MONTH = month THEN level - lag(level) OVER (ORDER BY month) END AS change FROM level
), j AS (SELECT ticker, mm.month, r, level, change FROM mm JOIN ch USING (month) WHERE r IS NOT NULL AND level IS NOT NULL AND change IS NOT NULL
)"""


def monthly(spark, sf_dir) -> DataFrame:
    level = tables.load(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg((F.count(F.lit(1)) / 10).alias("level"))
    level = level.where("month <> date'1997-07-01'")
    return month_growth(daily_returns(spark, sf_dir)).join(rate_changes(level), "month").where("r is not null and level is not null and change is not null")


@query(MONTHS + " SELECT ticker, CAST(month AS VARCHAR) AS month, round(r, 4) AS r, round(level, 4) AS level, round(change, 4) AS change FROM j")
def jn11_win9_monthly(spark, sf_dir):
    return rounded(monthly(spark, sf_dir).select("ticker", "month", "r", "level", "change"))


@query(MONTHS + " SELECT ticker, count(*) AS n, round(CASE WHEN count(*) >= 12 THEN corr(r, change) END, 4) AS corr FROM j GROUP BY ticker")
def agg17_monthly_correlation(spark, sf_dir):
    c = F.try_divide(F.covar_samp("r", "change"), F.stddev_samp("r") * F.stddev_samp("change"))
    return rounded(monthly(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 12, c).alias("corr")))


@query("""
, f AS (SELECT ccy, d, CASE WHEN day(d) = 14 THEN -1.0 ELSE rate END AS rate FROM fx
), v AS (SELECT *, d - lag(d) OVER (PARTITION BY ccy ORDER BY d) AS gap FROM f WHERE rate > 0
), g AS (SELECT ccy, max(gap) AS longest_gap FROM v GROUP BY ccy)
SELECT f.ccy, CAST(max(d) AS VARCHAR) AS last_day, round(arg_max(rate, d), 6) AS last_rate, count(*) FILTER (rate <= 0) AS invalid,
  array_to_string((list(CAST(d AS VARCHAR) ORDER BY d) FILTER (rate <= 0))[1:5], ',') AS first_invalid, min(longest_gap) AS longest_gap FROM f JOIN g USING (ccy) GROUP BY f.ccy
""")
def agg19_fx_observations(spark, sf_dir):
    f = tables.fx(spark, sf_dir).withColumn("rate", F.when(F.dayofmonth("d") == 14, -1.0).otherwise(F.col("rate")))
    bad = F.col("rate") <= 0
    seen = f.groupBy("ccy").agg(
        F.max("d").alias("last_day"), F.max_by("rate", "d").alias("last_rate"), F.count_if(bad).alias("invalid"),
        F.array_join(F.slice(F.sort_array(F.collect_list(F.when(bad, F.col("d").cast("string")))), 1, 5), ",").alias("first_invalid"),
    )
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("ccy").orderBy("d")))
    gaps = f.where("rate > 0").withColumn("gap", gap).groupBy("ccy").agg(F.max("gap").cast("long").alias("longest_gap"))
    return rounded(seen.join(gaps, "ccy"), 6)


@query(RETURNS + """
, w AS (SELECT ticker, d, product(1 + r) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) * 100 AS growth FROM good WHERE d > DATE '2001-06-30')
SELECT ticker, CAST(d AS VARCHAR) AS d, round(growth, 4) AS growth FROM w UNION ALL SELECT ticker, CAST(min(d) - 1 AS VARCHAR), 100.0 FROM w GROUP BY ticker
""")
def win11_win12_indexed_growth(spark, sf_dir):
    """Growth since a day, from a base point of 100 the day before the first return."""
    w = market.wealth(daily_returns(spark, sf_dir).where("d > date'2001-06-30'"), "ticker").select("ticker", "d", (F.col("wealth") * 100).alias("growth"))
    base = w.groupBy("ticker").agg(F.date_sub(F.min("d"), 1).alias("d"), F.lit(100.0).alias("growth"))
    return rounded(w.unionByName(base))


@query("""
, split AS (SELECT ticker, DATE '1999-03-01' AS d, 2.0::DOUBLE AS ratio FROM security UNION ALL SELECT ticker, DATE '2000-03-01', 4.0 FROM security)
SELECT p.ticker, CAST(p.d AS VARCHAR) AS d, round(p.px * coalesce((SELECT product(ratio) FROM split s WHERE s.ticker = p.ticker AND s.d > p.d), 1), 4) AS px FROM price p
""")
def win10_split_restored_prices(spark, sf_dir):
    days = F.explode(F.array(*(F.struct(F.to_date(F.lit(d)).alias("d"), F.lit(r).alias("ratio")) for d, r in (("1999-03-01", 2.0), ("2000-03-01", 4.0)))))
    splits = tables.securities(spark, sf_dir).select("ticker", days.alias("x")).select("ticker", "x.d", "x.ratio")
    later = Window.partitionBy("ticker").orderBy(F.desc("d"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = tables.prices(spark, sf_dir).withColumns({"ratio": F.lit(1.0), "kind": F.lit(0)}).unionByName(splits.withColumns({"px": F.lit(None).cast("double"), "kind": F.lit(1)}))
    f = F.coalesce(F.product("ratio").over(later), F.lit(1.0))
    return rounded(both.withColumn("px", F.col("px") * f).where("kind = 0").select("ticker", "d", "px"))


def risk_for_display(value: Column, covered: Column) -> Column:
    """The value where it is covered, finite and not negative."""
    return F.when(covered & market.finite(value) & (value >= 0), value)


@query(RETURNS + " SELECT ticker, round(CASE WHEN count(*) >= 500 THEN stddev_samp(r) END, 6) AS shown FROM good GROUP BY ticker")
def prj11_risk_for_display(spark, sf_dir):
    m = daily_returns(spark, sf_dir).where("r is not null").groupBy("ticker").agg(F.stddev_samp("r").alias("s"), F.count("r").alias("n"))
    return rounded(m.select("ticker", risk_for_display(F.col("s"), F.col("n") >= 500).alias("shown")), 6)


@query(FOLD + """
, need AS (SELECT DISTINCT ccy FROM pos JOIN security USING (ticker) WHERE qty <> 0 AND ccy <> 'USD'), have AS (SELECT DISTINCT ccy FROM fx)
SELECT ccy, ccy IN (FROM have) OR ccy = 'GBX' AS covered FROM need
""")
def set2_required_currencies(spark, sf_dir):
    need = value_positions(spark, sf_dir).where("qty <> 0 and ccy <> 'USD'").select("ccy").distinct()
    have = market.with_base(tables.fx(spark, sf_dir)).select("ccy", F.lit(True).alias("h")).distinct()
    return need.join(have, "ccy", "left").select("ccy", F.col("h").isNotNull().alias("covered"))


@query("""
, given AS (SELECT ccy, d, rate * 1.01 AS rate FROM fx WHERE day(d) = 2)
SELECT ccy, CAST(d AS VARCHAR) AS d, round(arg_min(rate, p), 6) AS rate FROM (SELECT *, 1 AS p FROM fx UNION ALL SELECT *, 0 FROM given) GROUP BY ccy, d
""")
def set4_fx_overrides(spark, sf_dir):
    fx = tables.fx(spark, sf_dir)
    given = fx.where(F.dayofmonth("d") == 2).withColumn("rate", F.col("rate") * 1.01)
    both = fx.withColumn("p", F.lit(1)).unionByName(given.withColumn("p", F.lit(0)))
    return rounded(both.groupBy("ccy", "d").agg(F.min_by("rate", "p").alias("rate")), 6)


@query(" SELECT book, seq, CAST(d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS VARCHAR) AS d FROM flow")
def scl7_next_business_day(spark, sf_dir):
    return rounded(tables.flows(spark, sf_dir).select("book", "seq", market.next_business_day("d").alias("d")))
