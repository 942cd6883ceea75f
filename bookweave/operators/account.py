"""Daily account paths of many books, and the attribution of their returns.

A position is a few runs: a quantity from one day to the next change. Runs meet the marks
of their ticker in months, so each day held makes one product and no grid of books,
tickers and days is sorted or shuffled. Cash in a currency is a position of its own,
`CASH:` and the currency, whose mark is its rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookweave.operators import market

#: Least equity that a return divides by.
LEAST = 1e-12
OUTSIDE = "external"


def marks(prices: DataFrame, rates: DataFrame, securities: DataFrame, events: DataFrame, base: str = "USD") -> DataFrame:
    """(ticker, m, d, mark) in the base currency on every business day from the first event (d) to the last weekday price.

    Prices of weekends are left out; prices and rates hold until the next one. A day before
    the first price or rate has a null mark. CASH:ccy has the rates of each currency, the
    base is 1 on all days.
    """
    weekday = prices.where(market.finite("px") & (F.weekday("d") < 5)).select("ticker", "d", "px")
    span = weekday.agg(F.max("d").alias("z")).crossJoin(events.agg(F.min("d").alias("a")))  # one row
    days = F.filter(F.sequence("a", "z"), lambda d: F.weekday(d) < 5)
    currencies = rates.select("ccy").distinct().where(F.col("ccy") != base).unionByName(span.select(F.lit(base).alias("ccy")))
    quoted = securities.select("ticker", "ccy").unionByName(currencies.select(F.concat(F.lit("CASH:"), "ccy").alias("ticker"), "ccy"))
    grid = quoted.crossJoin(F.broadcast(span.where("a <= z"))).select("ticker", "ccy", F.explode(days).alias("d"))  # span is one row
    grid = market.as_of(grid, weekday, "ticker", "d", "px")
    grid = market.as_of(grid, rates, "ccy", "d", "rate")
    px = F.when(F.col("ticker").startswith("CASH:"), 1.0).otherwise(F.col("px"))
    rate = F.when(F.col("ccy") == base, 1.0).otherwise(F.col("rate"))
    return grid.select("ticker", F.trunc("d", "MM").alias("m"), "d", (px * rate).alias("mark"))


def runs(changes: DataFrame) -> DataFrame:
    """(book, ticker, from, until, qty) of (book, ticker, d, q): the quantity from each day of change to the day before the next.

    until is null where nothing follows. Changes of a day are summed before the shuffle, so
    a book of many trades has at most tickers by days rows. Runs of nothing are left out,
    but for CASH:USD, which so covers every day of a book.
    """
    daily = changes.groupBy("book", "ticker", "d").agg(F.sum("q").alias("q")).repartition("book")
    order = Window.partitionBy("book", "ticker").orderBy("d")
    qty = F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = daily.select("book", "ticker", F.col("d").alias("from"), F.lead("d").over(order).alias("until"), F.when(F.abs(qty) <= 1e-15, 0.0).otherwise(qty).alias("qty"))
    return r.where((F.col("qty") != 0) | (F.col("ticker") == "CASH:USD"))


def by_month(own: DataFrame, end: DataFrame) -> DataFrame:
    """runs once for each month that they touch, up to the last day of marks."""
    last = F.date_sub(F.coalesce("until", F.date_add("z", 1)), 1)
    months = F.sequence(F.trunc("from", "MM"), F.trunc(F.least(last, F.col("z")), "MM"), F.expr("interval 1 month"))
    return own.crossJoin(F.broadcast(end)).where(F.col("from") <= F.col("z")).select("book", "ticker", "from", "until", "qty", F.explode(months).alias("m"))  # end is one row


def _held(own: DataFrame) -> DataFrame:
    return (F.col("d") >= F.col("from")) & (F.col("until").isNull() | (F.col("d") < F.col("until")))


def refusals(trades: DataFrame, flows: DataFrame, worth: DataFrame) -> DataFrame:
    """(book, reason) of books that have no path: the first reason in the order of the code.

    trades and flows on business days; worth: marks. Every currency of a book needs a rate
    from the book's first event on, and no event may fall after the last mark.
    """
    events = trades.select("book", "d", "ccy").unionByName(flows.select("book", "d", F.lit("USD").alias("ccy")))
    per = events.groupBy("book", "ccy").agg(F.min("d").alias("a"), F.max("d").alias("y"))
    known = worth.where(F.col("ticker").startswith("CASH:") & F.col("mark").isNotNull()).groupBy(F.substring("ticker", 6, 10).alias("ccy")).agg(F.min("d").alias("known"))
    per = per.join(known, "ccy", "left")
    per = per.groupBy("book").agg(F.min("a").alias("a"), F.max("y").alias("y"), F.max("known").alias("known"), F.bool_or(F.col("known").isNull()).alias("none"))
    per = per.crossJoin(F.broadcast(worth.agg(F.max("d").alias("z"))))  # one row
    priced = worth.select("ticker", F.lit(True).alias("priced")).distinct()
    traded = trades.select("book", "ticker").distinct().join(priced, "ticker", "left").groupBy("book").agg(F.bool_and(F.coalesce("priced", F.lit(False))).alias("traded"))
    reason = (
        F.when(F.col("traded").isNull(), "no trades")
        .when(~F.col("traded"), "missing prices")
        .when(F.col("y") > F.col("z"), "events after the market history")
        .when(F.col("none") | (F.col("known") > F.col("a")), "incomplete rates")
    )
    return per.join(traded, "book", "left").select("book", reason.alias("reason")).where("reason is not null")


def changes_of(trades: DataFrame, flows: DataFrame) -> DataFrame:
    """(book, ticker, d, q): what trades (book, ticker, ccy, d, q, paid) and flows in USD (book, d, kind, amt) change; external flows are runs of one day."""
    signed = F.when(F.col("kind") == "WITHDRAWAL", -F.col("amt")).otherwise(F.col("amt"))
    cash = trades.select("book", F.concat(F.lit("CASH:"), "ccy").alias("ticker"), "d", F.col("paid").alias("q"))
    given = flows.select("book", F.lit("CASH:USD").alias("ticker"), "d", signed.alias("q"))
    start = trades.select("book", "d").unionByName(flows.select("book", "d")).groupBy("book").agg(F.min("d").alias("d"))
    zero = start.select("book", F.lit("CASH:USD").alias("ticker"), "d", F.lit(0.0).alias("q"))
    return trades.select("book", "ticker", "d", "q").unionByName(cash).unionByName(given).unionByName(zero)


def external_of(flows: DataFrame) -> DataFrame:
    """(book, d, external) of deposits and withdrawals."""
    signed = F.when(F.col("kind") == "WITHDRAWAL", -F.col("amt")).otherwise(F.col("amt"))
    return flows.where("kind <> 'DIVIDEND'").groupBy("book", "d").agg(F.sum(signed).alias("external"))


def daily_path(own: DataFrame, external: DataFrame, worth: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """(book, d, cash, market_value, equity, external, before, r, wealth, drawdown, unmarked) on every business day from a book's first event.

    own: runs; external: (book, d, external) in USD at the end of the day; opening: (book,
    opening), cash that was there before the first day, else 0. r = (V - V' - F) / V', null where V' is not over 1e-12, and then
    as 0 in wealth. drawdown counts the starting capital of 1 as a peak. unmarked: a held
    position has no mark that day. The external flows come in as runs of one day, so the
    path needs no join by day.
    """
    end = worth.agg(F.max("d").alias("z"))
    flow = external.select("book", F.lit(OUTSIDE).alias("ticker"), F.col("d").alias("from"), F.date_add("d", 1).alias("until"), F.col("external").alias("qty"))
    ones = worth.where("ticker = 'CASH:USD'").select(F.lit(OUTSIDE).alias("ticker"), "m", "d", F.lit(1.0).alias("mark"))
    held = by_month(own.unionByName(flow), end).repartition("book").join(worth.unionByName(ones), ["ticker", "m"])
    held = held.where(_held(own))
    cash, flowing = F.col("ticker").startswith("CASH:"), F.col("ticker") == OUTSIDE
    value = F.col("qty") * F.col("mark")
    sum_ = lambda c: F.sum(F.when(c, value).otherwise(0.0))
    path = held.groupBy("book", "d").agg(sum_(cash).alias("cash"), sum_(~cash & ~flowing).alias("market_value"), sum_(flowing).alias("external"), F.bool_or(F.col("mark").isNull()).alias("unmarked"))
    if opening is None:
        path = path.withColumn("opening", F.lit(0.0))
    else:
        path = path.join(opening.select("book", "opening"), "book", "left").fillna(0.0, ["opening"]).withColumn("cash", F.col("cash") + F.col("opening"))
    path = path.withColumn("equity", F.col("cash") + F.col("market_value"))
    order = Window.partitionBy("book").orderBy("d")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = path.withColumn("before", F.coalesce(F.lag("equity").over(order), "opening")).drop("opening")
    path = path.withColumn("r", F.when(F.col("before") > LEAST, (F.col("equity") - F.col("before") - F.col("external")) / F.col("before")))
    path = path.withColumn("wealth", F.product(1 + F.coalesce("r", F.lit(0.0))).over(run))
    return path.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(run)) - 1)


def path_refusals(path: DataFrame) -> DataFrame:
    """(book, reason) of paths that cannot be shown."""
    per = path.groupBy("book").agg(F.bool_or("unmarked").alias("unmarked"), F.min("equity").alias("low"), F.count("r").alias("n"))
    reason = F.when(F.col("unmarked"), "missing marks").when(F.col("low") < 0, "negative equity").when(F.col("n") < 2, "too few valuations")
    return per.select("book", reason.alias("reason")).where("reason is not null")


def segments(path: DataFrame) -> DataFrame:
    """(book, mode, start, end, period_return, reason): the days that each mode attributes.

    `period` takes the whole path; `drawdown` goes from the earliest day of greatest wealth
    up to the trough, which is the earliest day of the deepest drawdown; figures that agree in
    ten places are equal here. The return of the first day does not count. A book has a reason in place of days where a later return is
    null or not above -1, or where the days are fewer than two.
    """
    order = Window.partitionBy("book").orderBy("d")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.row_number().over(order)
    p = path.select("book", "d", F.when(n == 1, 0.0).otherwise(F.col("r")).alias("r"))
    p = p.withColumn("wealth", F.product(1 + F.coalesce("r", F.lit(0.0))).over(run))
    p = p.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(run)) - 1)
    p = p.withColumn("peak", F.max_by("d", F.struct(F.round("wealth", 10), -F.unix_date("d"))).over(run))
    per = p.groupBy("book").agg(
        F.min("d").alias("a"), F.max("d").alias("z"), F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("r").isNull() | (F.col("r") <= -1)).alias("bad"), F.min_by(F.struct(F.col("d").alias("trough"), "peak"), F.struct(F.round("drawdown", 10), "d")).alias("x"),
    )
    both = per.select("book", "n", "bad", F.explode(F.array(F.struct(F.lit("period").alias("mode"), F.col("a").alias("start"), F.col("z").alias("end")), F.struct(F.lit("drawdown").alias("mode"), F.col("x.peak").alias("start"), F.col("x.trough").alias("end")))).alias("s"))
    reason = F.when(F.col("n") < 2, "fewer than two valuations").when(F.col("bad"), "incomplete returns").when(F.col("s.start") == F.col("s.end"), "no interval")
    return both.select("book", "s.*", reason.alias("reason"))


def linked(path: DataFrame, chosen: DataFrame) -> DataFrame:
    """(book, mode, d, m, r, c, g) on the days of the segments: c is what a dollar of gain adds to the return, g what a dollar of value held does.

    c is the wealth before the day over the equity before it, on the days after the first;
    the gain of a day is the change of value and the cash of its trades, so by parts a value
    counts with c of its day less c of the next.
    """
    order = Window.partitionBy("book", "mode").orderBy("d")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    days = path.select("book", "d", "before", "r").join(chosen.where("reason is null").select("book", "mode", "start", "end"), "book").where(F.col("d").between(F.col("start"), F.col("end")))
    first = F.col("d") == F.col("start")
    grown = F.when(first, 1.0).otherwise(1 + F.col("r"))
    days = days.withColumn("c", F.when(first, 0.0).otherwise(F.coalesce(F.product(grown).over(before), F.lit(1.0)) / F.col("before")))
    g = F.col("c") - F.coalesce(F.lead("c").over(order), F.lit(0.0))
    return days.select("book", "mode", "d", F.trunc("d", "MM").alias("m"), F.when(~first, F.col("r")).alias("r"), "c", g.alias("g"))


def contributions(own: DataFrame, trade_cash: DataFrame, worth: DataFrame, weights: DataFrame) -> DataFrame:
    """(book, mode, ticker, contribution) of every position: its daily gains over prior equity, linked by prior wealth.

    own: runs, of which cash is no position; trade_cash: (book, ticker, d, spent) in USD;
    weights: linked. The sums over days are dot products of a month's marks and weights, so
    rows are runs by months.
    """
    held = by_month(own.where(~F.col("ticker").startswith("CASH:")), worth.agg(F.max("d").alias("z")))
    monthly = worth.groupBy("ticker", "m").agg(F.map_from_entries(F.collect_list(F.struct("d", "mark"))).alias("marks"))  # 23 days at most
    days = weights.groupBy("book", "mode", "m").agg(F.collect_list(F.struct("d", "g")).alias("days"))  # 23 days at most
    inside = F.filter("days", lambda x: (x["d"] >= F.col("from")) & (F.col("until").isNull() | (x["d"] < F.col("until"))))
    dot = F.aggregate(inside, F.lit(0.0), lambda a, x: a + x["g"] * F.element_at("marks", x["d"]))
    value = held.join(monthly, ["ticker", "m"]).join(days, ["book", "m"]).select("book", "mode", "ticker", (F.col("qty") * dot).alias("x"))
    paid = trade_cash.groupBy("book", "ticker", "d").agg(F.sum("spent").alias("spent")).join(weights.select("book", "mode", "d", "c"), ["book", "d"]).select("book", "mode", "ticker", (F.col("spent") * F.col("c")).alias("x"))
    return value.unionByName(paid).groupBy("book", "mode", "ticker").agg(F.sum("x").alias("contribution"))
