"""As-of prices and rates, calendars, returns and risk figures over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweave.operators import blocks


def finite(x: str | Column, positive: bool = False) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return good & (x > 0) if positive else good


def with_base(fx: DataFrame, base: str = "USD") -> DataFrame:
    """Rates with the base at 1 and pence at a hundredth of the pound; bad rates are left out."""
    good = fx.where(finite("rate", True)).select("ccy", "d", "rate")
    ones = good.select("d").distinct().select(F.lit(base).alias("ccy"), "d", F.lit(1.0).alias("rate"))
    pence = good.where("ccy = 'GBP'").select(F.lit("GBX").alias("ccy"), "d", (F.col("rate") / 100).alias("rate"))
    return good.where((F.col("ccy") != base) & (F.col("ccy") != "GBX")).unionByName(ones).unionByName(pence)


def invert_missing(direct: DataFrame, reverse: DataFrame) -> DataFrame:
    """Direct rates, and 1 / rate of the reversed pair for currencies that have no direct one."""
    flipped = reverse.where(finite("rate", True)).join(direct.select("ccy").distinct(), "ccy", "left_anti")
    return direct.select("ccy", "d", "rate").unionByName(flipped.select("ccy", "d", (1 / F.col("rate")).alias("rate")))


def as_of(left: DataFrame, right: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """left with the last value of right on or before its day; null where there is none.

    Only the different (key, day) of left are sorted with right, for a running last value;
    left itself then meets them in an equi-join on both, so a few keys make no few tasks. Of
    several values of one key and day the largest counts. left's own column of that name is
    replaced; a null key or day has no value.
    """
    left = left.drop(value)
    r = right.where(finite(value, True)).groupBy(key, day).agg(F.max(value).alias("_v"))
    asked = left.select(key, day).where(F.col(key).isNotNull() & F.col(day).isNotNull()).distinct()
    both = asked.withColumns({"_v": F.lit(None).cast("double"), "_side": F.lit(1)}).unionByName(r.withColumn("_side", F.lit(0)))
    run = Window.partitionBy(key).orderBy(day, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumn(value, F.last("_v", ignorenulls=True).over(run)).where("_side = 1").select(key, day, value)
    return left.join(told, [key, day], "left").select(*left.columns, value)


def fx_issues(fx: DataFrame, most_days: int) -> DataFrame:
    """(ccy, code, n): how many rates of a currency are not valid, and its longest gap between valid ones where over most_days."""
    bad = fx.where(~F.coalesce(finite("rate", True), F.lit(False))).groupBy("ccy").agg(F.count(F.lit(1)).alias("n"))
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("ccy").orderBy("d")))
    gaps = fx.where(finite("rate", True)).withColumn("gap", gap).groupBy("ccy").agg(F.max("gap").cast("long").alias("n")).where(F.col("n") > most_days)
    return bad.select("ccy", F.lit("invalid history").alias("code"), "n").unionByName(gaps.select("ccy", F.lit("history gap").alias("code"), "n"))


def latest(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Last good value per key, with its day."""
    return rows.where(finite(value)).groupBy(key).agg(F.max_by(value, day).alias(value), F.max(day).alias(day))


def next_business_day(d: str | Column) -> Column:
    """Saturday and Sunday move to Monday."""
    return F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))


def calendar_fill(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Each key on every business day from its first to its last row, the value filled forward."""
    span = rows.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("z"))
    grid = span.select(key, F.explode(F.sequence("a", "z")).alias(day)).where(F.weekday(day) < 5)
    run = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = grid.join(rows.select(key, day, value, F.lit(True).alias("_own")), [key, day], "full")
    filled = joined.withColumn(value, F.last(value, ignorenulls=True).over(run))
    return filled.where(F.weekday(day) < 5).select(key, day, value, F.coalesce("_own", F.lit(False)).alias("observed"))


def returns(rows: DataFrame, key: str = "ticker", day: str = "d", value: str = "px") -> DataFrame:
    """Simple return to the row before; null where either side is missing or the result is not finite."""
    order = Window.partitionBy(key).orderBy(day)
    r = F.try_divide(F.col(value), F.lag(value).over(order)) - 1
    return rows.withColumn("r", r).withColumn("r", F.when(finite("r"), F.col("r")))


def wealth(rows: DataFrame, key: str, day: str = "d", r: str = "r") -> DataFrame:
    """Cumulative wealth and its drawdown; the starting capital of 1 counts as a peak. From a return of -1 or less on, wealth is not positive and compounds no more: series_metrics withholds such paths."""
    run = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = rows.where(F.col(r).isNotNull()).withColumn("wealth", F.product(1 + F.col(r)).over(run))
    return w.withColumn("drawdown", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(run)) - 1)


def daily_rate(annual: float) -> float:
    if not annual > -1:
        raise ValueError("the annual rate must be above -1")
    return (1 + annual) ** (1 / 252) - 1


def series_metrics(rows: DataFrame, key: str, day: str = "d", r: str = "r", rf: float = 0.0, level: float = 0.95) -> DataFrame:
    """Per key: n, annual return and volatility, Sharpe ratio, VaR, expected shortfall, growth, drawdown.

    VaR is the negated linear quantile at 1 - level, expected shortfall the negated mean of
    the returns at or below it, both at least zero. Growth and drawdown are null where a
    return is -1 or less.
    """
    good = wealth(rows.select(key, day, F.col(r).alias("r")), key, day)
    cut = good.groupBy(key).agg(F.percentile("r", 1 - level).alias("cut"))
    joined = good.join(cut, key)
    excess = F.avg("r") - daily_rate(rf)
    floor = lambda x: F.greatest(F.lit(0.0), x)
    return joined.groupBy(key).agg(
        F.count("r").alias("n"),
        (F.avg("r") * 252).alias("annual_return"),
        (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("volatility"),
        F.try_divide(excess * F.sqrt(F.lit(252.0)), F.stddev_samp("r")).alias("sharpe"),
        floor(-F.first("cut")).alias("var"),
        floor(-F.avg(F.when(F.col("r") <= F.col("cut"), F.col("r")))).alias("es"),
        F.when(F.min("r") > -1, F.product(1 + F.col("r")) - 1).alias("growth"),
        F.when(F.min("r") > -1, F.min("drawdown")).alias("max_drawdown"),
        (F.min("r") > -1).alias("compounds"),
    )


def complete_days(rows: DataFrame, keys: DataFrame, key: str = "ticker", day: str = "d", r: str = "r", group: str | None = None) -> DataFrame:
    """rows of the days on which every one of keys has a return; by group, each with keys of its own."""
    by = [group] if group else []
    n = keys.groupBy(*by).agg(F.count_distinct(key).alias("_n")) if by else keys.agg(F.count_distinct(key).alias("_n"))
    own = rows.where(F.col(r).isNotNull()).join(keys.select(*by, key).distinct(), key)
    days = own.groupBy(*by, day).agg(F.count(F.lit(1)).alias("_have"))
    full = (days.join(n, by) if by else days.join(F.broadcast(n))).where("_have = _n").select(*by, day)
    return own.join(full, [*by, day])


def risk_contribution(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(group, ticker): sigma, marginal, component and share of risk, from the annual covariance on complete days.

    weights: (group, ticker, w), one row each. A group whose variance is not positive has no rows.
    """
    own = complete_days(rows.select("ticker", "d", "r"), weights, group="group").select("group", "d", "ticker", "r")
    cov = blocks.pair_sums(own, ("group",)).select("group", "i", "j", (blocks.covariance() * 252).alias("c"))
    w = weights.select("group", F.col("ticker").alias("j"), "w")
    part = cov.join(w, ["group", "j"]).groupBy("group", "i").agg(F.sum(F.col("c") * F.col("w")).alias("cw"))
    part = part.join(weights.select("group", F.col("ticker").alias("i"), "w"), ["group", "i"])
    total = part.groupBy("group").agg(F.sum(F.col("cw") * F.col("w")).alias("variance")).where("variance > 0")
    sigma = F.sqrt("variance")
    return part.join(total, "group").select(
        "group", F.col("i").alias("ticker"), "w", sigma.alias("sigma"), (F.col("cw") / sigma).alias("marginal"),
        (F.col("w") * F.col("cw") / sigma).alias("component"), (F.col("w") * F.col("cw") / F.col("variance")).alias("share"),
    )
