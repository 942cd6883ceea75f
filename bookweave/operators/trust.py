"""What may be relied on of each book: issues with severity and areas, and three statuses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.plans.scratch import stage_table

# Severity and areas of every issue.
RULES = {
    "price_missing": ("blocker", "valuation allocation risk performance scenarios"),
    "price_date_unknown": ("warning", "valuation risk performance"),
    "price_future": ("warning", "valuation risk performance"),
    "price_stale": ("warning", "valuation risk performance"),
    "fx_missing_invalid": ("blocker", "valuation risk performance scenarios"),
    "fx_date_unknown": ("blocker", "valuation risk performance"),
    "fx_future": ("blocker", "valuation risk performance"),
    "fx_stale": ("blocker", "valuation risk performance"),
    "fx_history_invalid": ("warning", "risk performance"),
    "fx_history_gap": ("warning", "risk performance"),
    "currency_assumed": ("warning", "valuation risk performance"),
    "risk_coverage": ("warning", "risk simulated_performance risk_contribution"),
    "risk_short_sample": ("warning", "risk risk_contribution simulated_performance"),
    "account_performance_unavailable": ("warning", "actual_performance"),
    "no_securities": ("info", "concentration risk"),
}


@dataclass(frozen=True)
class Policy:
    """Calendar days that a rate and a price may be old, and common returns that risk needs."""

    fx_days: int = 5
    price_days: int = 5
    observations: int = 30

    def __post_init__(self) -> None:
        if self.fx_days < 0 or self.price_days < 0 or self.observations < 2:
            raise ValueError("ages are not negative, and risk needs two returns at least")


def _age(day: Column, as_of: str, most: int, kind: str) -> Column:
    """The code of a day's age, null where it is fresh."""
    age = F.datediff(F.to_date(F.lit(as_of)), day)
    return F.when(day.isNull(), f"{kind}_date_unknown").when(age < 0, f"{kind}_future").when(age > most, f"{kind}_stale")


def common_days(returns: DataFrame, required: DataFrame) -> DataFrame:
    """(book, missing, common): tickers of required (book, ticker) with fewer than two returns, and days on which all have one.

    Days are grouped by the tickers that have a return, so a book meets a row for every
    different set of these, not one for every day.
    """
    good = returns.where("r is not null").select("ticker", "d").distinct()
    n = good.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    missing = required.join(F.broadcast(n), "ticker", "left").groupBy("book").agg(F.count_if(F.coalesce("n", F.lit(0)) < 2).alias("missing"), F.collect_set("ticker").alias("own"))  # the tickers of a book
    sets = good.groupBy("d").agg(F.array_sort(F.collect_list("ticker")).alias("present")).groupBy("present").agg(F.count(F.lit(1)).alias("days"))
    all_sets = sets.agg(F.collect_list(F.struct("present", "days")).alias("sets"))  # one row: sets of tickers, days at most
    covered = F.filter("sets", lambda s: F.size(F.array_except("own", s["present"])) == 0)
    return missing.crossJoin(F.broadcast(all_sets)).select("book", "missing", F.aggregate(covered, F.lit(0).cast("long"), lambda a, s: a + s["days"]).alias("common"))


def diagnose(positions: DataFrame, prices: DataFrame, rates: DataFrame, cash: DataFrame, sample: DataFrame, performance: DataFrame, as_of: str, policy: Policy | None = None, base: str = "USD") -> tuple[DataFrame, DataFrame]:
    """(issues, statuses).

    positions: (book, ticker, ccy, px, value, assumed), open ones; prices: (ticker, day) of
    each ticker's own last price; rates: (ccy, rate, day, invalid, gap), the last rate of a
    currency, how many of its history are no rates, and its longest gap in days; cash:
    (book, ccy, amount); sample: (book, missing, common, equity); performance: (book,
    available). Books are those of sample; pence go by the rate of the pound.

    issues: (book, code, severity, areas, about), one row per book, code and what it is
    about (a ticker, a currency, or null). statuses: (book, valuation, risk, performance):
    valuation is `blocked` by a blocker, `warning` by another issue of that area, else
    `checked`; risk is `unavailable` where blocked or not covered, `limited` by a short
    sample or a warning of that area, else `checked`; performance is `unavailable` where
    blocked or without an account path, `warning` by an issue of that area, else `checked`.
    """
    policy = policy or Policy()
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    of = lambda df, code, about: df.select("book", code.alias("code"), about.cast("string").alias("about")).where("code is not null")
    none = F.lit(None)
    p = positions.join(F.broadcast(prices.select("ticker", "day")), "ticker", "left")  # a row per ticker
    priced = finite("px") & (F.col("px") > 0) & finite("value")
    found = of(p, F.when(~priced, "price_missing").otherwise(_age(F.col("day"), as_of, policy.price_days, "price")), F.col("ticker"))
    found = found.unionByName(of(positions.where("assumed").select("book").distinct(), F.lit("currency_assumed"), none))
    needed = positions.select("book", "ccy").unionByName(cash.where(F.abs("amount") > 1e-12).select("book", "ccy")).distinct().where(F.col("ccy") != base)
    quoted = needed.withColumn("pair", F.when(F.col("ccy") == "GBX", "GBP").otherwise(F.col("ccy"))).join(F.broadcast(rates.select(F.col("ccy").alias("pair"), "rate", "day", "invalid", "gap")), "pair", "left")  # a row per currency
    good = finite("rate") & (F.col("rate") > 0)
    found = found.unionByName(of(quoted, F.when(~F.coalesce(good, F.lit(False)), "fx_missing_invalid").otherwise(_age(F.col("day"), as_of, policy.fx_days, "fx")), F.col("ccy")))
    found = found.unionByName(of(quoted, F.when(F.col("invalid") > 0, "fx_history_invalid"), F.col("ccy"))).unionByName(of(quoted, F.when(F.col("gap") > policy.fx_days, "fx_history_gap"), F.col("ccy")))
    covered = (F.col("equity") > 0) & (F.col("missing") == 0) & (F.col("common") >= 2)
    found = found.unionByName(of(sample, F.when(~F.coalesce(covered, F.lit(False)), "risk_coverage").when(F.col("common") < policy.observations, "risk_short_sample"), none))
    paths = sample.select("book").join(performance.select("book", "available"), "book", "left")
    found = found.unionByName(of(paths.where(~F.coalesce("available", F.lit(False))), F.lit("account_performance_unavailable"), none))
    found = found.unionByName(of(sample.select("book").join(positions.select("book").distinct(), "book", "left_anti"), F.lit("no_securities"), none))
    rule = F.element_at(F.create_map(*(F.lit(x) for c, (s, a) in RULES.items() for x in (c, f"{s} {a}"))), F.col("code"))
    words = F.split(rule, " ")
    issues = stage_table(found.select("book", "code", words[0].alias("severity"), F.slice(words, 2, 9).alias("areas"), "about"), "trust")

    has = lambda area: F.array_contains("areas", area)
    folded = issues.groupBy("book").agg(
        F.bool_or((F.col("severity") == "blocker") & has("valuation")).alias("blocked"), F.bool_or(has("valuation")).alias("v"), F.bool_or(has("performance")).alias("p"), F.bool_or((F.col("severity") == "warning") & has("risk")).alias("r"),
        F.bool_or(F.col("code") == "risk_coverage").alias("uncovered"), F.bool_or(F.col("code") == "account_performance_unavailable").alias("pathless"),
    )
    t = sample.select("book").join(folded, "book", "left").na.fill(False)
    return issues, t.select(
        "book",
        F.when(F.col("blocked"), "blocked").when(F.col("v"), "warning").otherwise("checked").alias("valuation"),
        F.when(F.col("blocked") | F.col("uncovered"), "unavailable").when(F.col("r"), "limited").otherwise("checked").alias("risk"),
        F.when(F.col("blocked") | F.col("pathless"), "unavailable").when(F.col("p"), "warning").otherwise("checked").alias("performance"),
    )
