"""Scenario steps over the positions of many books, one DataFrame update per step number.

Positions: scenario, book, ticker, qty, px, avg_cost (null where unknown), realised, cash_change,
duration, sensitivity. Steps: scenario, step, action, ticker, amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.plans.scratch import stage_table

# Actions and the least amount of those that have one; a price shock must be above it.
ACTIONS = {"price_shock": -100.0, "rate_shock": None, "resize": 0.0, "set_quantity": None, "set_exposure": 0.0, "remove": None, "scale": 0.0}


def invalid_steps(steps: DataFrame) -> DataFrame:
    """(scenario, step, reason) of steps that may not run.

    Amounts are finite numbers: percent of a price shock above -100, basis points of a rate
    shock, factors of resize and scale and an exposure from 0 on, any quantity. Nothing
    else bounds them. remove needs no amount.
    """
    known = F.col("action").isin(*ACTIONS)
    lim = F.element_at(F.create_map(*(F.lit(x) for a, b in ACTIONS.items() if b is not None for x in (a, b))), F.col("action"))
    finite = F.col("amount").isNotNull() & ~F.isnan("amount") & (F.abs("amount") < float("inf"))
    needs = ~F.col("action").isin("rate_shock", "scale") & F.col("ticker").isNull()
    reason = (
        F.when(F.col("action").isNull() | ~known, "unknown action").when(~finite & (F.col("action") != "remove"), "amount is not a number")
        .when((F.col("amount") < lim) | ((F.col("action") == "price_shock") & (F.col("amount") <= lim)), "amount out of bounds")
        .when(needs, "no ticker")
    )
    return steps.withColumn("reason", reason).where("reason is not null").select("scenario", "step", "reason")


def valid_steps(steps: DataFrame) -> DataFrame:
    """Steps of the scenarios in which every step is valid."""
    return steps.join(invalid_steps(steps).select("scenario").distinct(), "scenario", "left_anti")


def rate_move(bps: Column) -> Column:
    """Percent move of a price: by its sensitivity, else by minus its duration; null for neither."""
    return F.coalesce(F.col("sensitivity") * bps / 100, -F.col("duration") * bps / 100)


def trade_to(p: DataFrame, target: Column) -> DataFrame:
    """Positions traded at their price to a target quantity: cash, average cost and realised follow."""
    p = p.withColumn("_to", target).withColumn("_dq", F.col("_to") - F.col("qty"))
    against = (F.col("qty") * F.col("_dq") < 0)
    closed = F.least(F.abs("_dq"), F.abs("qty"))
    gain = F.when(against, closed * (F.col("px") - F.col("avg_cost")) * F.signum("qty")).otherwise(0.0)
    flipped = (F.col("qty") == 0) | (F.col("qty") * F.col("_to") < 0)
    added = F.try_divide(F.abs("qty") * F.col("avg_cost") + F.abs("_dq") * F.col("px"), F.abs("_to"))
    cost = F.when(F.col("_dq") == 0, F.col("avg_cost")).when(F.col("_to") == 0, F.lit(None)).when(flipped, F.col("px")).when(against, F.col("avg_cost")).otherwise(added)
    return p.withColumns({"cash_change": F.col("cash_change") - F.col("_dq") * F.col("px"), "realised": F.col("realised") + gain, "avg_cost": cost, "qty": F.col("_to")}).drop("_to", "_dq")


def run(positions: DataFrame, steps: DataFrame, every: int = 4) -> DataFrame:
    """Positions of every (scenario, book) after all its steps.

    positions has no scenario; each valid scenario starts from a copy. A step without a
    ticker meets all positions. Lineage is cut each few steps; the loop is as long as the
    longest scenario, whatever the number of books and scenarios.
    """
    steps = valid_steps(steps).select("scenario", "step", "action", F.col("ticker").alias("_t"), "amount")
    steps = stage_table(steps, "steps")
    p = positions.join(F.broadcast(steps.select("scenario").distinct()))  # scenarios: as many as a user writes
    p = p.withColumn("cash_change", F.lit(0.0))
    last = steps.agg(F.max("step")).first()[0] or 0
    for n in range(1, last + 1):
        now = F.broadcast(steps.where(F.col("step") == n).drop("step"))
        columns = p.columns
        p = p.join(now, (p.scenario == now.scenario) & (now._t.isNull() | (now._t == p.ticker)), "left").select(*(p[c] for c in columns), "action", "amount")
        move = F.when(F.col("action") == "price_shock", F.col("amount")).when(F.col("action") == "rate_shock", rate_move(F.col("amount")))
        p = p.withColumn("px", F.col("px") * (1 + F.coalesce(move, F.lit(0.0)) / 100))
        q, x = F.col("qty"), F.col("amount")
        target = (
            F.when(F.col("action").isin("resize", "scale"), q * x).when(F.col("action") == "set_quantity", x).when(F.col("action") == "remove", 0.0)
            .when(F.col("action") == "set_exposure", F.coalesce(F.try_divide(x * F.signum(q), F.col("px")), q)).otherwise(q)
        )
        p = trade_to(p, F.coalesce(target, q)).select(*columns)
        if n % every == 0:
            p = stage_table(p, "scenario")
    return p


def reallocate(p: DataFrame, source: str, to: str, amount: float) -> DataFrame:
    """Moves a notional from one ticker to another at their prices, in every book that holds both."""
    both = p.groupBy("book").agg(F.bool_or(F.col("ticker") == source).alias("a"), F.bool_or(F.col("ticker") == to).alias("b")).where("a and b").select("book", F.lit(True).alias("_move"))
    p = p.join(both, "book", "left")
    shift = F.when(F.col("ticker") == source, -1.0).when(F.col("ticker") == to, 1.0).otherwise(0.0)
    return trade_to(p, F.when(F.col("_move"), F.col("qty") + F.coalesce(F.try_divide(shift * amount, "px"), F.lit(0.0))).otherwise(F.col("qty"))).drop("_move")


def to_target(state: DataFrame, target: float, leverage: bool = False) -> DataFrame:
    """state (volatility, net, gross, cash, equity) with the factor of all positions that brings it to a volatility, and what it leaves.

    A target above 1 is percent. Refused, with no figures, where the factor is above 1 and
    would need leverage that is not allowed.
    """
    if not target > 0:
        raise ValueError("the target volatility must be positive")
    scale = F.try_divide(F.lit(target / 100 if target > 1 else target), F.col("volatility"))
    s = state.withColumn("scale", scale).withColumns({"cash_after": F.col("cash") - (F.col("scale") - 1) * F.col("net"), "gross_after": F.col("scale") * F.col("gross"), "net_after": F.col("scale") * F.col("net")})
    borrows = (F.col("scale") > 1) & ((F.col("cash_after") < -1e-9) | (F.col("gross_after") > F.col("equity") + 1e-9)) & F.lit(not leverage)
    s = s.withColumn("status", F.when(F.col("scale").isNull(), "refused: no volatility").when(borrows, "refused: needs leverage").otherwise("ok"))
    return s.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("cash_after", "gross_after", "net_after")})


def compare(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match of two states: quantity, price and value before and after."""
    a = before.select(*keys, F.col("qty").alias("qty_before"), F.col("px").alias("px_before"))
    b = after.select(*keys, F.col("qty").alias("qty_after"), F.col("px").alias("px_after"))
    j = a.join(b, keys, "full").fillna(0.0, ["qty_before", "qty_after"])
    value = lambda s: F.coalesce(F.col(f"qty_{s}") * F.col(f"px_{s}"), F.lit(0.0))
    return j.withColumn("value_change", value("after") - value("before"))
