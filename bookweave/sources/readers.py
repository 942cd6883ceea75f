"""Files in and out: CSV staging with provenance, price histories, monthly rates, safe exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.functions import scalars

# Header aliases of the roles of a portfolio file.
ROLES = {
    "ticker": ("ticker", "symbol", "security", "security code", "instrument", "instrument code", "asset ticker", "stock", "code"),
    "name": ("asset", "asset name", "security name", "instrument name", "name", "description"),
    "quantity": ("quantity", "qty", "shares", "units", "units held", "holding", "position size", "position", "amount held"),
    "side": ("side", "position side", "long short", "long/short"),
    "price": ("price", "current price", "current price local", "current price (local)", "market price", "last price", "close", "close price", "valuation price"),
    "entry": (
        "entry price", "average entry price", "avg entry price", "average price", "cost price", "cost basis price", "purchase price", "avg cost",
        "avg cost local", "avg cost (local)", "average cost", "average cost local", "average cost (local)",
    ),
    "date": ("date", "trade date", "transaction date", "purchase date", "acquisition date", "datetime", "timestamp", "executed at"),
    "type": ("type", "transaction type", "action", "trade type", "side action"),
    "gross": ("gross value", "gross amount", "trade value", "notional", "value", "transaction value"),
    "fees": ("fees", "fee", "commission", "commissions", "charges", "costs"),
    "amount": ("amount", "cash amount", "cash value", "flow amount"),
    "transaction_id": ("transaction id", "trade id", "order id", "reference", "reference id"),
    "asset_class": ("asset class", "class", "category", "security type", "instrument type"),
    "duration": ("duration", "modified duration", "mod duration", "interest rate duration"),
    "currency": ("currency", "ccy", "currency code", "denomination", "quote currency"),
    "sensitivity": ("rate sensitivity", "interest rate sensitivity", "rate beta", "rate shock sensitivity"),
    "account": ("account", "account id", "account name"),
}


def column_map(names: list[str]) -> dict[str, str]:
    """Role to source header; the first header in file order wins."""
    flat = [(n, n.lower().strip().replace("_", " ").replace("-", " ")) for n in names]
    return {role: src for role, aliases in ROLES.items() if (src := next((n for n, f in flat if f in aliases), None)) is not None}


def read_price_history(rows: DataFrame, years: int, anchor: str) -> tuple[DataFrame, DataFrame]:
    """(prices, issues) from text columns (date, ticker, adjusted_close) within `years` of the anchor."""
    t = rows.select(scalars.iso_date(F.col("date")).alias("d"), scalars.ticker(F.col("ticker")).alias("ticker"), scalars.clean_number(F.col("adjusted_close")).alias("px"))
    n = t.groupBy("d", "ticker").agg(F.count(F.lit(1)).alias("_n"))
    end = F.to_date(F.lit(anchor))
    issue = (
        F.when(F.col("d").isNull(), "bad date").when(F.col("d") > end, "future date").when(F.col("px").isNull() | (F.col("px") <= 0), "bad price").when(F.col("_n") > 1, "duplicate")
    )
    t = t.withColumn("issue", F.when(F.col("d").isNull(), F.lit("bad date"))).where("issue is not null").select("d", "ticker", "px", "issue").unionByName(
        t.join(n, ["d", "ticker"]).withColumn("issue", issue).select("d", "ticker", "px", "issue")
    )
    good = t.where("issue is null").where(F.col("d") >= F.add_months(end, -12 * years)).select("ticker", "d", "px")
    return good, t.where("issue is not null")


def monthly_rates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rates, issues) of (month, level) with unique months and finite levels."""
    t = rows.select(F.trunc(scalars.iso_date(F.col("date")), "MM").alias("month"), scalars.clean_number(F.col("level")).alias("level"))
    n = t.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.first("level").alias("level"))
    issue = F.when(F.col("month").isNull(), "bad date").when(F.col("n") > 1, "duplicate month").when(F.col("level").isNull(), "bad level")
    n = n.withColumn("issue", issue)
    return n.where("issue is null").select("month", "level"), n.where("issue is not null").select("month", "n", "issue")


def safe_export(df: DataFrame, path: str) -> None:
    """CSV with no text that a spreadsheet would run."""
    text = {c for c, t in df.dtypes if t == "string"}
    df.select(*(scalars.spreadsheet_safe(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns)).write.option("header", True).csv(path)
