"""Book tables read as views over a star schema of orders, line items and parts.

Schemas: trade (book, ticker, d, seq, q, px, fee), flow (book, d, seq, kind, amt), price
(ticker, d, px), fx (ccy, d, rate), security (ticker, asset_class, ccy), book (book, label),
opening (book, opening).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Quote currencies by region number, and their rate to USD before the daily change.
CURRENCIES = (("USD", 1.0), ("GBP", 1.25), ("GBX", 0.0125), ("EUR", 1.1), ("JPY", 0.0075))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def currency(number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c, _ in CURRENCIES)), (number % len(CURRENCIES) + 1).cast("int"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed trades; returned items are sales. Quotients and products are made after the joins: a quantity or a tax takes less of a shuffle than what is made of it."""
    item = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), "l_quantity", "l_extendedprice", "l_tax",
        F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("sold"),
    )
    order = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return item.join(order, item.l_orderkey == order.o_orderkey).join(part, item.l_partkey == part.p_partkey).select(
        F.col("o_custkey").alias("book"),
        F.col("p_brand").alias("ticker"),
        "d",
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("sold"), -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("q"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash flows of books: finished orders take cash out, urgent ones pay a dividend, others pay in."""
    kind = F.when(F.col("o_orderstatus") == "F", "WITHDRAWAL").when(F.col("o_orderpriority") == "1-URGENT", "DIVIDEND").otherwise("DEPOSIT")
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("book"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("seq"), kind.alias("kind"), F.col("o_totalprice").alias("amt")
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price per ticker and trading day."""
    t = trades(spark, sf_dir)
    return t.groupBy("ticker", "d").agg(F.avg("px").alias("px"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers with their asset class and quote currency."""
    part = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_type").alias("asset_class"))
    number = F.substring("p_brand", -1, 1).cast("int") % len(CURRENCIES)
    return part.select(F.col("p_brand").alias("ticker"), "asset_class", currency(number).alias("ccy"))


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates to USD on days that have a trade and fall on an even day of the month; others have gaps."""
    days = load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).where(F.dayofmonth("d") % 2 == 0).distinct()
    base = F.explode(F.array(*(F.struct(F.lit(c).alias("ccy"), F.lit(r).alias("base")) for c, r in CURRENCIES if c != "GBX")))
    move = (F.dayofyear("d") % 20 - 10) / 1000.0
    rate = F.when(F.col("x.ccy") == "USD", 1.0).otherwise(F.col("x.base") * (1 + move))
    return days.select("d", base.alias("x")).select(F.col("x.ccy").alias("ccy"), "d", rate.alias("rate"))


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash in USD that a book had before its first event."""
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book"), (F.col("c_acctbal") * 100 + 2e6).alias("opening"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book"), F.col("c_mktsegment").alias("label"))


#: The same views in SQL, for the oracles: a list of common table expressions.
VIEWS = """
trade AS (
  SELECT o_custkey AS book, p_brand AS ticker, CAST(l_shipdate AS DATE) AS d, o_orderkey * 10 + l_linenumber AS seq,
    CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q,
    l_extendedprice / l_quantity AS px, l_extendedprice * l_tax AS fee
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), flow AS (
  SELECT o_custkey AS book, CAST(o_orderdate AS DATE) AS d, o_orderkey AS seq,
    CASE WHEN o_orderstatus = 'F' THEN 'WITHDRAWAL' WHEN o_orderpriority = '1-URGENT' THEN 'DIVIDEND' ELSE 'DEPOSIT' END AS kind,
    o_totalprice AS amt FROM orders
), price AS (
  SELECT ticker, d, avg(px) AS px FROM trade GROUP BY ticker, d
), security AS (
  SELECT p_brand AS ticker, min(p_type) AS asset_class,
    (['USD', 'GBP', 'GBX', 'EUR', 'JPY'])[CAST(right(p_brand, 1) AS INTEGER) % 5 + 1] AS ccy FROM part GROUP BY p_brand
), fx AS (
  SELECT ccy, d, CASE WHEN ccy = 'USD' THEN 1.0 ELSE base * (1 + (dayofyear(d) % 20 - 10) / 1000.0) END AS rate
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE day(l_shipdate) % 2 = 0),
    (VALUES ('USD', 1.0::DOUBLE), ('GBP', 1.25), ('EUR', 1.1), ('JPY', 0.0075)) AS c(ccy, base)
), book AS (
  SELECT c_custkey AS book, c_mktsegment AS label FROM customer
)"""
