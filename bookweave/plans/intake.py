"""Queries that normalise raw text rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweave.functions import scalars
from bookweave.operators import market, normalise
from bookweave.plans.registry import query, rounded
from bookweave.plans.valuation import FOLD, value_positions
from bookweave.sources import tables


def raw_ledger(spark, sf_dir) -> DataFrame:
    """Line items as the text rows of a ledger file, with faults."""
    t = tables.trades(spark, sf_dir)
    k = F.col("seq")
    return t.select(
        F.concat(F.lit("s"), F.col("book") % 3).alias("source"), k.alias("row_no"), F.when(k % 13 == 0, "gift").when(F.col("q") < 0, " sell ").otherwise("Buy").alias("type"),
        F.when(k % 17 == 0, "31/12/1999").otherwise(F.col("d").cast("string")).alias("date"), F.when(k % 19 == 0, "nan").otherwise(F.lower("ticker")).alias("ticker"),
        F.abs("q").cast("int").cast("string").alias("quantity"), F.when(k % 2 == 0, F.floor("px").cast("string")).alias("price"),
        F.concat(F.lit("$"), (F.abs("q").cast("int") * F.floor("px")).cast("string")).alias("amount"),
    )


RAW = """
, raw AS (
  SELECT 's' || (book % 3) AS source, seq AS row_no, CASE WHEN seq % 13 = 0 THEN 'unsupported type' WHEN seq % 17 = 0 THEN 'bad date' WHEN seq % 19 = 0 THEN 'missing ticker' END AS issue,
    upper(ticker) AS ticker, CAST(d AS VARCHAR) AS d, q, floor(px) AS px FROM trade
)"""


@query(RAW + " SELECT source, row_no, ticker, d, round(q, 2) AS quantity, round(px, 2) AS price FROM raw WHERE issue IS NULL")
def prj4_normalise_ledger(spark, sf_dir):
    trades, _, _ = normalise.ledger(raw_ledger(spark, sf_dir))
    return rounded(trades.select("source", "row_no", "ticker", "d", "quantity", "price"), 2)


@query(RAW + " SELECT source, row_no, issue FROM raw WHERE issue IS NOT NULL")
def prj4_ledger_issues(spark, sf_dir):
    return normalise.ledger(raw_ledger(spark, sf_dir))[2]


@query(RAW + " SELECT source, 'ledger' AS kind, 0.99::DOUBLE AS confidence FROM raw GROUP BY source")
def prj2_detect_type(spark, sf_dir):
    return normalise.detect_type(raw_ledger(spark, sf_dir))


def raw_holdings(spark, sf_dir) -> DataFrame:
    k = F.col("seq")
    return tables.trades(spark, sf_dir).select(
        F.concat(F.lit("h"), F.col("book") % 4).alias("source"), k.alias("row_no"), F.when(k % 23 == 0, " ").otherwise(F.col("ticker")).alias("ticker"),
        F.when(k % 29 == 0, "none").otherwise(F.abs("q").cast("int").cast("string")).alias("quantity"), F.when(F.col("q") < 0, "Short").when(k % 5 == 0, "long").alias("side"),
        F.when(k % 3 != 0, F.floor("px").cast("string")).alias("entry"), F.floor("px").cast("string").alias("price"), F.when(k % 7 == 0, "").otherwise("£").alias("currency"),
    )


RAWH = """
, h AS (
  SELECT 'h' || (book % 4) AS source, seq AS row_no, upper(ticker) AS ticker, q, floor(px) AS px, seq % 23 = 0 AS no_ticker, seq % 29 = 0 AS no_q, seq % 7 = 0 AS assumed FROM trade
)"""


@query(RAWH + " SELECT source, row_no, ticker, round(q, 2) AS quantity, round(CASE WHEN row_no % 3 <> 0 THEN px END, 2) AS entry, CASE WHEN assumed THEN 'USD' ELSE 'GBP' END AS currency FROM h WHERE NOT no_ticker AND NOT no_q")
def prj3_normalise_holdings(spark, sf_dir):
    return rounded(normalise.holdings(raw_holdings(spark, sf_dir))[0].select("source", "row_no", "ticker", "quantity", "entry", "currency"), 2)


@query(RAWH + """
SELECT source, code, count(*) AS n FROM (SELECT source, 'missing ticker' AS code FROM h WHERE no_ticker UNION ALL SELECT source, 'no quantity' FROM h WHERE no_q UNION ALL SELECT source, 'currency assumed' FROM h WHERE assumed) GROUP BY ALL
""")
def dq7_holdings_issues(spark, sf_dir):
    return normalise.holdings(raw_holdings(spark, sf_dir))[1].groupBy("source", "code").agg(F.count(F.lit(1)).alias("n"))


@query(RAWH + " SELECT source, count(*) AS lots, 0::BIGINT AS dated, count(DISTINCT ticker) AS tickers, count(*) AS priced FROM h WHERE NOT no_ticker AND NOT no_q GROUP BY source")
def prj5_capability(spark, sf_dir):
    return normalise.capability(normalise.holdings(raw_holdings(spark, sf_dir))[0])


@query(" SELECT c_custkey AS part, CASE WHEN c_custkey % 5 = 0 THEN 'fixed' ELSE c_mktsegment END AS account, c_mktsegment AS original FROM customer")
def prj7_assign_accounts(spark, sf_dir):
    parts = tables.books(spark, sf_dir).select(F.col("book").alias("part"), F.col("label").alias("account"))
    fixed = parts.where("part % 5 = 0").select("part", F.lit("fixed").alias("account"))
    return normalise.assign_accounts(parts, fixed)[0].select("part", "account", "original")


@query(FOLD + """
, s AS (SELECT book, ticker, value + CASE WHEN book % 9 = 0 THEN 1 ELSE 0 END AS shown, value, cost FROM valued)
SELECT count(*) AS n, count(*) FILTER (shown <> value AND abs(shown - value) > greatest(0.02, 1e-8 * abs(shown))) AS value_differs FROM s
""")
def fin6_statement(spark, sf_dir):
    """A statement made from the books, one in nine with a value that is off by one."""
    p = value_positions(spark, sf_dir)
    shown = F.col("value") + F.when(F.col("book") % 9 == 0, 1.0).otherwise(0.0)
    rows = p.select("book", "ticker", "ccy", "qty", "px", shown.alias("value"), "cost", (shown - F.col("cost")).alias("profit"), F.lit(0.0).alias("weight"))
    fx = market.latest(market.with_base(tables.fx(spark, sf_dir)), "ccy", "d", "rate")
    r = normalise.reconcile_statement(rows, fx)
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("issues", "value differs")).alias("value_differs"))


@query("""
SELECT p_brand AS ticker, count(*) AS listings, count(*) FILTER (p_partkey % 2 = 0) AS accepted FROM part GROUP BY p_brand
""")
def jn13_listings(spark, sf_dir):
    """Each part as a listing of its brand; every other one has the issuer's words."""
    part = tables.load(spark, sf_dir, "part")
    listings = part.select(F.col("p_partkey").cast("string").alias("symbol"), F.lit("GBX").alias("ccy"), F.when(F.col("p_partkey") % 2 == 0, "Acme Steel PLC").otherwise("Other Works Ltd").alias("issuer"), F.col("p_brand").alias("root"))
    own = part.select(F.col("p_brand").alias("ticker")).distinct().select("ticker", F.lit("Acme Steel Group").alias("name"), F.lit("GBP").alias("ccy"))
    m = normalise.match_listings(own, listings)
    return m.groupBy("ticker").agg(F.count(F.lit(1)).alias("listings"), F.count_if(F.col("accepted") & (F.col("factor") == 0.01)).alias("accepted"))


@query(" SELECT p_brand AS ticker, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY p_brand")
def fin14_identifier_catalog(spark, sf_dir):
    p = tables.load(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit(" x"), F.col("p_partkey").cast("string"))).alias("isin"))
    c = normalise.identifier_catalog(p)
    names = tables.securities(spark, sf_dir).select(F.col("ticker").alias("name"), scalars.ticker(F.col("ticker")).alias("ticker"))
    return c.join(names, "ticker").select(F.col("name").alias("ticker"), F.size("values").cast("long").alias("n"))


@query("""
, d AS (SELECT 'P' || (p_partkey % 7) AS parent, 's' || (p_partkey % 3) AS snapshot, p_brand AS constituent, p_size / 400.0 AS w FROM part
), g AS (SELECT parent, snapshot, count(*) AS n, count(DISTINCT constituent) AS k, sum(w) AS total FROM d GROUP BY ALL)
SELECT parent, snapshot, 'duplicate constituent' AS code FROM g WHERE n > k UNION ALL SELECT parent, snapshot, 'overweight' FROM g WHERE total > 1
""")
def fin11_fin13_constituent_checks(spark, sf_dir):
    k = F.col("p_partkey")
    d = tables.load(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), k % 7).alias("parent"), F.concat(F.lit("s"), k % 3).alias("snapshot"), F.col("p_brand").alias("constituent"),
        (F.col("p_size").cast("decimal(18,0)") / F.lit(400).cast("decimal(18,0)")).cast("decimal(19,18)").alias("weight"), F.to_date(F.lit("2001-01-01")).alias("date"),
    )
    return normalise.validate_constituents(d, "2001-02-01", 90)


@query(" SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d, CASE WHEN o_orderkey % 2 = 0 THEN '''=' || o_orderpriority ELSE o_orderpriority END AS safe FROM orders")
def scl5_src9_text_rules(spark, sf_dir):
    """Strict dates, and text made safe for spreadsheets."""
    o = tables.load(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.when(k % 3 == 0, d.cast("string")).when(k % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyyMMdd"))
    cell = F.when(k % 2 == 0, F.concat(F.lit("="), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    return rounded(o.select(k.alias("k"), scalars.iso_date(text).alias("d"), scalars.spreadsheet_safe(cell).alias("safe")))
