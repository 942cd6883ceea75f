"""Queries on look-through by identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweave.operators import lookthrough
from bookweave.plans.records import FUNDS, constituents
from bookweave.plans.registry import query, rounded
from bookweave.plans.scratch import stage_table
from bookweave.plans.valuation import FOLD, value_positions

#: Holdings below Brand#20 are funds: 13 holds what is no equity, 11, 12, 13 and 15 are declared, 15 has no snapshot, 12's is stale.
#: Brand#22 and Brand#23 share an ISIN under two tickers; every fifth constituent is known by its SEDOL alone.
AS_OF = "1999-01-01"
IDENTITY = FOLD + FUNDS + """
, cons2 AS (SELECT parent, constituent, weight, NOT (parent = 'Brand#13' AND constituent = 'Brand#42') AS equity FROM cons
), state AS (
  SELECT parent, CAST(sum(weight) AS DECIMAL(19, 18)) AS subtotal, bool_and(equity) AND sum(weight) <= 1 AS usable, parent = 'Brand#12' AS stale, parent = 'Brand#11' AND sum(weight) = 1 AS complete FROM cons2 WHERE parent <> 'Brand#15' GROUP BY parent
), p AS (
  SELECT book, ticker, CAST(value AS DECIMAL(18, 6)) AS value, CAST(substr(ticker, 7) AS INTEGER) < 20 AS fund, CAST(substr(ticker, 7) AS INTEGER) % 7 <> 0 AS equity FROM valued
), f AS (
  SELECT p.book, p.ticker, p.value, s.subtotal, s.stale, s.complete, CASE WHEN p.value IS NULL OR p.value <= 0 THEN 'unsupported fund' WHEN p.ticker = 'Brand#14' OR (s.parent IS NULL AND p.ticker <> 'Brand#15') THEN 'eligibility unverified' WHEN s.parent IS NULL THEN 'no data' WHEN NOT s.usable THEN 'composition unavailable' END AS code
  FROM p LEFT JOIN state s ON s.parent = p.ticker WHERE p.fund
), own AS (SELECT * FROM p WHERE NOT fund AND equity AND value IS NOT NULL
), entry AS (
  SELECT book, ticker AS security, CAST(value AS DECIMAL(38, 24)) AS direct, CAST(0 AS DECIMAL(38, 24)) AS indirect, NULL::VARCHAR AS parent FROM own
  UNION ALL SELECT f.book, c.constituent, 0, CAST(f.value * CAST(c.weight AS DECIMAL(19, 18)) AS DECIMAL(38, 24)), f.ticker FROM f JOIN cons2 c ON c.parent = f.ticker WHERE f.code IS NULL
), per AS (
  SELECT book, CASE WHEN security = 'Brand#23' THEN 'Brand#22' ELSE security END AS component, bool_or(security IN ('Brand#22', 'Brand#23')) AS conflict, sum(direct) AS direct, sum(indirect) AS indirect, count(DISTINCT parent) AS funds FROM entry GROUP BY ALL
)"""


def _fund_tables(spark, sf_dir) -> dict[str, DataFrame]:
    number = lambda c: F.substring(c, 7, 2).cast("int")
    c = stage_table(constituents(spark, sf_dir).withColumnRenamed("constituent", "security"), "constituents")
    c = c.withColumn("equity", ~((F.col("parent") == "Brand#13") & (F.col("security") == "Brand#42")))
    p = value_positions(spark, sf_dir).select("book", "ticker", "value", (number("ticker") < 20).alias("fund"), (number("ticker") % 7 != 0).alias("equity"), F.lit(True).alias("supported"))
    p = stage_table(p, "positions")
    parents = c.where("parent <> 'Brand#15'").select("parent").distinct()
    day = F.when(F.col("parent") == "Brand#12", "1998-01-01").otherwise("1998-12-15")
    n = number("security")
    isin = F.concat(F.lit("isin:"), F.when(n == 23, 22).otherwise(n).cast("string"))
    sedol = F.when(n % 5 == 0, F.concat(F.lit("sedol:"), n.cast("string")))
    held = p.select(F.col("ticker").alias("security")).distinct().select("security", F.array(F.concat(F.lit("ticker:"), "security"), isin, sedol).alias("ids"))
    inside = c.select("security").distinct().select("security", F.array(F.when(n % 5 != 0, isin), sedol).alias("ids"))
    return {
        "positions": p, "constituents": c, "snapshots": parents.select("parent", F.to_date(day).alias("day"), (F.col("parent") == "Brand#11").alias("verified")),
        "declared": parents.where("parent <> 'Brand#14'").unionByName(spark.createDataFrame([("Brand#15",)], "parent string")), "identifiers": held.unionByName(inside),
    }


def _looked_through(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    return lookthrough.look_through(**_fund_tables(spark, sf_dir), as_of=AS_OF)


@query(IDENTITY + " SELECT book, component, round(CAST(direct AS DOUBLE), 4) AS direct, round(CAST(indirect AS DOUBLE), 4) AS indirect, round(CAST(direct + indirect AS DOUBLE), 4) AS total, funds FROM per WHERE NOT conflict")
def fin9_fin10_look_through_by_identity(spark, sf_dir):
    """What every book is known to own of each security, itself and through funds."""
    s = _looked_through(spark, sf_dir)[0]
    return rounded(s.withColumns({c: F.col(c).cast("double") for c in ("direct", "indirect", "total")}))


@query(IDENTITY + """
, part AS (
  SELECT book, CAST(value AS DECIMAL(38, 24)) AS eligible, CAST(0 AS DECIMAL(38, 24)) AS known, CAST(0 AS DECIMAL(38, 24)) AS unknown, CAST(0 AS DECIMAL(38, 24)) AS unresolved FROM own UNION ALL SELECT book, value, 0, 0, 0 FROM f WHERE code IS NULL OR code IN ('no data', 'composition unavailable')
  UNION ALL SELECT book, 0, 0, value, 0 FROM f WHERE code IN ('no data', 'composition unavailable') UNION ALL SELECT book, 0, 0, value * (1 - subtotal), 0 FROM f WHERE code IS NULL
  UNION ALL SELECT book, 0, direct + indirect, 0, 0 FROM per WHERE NOT conflict UNION ALL SELECT book, 0, 0, 0, direct + indirect FROM per WHERE conflict UNION ALL SELECT DISTINCT book, 0, 0, 0, 0 FROM p
), flawed AS (
  SELECT book FROM f WHERE code IS NOT NULL OR NOT complete OR stale UNION SELECT book FROM p WHERE NOT fund AND (NOT equity OR value IS NULL) UNION SELECT book FROM per WHERE conflict
)
SELECT book, round(CAST(sum(eligible) AS DOUBLE), 4) AS eligible, round(CAST(sum(known) AS DOUBLE), 4) AS known, round(CAST(sum(unknown) AS DOUBLE), 4) AS unknown, round(CAST(sum(unresolved) AS DOUBLE), 4) AS unresolved, true AS reconciled, book NOT IN (FROM flawed) AS complete FROM part GROUP BY book
""")
def fin9_reconciliation(spark, sf_dir):
    """Eligible value of every book, split into known, unknown and unresolved, which add up to it exactly."""
    b = _looked_through(spark, sf_dir)[1]
    figures = {c: F.col(c).cast("double") for c in ("eligible", "known", "unknown", "unresolved")}
    return rounded(b.withColumns(figures).withColumn("reconciled", F.col("residual") == 0).drop("residual"))


@query(IDENTITY + """
SELECT code, count(*) AS n FROM (
  SELECT 'outside scope' AS code FROM p WHERE NOT fund AND (NOT equity OR value IS NULL) UNION ALL SELECT code FROM f WHERE code IS NOT NULL UNION ALL SELECT 'incomplete coverage' FROM f WHERE code IS NULL AND NOT complete
  UNION ALL SELECT 'stale' FROM f WHERE code IS NULL AND stale UNION ALL SELECT 'identity conflict' FROM per WHERE conflict) GROUP BY code
""")
def fin9_issues(spark, sf_dir):
    """How often each reason keeps a look-through from being complete."""
    return _looked_through(spark, sf_dir)[2].groupBy("code").agg(F.count(F.lit(1)).alias("n"))
