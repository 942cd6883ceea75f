"""Queries on the review log, the gates before a consolidation, and publishing in versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweave.operators import decisions, publish
from bookweave.plans.records import RECORDS, records
from bookweave.plans.registry import query, rounded
from bookweave.plans.scratch import scratch_root, stage_table
from bookweave.sources import tables


def _review_records(spark, sf_dir) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select(F.col("record_id").cast("string").alias("record_id"), "source", F.concat_ws(":", "source", "account").alias("part"), "account", F.lit("ledger").alias("kind"), "transaction_id", "sig", F.col("record_id").alias("number"))


def _decided(recs: DataFrame) -> decisions.Log:
    """A log over the issues of one transaction id: by the least record number n of an issue, n % 6 = 0, 1 or 4 exclude all but it, 2 keeps both, 3 defers; 1 is reversed later, and 4 saw other sources."""
    issues = decisions.detect(recs, contents=False)[0]
    members = stage_table(decisions.members_of(recs, issues), "members")
    numbered = members.withColumn("number", F.col("record_id").cast("long"))
    least = numbered.groupBy("issue_id").agg(F.min("number").alias("first"))
    told = stage_table(least.withColumn("m", F.col("first") % 6), "review")
    excludes = F.col("m").isin(0, 1, 4)
    action = F.when(excludes, "exclude_records").when(F.col("m") == 2, "keep_both").when(F.col("m") == 3, "defer")
    removed = numbered.join(told.where(excludes), "issue_id").where("number > first").select("issue_id", F.lit("record").alias("kind"), F.col("record_id").alias("target"))
    basis = stage_table(decisions.source_basis(recs), "basis")
    chosen = lambda rows: told.where(rows).select("issue_id", action.alias("action"), F.lit("broker record").alias("reason"))
    log = decisions.empty_log(recs.sparkSession).decide(0, chosen("m < 4"), members, basis, removed)
    log = log.decide(1, chosen("m = 4"), members, basis.withColumn("basis", F.lit("before a correction")), removed)
    return log.reverse(2, told.where("m = 1").select("issue_id", F.lit("restored").alias("reason")))


@query(RECORDS + """
, g AS (SELECT account, tid, count(*) AS n, min(record_id) AS first, min(record_id) % 6 AS m FROM rec WHERE tid IS NOT NULL GROUP BY ALL HAVING count(*) > 1
), gone AS (SELECT r.record_id FROM rec r JOIN g USING (account, tid) WHERE g.m = 0 AND r.record_id > g.first
), kept AS (SELECT * FROM rec WHERE record_id NOT IN (FROM gone)
), by_id AS (SELECT account, tid, count(*) AS n, CASE WHEN count(DISTINCT (sec, qty, day)) = 1 THEN 'transaction_duplicate' ELSE 'transaction_id_conflict' END AS code FROM kept WHERE tid IS NOT NULL GROUP BY ALL HAVING count(*) > 1
), by_sig AS (SELECT account, count(*) AS n FROM kept GROUP BY account, sec, qty, day HAVING count(*) > 1 AND (count(*) FILTER (tid IS NULL) > 0 OR count(DISTINCT tid) > 1))
SELECT 'decision ' || CASE m WHEN 1 THEN 'reversed' WHEN 4 THEN 'void' ELSE 'active' END AS what, count(*) AS n FROM g WHERE m < 5 GROUP BY 1
UNION ALL SELECT 'kept', count(*) FROM kept UNION ALL SELECT CASE WHEN g.m = 2 AND g.n = k.n THEN 'settled ' ELSE 'open ' END || code, count(*) FROM by_id k JOIN g USING (account, tid) GROUP BY 1
UNION ALL SELECT 'open transaction_match_ambiguous', count(*) FROM by_sig HAVING count(*) > 0 UNION ALL SELECT 'may end', 0 UNION ALL SELECT 'confirmed', 0
""")
def dq8_dq9_review_log(spark, sf_dir):
    """The review log replayed over all records: decisions by state, what is kept, and the issues that are open on that."""
    recs = _review_records(spark, sf_dir)  # made of line items alone: to read these again takes no disk
    view = decisions.replay(recs.drop("number"), _decided(recs))
    states = view.decisions.groupBy(F.concat(F.lit("decision "), "state").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    issues = view.issues.groupBy(F.concat(F.when(F.col("open"), "open ").otherwise("settled "), F.col("code")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    flags = spark.createDataFrame([("kept", view.kept.count()), ("may end", int(view.can_progress)), ("confirmed", int(view.confirmed))], "what string, n long")
    return states.unionByName(issues).unionByName(flags)


VALUATION = "1998-06-30"


def _gate_records(spark, sf_dir) -> DataFrame:
    """Trades as records of 60 accounts: snapshots, ledgers and both, with faults that the account's number, the ticker or the day make."""
    t = tables.trades(spark, sf_dir).join(tables.securities(spark, sf_dir).select("ticker", "ccy"), "ticker")
    n, seq = F.col("book") % 60, F.col("seq")
    held = (n % 4 == 0) | ((n % 4 == 1) & (seq % 2 == 0))
    day = F.to_date(F.lit(VALUATION))
    return t.select(
        F.concat(F.lit("a"), n).alias("account"), F.when(held & (n % 8 == 0), "p0").otherwise(F.concat(F.lit("p"), seq % 2)).alias("part"), F.when(held, "holdings").otherwise("ledger").alias("kind"),
        F.when(seq % 50 == 0, publish.CASH).otherwise(F.col("ticker")).alias("ticker"), F.when(F.col("q") < 0, "SELL").otherwise("BUY").alias("type"), "d", F.col("d").cast("string").alias("at"),
        F.when((n == 7) & F.col("ticker").endswith("3"), "CHF").otherwise(F.col("ccy")).alias("ccy"), F.when(held, F.when(F.col("ticker").endswith("1"), 100.0).otherwise(F.round("px", 2))).alias("price"),
        F.when(held & (n % 3 != 0), F.date_sub(day, F.when(n % 5 == 0, 1).otherwise(0))).alias("snapshot_day"), F.when(n % 2 == 0, F.col("q")).otherwise(F.abs("q")).alias("qty"),
    ).withColumnRenamed("d", "day")


@query(f"""
, r AS (
  SELECT *, book % 60 AS n, seq % 50 = 0 AS cash, (book % 60) % 4 = 0 OR ((book % 60) % 4 = 1 AND seq % 2 = 0) AS held, CASE WHEN q < 0 THEN 'SELL' ELSE 'BUY' END AS type FROM trade JOIN security USING (ticker)
), p AS (
  SELECT *, CASE WHEN held AND n % 8 = 0 THEN 'p0' ELSE 'p' || (seq % 2) END AS part, CASE WHEN n = 7 AND ticker LIKE '%3' THEN 'CHF' ELSE ccy END AS money,
    CASE WHEN held THEN CASE WHEN ticker LIKE '%1' THEN 100.0 ELSE round(px, 2) END END AS price, CASE WHEN held AND n % 3 <> 0 THEN DATE '{VALUATION}' - CAST(n % 5 = 0 AS INTEGER) END AS sday,
    CASE WHEN n % 2 = 0 THEN q ELSE abs(q) END AS qty FROM r
), a AS (
  SELECT n, count(DISTINCT part) FILTER (held) AS s, count(DISTINCT part) FILTER (NOT held) AS l, coalesce(min(sday), CASE WHEN n % 2 = 0 THEN DATE '{VALUATION}' END) AS f, coalesce(max(sday), CASE WHEN n % 2 = 0 THEN DATE '{VALUATION}' END) AS z, max(d) FILTER (NOT held) AS y FROM p GROUP BY n
), c AS (SELECT *, s > 1 OR (s > 0 AND l > 0) AS mixed FROM a
), o AS (SELECT DISTINCT n, CASE WHEN cash THEN 'CASH' ELSE ticker END AS ticker FROM p WHERE NOT held GROUP BY n, CASE WHEN cash THEN 'CASH' ELSE ticker END, d HAVING count(DISTINCT part) > 1 AND count(DISTINCT type) > 1
), h AS (SELECT ticker, n, sum(qty) AS q FROM p WHERE NOT cash GROUP BY ALL)
SELECT 'a' || n AS account, NULL AS ticker, 'overlapping formats' AS code FROM c WHERE mixed
UNION ALL SELECT 'a' || n, NULL, 'no snapshot date' FROM c WHERE NOT mixed AND s > 0 AND f IS NULL
UNION ALL SELECT 'a' || n, NULL, 'other snapshot date' FROM c WHERE NOT mixed AND s > 0 AND (f <> DATE '{VALUATION}' OR z <> DATE '{VALUATION}')
UNION ALL SELECT 'a' || n, NULL, 'opening history missing' FROM c WHERE NOT mixed AND l > 0 AND n % 6 = 3
UNION ALL SELECT 'a' || n, NULL, 'future transaction' FROM c WHERE NOT mixed AND l > 0 AND y > DATE '{VALUATION}'
UNION ALL SELECT 'a' || n, ticker, 'opposite trades at one time' FROM o
UNION ALL SELECT NULL, ticker, 'conflicting prices' FROM p WHERE NOT cash AND ticker NOT LIKE '%2' GROUP BY ticker HAVING min(price) < max(price)
UNION ALL SELECT NULL, ticker, 'several currencies' FROM p WHERE NOT cash GROUP BY ticker HAVING count(DISTINCT money) > 1
UNION ALL SELECT NULL, ticker, 'long and short' FROM h GROUP BY ticker HAVING min(q) < 0 AND max(q) > 0
""")
def fin7_gates(spark, sf_dir):
    """Everything that stands against consolidating the accounts."""
    n = F.col("book") % 60
    accounts = tables.trades(spark, sf_dir).select(n.alias("n")).distinct()
    said = accounts.select(F.concat(F.lit("a"), "n").alias("account"), (F.col("n") % 6 != 3).alias("complete_from_zero"), F.when(F.col("n") % 2 == 0, F.to_date(F.lit(VALUATION))).alias("snapshot_day"))
    priced = tables.securities(spark, sf_dir).where("ticker like '%2'").select("ticker")
    return publish.gates(stage_table(_gate_records(spark, sf_dir), "gates"), said, VALUATION, "2024-01-01", priced)


@query("""
, h AS (SELECT label, ticker, sum(q) AS qty, count(*) FILTER (seq % 10 = 1) AS gone, count(*) AS n, sum(q) FILTER (seq % 10 <> 1) AS left_ FROM trade JOIN book USING (book) GROUP BY label, ticker
), one AS (SELECT count(*) AS n, sum(qty) AS q FROM h), two AS (SELECT count(*) AS n, sum(left_) AS q FROM h WHERE gone < n)
SELECT step, outcome, version, holdings, round(quantity, 2) AS quantity, derived FROM (
  SELECT 1 AS step, 'unconfirmed' AS outcome, 0 AS version, 0 AS holdings, 0.0 AS quantity, 0 AS derived
  UNION ALL SELECT 2, 'failed validation', 0, 0, 0.0, 0
  UNION ALL SELECT 3, 'published', 1, n, q, 0 FROM one
  UNION ALL SELECT 4, 'derived', 1, n, q, 5 FROM one
  UNION ALL SELECT 5, 'records or review changed', 1, n, q, 5 FROM one
  UNION ALL SELECT 6, 'another request', 1, n, q, 5 FROM one
  UNION ALL SELECT 7, 'published', 2, n, q, 0 FROM two
  UNION ALL SELECT 8, 'refused', 2, n, q, 0 FROM two
  UNION ALL SELECT 9, 'derived', 2, n, q, 5 FROM two)
""")
def src8_pub1_pub2_versions(spark, sf_dir):
    """Holdings by label published from trades: what is refused and what readers see after every step, rows derived from an old version included."""
    store = publish.Store(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}")
    trades = stage_table(tables.trades(spark, sf_dir).join(tables.books(spark, sf_dir), "book").select("label", "ticker", "seq", "q"), "trades")
    fewer = trades.where("seq % 10 <> 1")
    nothing = spark.createDataFrame([], "code string")
    fault = spark.createDataFrame([("opening history missing",)], "code string")
    steps: list[tuple] = []
    # Neither table changes between the steps, so each is read for its digest once.
    digest = {rows: publish.content_digest(rows) for rows in (trades, fewer)}

    def candidate(rows: DataFrame, blocked: DataFrame = nothing, request: str = "all labels") -> publish.Candidate:
        return publish.Candidate({"holdings": rows.groupBy("label", "ticker").agg(F.sum("q").alias("qty"))}, digest[rows], request, blocked)

    def derived(version: int) -> str:
        seen = store.read("holdings").groupBy("label").agg(F.sum(F.abs("qty")).alias("gross"))
        return "derived" if store.derive("gross", seen, version) else "refused"

    def told(outcome: str) -> None:
        held, gross = store.read("holdings"), store.read("gross")
        n, q = held.agg(F.count(F.lit(1)), F.sum("qty")).first() if held is not None else (0, 0.0)
        steps.append((len(steps) + 1, outcome, store.version(), n, q, gross.count() if gross is not None else 0))

    def tried(made: publish.Candidate, rows: DataFrame, confirmed: bool = True, request: str = "all labels") -> str:
        try:
            store.publish(made, digest[rows], request, confirmed)
        except publish.Stale as e:
            return str(e)
        return "published"

    first = candidate(trades)
    told(tried(first, trades, confirmed=False))
    told(tried(candidate(trades, fault), trades))
    told(tried(first, trades))
    told(derived(1))
    told(tried(first, fewer))
    told(tried(candidate(fewer), fewer, request="one label"))
    told(tried(candidate(fewer), fewer))
    told(derived(1))
    told(derived(2))
    return rounded(spark.createDataFrame(steps, "step int, outcome string, version int, holdings long, quantity double, derived long"), 2)
