"""Queries on staged records, duplicates, look-through, data quality, publishing and increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookweave.functions import scalars
from bookweave.operators import market, review
from bookweave.plans.registry import query, rounded
from bookweave.plans.scratch import stage_table
from bookweave.plans.valuation import FOLD, accounts, base_trades, cash_of, concentration, totals, value_positions
from bookweave.sources import readers, tables
from bookweave.streaming import incremental

RECORDS = """
, rec AS (
  SELECT 'f' || (l_suppkey % 5) AS source, 'a' || (l_suppkey % 3) AS account, l_orderkey * 10 + l_linenumber AS record_id,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_orderkey % 97 AS VARCHAR) || '-' || l_linenumber END AS tid,
    CAST(l_partkey % 50 AS BIGINT) AS sec, CAST(l_quantity AS BIGINT) AS qty, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem
)"""


def records(spark, sf_dir) -> DataFrame:
    """Line items as staged records of five sources and three accounts."""
    i = tables.load(spark, sf_dir, "lineitem")
    tid = F.when(F.col("l_partkey") % 11 != 0, F.concat_ws("-", (F.col("l_orderkey") % 97).cast("string"), F.col("l_linenumber").cast("string")))
    r = i.select(
        F.concat(F.lit("f"), F.col("l_suppkey") % 5).alias("source"), F.concat(F.lit("a"), F.col("l_suppkey") % 3).alias("account"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), tid.alias("transaction_id"), (F.col("l_partkey") % 50).alias("sec"),
        F.col("l_quantity").cast("long").alias("qty"), F.to_date("l_shipdate").cast("string").alias("day"),
    )
    return r.withColumn("sig", review.signature("sec", "qty", "day"))


@query(RECORDS + """
SELECT account, tid AS transaction_id, count(*) AS n, CASE WHEN count(DISTINCT (sec, qty, day)) = 1 THEN 'duplicate' ELSE 'conflict' END AS issue FROM rec WHERE tid IS NOT NULL GROUP BY account, tid HAVING count(*) > 1
""")
def dq4_transaction_ids(spark, sf_dir):
    return review.id_conflicts(records(spark, sf_dir))


@query(RECORDS + """
SELECT account, sec, qty, day, count(*) AS n, count(DISTINCT tid) AS ids, count(*) FILTER (tid IS NULL) AS without FROM rec GROUP BY account, sec, qty, day HAVING count(*) > 1 AND (count(DISTINCT tid) > 1 OR count(*) FILTER (tid IS NULL) > 0)
""")
def dq5_economic_matches(spark, sf_dir):
    r = records(spark, sf_dir)
    names = r.groupBy("account", "sig").agg(*(F.first(c).alias(c) for c in ("sec", "qty", "day")))
    return review.possible_duplicates(r).join(names, ["account", "sig"]).select("account", "sec", "qty", "day", "n", "ids", "without")


@query(RECORDS + " SELECT accounts, count(*) AS signatures, CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(DISTINCT account) AS accounts, count(*) AS n FROM rec GROUP BY sec, qty, day HAVING count(DISTINCT account) > 1) GROUP BY accounts")
def dq6_across_accounts(spark, sf_dir):
    return review.across_accounts(records(spark, sf_dir)).groupBy("accounts").agg(F.count(F.lit(1)).alias("signatures"), F.sum("n").alias("n"))


@query(RECORDS + " SELECT 'f0' AS a, 'copy of f0' AS b, count(*) AS n FROM rec WHERE source = 'f0' HAVING count(*) > 0")
def dq1_same_content(spark, sf_dir):
    r = records(spark, sf_dir).select("source", "record_id", "sig").withColumn("sig", review.signature("record_id", "sig"))
    copy = r.where("source = 'f0'").withColumn("source", F.lit("copy of f0"))
    found = review.same_content(r.unionByName(copy))
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "n")


@query(RECORDS + " SELECT source, count(DISTINCT account) AS accounts, count(DISTINCT day) AS days, count(*) AS n, CASE WHEN count(DISTINCT day) > 1 THEN 'several dates' ELSE 'one date' END AS issue FROM rec GROUP BY source")
def dq2_dq3_dq13_source_report(spark, sf_dir):
    g = records(spark, sf_dir).groupBy("source").agg(F.count_distinct("account").alias("accounts"), F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("issue", F.when(F.col("days") > 1, "several dates").otherwise("one date"))


@query(RECORDS + """
, part AS (SELECT account, source AS part, min(day) AS a, max(day) AS z FROM rec WHERE substr(day, 1, 4) = CAST(1994 + CAST(substr(source, 2) AS INTEGER) + 1 AS VARCHAR) OR source = 'f0' GROUP BY account, source)
SELECT x.account, x.part AS a, y.part AS b FROM part x JOIN part y ON x.account = y.account AND x.part < y.part AND x.a <= y.z AND y.a <= x.z
""")
def jn10_overlapping_periods(spark, sf_dir):
    r = records(spark, sf_dir).where(F.expr("substr(day, 1, 4) = cast(1994 + cast(substr(source, 2) as int) + 1 as string) or source = 'f0'"))
    return review.overlapping_periods(r.groupBy("account", F.col("source").alias("part")).agg(F.min("day").alias("first"), F.max("day").alias("last")))


@query(RECORDS + " SELECT source, account, count(*) AS n FROM rec WHERE source <> 'f4' AND NOT (source = 'f1' AND account = 'a1') AND sec <> 7 GROUP BY ALL")
def jn12_set6_retained(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("record_id", F.concat_ws("#", F.col("record_id").cast("string"), "sig"))
    one = stage_table(r.select("source", "account").distinct(), "parts")
    out = review.retained(r, one.where("source = 'f4'"), one.where("source = 'f1' and account = 'a1'"), r.where("sec = 7").select("record_id").distinct())
    return out.groupBy("source", "account").agg(F.count(F.lit(1)).alias("n"))


@query(RECORDS + " SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT account) AS accounts, count(*) FILTER (tid IS NULL) AS unresolved, CASE WHEN count(*) FILTER (tid IS NULL) > 0 THEN 'needs review' ELSE 'ready' END AS status FROM rec")
def agg21_batch_status(spark, sf_dir):
    lacking = F.count_if(F.col("transaction_id").isNull())
    return records(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("account").alias("accounts"), lacking.alias("unresolved"), F.when(lacking > 0, "needs review").otherwise("ready").alias("status"))


@query(RECORDS + """
, issue AS (SELECT account || ':' || tid AS id, CAST(count(*) AS VARCHAR) AS basis FROM rec WHERE tid IS NOT NULL GROUP BY account, tid HAVING count(*) > 1)
SELECT id AS issue_id, CASE WHEN length(id) % 2 = 0 THEN 'exclude' ELSE 'keep' END AS action, basis FROM issue WHERE length(id) % 3 <> 0
""")
def dq8_dq9_decisions(spark, sf_dir):
    """Decisions that still stand: every issue was decided, each third reversed later."""
    issues = review.id_conflicts(records(spark, sf_dir)).select(F.concat_ws(":", "account", "transaction_id").alias("issue_id"), F.col("n").cast("string").alias("basis"))
    first = issues.withColumns({"action": F.when(F.length("issue_id") % 2 == 0, "exclude").otherwise("keep"), "at": F.lit(1)})
    later = issues.where(F.length("issue_id") % 3 == 0).withColumns({"action": F.lit("reverse"), "at": F.lit(2)})
    return review.latest_decisions(first.unionByName(later), issues).select("issue_id", "action", "basis")


@query(" SELECT book, ticker, CAST(d AS VARCHAR) AS d, count(*) AS n FROM trade GROUP BY book, ticker, d HAVING min(sign(q)) < max(sign(q))")
def dq15_opposite_trades(spark, sf_dir):
    return rounded(review.opposite_trades(tables.trades(spark, sf_dir)))


@query("""
, p AS (SELECT p_partkey AS id, 'isin:' || (p_partkey // 3) AS a, CASE WHEN p_partkey % 6 IN (2, 3) THEN 'sedol:' || (p_partkey // 6) END AS b FROM part
), e AS (SELECT x.id AS x, y.id AS y FROM p x JOIN p y ON x.a = y.a OR x.b = y.b
), reach(id, r) AS (SELECT id, id FROM p UNION SELECT reach.id, e.y FROM reach JOIN e ON e.x = reach.r)
SELECT id AS row_id, min(r) AS component FROM reach GROUP BY id
""")
def jn9_fin10_identity(spark, sf_dir):
    """Parts that share an identifier, in threes, two of which another identifier joins."""
    k = F.col("p_partkey")
    ids = F.array(F.concat(F.lit("isin:"), F.floor(k / 3).cast("string")), F.when((k % 6).isin(2, 3), F.concat(F.lit("sedol:"), F.floor(k / 6).cast("string"))))
    return review.identity(tables.load(spark, sf_dir, "part").select(k.alias("row_id"), ids.alias("ids")))


FUNDS = """
, cons AS (
  SELECT 'Brand#' || (10 + CAST(p_brand[7:] AS INTEGER) % 4 + 1) AS parent, p_brand AS constituent, CAST(CAST(sum(p_size) AS DECIMAL(18, 0)) / 100000 AS DECIMAL(19, 18)) AS weight
  FROM part WHERE CAST(p_brand[7:] AS INTEGER) > 20 GROUP BY ALL
)"""


def constituents(spark, sf_dir) -> DataFrame:
    """Parts as constituents of funds; a weight grows with the parts and has room for ten digits before its point."""
    number = F.expr("cast(substr(p_brand, 7) as int)")
    p = tables.load(spark, sf_dir, "part").where(number > 20)
    parent = F.concat(F.lit("Brand#"), (10 + number % 4 + 1).cast("string"))
    w = F.sum("p_size").cast("decimal(18,0)") / F.lit(100000).cast("decimal(18,0)")
    return p.groupBy(parent.alias("parent"), F.col("p_brand").alias("constituent")).agg(w.cast("decimal(28,18)").alias("weight"))


@query(FUNDS + """
SELECT parent, round(CAST(sum(weight) AS DOUBLE), 6) AS total, count(*) AS n, round(CAST(greatest(1 - sum(weight), 0) AS DOUBLE), 6) AS unreported,
  CASE WHEN sum(weight) > 1 THEN 'overweight' WHEN sum(weight) = 1 THEN 'complete' ELSE 'partial' END AS state FROM cons GROUP BY parent
""")
def agg22_coverage(spark, sf_dir):
    c = review.coverage(constituents(spark, sf_dir))
    return rounded(c.withColumns({x: F.col(x).cast("double") for x in ("total", "unreported")}), 6)


LOOK = """
, okay AS (SELECT parent FROM cons GROUP BY parent HAVING sum(weight) <= 1
), h AS (SELECT book, ticker, CAST(value AS DECIMAL(18, 6)) AS value FROM valued
), flat AS (
  SELECT h.book, c.constituent AS security, CAST(0 AS DECIMAL(18, 6)) AS direct, CAST(h.value AS DECIMAL(18, 6)) * CAST(c.weight AS DECIMAL(19, 18)) AS indirect FROM h JOIN cons c ON c.parent = h.ticker JOIN okay o ON o.parent = c.parent
  UNION ALL SELECT book, ticker, value, 0 FROM h WHERE ticker NOT IN (FROM okay)
)"""


@query(FOLD + FUNDS + LOOK + """
SELECT book, security, round(CAST(sum(direct) AS DOUBLE), 3) AS direct, round(CAST(sum(indirect) AS DOUBLE), 3) AS indirect, round(CAST(sum(direct) AS DOUBLE) + CAST(sum(indirect) AS DOUBLE), 3) AS total FROM flat GROUP BY book, security
""")
def jn8_fin9_look_through(spark, sf_dir):
    h = value_positions(spark, sf_dir).select("book", "ticker", "value")
    out = review.look_through(h, constituents(spark, sf_dir))
    return rounded(out.withColumn("total", F.col("direct") + F.col("indirect")), 3)


@query(FUNDS + """
, v AS (SELECT DISTINCT parent, s AS snapshot, s % 2 = 1 AS ready, s AS accepted_at FROM cons, unnest([1, 2, 3, 4]) AS t(s))
SELECT parent, max(snapshot) AS snapshot, max(accepted_at) AS accepted_at FROM v WHERE ready GROUP BY parent
""")
def fin12_pub1_accepted_version(spark, sf_dir):
    v = constituents(spark, sf_dir).select("parent").distinct().select("parent", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("snapshot"))
    v = v.withColumns({"ready": F.col("snapshot") % 2 == 1, "accepted_at": F.col("snapshot")})
    return review.accepted(v).select("parent", "snapshot", "accepted_at")


@query(FUNDS + " SELECT count(*) AS funds, bool_and(t <= 1) AS publish FROM (SELECT sum(weight) AS t FROM cons GROUP BY parent)")
def pub3_publish_all_or_none(spark, sf_dir):
    return review.coverage(constituents(spark, sf_dir)).agg(F.count(F.lit(1)).alias("funds"), F.bool_and(F.col("state") != "overweight").alias("publish"))


@query(FOLD + """
, s AS (SELECT book, max(exposure) / sum(exposure) AS largest FROM valued WHERE exposure > 0 GROUP BY book
), f AS (
  SELECT book, 'concentration' AS code, largest AS evidence, 1 AS severity FROM s WHERE largest > 0.2
  UNION ALL SELECT book, 'negative cash', cash, 2 FROM money WHERE cash < 0
  UNION ALL SELECT book, 'loss', sum(unrealised), 1 FROM valued GROUP BY book HAVING sum(unrealised) < 0
)
SELECT book, code, round(evidence, 2) AS evidence, severity, row_number() OVER (PARTITION BY book ORDER BY severity DESC, code) AS place FROM f
""")
def fin8_fin15_srt8_findings(spark, sf_dir):
    """Findings per book in order of severity; the first three are shown."""
    trades = base_trades(spark, sf_dir)
    p = value_positions(spark, sf_dir, trades).select("book", "ticker", "exposure", "unrealised")
    one = concentration(p).where("largest > 0.2").select("book", F.lit("concentration").alias("code"), F.col("largest").alias("evidence"), F.lit(1).alias("severity"))
    two = cash_of(spark, sf_dir, trades).where("cash < 0").select("book", F.lit("negative cash").alias("code"), F.col("cash").alias("evidence"), F.lit(2).alias("severity"))
    three = p.groupBy("book").agg(F.sum("unrealised").alias("evidence")).where("evidence < 0").select("book", F.lit("loss").alias("code"), "evidence", F.lit(1).alias("severity"))
    place = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("severity"), "code")).cast("long")
    return rounded(one.unionByName(two).unionByName(three).withColumn("place", place), 2)


@query("""
, last AS (SELECT ticker, max(d) AS d FROM price GROUP BY ticker), now AS (SELECT max(d) AS d FROM price)
SELECT ticker, CAST(last.d AS VARCHAR) AS d, now.d - last.d AS age, CASE WHEN now.d - last.d > 5 THEN 'stale' ELSE 'fresh' END AS state FROM last, now
""")
def dq10_freshness(spark, sf_dir):
    last = market.latest(tables.prices(spark, sf_dir), "ticker", "d", "px")
    now = last.agg(F.max("d").alias("now"))
    age = F.datediff("now", "d").cast("long")
    return rounded(last.join(F.broadcast(now)).select("ticker", "d", age.alias("age"), F.when(age > 5, "stale").otherwise("fresh").alias("state")))


@query(FOLD + """
, one AS (SELECT label, sum(value) AS parts FROM valued JOIN book USING (book) GROUP BY label
), two AS (SELECT label, sum(qty * px * rate) AS whole FROM (SELECT label, ticker, sum(qty) AS qty, min(px) AS px, min(rate) AS rate FROM valued JOIN book USING (book) GROUP BY label, ticker) GROUP BY label)
SELECT label, round(parts, 2) AS parts, round(whole, 2) AS whole, abs(parts - whole) <= 1e-7 * greatest(1, abs(whole)) AS agrees FROM one JOIN two USING (label)
""")
def fin7_agg20_set5_consolidation(spark, sf_dir):
    """Books of a label valued apart and as one, and whether the sums agree."""
    p = value_positions(spark, sf_dir).join(tables.books(spark, sf_dir), "book")
    parts = p.groupBy("label").agg(F.sum("value").alias("parts"))
    whole = p.groupBy("label", "ticker").agg(F.sum("qty").alias("qty"), F.min("px").alias("px"), F.min("rate").alias("rate"))
    whole = whole.groupBy("label").agg(F.sum(F.col("qty") * F.col("px") * F.col("rate")).alias("whole"))
    agrees = F.abs(F.col("parts") - F.col("whole")) <= 1e-7 * F.greatest(F.lit(1.0), F.abs("whole"))
    return rounded(parts.join(whole, "label").withColumn("agrees", agrees), 2)


@query("""
SELECT book, seq, CASE seq % 6 WHEN 0 THEN v WHEN 1 THEN -v WHEN 2 THEN v END AS x FROM (SELECT book, seq, floor(amt) AS v FROM flow)
""")
def scl1_clean_numbers(spark, sf_dir):
    whole = F.floor("amt").cast("string")
    k = F.col("seq") % 6
    text = F.when(k == 0, F.concat(F.lit("$"), whole)).when(k == 1, F.concat(F.lit("("), whole, F.lit(")"))).when(k == 2, F.concat(F.lit(" "), whole, F.lit(" %"))).when(k == 3, "n/a").when(k == 4, "abc")
    return tables.flows(spark, sf_dir).select("book", "seq", scalars.clean_number(text).alias("x"))


@query("""
, r AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN ' btc ' WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN '<na>' ELSE 'n/a' END WHEN 2 THEN c_name WHEN 3 THEN NULL ELSE 'eth' END AS t,
  CASE c_custkey % 4 WHEN 0 THEN '£' WHEN 1 THEN 'GB Pence' WHEN 2 THEN NULL ELSE 'usd' END AS c FROM customer)
SELECT k, CASE k % 5 WHEN 0 THEN 'BTC-USD' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN '' ELSE 'N/A' END WHEN 2 THEN upper(t) WHEN 3 THEN '' ELSE 'ETH-USD' END AS ticker,
  CASE k % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'GBX' ELSE 'USD' END AS ccy, regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]', '', 'g') AS token FROM r
""")
def scl2_scl3_scl4_identifiers(spark, sf_dir):
    k = F.col("c_custkey")
    t = F.when(k % 5 == 0, " btc ").when(k % 10 == 6, "<na>").when(k % 5 == 1, "n/a").when(k % 5 == 2, F.col("c_name")).when(k % 5 == 4, "eth")
    c = F.when(k % 4 == 0, "£").when(k % 4 == 1, "GB Pence").when(k % 4 == 3, "usd")
    return tables.load(spark, sf_dir, "customer").select(k.alias("k"), scalars.ticker(t).alias("ticker"), scalars.currency(c).alias("ccy"), scalars.token(F.coalesce(t, F.lit(""))).alias("token"))


@query(" SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE round(p_size / 100.0, 6) END AS w FROM part")
def scl6_weights(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" %"))).otherwise((F.col("p_size") / 100).cast("decimal(9,4)").cast("string"))
    unit = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 2 == 0, "percent").otherwise("decimal")
    return rounded(tables.load(spark, sf_dir, "part").select(k.alias("k"), scalars.weight(text, unit).cast("double").alias("w")), 6)


@query("""
, raw AS (SELECT ticker, CAST(d AS VARCHAR) AS date, CASE WHEN day(d) = 5 THEN -px ELSE px END AS px FROM price)
SELECT ticker, date AS d, round(px, 4) AS px FROM raw WHERE px > 0 AND date <= '2001-06-30' AND date >= '1999-06-30'
""")
def src4_price_history(spark, sf_dir):
    p = tables.prices(spark, sf_dir)
    raw = p.select(F.col("d").cast("string").alias("date"), "ticker", F.when(F.dayofmonth("d") == 5, -F.col("px")).otherwise(F.col("px")).cast("string").alias("adjusted_close"))
    good, _ = readers.read_price_history(raw, 2, "2001-06-30")
    up = tables.securities(spark, sf_dir).select(F.col("ticker").alias("name"), F.upper("ticker").alias("ticker"))
    return rounded(good.join(up, "ticker").select(F.col("name").alias("ticker"), "d", "px"))


@query("""
, f AS (SELECT book, d, seq, CASE WHEN kind = 'WITHDRAWAL' THEN -amt ELSE amt END AS amt, kind FROM flow)
SELECT kind, count(*) AS n, round(sum(q), 2) AS quantity, round(sum(amount), 2) AS amount FROM (
  SELECT CASE WHEN q < 0 THEN 'SELL' ELSE 'BUY' END AS kind, q, abs(q) * px AS amount FROM trade UNION ALL SELECT kind, NULL, abs(amt) FROM f) GROUP BY kind
""")
def prj4_set1_event_stream(spark, sf_dir):
    """Trades and cash flows in one stream of events."""
    t = tables.trades(spark, sf_dir).select(F.when(F.col("q") < 0, "SELL").otherwise("BUY").alias("kind"), F.col("q").alias("quantity"), (F.abs("q") * F.col("px")).alias("amount"))
    e = t.unionByName(tables.flows(spark, sf_dir).select("kind", F.abs("amt").alias("amount")), allowMissingColumns=True)
    return rounded(e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount")), 2)


@query(" SELECT user_id, round(arg_max(value, (ts, event_id)), 6) AS value, CAST(epoch_us(max(ts)) AS BIGINT) AS ts, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id")
def inc2_latest_tick(spark, sf_dir):
    return rounded(incremental.latest_batch(tables.load(spark, sf_dir, "events")).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))), 6)


@query(" SELECT user_id, round(arg_max(value, (ts, event_id)), 6) AS value, CAST(epoch_us(max(ts)) AS BIGINT) AS ts, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id")
def inc2_latest_tick_stream(spark, sf_dir):
    schema = tables.load(spark, sf_dir, "events").schema
    out = incremental.latest_stream(spark, f"{sf_dir}/events.parque[t]", schema)  # as a pattern, for one file as for a folder
    return rounded(out.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))), 6)


@query(FOLD + """
, t AS (SELECT book, count(*) FILTER (qty <> 0) AS n, sum(value) AS net FROM valued GROUP BY book)
SELECT label, count(*) AS books, round(sum(net), 2) AS net, round(max(net), 2) AS largest FROM t JOIN book USING (book) GROUP BY label
""")
def agg2_totals_by_label(spark, sf_dir):
    trades = base_trades(spark, sf_dir)
    t = totals(value_positions(spark, sf_dir, trades), cash_of(spark, sf_dir, trades)).where("status = 'ok' and n_positions is not null").join(tables.books(spark, sf_dir), "book")
    held = accounts(trades).select("book").distinct()
    t = t.join(held, "book", "left_semi")
    return rounded(t.groupBy("label").agg(F.count(F.lit(1)).alias("books"), F.sum("net").alias("net"), F.max("net").alias("largest")), 2)
