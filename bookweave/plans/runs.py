"""Queries that compose others: current-weight runs, target risk, checks on them, staged files, orders of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookweave.functions import scalars
from bookweave.operators import market, normalise, review, scenario
from bookweave.plans import history, records, risk
from bookweave.plans.registry import query, rounded
from bookweave.plans.scratch import scratch_root, stage_table
from bookweave.plans.valuation import FOLD, base_trades, cash_of, prices_of, value_positions
from bookweave.sources import readers, staging, tables
from bookweave.streaming import incremental

#: Of the files that the queries drop, whose number is fixed and whose size grows with the tables.
MOST_BYTES = 1 << 30

LABELS = FOLD + risk.RETURNS + """
, lab AS (SELECT label AS grp, ticker, sum(value) AS value FROM valued JOIN book USING (book) GROUP BY ALL
), labcash AS (SELECT label AS grp, sum(cash) AS cash FROM money JOIN book USING (book) GROUP BY ALL
), state AS (SELECT grp, sum(value) AS net, sum(abs(value)) AS gross, min(cash) AS cash, sum(value) + min(cash) AS equity FROM lab JOIN labcash USING (grp) GROUP BY grp
), weights AS (SELECT grp, ticker, CASE WHEN equity > 1e-12 THEN value / equity ELSE 0 END AS w FROM lab JOIN state USING (grp)
)""" + risk.FULL_DAYS
SERIES = """
, series AS (SELECT grp, d, sum(w * r) AS r FROM full_ GROUP BY ALL
), cut AS (SELECT grp, quantile_cont(r, 0.05) AS cut FROM series GROUP BY grp
), m AS (SELECT grp, count(r) AS n, avg(r) * 252 AS annual_return, stddev_samp(r) * sqrt(252) AS volatility, greatest(0, -min(cut)) AS var,
  greatest(0, -avg(CASE WHEN r <= cut THEN r END)) AS es, count(*) FILTER (r <= cut) AS tail FROM series JOIN cut USING (grp) GROUP BY grp
)"""


def label_state(positions: DataFrame, cash: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, weights) of the books of each label as one: (group, net, gross, cash, equity) and (group, ticker, w), w the signed value over the equity, 0 where that is not positive."""
    own = stage_table(positions.join(books, "book").groupBy(F.col("label").alias("group"), "ticker").agg(F.sum("value").alias("value")), "labels")
    state = own.groupBy("group").agg(F.sum("value").alias("net"), F.sum(F.abs("value")).alias("gross"))
    state = state.join(cash.join(books, "book").groupBy(F.col("label").alias("group")).agg(F.sum("cash").alias("cash")), "group")
    state = stage_table(state.withColumn("equity", F.col("cash") + F.col("net")), "labels")
    w = F.when(F.col("equity") > 1e-12, F.col("value") / F.col("equity")).otherwise(0.0)
    return state, own.join(state.select("group", "equity"), "group").select("group", "ticker", w.alias("w"))


def current_risk(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Metrics of each group's present weights on stored returns, with the number of returns in the tail."""
    series = stage_table(risk.book_returns(returns, weights), "series")
    cut = series.groupBy("group").agg(F.percentile("r", 0.05).alias("cut"))
    tail = series.join(cut, "group").groupBy("group").agg(F.count_if(F.col("r") <= F.col("cut")).alias("tail"))
    return market.series_metrics(series, "group").join(tail, "group")


def _returns(spark, sf_dir, trades: DataFrame) -> DataFrame:
    return stage_table(risk.daily_returns(spark, sf_dir, prices_of(trades)).select("ticker", "d", "r"), "returns")


def _labels(spark, sf_dir, trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    return label_state(value_positions(spark, sf_dir, trades), cash_of(spark, sf_dir, trades), tables.books(spark, sf_dir))


@query(LABELS + SERIES + """
SELECT grp AS label, n, round(annual_return, 4) AS annual_return, round(volatility, 4) AS volatility, round(var, 4) AS var, round(es, 4) AS es,
  round(abs(equity) * var, 2) AS var_value, round(abs(equity) * es, 2) AS es_value, round(equity, 2) AS equity FROM m JOIN state USING (grp)
""")
def fin3_current_weight_run(spark, sf_dir):
    """Risk of the present book of each label, as a share and in USD."""
    trades = base_trades(spark, sf_dir)
    state, weights = _labels(spark, sf_dir, trades)
    m = current_risk(_returns(spark, sf_dir, trades), weights).join(state, "group")
    worth = lambda c: (F.abs("equity") * F.col(c)).alias(f"{c}_value")
    r = m.select(F.col("group").alias("label"), "n", "annual_return", "volatility", "var", "es", worth("var"), worth("es"), "equity")
    fine = rounded(r.drop("var_value", "es_value", "equity"))
    return fine.join(rounded(r.select("label", "var_value", "es_value", "equity"), 2), "label")


@query(LABELS + """
, cov AS (SELECT a.grp, a.ticker AS i, b.ticker AS j, min(b.w) AS wj, min(a.w) AS wi, covar_samp(a.r, b.r) * 252 AS c FROM full_ a JOIN full_ b ON a.grp = b.grp AND a.d = b.d GROUP BY a.grp, a.ticker, b.ticker
), part AS (SELECT grp, i, min(wi) * sum(c * wj) AS x FROM cov GROUP BY grp, i
), tot AS (SELECT grp, sum(x) AS v FROM part GROUP BY grp HAVING sum(x) > 0
), sh AS (SELECT grp AS label, i AS ticker, x / v AS share FROM part JOIN tot USING (grp))
SELECT label, ticker, round(share, 4) AS share, CASE WHEN share < 0 THEN 'hedge' ELSE 'risk contributor' END AS effect, row_number() OVER (PARTITION BY label ORDER BY share DESC, ticker) AS place,
  row_number() OVER (PARTITION BY label ORDER BY abs(share) DESC, ticker) AS absolute_place FROM sh
""")
def srt2_ranked_contributors(spark, sf_dir):
    """Tickers of each label by their signed and by their absolute share of its risk."""
    trades = base_trades(spark, sf_dir)
    _, weights = _labels(spark, sf_dir, trades)
    c = market.risk_contribution(_returns(spark, sf_dir, trades), weights)
    by = lambda x: F.row_number().over(Window.partitionBy("group").orderBy(F.desc(x), "ticker")).cast("long")
    c = c.withColumns({"place": by("share"), "size": F.abs("share")}).withColumn("absolute_place", by("size"))
    effect = F.when(F.col("share") < 0, "hedge").otherwise("risk contributor")
    return rounded(c.select(F.col("group").alias("label"), "ticker", "share", effect.alias("effect"), "place", "absolute_place"))


@query(LABELS + SERIES + """
SELECT grp AS label, n, tail, CASE WHEN n < 30 THEN 'limited' WHEN volatility IS NULL OR volatility < 0 OR var IS NULL OR es IS NULL THEN 'unavailable' ELSE 'checked' END AS status, tail < 20 AS small_tail FROM m
""")
def dq12_risk_sample(spark, sf_dir):
    """Whether each label's risk rests on enough returns, in all and in the tail."""
    trades = base_trades(spark, sf_dir)
    _, weights = _labels(spark, sf_dir, trades)
    m = current_risk(_returns(spark, sf_dir, trades), weights)
    sound = F.lit(True)
    for c in ("volatility", "var", "es"):
        sound = sound & market.finite(c) & (F.col(c) >= 0)
    status = F.when(F.col("n") < 30, "limited").when(~sound, "unavailable").otherwise("checked")
    return m.select(F.col("group").alias("label"), "n", "tail", status.alias("status"), (F.col("tail") < 20).alias("small_tail"))


#: The volatility that books are scaled to.
TARGET = 0.15

AFTER = history.SCENARIO + risk.RETURNS + """
, lab AS (SELECT label AS grp, ticker, sum(nq * np) AS value FROM e JOIN book USING (book) WHERE scenario = 'shock' GROUP BY ALL
), labcash AS (
  SELECT label AS grp, sum(cash) AS cash FROM (SELECT book, cash FROM money UNION ALL SELECT book, -dq * np FROM e WHERE scenario = 'shock') JOIN book USING (book) GROUP BY ALL
), state AS (SELECT grp, sum(value) AS net, sum(abs(value)) AS gross, min(cash) AS cash, sum(value) + min(cash) AS equity FROM lab JOIN labcash USING (grp) GROUP BY grp
), weights AS (SELECT grp, ticker, CASE WHEN equity > 1e-12 THEN value / equity ELSE 0 END AS w FROM lab JOIN state USING (grp)
)""" + risk.FULL_DAYS


@query(AFTER + SERIES + f"""
, t AS (SELECT *, {TARGET} / volatility AS k FROM m JOIN state USING (grp) WHERE volatility > 0
), u AS (SELECT *, cash - (k - 1) * net AS cash_after, k * gross AS gross_after FROM t
), v AS (SELECT *, k > 1 AND (cash_after < -1e-9 OR gross_after > equity + 1e-9) AS refused FROM u)
SELECT grp AS label, round(volatility, 4) AS volatility, round(k, 4) AS scale, CASE WHEN refused THEN 'refused: needs leverage' ELSE 'ok' END AS status,
  round(CASE WHEN NOT refused THEN k * net END, 2) AS net_after, round(CASE WHEN NOT refused THEN gross_after END, 2) AS gross_after, round(CASE WHEN NOT refused THEN cash_after END, 2) AS cash_after FROM v
""")
def fin5_scn7_target_risk(spark, sf_dir):
    """Risk of each label's book after a scenario, and the book scaled to a volatility where that needs no leverage."""
    trades = base_trades(spark, sf_dir)
    after = scenario.run(history.scenario_positions(spark, sf_dir, trades), history._steps(spark).where("scenario = 'shock'"))
    worth = stage_table(after.select("book", "ticker", (F.col("qty") * F.col("px")).alias("value"), "cash_change"), "after")
    cash = cash_of(spark, sf_dir, trades).unionByName(worth.select("book", F.col("cash_change").alias("cash")))
    state, weights = label_state(worth, cash, tables.books(spark, sf_dir))
    m = current_risk(_returns(spark, sf_dir, trades), weights).join(state, "group").where("volatility > 0")
    r = scenario.to_target(m, TARGET)
    fine = rounded(r.select(F.col("group").alias("label"), "volatility", "scale", "status"))
    return fine.join(rounded(r.select(F.col("group").alias("label"), "net_after", "gross_after", "cash_after"), 2), "label")


@query("""
, f AS (SELECT ccy, d, CASE WHEN day(d) = 14 THEN -1.0 ELSE rate END AS rate FROM fx
), v AS (SELECT *, d - lag(d) OVER (PARTITION BY ccy ORDER BY d) AS gap FROM f WHERE rate > 0
), g AS (SELECT ccy, max(gap) AS n FROM v GROUP BY ccy)
SELECT ccy, 'invalid history' AS code, count(*) AS n FROM f WHERE rate <= 0 GROUP BY ccy UNION ALL SELECT ccy, 'history gap', n FROM g WHERE n > 3
""")
def dq11_fx_history(spark, sf_dir):
    """Currencies with rates that are not valid, and with more than three days between valid ones."""
    f = tables.fx(spark, sf_dir).withColumn("rate", F.when(F.dayofmonth("d") == 14, -1.0).otherwise(F.col("rate")))
    return market.fx_issues(f, 3)


@query(risk.RETURNS + " SELECT ticker, round((avg(r) - (pow(1.03, 1.0 / 252) - 1)) * 252, 4) AS excess, count(*) AS n FROM good WHERE isfinite(r) GROUP BY ticker")
def scl9_scl12_excess_return(spark, sf_dir):
    """Annual return above a rate of 3 percent, over finite returns."""
    r = risk.daily_returns(spark, sf_dir).where(market.finite("r"))
    return rounded(r.groupBy("ticker").agg(((F.avg("r") - market.daily_rate(0.03)) * 252).alias("excess"), F.count("r").alias("n")))


@query("""
, stop AS (SELECT ['plc', 'inc', 'corp', 'corporation', 'company', 'group', 'holding', 'holdings', 'nv', 'se', 'ag', 'etf', 'ucits', 'ishares', 'vanguard', 'core', 'trust', 'fund', 'the', 'ltd', 'limited'] AS w)
SELECT p_partkey AS k, array_to_string(list_filter(regexp_extract_all(lower('The ' || p_name || ' ' || p_type || ' X Holdings PLC'), '[a-z]+'), lambda x: length(x) > 1 AND NOT list_contains(w, x)), ' ') AS words FROM part, stop
""")
def scl10_issuer_words(spark, sf_dir):
    """Words of parts' names as those of issuers."""
    name = F.concat(F.lit("The "), "p_name", F.lit(" "), "p_type", F.lit(" X Holdings PLC"))
    return tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(scalars.issuer_words(name), " ").alias("words"))


@query("""
, last AS (SELECT ticker, max(d) AS z FROM price GROUP BY ticker
), w AS (SELECT ticker, z, n, CAST(z - to_months(n) AS DATE) AS a FROM last, unnest([1, 3, 6, 12, 36, 60]) AS t(n))
SELECT w.ticker, w.n AS months, CAST(w.a AS VARCHAR) AS start, count(p.d) AS days, round(arg_max(p.px, p.d) / arg_min(p.px, p.d) - 1, 4) AS change FROM w JOIN price p ON p.ticker = w.ticker AND p.d >= w.a GROUP BY ALL
""")
def scl11_period_windows(spark, sf_dir):
    """Prices in windows of months and years back from each ticker's last day."""
    p = tables.prices(spark, sf_dir)
    last = p.groupBy("ticker").agg(F.max("d").alias("z"))
    w = last.select("ticker", "z", F.explode(F.array(*map(F.lit, (1, 3, 6, 12, 36, 60)))).alias("months"))
    w = w.select("ticker", F.col("months").cast("int").alias("months"), F.add_months("z", -F.col("months")).alias("start"))
    own = w.join(p, "ticker").where("d >= start").groupBy("ticker", "months", "start")
    return rounded(own.agg(F.count("d").alias("days"), (F.max_by("px", "d") / F.min_by("px", "d") - 1).alias("change")))


@query(" SELECT CAST(d AS VARCHAR) AS d, bool_or(p) AS has_price, bool_or(NOT p) AS has_rate FROM (SELECT d, true AS p FROM price UNION ALL SELECT d, false FROM fx) GROUP BY d")
def set3_calendar(spark, sf_dir):
    """Days of prices and rates together, and which of them have which."""
    days = tables.prices(spark, sf_dir).select("d", F.lit(True).alias("p")).unionByName(tables.fx(spark, sf_dir).select("d", F.lit(False).alias("p")))
    return rounded(days.groupBy("d").agg(F.bool_or("p").alias("has_price"), F.bool_or(~F.col("p")).alias("has_rate")))


@query("""
, ev AS (SELECT ticker, d, 1 AS rank, seq FROM trade UNION ALL SELECT ticker, d, 0, 0 FROM (SELECT DISTINCT ticker, d FROM price WHERE day(d) = 1))
SELECT ticker, CAST(d AS VARCHAR) AS d, rank, seq, row_number() OVER (PARTITION BY ticker, year(d) ORDER BY d, rank, seq) AS place FROM ev
""")
def srt1_event_order(spark, sf_dir):
    """Places of splits and trades in each ticker's year: by day, splits first, then in the order given."""
    trade = tables.trades(spark, sf_dir).select("ticker", "d", F.lit(1).alias("rank"), "seq")
    split = tables.prices(spark, sf_dir).where(F.dayofmonth("d") == 1).select("ticker", "d", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("seq"))
    place = F.row_number().over(Window.partitionBy("ticker", F.year("d")).orderBy("d", "rank", "seq")).cast("long")
    return rounded(trade.unionByName(split).withColumn("place", place))


@query(FOLD + records.FUNDS + records.LOOK + """
, t AS (SELECT book, security, round(CAST(sum(direct) AS DOUBLE) + CAST(sum(indirect) AS DOUBLE), 2) AS total FROM flat GROUP BY book, security)
SELECT book, security, row_number() OVER (PARTITION BY book ORDER BY total DESC NULLS LAST, security) AS place FROM t
""")
def srt7_securities_order(spark, sf_dir):
    """Each book's securities after look-through: known totals first, largest first, then by name."""
    out = review.look_through(value_positions(spark, sf_dir).select("book", "ticker", "value"), records.constituents(spark, sf_dir))
    total = rounded(out.select("book", "security", (F.col("direct") + F.col("indirect")).alias("total")), 2)
    place = F.row_number().over(Window.partitionBy("book").orderBy(F.desc_nulls_last("total"), "security")).cast("long")
    return total.select("book", "security", place.alias("place"))


@query(records.RECORDS + """
, v AS (SELECT source, account, count(*) AS n, sum(record_id) AS s FROM rec GROUP BY ALL)
SELECT source AS name, count(DISTINCT (n, s)) AS versions FROM v GROUP BY source HAVING count(DISTINCT (n, s)) > 1
""")
def dq2_changed_content(spark, sf_dir):
    """Files of one name, one from each account, whose contents differ."""
    r = records.records(spark, sf_dir).withColumn("sig", review.signature("record_id", "sig"))
    return review.changed_content(r.select(F.col("source").alias("name"), F.concat_ws("/", "account", "source").alias("source"), "sig"))


@query("""
, h AS (SELECT sha256('{"book":' || book || ',"day":' || CASE WHEN seq % 10 = 3 THEN 'null' ELSE '"' || CAST(d AS VARCHAR) || '"' END || ',"seq":' || seq || '}') AS x FROM trade)
SELECT count(*) AS n, CAST(sum(CAST('0x' || x[1:8] AS BIGINT)) AS BIGINT) AS d0, CAST(sum(CAST('0x' || x[9:16] AS BIGINT)) AS BIGINT) AS d1,
  CAST(sum(CAST('0x' || x[17:24] AS BIGINT)) AS BIGINT) AS d2, CAST(sum(CAST('0x' || x[25:32] AS BIGINT)) AS BIGINT) AS d3 FROM h
""")
def dq14_table_digest(spark, sf_dir):
    """Digest of all trades as canonical JSON, whatever their order."""
    day = F.when(F.col("seq") % 10 != 3, F.col("d").cast("string"))
    return review.table_digest(tables.trades(spark, sf_dir).select("book", "seq", day.alias("day")), "book", "day", "seq")


@query("""
, m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*)::DOUBLE / 4 AS level FROM orders GROUP BY 1)
SELECT CAST(month AS VARCHAR) AS month, round(level, 4) AS level, CASE WHEN month(month) = 7 THEN 'bad level' WHEN month(month) = 11 THEN 'duplicate month' END AS issue FROM m
""")
def src7_monthly_rates(spark, sf_dir):
    """Monthly levels from text; Julys are no number, Novembers come twice."""
    month = F.trunc("o_orderdate", "MM")
    m = tables.load(spark, sf_dir, "orders").groupBy(month.alias("month")).agg((F.count(F.lit(1)) / 4).alias("level"))
    text = F.when(F.month("month") == 7, "n/a").otherwise(F.col("level").cast("string"))
    raw = m.select(F.col("month").cast("string").alias("date"), text.alias("level"))
    twice = raw.where(F.substring("date", 6, 2) == "11").withColumn("date", F.concat(F.substring("date", 1, 8), F.lit("15")))
    good, bad = readers.monthly_rates(raw.unionByName(twice))
    told = m.join(good.select("month", F.lit(True).alias("good")), "month", "left").join(bad.select("month", "issue"), "month", "left")
    return rounded(told.where("good or issue is not null").select("month", "level", "issue"))


def _drop_trades(spark, sf_dir, root: str) -> None:
    """Trades as 64 CSV files, one per remainder of seq: two header orders, two files in eight without accounts' names for all rows, one in eight broken, and the first file twice."""
    t = tables.trades(spark, sf_dir).withColumn("file", F.col("seq") % 64)
    account = F.when(F.col("book") % 7 == 0, "").otherwise(F.lpad((F.col("book") % 5).cast("string"), 4, "0"))
    kind = F.pmod("file", F.lit(8))
    cells = {"Order ID": F.col("seq").cast("string"), "Instrument-Code": F.col("ticker"), "Position_Size": F.col("q").cast("string"), "Executed At": F.col("d").cast("string"), "Account Number": account}
    orders = {"brokerage": list(cells), "backwards": list(reversed(cells))}

    def write(rows: DataFrame, name: str, header: list[str]) -> None:
        # by all cells, as several trades may have one number: equal files must be equal in each byte
        by_file = rows.select("file", *(cells[h].alias(h) for h in header)).repartition(64, "file").sortWithinPartitions("file", F.col("Order ID").cast("long"), *cells)
        by_file.write.partitionBy("file").option("header", True).option("emptyValue", "").csv(f"{root}/{name}")

    write(t.where(kind < 4), "brokerage", orders["brokerage"])
    write(t.where((kind >= 4) & (kind < 7)), "backwards", orders["backwards"])
    write(t.where("file = 0"), "again", orders["brokerage"])
    line = F.concat_ws(",", F.col("seq").cast("string"), "ticker", F.when(F.col("seq") % 3 == 0, "a cell too many"))
    torn = t.where(kind == 7)
    lines = torn.select("file", "seq", line.alias("line")).unionByName(torn.select("file", F.lit(-1).cast("long").alias("seq"), F.lit("Order ID,Instrument-Code").alias("line")).distinct())
    lines.repartition(64, "file").sortWithinPartitions("file", "seq").drop("seq").write.partitionBy("file").option("sep", "\u0001").csv(f"{root}/torn")


@query("""
, f AS (SELECT *, seq % 64 AS file, CASE WHEN seq % 64 % 8 < 4 THEN 'brokerage' WHEN seq % 64 % 8 < 7 THEN 'backwards' ELSE 'torn' END AS folder, CASE WHEN book % 7 <> 0 THEN lpad(CAST(book % 5 AS VARCHAR), 4, '0') END AS account FROM trade
), all_ AS (FROM f UNION ALL SELECT * REPLACE ('again' AS folder) FROM f WHERE file = 0
), s AS (SELECT folder, file, bool_or(folder = 'torn' AND seq % 3 = 0) AS bad, count(*) AS n, count(DISTINCT account) AS accounts, count(*) FILTER (account IS NULL) AS unresolved, round(sum(q), 2) AS quantity, max(seq) AS last_order FROM all_ GROUP BY ALL)
SELECT folder, file, CASE WHEN bad THEN 'blocked' ELSE 'staged' END AS status, CASE WHEN bad THEN 'row width' END AS issue, CASE WHEN file = 0 THEN 2 ELSE 1 END AS same_content,
  CASE WHEN bad THEN 0 ELSE n END AS rows, CASE WHEN NOT bad THEN CASE WHEN folder = 'torn' THEN 0 ELSE accounts END END AS accounts, CASE WHEN NOT bad THEN CASE WHEN folder = 'torn' THEN n ELSE unresolved END END AS unresolved,
  CASE WHEN NOT bad AND folder <> 'torn' THEN quantity END AS quantity, CASE WHEN NOT bad THEN n END AS ids, CASE WHEN NOT bad THEN last_order END AS last_order FROM s
""")
def src1_src2_prj1_prj6_staged_files(spark, sf_dir):
    """Trades dropped as files of several header orders, some broken, one twice; what was staged of each, by its own header."""
    root = f"{scratch_root(spark)}/drop-{uuid.uuid4().hex}"
    _drop_trades(spark, sf_dir, root)
    sources, rows, issues = staging.stage_files(spark, f"{root}/*/*/*.csv", "session", MOST_BYTES)
    same = sources.groupBy("sha256").agg(F.count(F.lit(1)).cast("int").alias("same_content"))
    role = lambda r: F.col("roles")[r]
    by = rows.groupBy("source_id").agg(
        F.count_distinct("account").alias("accounts"), F.count_if(F.col("account").isNull()).alias("unresolved"), F.sum(scalars.clean_number(role("quantity"))).alias("quantity"),
        F.count_distinct("record_id").alias("ids"), F.max_by(role("transaction_id"), "source_row").cast("long").alias("last_order"),
    )
    place = lambda k: F.element_at(F.split("path", "/"), k)
    told = sources.join(same, "sha256").join(by, "source_id", "left").join(issues.select("source_id", "issue"), "source_id", "left")
    return rounded(told.select(place(-3).alias("folder"), F.substring(place(-2), 6, 9).cast("long").alias("file"), "status", "issue", "same_content", "rows", "accounts", "unresolved", "quantity", "ids", "last_order"), 2)


@query("""
, f AS (SELECT o_orderkey % 16 AS file, count(*) AS n FROM orders GROUP BY 1)
SELECT step, files, "rows", confirmed FROM (
  SELECT 1 AS step, count(*) AS files, CAST(sum(n) AS BIGINT) AS "rows", true AS confirmed FROM f WHERE file % 2 = 0
  UNION ALL SELECT 2, count(*), CAST(sum(n) AS BIGINT), false FROM f UNION ALL SELECT 3, count(*), CAST(sum(n) AS BIGINT), true FROM f) ORDER BY step
""")
def src3_inc1_staged_increments(spark, sf_dir):
    """Orders dropped as files in two runs, the second with copies of what the first had: each content is staged once, and a new file ends the confirmation."""
    root = f"{scratch_root(spark)}/increments-{uuid.uuid4().hex}"
    o = tables.load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 16).alias("file"), F.col("o_orderkey").cast("string").alias("Reference"), F.col("o_custkey").cast("string").alias("Portfolio ID"), F.col("o_totalprice").cast("string").alias("Amount"))

    def put(rows: DataFrame, run: str) -> None:
        rows.repartition(16, "file").sortWithinPartitions("file", F.col("Reference").cast("long")).write.partitionBy("file").option("header", True).csv(f"{root}/drop/{run}")

    def stage() -> staging.Draft:
        return incremental.stage_new_files(spark, f"{root}/drop", f"{root}/draft", f"{root}/state", most_bytes=MOST_BYTES)

    def told(step: int) -> tuple:
        return step, draft.sources().count(), draft.rows().count(), draft.confirmed()

    put(o.where("file % 2 = 0"), "one")
    draft = stage()
    draft.confirm("first reviewer")
    steps = [told(1)]
    put(o.where("file % 2 = 0"), "again")
    put(o.where("file % 2 = 1"), "two")
    draft = stage()
    steps.append(told(2))
    draft.confirm("second reviewer")
    steps.append(told(3))
    return spark.createDataFrame(steps, "step int, files long, rows long, confirmed boolean")


@query(" SELECT 'a' || (book % 3) AS account, count(*) AS n, count(*) AS ids, round(sum(q), 2) AS quantity, 0::BIGINT AS issues FROM trade GROUP BY ALL")
def src1_prj1_prj6_staged_files(spark, sf_dir):
    """Trades written as CSV with a broker's headers and staged again: roles by header, records by account."""
    path = f"{scratch_root(spark)}/drop-{uuid.uuid4().hex}"
    t = tables.trades(spark, sf_dir)
    t.select(
        F.col("seq").alias("Order ID"), F.col("ticker").alias("Instrument-Code"), F.col("q").alias("Position_Size"), F.col("d").alias("Executed At"), F.concat(F.lit("a"), F.col("book") % 3).alias("Account ID"), F.lit(0).alias("drop")
    ).write.partitionBy("drop").option("header", True).option("maxRecordsPerFile", 500_000).csv(path)  # some 25 MB a file, whatever the tasks; without a folder by value, a first task with no rows would leave a file of a header
    _, rows, issues = staging.stage_files(spark, path, "session")
    by = rows.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("ids"), F.sum(scalars.clean_number(F.col("roles")["quantity"])).alias("quantity"))
    return rounded(by.join(F.broadcast(issues.agg(F.count(F.lit(1)).alias("issues")))), 2)


@query(" SELECT label, count(*) AS n FROM book GROUP BY label")
def inc1_staged_increments(spark, sf_dir):
    """Books dropped as files in two runs, the second with a copy of what the first had: each content is staged once."""
    root = f"{scratch_root(spark)}/increments-{uuid.uuid4().hex}"
    b = tables.books(spark, sf_dir)
    for part, run in ((0, "one"), (0, "again"), (1, "two")):
        b.where(F.col("book") % 2 == part).repartition(8, "book").sortWithinPartitions("book").write.option("header", True).csv(f"{root}/drop/{run}")
        if run != "again":
            draft = incremental.stage_new_files(spark, f"{root}/drop", f"{root}/draft", f"{root}/state")
    return draft.rows().groupBy(F.col("cells")["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT ticker, count(*) AS n, round(sum(q), 2) AS quantity, 'lines.at,lines.inner.q,ticker' AS fields FROM trade GROUP BY ticker")
def prj10_redacted(spark, sf_dir):
    """Trades without private fields at any depth."""
    t = tables.trades(spark, sf_dir)
    inner = F.struct("q", F.col("seq").alias("transaction_id"))
    nested = t.select("ticker", F.col("book").alias("account"), F.array(F.struct(F.col("d").alias("at"), F.col("book").alias("account"), inner.alias("inner"))).alias("lines"))
    r = normalise.redact(nested)
    fields = ",".join(sorted(normalise.field_names(r.schema)))
    return rounded(r.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("lines")[0]["inner"]["q"]).alias("quantity"), F.lit(fields).alias("fields")), 2)
