"""What books own through funds, by the identity of securities, in exact decimals.

A fund's value goes to its constituents by their reported weights. Securities are one
where they share a typed identifier, directly or over others; a component with two values
of one kind is no security, and what it is worth stays unresolved. Per book, eligible
value = known + unknown + unresolved, to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.operators import review
from bookweave.plans.scratch import stage_table

VALUE, WEIGHT = "decimal(18,6)", "decimal(19,18)"
#: Weights and their sums before it is known that they are 1 at most.
WIDE = "decimal(28,18)"
#: Two digits less than the most, so that two of them add up without a loss of places.
EXACT = "decimal(36,24)"


def components(securities: DataFrame) -> DataFrame:
    """(security, component, conflict) of (security, ids): ids are texts `kind:value`, repeated rows of a security add theirs.

    component is the least security that is reached. conflict: it has two values of one
    kind, or no identifier at all.
    """
    long = securities.select("security", F.explode_outer("ids").alias("k"))
    named = stage_table(long.select("security").distinct().select("security", F.monotonically_increasing_id().alias("row_id")), "securities")
    ids = long.join(named, "security").groupBy("row_id").agg(F.array_compact(F.collect_set("k")).alias("ids"))
    ids = stage_table(ids, "identifiers")
    joined = stage_table(review.identity(ids), "components")
    kinds = ids.select("row_id", F.explode("ids").alias("k")).join(joined, "row_id").groupBy("component", F.substring_index("k", ":", 1).alias("kind")).agg((F.min("k") < F.max("k")).alias("two"))
    told = kinds.groupBy("component").agg(F.bool_or("two").alias("two"))
    first = joined.join(named, "row_id").groupBy("component").agg(F.min("security").alias("first"))
    return joined.join(named, "row_id").join(first, "component").join(told, "component", "left").select("security", F.col("first").alias("component"), F.coalesce("two", F.lit(True)).alias("conflict"))


def fund_states(constituents: DataFrame, snapshots: DataFrame, as_of: str, most_days: int) -> DataFrame:
    """(parent, subtotal, usable, complete, stale) of every fund with a snapshot.

    constituents: (parent, security, weight, equity), one row each; snapshots: (parent,
    day, verified). Not usable: weights above 1, one missing, a constituent that is no
    equity or is listed twice, or no constituent. Stale: older than most_days, of the
    future, or of no day. Complete only where all is reported and someone verified it.
    """
    c = constituents.groupBy("parent").agg(
        F.sum(F.col("weight").cast(WIDE)).alias("subtotal"), F.bool_and(F.coalesce("equity", F.lit(False))).alias("equity"), F.bool_or(F.col("weight").isNull()).alias("lacking"),
        (F.count(F.lit(1)) > F.count_distinct("security")).alias("twice"),
    )
    age = F.datediff(F.to_date(F.lit(as_of)), "day")
    usable = F.coalesce(F.col("equity") & ~F.col("lacking") & ~F.col("twice") & (F.col("subtotal") <= 1), F.lit(False))
    return snapshots.join(c, "parent", "left").select(
        "parent", F.coalesce("subtotal", F.lit(0)).cast("decimal(38,18)").alias("subtotal"), usable.alias("usable"),
        (F.coalesce("verified", F.lit(False)) & (F.col("subtotal") == 1)).alias("complete"), F.coalesce(~age.between(0, most_days), F.lit(True)).alias("stale"),
    )


def _exact(x: Column) -> Column:
    return x.cast(EXACT)


def look_through(positions: DataFrame, constituents: DataFrame, snapshots: DataFrame, declared: DataFrame, identifiers: DataFrame, as_of: str, most_days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(securities, books, issues) of long tables.

    positions: (book, ticker, value, fund, equity, supported), one row per book and ticker;
    declared: (parent) of funds that someone confirmed as ordinary equity funds;
    identifiers: (security, ids) of tickers and constituents alike.

    securities: (book, component, direct, indirect, total, funds), what each book is known
    to own of each security. books: (book, eligible, known, unknown, unresolved, residual,
    complete). issues: (book, parent, code). A holding that is no fund and no equity, or has
    no value, is outside the scope. A fund counts in full as unknown where it has no
    snapshot or none that is usable, and for the part that is not reported; one that is
    short, of no value, of an unsupported kind or not declared is left out, with an issue.
    No rows give no rows.
    """
    p = positions.withColumn("value", F.col("value").cast(VALUE))
    funds = stage_table(p.where("fund").join(declared.select(F.col("parent").alias("ticker"), F.lit(True).alias("declared")).distinct(), "ticker", "left").join(fund_states(constituents, snapshots, as_of, most_days).withColumnRenamed("parent", "ticker"), "ticker", "left"), "funds")
    bad = F.col("value").isNull() | (F.col("value") <= 0) | ~F.coalesce("supported", F.lit(True))
    code = F.when(bad, "unsupported fund").when(F.col("declared").isNull(), "eligibility unverified").when(F.col("subtotal").isNull(), "no data").when(~F.col("usable"), "composition unavailable")
    funds = funds.withColumn("code", code)
    open_ = funds.where("code is null")
    eligible = funds.where("code is null or code in ('no data', 'composition unavailable')")
    outside = p.where(~F.col("fund") & (~F.coalesce("equity", F.lit(False)) | F.col("value").isNull()))
    own = p.where(~F.col("fund") & F.coalesce("equity", F.lit(False)) & F.col("value").isNotNull())
    partial = open_.where("not complete").select("book", "ticker", F.lit("incomplete coverage").alias("code"))
    stale = open_.where("stale").select("book", "ticker", F.lit("stale").alias("code"))
    issues = outside.select("book", "ticker", F.lit("outside scope").alias("code")).unionByName(funds.where("code is not null").select("book", "ticker", "code")).unionByName(partial).unionByName(stale)

    inside = open_.select("book", F.col("ticker").alias("parent"), "value").join(constituents.select("parent", "security", "weight"), "parent")
    entries = own.select("book", F.col("ticker").alias("security"), _exact(F.col("value")).alias("direct"), _exact(F.lit(0)).alias("indirect"), F.lit(None).cast("string").alias("parent")).unionByName(
        inside.select("book", "security", _exact(F.lit(0)).alias("direct"), _exact(F.col("value") * F.col("weight").cast(WEIGHT)).alias("indirect"), "parent")
    )
    named = stage_table(components(identifiers), "identity")
    entries = entries.join(named, "security", "left").withColumns({"component": F.coalesce("component", "security"), "conflict": F.coalesce("conflict", F.lit(True))})
    per = stage_table(entries.groupBy("book", "component", "conflict").agg(_exact(F.sum("direct")).alias("direct"), _exact(F.sum("indirect")).alias("indirect"), F.count_distinct("parent").alias("funds")), "entries")
    total = _exact(F.col("direct") + F.col("indirect"))
    securities = per.where("not conflict").select("book", "component", "direct", "indirect", total.alias("total"), "funds")
    clashes = per.where("conflict").select("book", F.col("component").alias("ticker"), F.lit("identity conflict").alias("code"))

    zero = _exact(F.lit(0))
    row = lambda df, **k: df.select("book", *(_exact(k[c]).alias(c) if c in k else zero.alias(c) for c in ("eligible", "known", "unknown", "unresolved")))
    whole = eligible.where("code is not null")
    rest = _exact(F.col("value") * (F.lit(1).cast(WEIGHT) - F.col("subtotal").cast(WEIGHT)).cast(WEIGHT))
    sums = row(own, eligible=F.col("value")).unionByName(row(eligible, eligible=F.col("value"))).unionByName(row(whole, unknown=F.col("value"))).unionByName(row(open_, unknown=rest))
    sums = sums.unionByName(row(per.where("not conflict"), known=total)).unionByName(row(per.where("conflict"), unresolved=total)).unionByName(row(p.select("book").distinct()))
    books = sums.groupBy("book").agg(*(_exact(F.sum(c)).alias(c) for c in ("eligible", "known", "unknown", "unresolved")))
    told = _exact(_exact(F.col("known") + F.col("unknown")) + F.col("unresolved"))
    books = books.withColumn("residual", F.col("eligible") - told)
    issues = stage_table(issues.unionByName(clashes).withColumnRenamed("ticker", "parent"), "issues")
    flawed = issues.select("book").distinct().withColumn("complete", F.lit(False))
    return securities, books.join(flawed, "book", "left").withColumn("complete", F.coalesce("complete", F.lit(True))), issues
