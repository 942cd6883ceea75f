"""Duplicate review of staged records, look-through of funds, and identity of securities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweave.operators.components import connected_components
from bookweave.plans.scratch import stage_table


def signature(*columns: str) -> Column:
    """SHA-256 of the columns as canonical JSON: names in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def same_content(records: DataFrame, signature_column: str = "sig") -> DataFrame:
    """(a, b) sources of equal content: same number of records and the same digest of their signatures."""
    sums = [F.sum(F.conv(F.substring(signature_column, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(4)]
    digest = records.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *sums)
    keys = ["n", "s0", "s1", "s2", "s3"]
    first = digest.groupBy(*keys).agg(F.min("source").alias("a"))
    return digest.join(first, keys).where("source > a").select("a", F.col("source").alias("b"), "n")


def changed_content(records: DataFrame) -> DataFrame:
    """(name, versions) of files of one name whose contents differ: records has name, source (one file) and sig."""
    sums = [F.sum(F.conv(F.substring("sig", 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(4)]
    digest = records.groupBy("name", "source").agg(F.struct(F.count(F.lit(1)), *sums).alias("content"))
    return digest.groupBy("name").agg(F.count_distinct("content").alias("versions")).where("versions > 1")


def id_conflicts(records: DataFrame) -> DataFrame:
    """Per (account, transaction_id) that occurs again: `duplicate` where all fields agree, else `conflict`."""
    g = records.where("transaction_id is not null").groupBy("account", "transaction_id").agg(F.count(F.lit(1)).alias("n"), (F.min("sig") == F.max("sig")).alias("same"))
    return g.where("n > 1").select("account", "transaction_id", "n", F.when(F.col("same"), "duplicate").otherwise("conflict").alias("issue"))


def possible_duplicates(records: DataFrame) -> DataFrame:
    """Records of one account with equal economic fields under different or missing ids."""
    g = records.groupBy("account", "sig").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("transaction_id").alias("ids"), F.count_if(F.col("transaction_id").isNull()).alias("without"))
    return g.where("n > 1 and (ids > 1 or without > 0)").select("account", "sig", "n", "ids", "without")


def across_accounts(records: DataFrame) -> DataFrame:
    """Signatures that are in several accounts."""
    g = records.groupBy("sig").agg(F.count_distinct("account").alias("accounts"), F.count(F.lit(1)).alias("n"))
    return g.where("accounts > 1")


def overlapping_periods(parts: DataFrame) -> DataFrame:
    """Pairs of parts of one account whose date ranges meet: (account, a, b). Parts are few per account."""
    b = parts.select("account", F.col("part").alias("b"), F.col("first").alias("bf"), F.col("last").alias("bl"))
    a = parts.select("account", F.col("part").alias("a"), "first", "last")
    return a.join(b, "account").where((F.col("a") < F.col("b")) & (F.col("first") <= F.col("bl")) & (F.col("bf") <= F.col("last"))).select("account", "a", "b")


def retained(records: DataFrame, sources: DataFrame, parts: DataFrame, ids: DataFrame) -> DataFrame:
    """Records without those of excluded sources, parts (source, account) and record ids.

    Sources and parts are as few as reviewers name: they go to every task, as a shuffle by
    source would bring all records of one together.
    """
    out = records.join(F.broadcast(sources.select("source")), "source", "left_anti").join(F.broadcast(parts.select("source", "account")), ["source", "account"], "left_anti")
    return out.join(ids.select("record_id"), "record_id", "left_anti")


def latest_decisions(decisions: DataFrame, basis: DataFrame) -> DataFrame:
    """The last decision per issue whose evidence hash is still the present one; reversed ones count as none."""
    last = decisions.groupBy("issue_id").agg(F.max_by(F.struct("action", "basis"), "at").alias("x")).select("issue_id", "x.*")
    return last.join(basis.select("issue_id", "basis"), ["issue_id", "basis"]).where("action <> 'reverse'")


def table_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: number of rows and an order-free digest of them."""
    s = df.select(signature(*columns).alias("sig"))
    return s.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.conv(F.substring("sig", 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(0)).alias(f"d{i}") for i in range(4)))


def opposite_trades(trades: DataFrame) -> DataFrame:
    """(book, ticker, d) on which a book both buys and sells."""
    return trades.groupBy("book", "ticker", "d").agg(F.count(F.lit(1)).alias("n"), (F.min(F.signum("q")) < F.max(F.signum("q"))).alias("both")).where("both").select("book", "ticker", "d", "n")


def identity(rows: DataFrame, row: str = "row_id", ids: str = "ids") -> DataFrame:
    """(row, component): rows that share any typed identifier `kind:value`, directly or over others, are one security.

    rows: a long id, not negative, and an array of identifiers. Identifiers get negative
    numbers of their own, so each is a node; a hot identifier is one node, not all pairs of
    rows.
    """
    links = rows.select(F.col(row).alias("a"), F.explode(ids).alias("k")).where("k is not null")
    numbers = stage_table(links.select("k").distinct().select("k", (-2 - F.monotonically_increasing_id()).alias("b")), "numbers")
    edges = links.join(numbers, "k").select(F.lit(None).cast("long").alias("x"), "a", "b")
    groups = connected_components(edges, "a", "b")
    named = rows.select(F.col(row).alias("node")).join(groups, "node", "left")
    first = named.groupBy("component").agg(F.min("node").alias("first"))
    return named.join(first, "component", "left").select(F.col("node").alias(row), F.coalesce("first", "node").alias("component"))


def conflicting(rows: DataFrame, components: DataFrame, row: str = "row_id", ids: str = "ids") -> DataFrame:
    """Components that hold two values of one kind of identifier."""
    k = rows.select(row, F.explode(ids).alias("k")).join(components, row).select("component", F.split("k", ":")[0].alias("kind"), "k")
    return k.groupBy("component", "kind").agg(F.count_distinct("k").alias("n")).where("n > 1").select("component").distinct()


def coverage(constituents: DataFrame) -> DataFrame:
    """Per parent: total weight, what is not reported, and its state."""
    c = constituents.groupBy("parent").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    one = F.lit(1).cast("decimal(38,18)")
    left = F.greatest(one - F.col("total"), F.lit(0).cast("decimal(38,18)"))
    state = F.when(F.col("total") > 1, "overweight").when(F.col("total") == 1, "complete").otherwise("partial")
    return c.withColumns({"unreported": left, "state": state})


def look_through(holdings: DataFrame, constituents: DataFrame) -> DataFrame:
    """(book, security, direct, indirect, total): what books hold themselves and through funds, exact decimals.

    Funds that are overweight are not looked through and count as held directly.
    """
    good = constituents.join(coverage(constituents).where("state <> 'overweight'").select("parent"), "parent", "left_semi")
    value = F.col("value").cast("decimal(18,6)")
    inside = holdings.join(good, holdings.ticker == good.parent).select("book", F.col("constituent").alias("security"), F.lit(0).cast("decimal(38,18)").alias("direct"), (value.cast("decimal(18,6)") * F.col("weight").cast("decimal(19,18)")).cast("decimal(38,18)").alias("indirect"))  # of funds of 1 at most, so no weight is too large
    funds = good.select(F.col("parent").alias("ticker")).distinct()
    own = holdings.join(funds, "ticker", "left_anti").select("book", F.col("ticker").alias("security"), value.cast("decimal(38,18)").alias("direct"), F.lit(0).cast("decimal(38,18)").alias("indirect"))
    return own.unionByName(inside).groupBy("book", "security").agg(F.sum("direct").cast("double").alias("direct"), F.sum("indirect").cast("double").alias("indirect"))


def accepted(versions: DataFrame) -> DataFrame:
    """The last ready version of each parent."""
    n = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("accepted_at"), F.desc("snapshot")))
    return versions.where("ready").withColumn("_n", n).where("_n = 1").drop("_n")
