"""What stands against a consolidation, and publishing it in versions.

A candidate is tables made from reviewed records. It is published only while the digests
of the records, of their review and of its request are those it was made from, and only
if no gate is shut. Tables lie in a folder per version; readers see the current one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.operators.review import signature

CASH = "CASH"


def content_digest(df: DataFrame, *columns: str) -> str:
    """One digest of all rows, whatever their order; repeated rows count."""
    marks = df.select(signature(*(columns or df.columns)).alias("s"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("s", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(8)]
    return marks.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("d")).first()["d"]


def gates(records: DataFrame, declarations: DataFrame, valuation: str, today: str, market: DataFrame) -> DataFrame:
    """(account, ticker, code): every reason against consolidating; null where it concerns no one account or ticker.

    records: (account, part, kind holdings, ledger or cashflow, ticker, type, day, at, ccy,
    price, snapshot_day, qty), repeated rows allowed; at is a trade's timestamp as text, of
    ledger rows only. declarations: (account, complete_from_zero, snapshot_day), one row per
    account. market: (ticker), those with a market price, whose supplied prices may differ.
    """
    day = F.to_date(F.lit(valuation))
    fine = F.lit(valuation).cast("date").isNotNull() & (F.try_to_date(F.lit(valuation)) <= F.to_date(F.lit(today)))
    one = records.sparkSession.range(1).where(~F.coalesce(fine, F.lit(False))).select(F.lit(None).cast("string").alias("account"), F.lit(None).cast("string").alias("ticker"), F.lit("bad valuation date").alias("code"))
    snapshot, security = F.col("kind") == "holdings", F.col("ticker").isNotNull() & (F.col("ticker") != CASH)

    # one row per account and part, then per account: all sums combine before the shuffle
    parts = records.groupBy("account", "part").agg(F.bool_or(snapshot).alias("held"), F.bool_or(~snapshot).alias("moved"), F.min(F.when(snapshot, F.col("snapshot_day"))).alias("first"), F.max(F.when(snapshot, F.col("snapshot_day"))).alias("last"), F.max(F.when(~snapshot, F.col("day"))).alias("moves_to"))
    per = parts.groupBy("account").agg(
        F.count_if("held").alias("snapshots"), F.count_if("moved").alias("ledgers"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("moves_to").alias("moves_to"),
    ).join(declarations.select("account", "complete_from_zero", F.col("snapshot_day").alias("declared")), "account", "left")
    first, last = F.coalesce("first", "declared"), F.coalesce("last", "declared")
    mixed = (F.col("snapshots") > 1) | ((F.col("snapshots") > 0) & (F.col("ledgers") > 0))
    only = ~mixed
    checks = {
        "overlapping formats": mixed,
        "no snapshot date": only & (F.col("snapshots") > 0) & first.isNull(),
        "other snapshot date": only & (F.col("snapshots") > 0) & ((first != day) | (last != day)),
        "opening history missing": only & (F.col("ledgers") > 0) & ~F.coalesce("complete_from_zero", F.lit(False)),
        "future transaction": only & (F.col("moves_to") > day),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())
    accounts = per.select("account", F.lit(None).cast("string").alias("ticker"), F.explode(found).alias("code"))

    events = records.where(F.col("kind") == "ledger").groupBy("account", "ticker", "at").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min("type").alias("s"), F.max("type").alias("t"))
    opposed = events.where("a < b and s < t").select("account", "ticker", F.lit("opposite trades at one time").alias("code")).distinct()

    supplied = records.where(snapshot & security & F.col("price").isNotNull()).groupBy("ticker").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    priced = market.select("ticker").distinct()
    quotes = supplied.where("low < high").join(priced, "ticker", "left_anti").select(F.lit(None).cast("string").alias("account"), "ticker", F.lit("conflicting prices").alias("code"))
    ccys = records.where(security).groupBy("ticker").agg(F.min("ccy").alias("a"), F.max("ccy").alias("b")).where("a < b")
    quoted = ccys.select(F.lit(None).cast("string").alias("account"), "ticker", F.lit("several currencies").alias("code"))
    held = records.where(security).groupBy("ticker", "account").agg(F.sum("qty").alias("qty")).groupBy("ticker").agg(F.min("qty").alias("low"), F.max("qty").alias("high"))
    sides = held.where("low < -1e-15 and high > 1e-15").select(F.lit(None).cast("string").alias("account"), "ticker", F.lit("long and short").alias("code"))
    return one.unionByName(accounts).unionByName(opposed).unionByName(quotes).unionByName(quoted).unionByName(sides)


def residuals(parts: DataFrame, whole: DataFrame, key: list[str], figures: list[str], tolerance: float = 1e-7) -> DataFrame:
    """(key, figure, residual, agrees): the whole less the sum of its parts, within tolerance of the whole's size; a key or figure that one side lacks does not agree."""
    sums = parts.groupBy(*key).agg(*(F.sum(c).alias(c) for c in figures))
    long = lambda df, name: df.select(*key, F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias(name)) for c in figures))).alias("x")).select(*key, "x.*")
    both = long(whole, "all").join(long(sums, "sum"), [*key, "figure"], "full")
    left = F.col("all") - F.col("sum")
    return both.select(*key, "figure", left.alias("residual"), F.coalesce(F.abs(left) <= tolerance * F.greatest(F.lit(1.0), F.abs("all")), F.lit(False)).alias("agrees"))


@dataclass
class Candidate:
    """Tables to publish, and the digests of what they were made from."""

    tables: dict[str, DataFrame]
    review: str
    request: str
    blocked: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


class Stale(ValueError):
    """A candidate that may not be published, with the reason."""


class Store:
    """Published tables below a folder, a folder `book_version=N` of each for every version.

    The last thing that a version gets is its row in `versions`; a version without it was
    never published, and its tables are written anew by the next try. Two writers of one
    number: the second fails on that row. Derived tables name the version that they were
    computed from; those of other versions are never read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def version(self) -> int:
        """The current version, 0 before the first."""
        if not self._exists("versions"):
            return 0
        return self.spark.read.parquet(f"{self.path}/versions").agg(F.max("book_version")).first()[0]

    def _write(self, name: str, df: DataFrame, version: int) -> None:
        df.withColumn("book_version", F.lit(version)).write.partitionBy("book_version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/tables/{name}")

    def publish(self, candidate: Candidate, review: str, request: str, confirmed: bool) -> int:
        """Publish the candidate's tables as the next version and return its number; Stale if it may not be."""
        if not confirmed:
            raise Stale("unconfirmed")
        if candidate.review != review:
            raise Stale("records or review changed")
        if candidate.request != request:
            raise Stale("another request")
        if candidate.blocked.limit(1).count():
            raise Stale("failed validation")
        version = self.version() + 1
        for name, df in candidate.tables.items():
            self._write(name, df, version)
        row = self.spark.createDataFrame([(review, request)], "review string, request string")
        row.write.mode("errorifexists").parquet(f"{self.path}/versions/book_version={version}")
        return version

    def derive(self, name: str, df: DataFrame, version: int) -> bool:
        """Write rows computed from that version; False, and nothing is written, if another is current by now."""
        if version != self.version():
            return False
        self._write(name, df, version)
        return True

    def read(self, name: str) -> DataFrame | None:
        """The current version of a table, without book_version; None if it has none."""
        version = self.version()
        if not version or not self._exists(f"tables/{name}/book_version={version}"):
            return None
        return self.spark.read.parquet(f"{self.path}/tables/{name}").where(F.col("book_version") == version).drop("book_version")
