"""Duplicate review as an append-only log, replayed over staged records.

A decision holds what its sources looked like. It counts while they still look like that
and no later event reversed it. Issues are found again on what is left, so a decision
that removes too little leaves an issue, under another id as its records are others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.operators.publish import content_digest
from bookweave.plans.scratch import stage_table

#: Columns of the log: its events, what each saw of its sources, and what it removes. Events of one seq are of different issues.
EVENTS = "seq long, event string, issue_id string, action string, reason string, digest string"
BASES = "seq long, issue_id string, source string, basis string"
TARGETS = "seq long, issue_id string, kind string, target string"


def order_free(value: Column) -> list[Column]:
    """Aggregates that tell sets of texts apart, whatever their order: four sums of the parts of their SHA-256."""
    return [F.sum(F.conv(F.substring(F.sha2(value, 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]


def source_basis(records: DataFrame) -> DataFrame:
    """(source, basis): a digest of a source's records with their parts, accounts and contents."""
    row = F.concat_ws("\x1f", "record_id", "part", F.coalesce("account", F.lit("\x00")), "kind", "sig", F.coalesce("transaction_id", F.lit("\x00")))
    return records.groupBy("source").agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *order_free(row)), 256).alias("basis"))


def packed(text: Column) -> Column:
    """text as bytes, digests in half of their length: what a shuffle or a table takes of it. unpacked undoes it."""
    return F.when(text.rlike(r"\A([0-9a-f]{2})+\z"), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), F.encode(text, "utf-8")))


def unpacked(code: Column) -> Column:
    rest = F.substring(code, 2, 2**31 - 1)
    return F.when(F.substring(code, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8"))


def detect(records: DataFrame, contents: bool = True) -> tuple[DataFrame, DataFrame]:
    """(issues, members): blocking issues (issue_id, code, account, key, n) and the records (issue_id, record_id, source) of each.

    Of records of one account: several under one transaction id are a `transaction_duplicate`
    where all agree, else a `transaction_id_conflict`; equal contents under different ids or
    none are a `transaction_match_ambiguous`, which is not looked for without contents.
    Records without an account take no part. An id names the code, the account, the key and
    the set of records.
    """
    own = records.where("account is not null and kind <> 'holdings'")
    # Numbers of the signature's digest agree where signatures do, and are kept in a hash table, so records are not sorted for it.
    parts = [F.conv(F.substring(F.sha2("sig", 256), 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    same = reduce(and_, (F.min(p) == F.max(p) for p in parts))
    found = own.where("transaction_id is not null").groupBy("account", packed(F.col("transaction_id")).alias("key")).agg(F.count(F.lit(1)).alias("n"), same.alias("same"), F.concat_ws("|", *order_free(F.col("record_id"))).alias("set"))
    columns = ("code", "account", "key", "n", "set")
    found = found.where("n > 1").withColumn("code", F.when(F.col("same"), "transaction_duplicate").otherwise("transaction_id_conflict")).select(*columns)
    if contents:
        # Few contents agree within a task, so records are shuffled as they are: what an aggregate holds of one takes more.
        rows = own.select("account", packed(F.col("sig")).alias("key"), "transaction_id", "record_id").repartition("account", "key")
        of_sig = rows.groupBy("account", "key").agg(F.count(F.lit(1)).alias("n"), F.min("transaction_id").alias("a"), F.max("transaction_id").alias("b"), F.count_if(F.col("transaction_id").isNull()).alias("without"), F.concat_ws("|", *order_free(F.col("record_id"))).alias("set"))
        of_sig = of_sig.where("n > 1 and (without > 0 or a < b)").withColumn("code", F.lit("transaction_match_ambiguous"))
        found = found.unionByName(of_sig.select(*columns))
    told = F.sha2(F.concat_ws("\x1f", "code", "account", unpacked(F.col("key")), "n", "set"), 256)
    issues = stage_table(found.select(F.unhex(told).alias("issue_id"), "code", "account", "key", "n"), "found").withColumns({"issue_id": F.lower(F.hex("issue_id")), "key": unpacked(F.col("key"))})
    return issues, members_of(records, issues)


def members_of(records: DataFrame, issues: DataFrame) -> DataFrame:
    """(issue_id, record_id, source) of the records of issues, which detect found in them."""
    own = records.where("account is not null and kind <> 'holdings'")
    by_id = issues.where("code <> 'transaction_match_ambiguous'").join(own.withColumn("key", F.col("transaction_id")), ["account", "key"])
    by_sig = issues.where("code = 'transaction_match_ambiguous'").join(own.withColumn("key", F.col("sig")), ["account", "key"])
    return by_id.select("issue_id", "record_id", "source").unionByName(by_sig.select("issue_id", "record_id", "source"))


@dataclass
class Log:
    """The three tables of the log."""

    events: DataFrame
    bases: DataFrame
    targets: DataFrame

    def decide(self, seq: int, decided: DataFrame, members: DataFrame, basis: DataFrame, removed: DataFrame) -> Log:
        """The log with a decision at seq for each row of decided (issue_id, action, reason), one per issue.

        members and basis tell the sources that each saw; removed is (issue_id, kind, target)
        of kind source, part or record. An empty reason is refused.
        """
        if decided.where("reason is null or trim(reason) = ''").limit(1).count():
            raise ValueError("a decision needs a reason")
        at = F.lit(seq).cast("long").alias("seq")
        events = decided.select(at, F.lit("decision").alias("event"), "issue_id", "action", "reason", F.lit(None).cast("string").alias("digest"))
        made = decided.select("issue_id")
        saw = made.join(members.select("issue_id", "source").distinct(), "issue_id").join(basis, "source").select(at, "issue_id", "source", "basis")
        gone = made.join(removed, "issue_id").select(at, "issue_id", "kind", "target")
        return Log(self.events.unionByName(events), self.bases.unionByName(saw), self.targets.unionByName(gone))

    def reverse(self, seq: int, reversed_: DataFrame) -> Log:
        """The log with a reversal at seq of the decisions on each row of reversed_ (issue_id, reason)."""
        rows = reversed_.select(F.lit(seq).cast("long").alias("seq"), F.lit("reversal").alias("event"), "issue_id", F.lit(None).cast("string").alias("action"), "reason", F.lit(None).cast("string").alias("digest"))
        return Log(self.events.unionByName(rows), self.bases, self.targets)

    def confirm(self, seq: int, digest: str) -> Log:
        row = self.events.sparkSession.createDataFrame([(seq, "confirmation", None, None, None, digest)], EVENTS)
        return Log(self.events.unionByName(row), self.bases, self.targets)


def empty_log(spark) -> Log:
    return Log(*(spark.createDataFrame([], schema) for schema in (EVENTS, BASES, TARGETS)))


@dataclass
class View:
    """What a log makes of records: decisions with their state, records kept, issues of these, and whether review may end."""

    decisions: DataFrame
    kept: DataFrame
    issues: DataFrame
    digest: str
    can_progress: bool
    confirmed: bool


def replay(records: DataFrame, log: Log) -> View:
    """The present view. records: (record_id, source, part, account, kind, transaction_id, sig), text but for nulls.

    decisions: (issue_id, seq, action, state): the last event of an issue counts; `reversed`
    if that is a reversal, `void` if a source has changed or gone since, else `active`. Only
    active ones remove records, by source, part or record. issues: those of what is kept,
    with `open`: no active decision on that very issue keeps both. Review may end with
    records left, nothing open and nothing void; it is confirmed while the last
    confirmation has the digest of now.
    """
    last = log.events.where("issue_id is not null").groupBy("issue_id").agg(F.max_by(F.struct("seq", "event", "action"), "seq").alias("x")).select("issue_id", "x.*")
    now = stage_table(source_basis(records).select("source", F.col("basis").alias("now")), "now")
    seen = log.bases.join(now, "source", "left").groupBy("seq", "issue_id").agg(F.bool_and(F.coalesce(F.col("basis") == F.col("now"), F.lit(False))).alias("same"))
    state = F.when(F.col("event") == "reversal", "reversed").when(F.coalesce("same", F.lit(False)), "active").otherwise("void")
    decisions = stage_table(last.join(seen, ["seq", "issue_id"], "left").select("issue_id", "seq", "action", state.alias("state")), "decisions")
    active = decisions.where("state = 'active'")
    gone = stage_table(log.targets.join(active.select("seq", "issue_id"), ["seq", "issue_id"]).select("kind", "target").distinct(), "gone")
    removes = {r.kind for r in gone.select("kind").distinct().collect()}  # three at most; what nothing removes by needs no join
    kept = records.withColumn("sig", packed(F.col("sig")))
    for kind, column in (("source", "source"), ("part", "part"), ("record", "record_id")):
        if kind in removes:
            kept = kept.join(gone.where(F.col("kind") == kind).select(F.col("target").alias(column)), column, "left_anti")
    kept = stage_table(kept.select(*records.columns), "kept").withColumn("sig", unpacked(F.col("sig")))
    both = active.where("action = 'keep_both'").select("issue_id", F.lit(True).alias("settled"))
    issues = detect(kept)[0].join(both, "issue_id", "left").withColumn("open", F.col("settled").isNull()).drop("settled")
    digest = content_digest(
        now.select(F.lit("basis").alias("what"), F.col("source").alias("a"), F.col("now").alias("b")).unionByName(active.select(F.lit("decision").alias("what"), F.col("issue_id").alias("a"), F.concat_ws("#", "seq", "action").alias("b"))).unionByName(kept.select(F.lit("kept").alias("what"), F.col("record_id").alias("a"), F.lit("").alias("b")))
    )
    can = bool(kept.limit(1).count()) and not issues.where("open").limit(1).count() and not decisions.where("state = 'void'").limit(1).count()
    said = log.events.where("event = 'confirmation'").agg(F.max_by("digest", "seq")).first()[0]
    return View(decisions, kept, issues, digest, can, can and said == digest)
