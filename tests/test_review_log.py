"""The decision log and publishing in versions."""

import pytest
from pyspark.sql import functions as F

from bookweave.operators import decisions, publish

RECORD = "record_id string, source string, part string, account string, kind string, transaction_id string, sig string"


def records(spark, *rows):
    return spark.createDataFrame([(r, s, f"{s}:1", a, "ledger", t, c) for r, s, a, t, c in rows], RECORD)


def decide(spark, log, seq, recs, code, action, reason="because", removed=(), whole=None):
    """A decision on the one issue of that code."""
    issues, members = decisions.detect(recs)
    (issue,) = issues.where(F.col("code") == code).collect()
    decided = spark.createDataFrame([(issue.issue_id, action, reason)], "issue_id string, action string, reason string")
    gone = spark.createDataFrame([(issue.issue_id, k, t) for k, t in removed], "issue_id string, kind string, target string")
    return issue.issue_id, log.decide(seq, decided, members, decisions.source_basis(recs if whole is None else whole), gone)


def test_defer_reverse_and_confirm(spark):
    recs = records(spark, ("1", "f", "a", "T", "x"), ("2", "f", "a", "T", "x"))
    log = decisions.empty_log(spark)
    view = decisions.replay(recs, log)
    assert [r.code for r in view.issues.collect()] == ["transaction_duplicate"] and not view.can_progress
    issue, log = decide(spark, log, 1, recs, "transaction_duplicate", "defer")
    assert not decisions.replay(recs, log).can_progress
    log = log.reverse(2, spark.createDataFrame([(issue, "evidence is here")], "issue_id string, reason string"))
    _, log = decide(spark, log, 3, recs, "transaction_duplicate", "exclude_records", removed=[("record", "2")])
    view = decisions.replay(recs, log)
    assert view.can_progress and not view.confirmed and [r.record_id for r in view.kept.collect()] == ["1"] and view.issues.count() == 0
    log = log.confirm(4, view.digest)
    assert decisions.replay(recs, log).confirmed
    log = log.reverse(5, spark.createDataFrame([(issue, "look again")], "issue_id string, reason string"))
    view = decisions.replay(recs, log)
    assert not view.can_progress and not view.confirmed and view.kept.count() == 2
    assert [r.event for r in log.events.orderBy("seq").collect()] == ["decision", "reversal", "decision", "confirmation", "reversal"]
    with pytest.raises(ValueError, match="reason"):
        decide(spark, log, 6, recs, "transaction_duplicate", "defer", reason=" ")


def test_a_corrected_account_voids_what_was_decided(spark):
    recs = records(spark, ("1", "f", "a", "T", "x"), ("2", "g", "a", "T", "x"))
    issue, log = decide(spark, decisions.empty_log(spark), 1, recs, "transaction_duplicate", "exclude_sources", removed=[("source", "g")])
    log = log.confirm(2, decisions.replay(recs, log).digest)
    assert decisions.replay(recs, log).confirmed
    moved = recs.withColumn("account", F.when(F.col("source") == "g", "b").otherwise(F.col("account")))
    view = decisions.replay(moved, log)
    assert [r.state for r in view.decisions.collect()] == ["void"] and view.kept.count() == 2 and not view.can_progress and not view.confirmed
    log = log.reverse(3, spark.createDataFrame([(issue, "wrong account")], "issue_id string, reason string"))
    assert decisions.replay(moved, log).can_progress


def test_issues_are_found_again_on_the_rest(spark):
    recs = records(spark, ("1", "f", "a", "T", "x"), ("2", "f", "a", "T", "x"), ("3", "f", "a", "T", "y"), ("4", "g", "a", None, "y"), ("5", "g", None, "T", "x"), ("6", "g", "b", "T", "x"))
    _, log = decide(spark, decisions.empty_log(spark), 1, recs, "transaction_id_conflict", "exclude_records", removed=[("record", "3")])
    view = decisions.replay(recs, log)
    assert {r.code: r.n for r in view.issues.collect()} == {"transaction_duplicate": 2}
    _, log = decide(spark, log, 2, view.kept, "transaction_duplicate", "keep_both", whole=recs)
    view = decisions.replay(recs, log)
    assert view.can_progress and {r.state for r in view.decisions.collect()} == {"active"} and view.issues.where("open").count() == 0
    gone = decisions.replay(recs.where("source = 'g'"), log)
    assert {r.state for r in gone.decisions.collect()} == {"void"} and not gone.can_progress
    assert not decisions.replay(recs.limit(0), decisions.empty_log(spark)).can_progress


def test_only_what_removes_records_is_joined(spark, monkeypatch):
    recs = records(spark, ("1", "f", "a", "T", "x"), ("2", "f", "a", "T", "x"), ("3", "f", "a", None, "00ff"), ("4", "g", "a", "U", "00ff"))
    _, log = decide(spark, decisions.empty_log(spark), 1, recs, "transaction_duplicate", "exclude_records", removed=[("record", "2")])
    plans, stage = {}, decisions.stage_table
    monkeypatch.setattr(decisions, "stage_table", lambda df, label, *a: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and stage(df, label, *a))
    view = decisions.replay(recs, log)
    assert plans["kept"].count("LeftAnti") == 1 and [(r.record_id, r.sig) for r in view.kept.orderBy("record_id").collect()] == [("1", "x"), ("3", "00ff"), ("4", "00ff")]
    assert [r.key for r in view.issues.collect()] == ["00ff"]
    assert decisions.detect(view.kept, contents=False)[0].count() == 0


def test_packed_text_comes_back(spark):
    texts = ["", "x", "a", "ab", "AB", "00", "0f" * 32, "\x01", "é", None, "ab\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decisions.packed(F.col("t")).alias("p")).select("t", F.length("p").alias("n"), decisions.unpacked(F.col("p")).alias("back")).collect()
    assert all(r.back == r.t for r in rows) and {r.t: r.n for r in rows}["0f" * 32] == 33


GATE = "account string, part string, kind string, ticker string, type string, day date, at string, ccy string, price double, snapshot_day date, qty double"


def test_every_gate(spark):
    day = "2024-06-30"
    rows = [
        ("ok", "p", "holdings", "A", None, None, None, "USD", 5.0, day, 1.0), ("two", "p", "holdings", "A", None, None, None, "USD", 5.0, day, 1.0), ("two", "q", "holdings", "A", None, None, None, "USD", 5.0, day, 1.0),
        ("both", "p", "holdings", "A", None, None, None, "USD", 5.0, day, 1.0), ("both", "q", "ledger", "A", "BUY", "2024-01-01", "t", "USD", None, None, 1.0),
        ("undated", "p", "holdings", "A", None, None, None, "USD", 5.0, None, 1.0), ("declared", "p", "holdings", "A", None, None, None, "USD", 5.0, None, 1.0), ("other", "p", "holdings", "A", None, None, None, "USD", 5.0, "2024-06-29", 1.0),
        ("opened", "p", "ledger", "A", "BUY", "2024-01-01", "t", "USD", None, None, 1.0), ("future", "p", "ledger", "A", "BUY", "2024-07-01", "t", "USD", None, None, 1.0),
        ("opposed", "p", "ledger", "A", "BUY", "2024-01-01", "t", "USD", None, None, 3.0), ("opposed", "q", "ledger", "A", "SELL", "2024-01-01", "t", "USD", None, None, -1.0),
        ("ok", "p", "holdings", "Q", None, None, None, "USD", 7.0, day, 1.0), ("declared", "p", "holdings", "Q", None, None, None, "USD", 8.0, None, 1.0), ("ok", "p", "holdings", "M", None, None, None, "USD", 7.0, day, 1.0), ("declared", "p", "holdings", "M", None, None, None, "GBP", 8.0, None, 1.0),
        ("ok", "p", "holdings", "S", None, None, None, "USD", 1.0, day, 1.0), ("declared", "p", "holdings", "S", None, None, None, "USD", 1.0, None, -1.0), ("ok", "p", "holdings", "CASH", None, None, None, "USD", 1.0, day, 1.0), ("declared", "p", "holdings", "CASH", None, None, None, "EUR", 2.0, None, -1.0),
    ]
    recs = spark.createDataFrame([tuple(r) for r in rows], GATE.replace("date", "string")).withColumns({"day": F.to_date("day"), "snapshot_day": F.to_date("snapshot_day")})
    said = spark.createDataFrame([("declared", False, day), ("future", True, None), ("opposed", True, None), ("both", True, None)], "account string, complete_from_zero boolean, snapshot_day string").withColumn("snapshot_day", F.to_date("snapshot_day"))
    market = spark.createDataFrame([("M",)], "ticker string")
    got = {tuple(r) for r in publish.gates(recs, said, day, "2024-07-01", market).collect()}
    assert got == {
        ("two", None, "overlapping formats"), ("both", None, "overlapping formats"), ("undated", None, "no snapshot date"), ("other", None, "other snapshot date"), ("opened", None, "opening history missing"),
        ("future", None, "future transaction"), ("opposed", "A", "opposite trades at one time"), (None, "Q", "conflicting prices"), (None, "M", "several currencies"), (None, "S", "long and short"),
    }
    assert publish.gates(recs.limit(0), said, "2024-07-02", "2024-07-01", market).collect()[0].code == "bad valuation date"
    assert publish.gates(recs.limit(0), said, day, "2024-07-01", market).count() == 0


def test_only_a_current_confirmed_and_valid_candidate_is_published(spark, tmp_path):
    store = publish.Store(spark, str(tmp_path / "store"))
    table = spark.createDataFrame([("x", 1)], "k string, v int")
    fine = spark.createDataFrame([], "code string")
    make = lambda **k: publish.Candidate(**{"tables": {"state": table}, "review": "r1", "request": "q1", "blocked": fine} | k)
    assert store.version() == 0 and store.read("state") is None
    for candidate, review, request, confirmed, reason in (
        (make(), "r1", "q1", False, "unconfirmed"), (make(), "r2", "q1", True, "records or review changed"), (make(), "r1", "q2", True, "another request"), (make(blocked=spark.createDataFrame([("bad",)], "code string")), "r1", "q1", True, "failed validation"),
    ):
        with pytest.raises(publish.Stale, match=reason):
            store.publish(candidate, review, request, confirmed)
    assert store.version() == 0 and store.read("state") is None
    assert store.publish(make(), "r1", "q1", True) == 1
    assert store.derive("risk", table.withColumn("v", F.lit(10)), 1) and [r.v for r in store.read("risk").collect()] == [10]
    store._write("state", table.withColumn("v", F.lit(-1)), 2)  # a try that ended before its row
    assert store.version() == 1 and [r.v for r in store.read("state").collect()] == [1]
    assert store.publish(make(tables={"state": table.withColumn("v", F.lit(2))}, review="r2"), "r2", "q1", True) == 2
    assert [r.v for r in store.read("state").collect()] == [2] and store.read("risk") is None
    assert not store.derive("risk", table, 1) and store.read("risk") is None
    assert store.derive("risk", table.withColumn("v", F.lit(20)), 2) and [r.v for r in store.read("risk").collect()] == [20]


def test_residuals(spark):
    parts = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, None), ("b", 5.0, 1.0)], "k string, x double, y double")
    whole = spark.createDataFrame([("a", 3.0, 2.5), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = {(r.k, r.figure): (r.residual, r.agrees) for r in publish.residuals(parts, whole, ["k"], ["x", "y"]).collect()}
    assert got == {("a", "x"): (0.0, True), ("a", "y"): (0.5, False), ("b", "x"): (None, False), ("b", "y"): (None, False), ("c", "x"): (None, False), ("c", "y"): (None, False)}
