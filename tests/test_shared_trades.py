"""Queries on positions make the trades once, and the streamed fold equals the replay by windows."""

import os
import random
from datetime import date, timedelta

import pytest

from bookweave import catalog
from bookweave.operators import ledger
from bookweave.sources import tables

SF = "/root/testdata/sf0.001"
ONCE = ["win4_ledger_positions", "fin1_value_books", "agg2_totals_by_label", "agg12_concentration", "agg10_agg13_holdings_mix", "prj8_labels", "jn7_compare_states", "fin8_fin15_srt8_findings", "set2_required_currencies", "fin3_current_weight_run", "srt2_ranked_contributors", "dq12_risk_sample", "fin5_scn7_target_risk", "fin15_trust_statuses", "dq10_fin15_issues"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ONCE)
def test_trades_are_joined_once(spark, monkeypatch, name):
    made, trades = [], tables.trades
    monkeypatch.setattr(tables, "trades", lambda *a: made.append(1) or trades(*a))
    catalog.queries()[name](spark, SF)
    assert len(made) == 1


def test_positions_equal_the_replay_over_batches(spark):
    rng = random.Random(3)
    rows = [(b, t, date(2024, 1, 1) + timedelta(rng.randint(0, 90)), k, float(rng.choice((-3, -2, -1, 1, 2, 3))), rng.uniform(5, 50)) for k, (b, t) in enumerate((b, t) for b in range(4) for t in "XY" for _ in range(25))]
    df = spark.createDataFrame(rows, "book long, ticker string, d date, seq long, q double, px double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {(r.book, r.ticker): (r.qty, r.basis, r.realised) for r in ledger.positions(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in ledger.replay(df).orderBy("d", "seq").collect():
        want[r.book, r.ticker] = (r.qty, r.basis, want.get((r.book, r.ticker), (0, 0, 0.0))[2] + r.realised)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert ledger.positions(df.limit(0)).count() == 0
