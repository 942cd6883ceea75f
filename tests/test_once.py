"""Work that a query does once, however often its steps ask for it."""

import os

import pytest

from bookweave.operators import decisions, publish
from bookweave.plans import consolidation

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_a_table_is_read_for_its_digest_once(spark, monkeypatch):
    made, digest = [], publish.content_digest
    monkeypatch.setattr(publish, "content_digest", lambda *a: made.append(1) or digest(*a))
    consolidation.src8_pub1_pub2_versions(spark, SF)
    assert len(made) == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_issues_are_found_once_on_each_state(spark, monkeypatch):
    staged, stage = [], decisions.stage_table
    monkeypatch.setattr(decisions, "stage_table", lambda df, label, *a: staged.append(label) or stage(df, label, *a))
    consolidation.dq8_dq9_review_log(spark, SF)
    assert staged.count("found") == 2
