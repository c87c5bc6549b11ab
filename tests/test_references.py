"""p4_found takes its rows out of the finished fixpoint over the key graph."""

from pathlib import Path

import pytest

from vislake.plans import references

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_found_orphans_come_from_the_finished_fixpoint(spark, monkeypatch):
    made, run = [], references.cascade
    monkeypatch.setattr(references, "cascade", lambda *args, **more: made.append(run(*args, **more)) or made[-1])
    found = sorted(map(tuple, references.p4_found(spark, FOLDER).collect()))
    (whole,) = made
    whole = whole.collect()
    everything = sorted(map(tuple, references.p4_cascade(spark, FOLDER).collect()))
    assert sorted((r["tab"], r["row_id"], r["kind"], r["reason"], r["depth"]) for r in whole) == everything
    assert {r["kind"] for r in whole} == {"direct", "inherited"} and max(r["depth"] for r in whole) > 0
    assert found == sorted((tab, row_id, reason) for tab, row_id, kind, reason, _ in everything if kind == "direct")
