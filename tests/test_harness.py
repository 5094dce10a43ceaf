"""The two-table workload at a small size, row by row."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import harness


@pytest.mark.parametrize("mode", ["recreate", "topup", "grow"])
def test_two_table_workload(spark, tmp_path, mode):
    total, payload = 2000, 8
    _, out = harness.run(spark, str(tmp_path), total, payload, mode)
    _, _, selected, resident = harness.shape(total)
    assert out.tables["child"].count() == harness.expected(total, mode)
    got = {r.id: r.payload for r in out.tables["child"].collect()}
    # the first child was there before: only grow refreshes it, and only grow and a fresh run see the late one
    assert got[1] == ("x" * payload if mode == "topup" else "updated")
    assert ((total - total // 10) in got) == (mode != "topup")
    assert {r.id for r in out.tables["parent"].collect()} == set(range(1, selected + 1))
    if mode == "topup":
        assert out.deltas["parent"].where("_inserted").count() == selected - resident
