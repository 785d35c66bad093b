"""Every registered query against its SQL twin, plainly and with split keys."""

import pytest

from tests.oracle import compare, connect
from timelane.plans import REGISTRY
from timelane.session import HOT_ROWS

# Queries whose rows are ordered inside a key; they run again with keys cut into pieces.
ORDERED = [
    "normalize_keyframes", "segments", "fill_hold", "envelope_at", "coalesce_edits_two_logs",
    "prefix_offsets", "block_ranges", "last_transport", "debounce", "undo_redo", "throttle", "peak_hold",
]


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    problem, rows, _ = compare(spark, con, "/root/testdata/sf0.001", name)
    assert problem is None
    assert rows > 0


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_split_keys(spark, con, name):
    spark.conf.set(HOT_ROWS, "30")
    try:
        problem, _, _ = compare(spark, con, "/root/testdata/sf0.001", name)
    finally:
        spark.conf.unset(HOT_ROWS)
    assert problem is None


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
