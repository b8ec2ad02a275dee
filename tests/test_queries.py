"""Every registered library query against its SQL on the smallest tables."""

import pytest
from helpers import DATA, connect, same

from lexigauge.plans import oracle, queries

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, con, name):
    same(spark, con, queries.QUERIES, oracle.SQL, name, SF)


NO_SQL = {"edit_ops", "edit_ops_all", "rare_label_ops", "rare_label_stats", "rare_label_bootstrap", "layout_aware_order"}


def test_queries_without_sql_are_few(spark):
    assert set(queries.QUERIES) - set(oracle.SQL) == NO_SQL
    for name in NO_SQL:
        assert queries.QUERIES[name](spark, str(SF)).count() > 0


def test_edit_sums_equal_distances(spark):
    """Edits by an alignment are as many as the built-in distance says, and their difference is that of the lengths."""
    got = queries.QUERIES["edit_ops_all"](spark, str(SF)).where("dimension = 'overall'").first()
    want = queries._scored(spark, str(SF)).selectExpr(
        "sum(edits) as edits", "sum(ref_len) as refs", "sum(char_length(ref_n) - char_length(hyp_n)) as more"
    ).first()
    assert (got["total_errors"], got["total_ref_chars"], got["deletions"] - got["insertions"]) == tuple(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
