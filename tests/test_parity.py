"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as contract
from checks import inputs as I
from checks.compare import compare
from checks.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, small, name):
    verdict, _ = compare(spark, duck, name, small)
    assert verdict == ("ok" if name in SQL else "rows only")


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    rows = contract.entry(spark).collect()
    assert sum(r["received"] for r in rows) == 986


def test_totals(spark, small):
    (row,) = QUERIES["ordering_totals"](spark, small).collect()
    assert (row.received, row.violations, row.gaps, row.missing) == (986, 190, 292, 575)
    extra = QUERIES["duplicates"](spark, small).groupBy().sum("extra").collect()
    assert extra[0][0] == 70


def test_parse_state_key_reads_every_report(spark, small):
    """One report for each key sent and each key and partition seen, also those not renewed."""
    sent = I.published(spark, small).select("key").distinct().count()
    seen = I.delivered(spark, small).select("key", "partition").distinct().count()
    rows = QUERIES["parse_state_key"](spark, small)
    assert rows.count() == 3 * (sent + seen)
    assert I.kv_state(spark, small).count() < sent + seen
