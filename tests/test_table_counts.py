"""table_counts counts the rows that the builders made, and reads the sources once or twice."""

import pytest

from faultbench.operators import downstream
from faultbench.plans import queries
from tests.conftest import SF_SMALL
from tests.scans import rows_read


def test_a_builder_that_doubles_or_loses_rows_shows(spark, monkeypatch):
    want = {r.table_name: r.row_count for r in queries.QUERIES["table_counts"](spark, SF_SMALL).collect()}
    daily, totals, board = downstream.daily_revenue, downstream.customer_totals, downstream.executive_dashboard

    def doubled(build):
        return lambda *args: (lambda df: df.union(df))(build(*args))

    monkeypatch.setattr(downstream, "daily_revenue", doubled(daily))
    monkeypatch.setattr(downstream, "executive_dashboard", doubled(board))
    monkeypatch.setattr(downstream, "customer_totals", lambda *args: totals(*args).limit(7))
    got = {r.table_name: r.row_count for r in queries.QUERIES["table_counts"](spark, SF_SMALL).collect()}
    twice = {"daily_revenue": 2 * want["daily_revenue"], "executive_dashboard": 2}
    assert got == want | twice | {"customer_value": 7}


CODE = """
from faultbench.plans.queries import QUERIES
counted()
QUERIES[{name!r}](spark, {sf!r}).collect()
"""


@pytest.mark.parametrize("name", ["table_counts", "snapshot_manifest", "restore_verification"])
def test_sources_are_read_twice_at_most(name):
    rows = rows_read(CODE.format(name=name, sf=SF_SMALL), SF_SMALL)
    assert 1500 <= rows["orders"] <= 3000 and rows["customer"] <= 2 * 150
