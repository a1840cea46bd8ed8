"""Every analytics query against its SQL on the smallest tables; those without SQL must at least run."""

import duckdb
import pytest

from foliant.plans import catalogue
from tests.compare import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    same_rows(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF, duckdb.connect())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    rows = catalogue.queries()[name](spark, SF).collect()
    # No section of these texts has a type that a table of contents lists.
    assert rows or name == "table_of_contents"
