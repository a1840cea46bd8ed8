"""The registered corpus queries against their SQL, on the small tables."""

import duckdb
import pytest

from foliant.llm import queries as llm
from tests.compare import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, name):
    same_rows(llm.queries()[name](spark, SF), llm.oracle_sql()[name], SF, duckdb.connect())
