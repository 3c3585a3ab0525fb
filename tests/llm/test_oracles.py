"""The queries of this subpackage that have SQL, against DuckDB on the smallest tables."""

import os

import pytest

from tests.test_oracles import SF, con, plain  # noqa: F401
from tidemill.llm import queries as llm

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, con, name):  # noqa: F811
    df = llm.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    con.execute(llm.oracle_sql()[name])
    at = [d[0] for d in con.description]
    assert sorted(at) == columns
    order = [at.index(c) for c in columns]
    assert mine == sorted(repr([plain(r[i]) for i in order]) for r in con.fetchall())
