"""The training-text queries on the smallest tables, against SQL where it can express them."""

import os

import pytest
from compare import SMALL, connect, same

from stewardry import llm

QUERIES = {name: q for m in llm.query_modules() for name, q in m.QUERIES.items()}
SQL = {name: text for m in llm.query_modules() for name, text in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same(df, connect(SMALL), SQL[name])
    else:
        assert df.count() > 0
