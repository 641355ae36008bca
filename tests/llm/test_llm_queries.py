"""Every registered query of the operators that SQL can express, against its SQL on the smallest tables."""

import pytest

from quirelab.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import norm, sql  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, sql, name):  # noqa: F811
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([norm(v) for v in r]) for r in df.select(cols).collect())
    res = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in res.fetchall())
