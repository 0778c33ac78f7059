"""The queries of the subpackage run, and agree with SQL where there is some."""

from collections import Counter

import pytest

from keyfold.llm import queries
from tests.conftest import DATA, plain


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got
    if name in queries.SQL:
        found = duck.execute(queries.SQL[name])
        names = [c[0] for c in found.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(df.columns)
        assert Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall()) == got
