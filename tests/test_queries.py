"""Every core query against its SQL, over the smallest tables."""

from collections import Counter

import pytest

from keyfold.plans import registry

from .conftest import DATA, plain

SQL = registry.oracle_sql()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def test_every_query_has_sql():
    assert set(SQL) == set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    found = duck.execute(SQL[name])
    kinds = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in found.description}
    assert kinds == dict(df.dtypes)
    order = [list(kinds).index(c) for c in sorted(kinds)]
    want = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(kinds)) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_need_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['keyfold.llm'] = None; import __spark_entry__ as e; assert e.llm is None; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) == len(registry.queries())
