"""The shared folder and intermediate tables."""

import pytest

from keyfold import session


def test_shared_root_comes_from_the_session(spark):
    assert session.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.shared_path(spark, "x") != session.shared_path(spark, "x")


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Session())


def test_materialise_lookup_and_drop(spark):
    table = session.materialise(spark.range(10), "t")
    assert table.count() == 10
    small, ok = session.lookup(spark.range(10), "t", max_rows=10)
    large, no = session.lookup(spark.range(11), "t", max_rows=10)
    assert (ok, no) == (True, False) and small.count() == 10 and large.count() == 11
    assert session.drop_intermediate(spark) >= 3
    with pytest.raises(Exception):  # noqa: B017
        table.count()
    assert session.drop_intermediate(spark) == 0
