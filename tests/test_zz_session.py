import pytest

from phrasecast import session


def test_clear_scratch(spark):
    df = session.materialize(spark.range(5), "x")
    assert df.count() == 5
    session.clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_spread(spark):
    df = session.materialize(spark.range(100).coalesce(1), "one")
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(df).count() == 100


def test_unset_folder_is_an_error_on_a_cluster():
    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        session.shared_folder(Session)
