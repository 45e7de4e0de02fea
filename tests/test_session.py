"""Folders that executors share, and numbering by ranges."""

import os

import pytest

from resemblage import session


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Session:
    def __init__(self, **conf):
        self.conf = _Conf({k.replace("__", "."): v for k, v in conf.items()})


def test_shared_folder():
    assert session.shared_folder(_Session(spark__checkpoint__dir="hdfs://a/b/", spark__master="yarn")) == "hdfs://a/b"
    for master in ("local", "local[8]", "local[*]", "local[2,3]"):
        assert session.shared_folder(_Session(spark__master=master, spark__sql__warehouse__dir="file:/w/")) == "file:/w/checkpoints"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(_Session(spark__master=master, spark__sql__warehouse__dir="file:/w/"))


def test_written_and_forgotten(spark):
    df = session.written(spark.range(5).toDF("x"))
    place = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(place)
    session.forget(spark, f"file:{place}", now=True)
    assert not os.path.exists(place)


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbered(spark, n):
    rows = [(i * 7919 % 1000, i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = {r["n"]: (r["b"], r["a"]) for r in session.numbered(df, "n", "b", "a").collect()}
    assert [got[i] for i in range(n)] == sorted((b, a) for a, b in rows)
