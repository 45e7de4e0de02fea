"""Every registered query runs, and agrees with its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from resemblage.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = db.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_stream(spark, tmp_path):
    from resemblage.operators.embed import HashEmbedder
    from resemblage.streaming.incremental import embed_stream

    spark.createDataFrame([(0, "a b"), (1, "c")], "ord long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ord long, text string").parquet(str(tmp_path / "in"))
    embed_stream(stream, HashEmbedder(8), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_plain_pairs_by_block_products(spark):
    """A join of vectors has quadratically many rows, one of blocks few."""
    from resemblage.operators import similarity
    from resemblage.plans.queries import THRESHOLD, TOP, vectors

    found = entry.queries()["similar_pairs_plain"](spark, DATA)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    want = similarity.best(similarity.plain_pairs(vectors(spark, DATA)), THRESHOLD, TOP).collect()
    assert [tuple(r) for r in found.collect()] == [(r["a_ord"], r["b_ord"], round(r["score"], 6)) for r in want]
