"""Every query with SQL gives DuckDB's rows; the others give rows."""

import os

import duckdb
import pytest

from corpusloom.plans import catalogue, language, samples, stores  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    got = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == columns
    at = [list(got.columns).index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_partitioning_does_not_matter(spark, partitions):
    from corpusloom.operators import corpus

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(partitions)
    packed = corpus.pack_fixed(docs, "doc_id", 512).orderBy("source", "chunk").collect()
    assert packed == corpus.pack_fixed(docs.coalesce(1), "doc_id", 512).orderBy("source", "chunk").collect()
