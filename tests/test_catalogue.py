"""Every query against its SQL, on the smallest data."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from veldspar.plans import catalogue


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def canonical(frame):
    columns = sorted(frame.columns)

    def plain(x):
        x = x.tolist() if hasattr(x, "tolist") else x
        return None if x is None or x != x else str(x)

    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalogue.ORACLE_SQL:
        assert canonical(got) == canonical(sql.sql(catalogue.ORACLE_SQL[name]).df())
    else:
        assert "lsh" in name and list(got.columns)


@pytest.mark.parametrize("name", ["export_import", "export_records"])
def test_exports_where_decimals_are_in_doubt(spark, tmp_path, name):
    """Odd 128ths, which lie on a half of the sixth decimal, floats on either side of other
    halves, and numbers that become zero: the larger tables have a few of each."""
    halves = ((np.arange(0, 1_000_000, 997) + 0.5) / 1e6).astype(np.float32)
    found = np.concatenate([np.arange(1, 128, 2, dtype=np.float32) / 128, halves, np.nextafter(halves, np.float32(0)), np.nextafter(halves, np.float32(2)), np.float32([1e-9, 4e-7, 0.0])])
    found = np.concatenate([found, -found])
    rows = np.resize(found, (-(-len(found) // 64), 64))
    pq.write_table(pa.table({"vec_id": range(len(rows)), "embedding": pa.array(rows.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(len(rows))], pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert canonical(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(con.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("method", ["euclidean", "cosine"])
def test_every_vector_is_a_query(spark, sf_dir, method):
    got = catalogue.QUERIES[f"knn_batch_all_{method}"](spark, sf_dir).groupBy("query_id").count().collect()
    assert len(got) == catalogue.embeddings(spark, sf_dir).count() and all(r["count"] == 5 for r in got)


def test_entry(spark):
    assert contract.entry(spark).count() == 10
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalogue.QUERIES) <= set(contract.queries())
