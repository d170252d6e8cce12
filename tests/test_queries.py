"""Every query with SQL against DuckDB at the smallest scale."""

import os
from decimal import Decimal

import duckdb
import pytest

from coppice import engine_queries  # noqa: F401 (registers its queries)
from coppice.workload_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = lambda x: sorted((tuple(plain(v) for v in r) for r in x), key=str)
    assert rows(got.select(*(f"`{c}`" for c in columns)).collect()) == rows(want.fetchall())


def test_bodies_text_with_gaps_between_ids(spark, tmp_path):
    rows = [(7 * k, k % 3, [0.1 * k, 0.2, 0.3]) for k in range(9)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["bodies_text"]).fetchall()
    got = QUERIES["bodies_text"](spark, str(tmp_path)).select("id", "mass", "near").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
