"""Every registered query against the SQL that gives the same rows, on the smallest tables."""

import duckdb
import pytest

from gatelake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = duck.execute(SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(d[0] for d in want.description) == columns
    assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_handoff_tells_order_0_from_customer_0(spark, tmp_path):
    orders = [(0, "O"), (1, "F"), (2, "P"), (3, None), (None, "F")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0,), (1,), (2,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted((tuple(r) for r in QUERIES["q025_handoff"](spark, str(tmp_path)).select("check_id", "phase").collect()), key=repr)
    assert got == sorted(con.execute(SQL["q025_handoff"]).fetchall(), key=repr)
    assert (0, "gate") in got and (0, "walk") in got
