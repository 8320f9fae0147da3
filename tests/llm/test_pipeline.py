"""The pipeline's stages, and the registered queries of these operators."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from gatelake.llm.common import shared_table
from gatelake.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import check_packing, plain_components, plain_sets

SF = "/root/testdata/sf0.001"


def test_registered():
    made = __spark_entry__.queries()
    assert set(QUERIES) <= set(made) and "pipeline" in made
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in sorted(df.columns)]
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_stages_like_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(shared_table(stage(spark, seen[-1], SF), f"test_{name}"))
    for before, after in zip(seen[:-2], seen[1:-1]):
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0
    good, unique, apart, mixed = ({r["doc_id"]: r["text"] for r in d.collect()} for d in seen[1:5])
    bad = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 0").fetchall()}
    fine = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1").fetchall()}
    assert len(bad & good.keys()) <= 0.1 * len(bad) + 1 and len(fine - good.keys()) <= 0.05 * len(fine)
    first = {}
    for i in sorted(good):
        first[good[i]] = i
    assert set(unique) == set(first.values())
    parts = plain_components(plain_sets(unique.items(), 5), 80)
    assert set(apart) == set(parts.values())
    assert set(mixed) <= set(apart) and mixed
    packed = seen[5].collect()
    check_packing(packed)
    assert {r["doc_id"] for r in packed} == set(mixed)


def test_stages_take_awkward_rows(spark, docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for given in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, folder)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == given.columns
