"""Every registered query with a twin agrees with its SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from stainframe.verify import all_oracles, all_queries
from stainframe.verify.check import compare
from stainframe.verify.views import GIVEN

FOLDER = "/root/testdata/sf0.001"
KEYS = sorted(all_oracles())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_agrees(spark, con, key):
    ok, note = compare(spark, con, key, FOLDER)
    assert ok, note


def test_l2_normalise_keeps_the_sign_of_zero(spark, tmp_path):
    row = [(1, [-1e-6, 1.0, 0.0, 1e-6], 0)]
    spark.createDataFrame(row, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = all_queries()["l2_normalise"](spark, str(tmp_path)).collect()[0]["unit"]
    want = own.sql(all_oracles()["l2_normalise"]).fetchall()[0][1]
    assert list(map(repr, got)) == list(map(repr, want)) and repr(got[0]) == "-0.0"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "eligibility_flip" in df.columns


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
