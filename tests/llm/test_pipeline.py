"""The stages one by one against plain Python on the smallest table, and the registered twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from stainframe.llm import packing, quality_classifier, secrets, simhash, toxicity
from stainframe.verify.check import _rows
from stainframe.verify.views import GIVEN
from tests.llm.helpers import SCHEMA, near_classes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_names():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["toxic_documents", "poor_documents", "near_copies", "masked_secrets", "packed_documents"]
    assert {"pipeline", *(k for k in entry.queries() if k.startswith("op"))} >= {"pipeline", "op1_toxicity", "op5_pieces", "op10_secrets"}


def test_stages(spark, docs):
    """Each stage on all that the one before kept."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    left = docs.collect()
    stages = [f for _, f in corpus_pipeline.STAGES]
    model = toxicity.train(docs, labels)
    after = stages[0](spark, docs, FOLDER)
    assert after.columns == docs.columns
    want = [r for r, s in zip(left, toxicity.score(model, iter([r["text"] for r in left]))) if s < 0.7]
    assert sorted(after.collect()) == sorted(want) and len(want) >= 150
    model = quality_classifier.train(after, labels)
    kept = quality_classifier.scores(model, quality_classifier.table([r["text"] for r in want])) >= 0.7
    after, want = stages[1](spark, after, FOLDER), [r for r, k in zip(want, kept) if k]
    assert sorted(after.collect()) == sorted(want)
    root = near_classes({r["doc_id"]: simhash.near_prints(r["text"]) for r in want})
    after, want = stages[2](spark, after, FOLDER), [r for r in want if root[r["doc_id"]] == r["doc_id"]]
    assert after.columns == docs.columns and sorted(after.collect()) == sorted(want)
    after = stages[3](spark, after, FOLDER)
    for r, old in zip(sorted(after.collect()), sorted(want)):
        assert r["doc_id"] == old["doc_id"] and secrets.base_spans(r["text"].encode(), r["text"].lower().encode()) == []
        assert (r["text"] == old["text"]) == (not secrets.spans(old["text"]))
    encode = packing.encoder()
    rows = stages[4](spark, after, FOLDER).toPandas()
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {r["doc_id"]: len(encode(r["text"])) + 1 for r in after.collect()}
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024


def test_stages_on_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, FOLDER)
        assert out.count() == 0


@pytest.mark.parametrize("key", ["op2_host_rules", "op3_page_text", "op8_url_filter", "op9_top_k"])
def test_twins(spark, key):
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    own, twin = entry.queries()[key](spark, FOLDER).toArrow(), con.sql(entry.oracle_sql()[key]).to_arrow_table()
    assert own.num_rows > 0 and sorted(own.column_names) == sorted(twin.column_names)
    assert _rows(own.column_names, zip(*own.to_pydict().values())) == _rows(twin.column_names, zip(*twin.to_pydict().values()))


def test_columns_of_the_working_names(spark, docs):
    """A table may have columns of any name; they come out as they went in."""
    extra = {n: F.concat(F.lit("own "), F.col("doc_id")) for n in ("score", "_score", "doc", "new", "row", "best", "prints", "node", "fp", "_fp", "_t", "a.b")}
    own = docs.limit(60).withColumns(extra)
    rows = {r["doc_id"]: r for r in own.collect()}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, own, FOLDER)
        assert out.columns == own.columns
        for r in out.collect():
            assert [r[n] for n in extra] == [rows[r["doc_id"]][n] for n in extra]
