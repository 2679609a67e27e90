"""Ids that are null beside ids no float can hold, and single rows, through every operator that passes ids on."""

import public_tokenizers
import pytest

from stainframe.llm import html_extraction, packing, pieces, quality_rules, secrets, simhash
from tests.llm.helpers import SCHEMA

BIG = 2**53 + 1
ROWS = [(BIG, "some words stand here", "en", "s", 1), (None, None, None, None, None), (BIG + 1, "", "en", None, 0)]


@pytest.mark.parametrize("run", [
    secrets.scan, packing.packed, simhash.classes, quality_rules.judge,
    lambda df: pieces.encode(df, pieces.load(public_tokenizers.path("piece_bpe_32k.model"))),
], ids=["secrets", "packing", "simhash", "rules", "pieces"])
def test_documents(spark, run):
    for rows in (ROWS, ROWS[1:2]):
        out = run(spark.createDataFrame(rows, SCHEMA).coalesce(1))
        assert dict(out.dtypes)["doc_id"] == "bigint"
        assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r[0]) for r in rows)


def test_pages(spark):
    rows = [(BIG, "http://a/b", "<p>x</p>"), (None, None, None), (BIG + 1, "", "")]
    for some in (rows, rows[1:2]):
        out = html_extraction.extract(spark.createDataFrame(some, "page_id bigint, url string, html string").coalesce(1))
        assert sorted((str(r["page_id"]), r["text"]) for r in out.collect()) == sorted((str(a), "x" if a == BIG else "") for a, _, _ in some)
