"""What the physical plans of the text operators must look like."""

import re

from chronoraster.llm import encode, forms, queries
from tests.test_plans import plan

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, title_id string, n_cues int, fps double, added_at timestamp"


def test_encoding_and_forms_take_no_shuffle_and_two_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a", "en", "s", 1, "t", 1, 25.0, None)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for out in (encode.encode_corpus(df), forms.normalize_corpus(df)):
        assert "Exchange" not in plan(out)
        assert set(re.findall(r"ReadSchema: struct<(.*)>", plan(out))) == {"doc_id:bigint,text:string"}
    assert "Exchange" not in plan(queries.p6_ids(spark, str(tmp_path)))


def test_pairs_use_no_cross_join(spark):
    out = forms.lookalike_pairs(spark.createDataFrame([(1, "Paul"), (2, "Pаul")], "doc_id bigint, text string"))
    assert "Cartesian" not in plan(out) and "NestedLoop" not in plan(out)
