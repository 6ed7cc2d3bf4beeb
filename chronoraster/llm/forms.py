"""Consistent forms and look-alike pairs as DataFrame operators (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoraster.functions.session import cut

SLICE = 1000  # texts that are Python strings at a time
FULL = 64  # documents of a form up to which all pairs are given, and texts of a form that are paired beyond it


def normalize_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", with_form: bool = True) -> DataFrame:
    """(key, form, form_key, text_key, visible, n_mixed, n_whole) for each row; no shuffle.

    form_key and text_key are 128-bit digests of the form and of the text as
    written.  visible is false for null, empty and blank texts.  n_mixed and
    n_whole count tokens that mix scripts or consist of look-alikes of another
    script.  Without ``with_form`` the form itself is left null.  The look-alike
    classes are made on the driver and sent along (30 kB).
    """
    from chronoraster.llm import lookalike

    sent = lookalike.classes()
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        from chronoraster.llm.lookalike import consistent_form, install, mixed_tokens

        install(sent)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                forms, form_keys, text_keys, visible, mixed, whole_words = [], [], [], [], [], []
                for t in b.column("t").to_pylist():
                    f = consistent_form(t)
                    m, w = mixed_tokens(t) if with_form else (None, None)
                    forms.append(f if with_form else None)
                    form_keys.append(None if f is None else md5(f.encode()).digest())
                    text_keys.append(None if t is None else md5(t.encode()).digest())
                    visible.append(bool(f) and not f.isspace())
                    mixed.append(m)
                    whole_words.append(w)
                yield pa.RecordBatch.from_arrays(
                    [b.column("k"), pa.array(forms, pa.string()), pa.array(form_keys, pa.binary()), pa.array(text_keys, pa.binary()), pa.array(visible, pa.bool_()), pa.array(mixed, pa.int32()), pa.array(whole_words, pa.int32())],
                    names=["k", "form", "form_key", "text_key", "visible", "n_mixed", "n_whole"],
                )

    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInArrow(run, f"k {kind}, form string, form_key binary, text_key binary, visible boolean, n_mixed int, n_whole int")
    return out.withColumnRenamed("k", key)


def _keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, form_key, text_key) of rows with a key and a visible character, written once."""
    forms = normalize_corpus(df, key, text, with_form=False).where("visible").where(F.col(key).isNotNull())
    return cut(forms.select(F.col(key).alias("k"), "form_key", "text_key"))


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), a < b: different texts with one form.

    Of a form with up to ``FULL`` documents all pairs are given.  Of a larger one
    every document is paired with the first document (least key) of each other
    text, for the ``FULL`` texts that come first; so work and result stay linear
    in copies and in variants, and ``lookalike_classes`` gives all links exactly.
    Rows with a null key or without a visible character are left out.
    """
    forms = _keys(df, key, text)
    # partial aggregation keeps this small whatever the size of a group of copies
    several = forms.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("form_key", "n")
    docs = forms.join(several, "form_key")
    firsts = docs.where(F.col("n") > FULL).groupBy("form_key", "text_key").agg(F.min("k").alias("first"))
    place = F.row_number().over(Window.partitionBy("form_key").orderBy("first"))  # a limit before the shuffle, too
    firsts = firsts.withColumn("place", place).where(F.col("place") <= FULL).drop("place")
    partners = firsts.unionByName(docs.where(F.col("n") <= FULL).select("form_key", "text_key", F.col("k").alias("first")))
    pairs = docs.join(partners.withColumnRenamed("text_key", "other_key"), "form_key").where("text_key <> other_key")
    return pairs.select(F.least("k", "first").alias(f"{key}_a"), F.greatest("k", "first").alias(f"{key}_b")).distinct()


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, text_id, n_texts, n_docs): one row per document with a visible text.

    class_id is the first document of its form, text_id that of its very text;
    two documents are a look-alike pair if and only if class_id is equal and
    text_id is not.  Partial aggregation and joins on digests; linear throughout.
    """
    forms = _keys(df, key, text)
    texts = forms.groupBy("form_key", "text_key").agg(F.min("k").alias("text_id"), F.count("*").alias("n"))
    whole = texts.groupBy("form_key").agg(F.min("text_id").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n").alias("n_docs"))
    texts = texts.join(whole, "form_key").select("text_key", "class_id", "text_id", "n_texts", "n_docs")
    return forms.join(texts, "text_key").select(F.col("k").alias(key), "class_id", "text_id", "n_texts", "n_docs")
