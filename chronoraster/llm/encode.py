"""Corpus encoding and token counts as DataFrame operators (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoraster.llm.chunkcode import DEFAULT_DIR


def _state(text: Column) -> Column:
    return F.when(text.isNull(), "null").when(F.length(text) == 0, "empty").otherwise("text")


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", directory: str = DEFAULT_DIR) -> DataFrame:
    """(key, ids, n_tokens, state) for each row; no shuffle, one pass over the text.

    state is ``null``, ``empty`` or ``text``; null and empty texts get an empty
    list.  Only ``key`` and ``text`` are read, so other columns may have any name.
    Rows with equal or null keys are kept as they are.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"), _state(F.col(text)).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from chronoraster.llm.chunkcode import encoder

        enc = encoder(vocabulary, directory)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                ids, counts = enc.column(part.column("t"))
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("k"), lists, pa.array(counts, pa.int64()), part.column("s")], names=["k", "ids", "n_tokens", "state"])

    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(run, f"k {kind}, ids array<int>, n_tokens bigint, state string").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str, keep: dict[str, Column], vocabulary: str = "byte_bpe_50k", directory: str = DEFAULT_DIR) -> DataFrame:
    """``keep`` columns and n_tokens; as ``encode_corpus`` without handing the ids on."""
    src = df.select(F.col(text).alias("__t"), *[c.alias(n) for n, c in keep.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chronoraster.llm.chunkcode import encoder

        enc = encoder(vocabulary, directory)
        for b in batches:
            _, counts = enc.column(b.column("__t"))
            cols = [b.column(n) for n in b.schema.names if n != "__t"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*[n for n in b.schema.names if n != "__t"], "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "__t")
    return src.mapInArrow(run, f"{kinds}, n_tokens bigint")
