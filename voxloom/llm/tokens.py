"""Sizes of texts in tokens of a public tokenizer, counted from whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A sentencepiece model; every executor finds it under this path.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def clean_source(source: Column) -> Column:
    """Source names are written in several ways: letter case and outer blanks don't tell them apart."""
    return F.lower(F.trim(source))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """`doc_id, source, tokens`; a null text or id gives no row, an empty text no tokens. Rows of one doc_id count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [len(x) for i in range(0, len(texts), 256) for x in model.encode(texts[i : i + 256], num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", clean_source(F.col("source")).alias("source"), "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType())])
    counted = rows.mapInArrow(run, schema)
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.*")
