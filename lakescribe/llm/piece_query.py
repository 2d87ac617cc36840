"""op4: SentencePiece encoding and decoding of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .piece_encoding import encode_pieces


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, digests=True)


QUERIES = {"op4_sentencepiece": op4_sentencepiece}

#: SQL has no merging; tests/llm compares with the library.
ORACLES: dict = {}
