"""op11: byte-pair encoding and decoding of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_pair_encoding import encode_byte_pairs


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode_byte_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, digests=True)


QUERIES = {"op11_byte_pairs": op11_byte_pairs}

#: SQL has no merging; tests/llm compares with the library.
ORACLES: dict = {}
