"""Byte-pair encoding and decoding of whole texts, one pass without a shuffle."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pairs import STEP, BytePairs, Encodings
from .words import pieces


@lru_cache(maxsize=1)
def _loaded(path: str) -> Encodings:
    """The vocabulary and the words met so far, kept by a worker from task to task."""
    known = Encodings(BytePairs(path))
    gc.freeze()  # the vocabulary stays for the worker's life, no collection needs to walk it
    return known


class _Digests:
    """Number of ids and digests, taken up step by step."""

    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def __init__(self) -> None:
        self.n, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: str, decoded: str) -> None:
        self.ids.update(("," + ids if self.n else ids).encode())
        self.decoded.update(decoded.encode())
        self.n += ids.count(",") + 1

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


class _Values:
    """The ids and the text decoded from them."""

    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.large_string()}
    schema = "ids array<int>, decoded string"

    def __init__(self) -> None:
        self.ids, self.decoded = [], []

    def add(self, ids: str, decoded: str) -> None:
        self.ids.extend(map(int, ids.split(",")))
        self.decoded.append(decoded)

    def row(self) -> tuple:
        return self.ids, "".join(self.decoded)


def _encoder(path: str, result: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(path)
        split = known.model.split
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts, rows = piece.column("text").to_pylist(), []
                # the words of the slice's shorter texts make one trie; a long text makes one a step
                parts = [list(split(t)) if t and len(t) <= STEP else None for t in texts]
                known.learn(set().union(*[words for steps in parts if steps for words, added in steps if not added]))
                for text, steps in zip(texts, parts):
                    out = result()
                    for words, added in split(text or "") if steps is None else steps:
                        if steps is None and not added:
                            known.learn(set(words))
                        out.add(*known.of(words, added))
                    rows.append(out.row())
                known.trim()
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(result.kinds.values())]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *made], ["id", *result.kinds])

    return run


def encode_byte_pairs(
    docs: DataFrame, path: str, digests: bool = False, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ids (without special tokens added) and the text decoded from them, or their digests.

    path: the tokenizer file on every machine. An added token's own string in a text is that token. Null
    text: empty, so no ids. Null ids, ties and repeated rows are rows like others; an empty table gives no
    rows; other columns, whatever their names, are ignored. A text of any length is encoded in steps.
    """
    result = _Digests if digests else _Values
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(_encoder(path, result), f"id {kind}, {result.schema}").withColumnRenamed("id", id_column)


def decode_byte_pairs(
    encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids",
) -> DataFrame:
    """One row per row: id and the text decoded from its ids, special tokens included.

    Null ids: null text; no ids: an empty text. Null entries and ids outside the vocabulary have no text.
    Bytes that are no UTF-8 become replacement characters. Repeated rows are rows like others; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(path).model
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    source = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    return source.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_column)
