"""SentencePiece encoding and decoding of whole texts, one pass without a shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import CACHE, Pieces
from .words import pieces as slices


class _Units(dict):
    """unit -> (ids as decimal text, text decoded from the ids), made on demand, bounded."""

    def __init__(self, model: Pieces) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, unit: str) -> tuple[str, str]:
        ids = self.model.ids_of(self.model.unit_tokens(unit))
        made = " ".join(map(str, ids)), self.model.surface(ids)
        if len(unit) <= 64:
            self[unit] = made
        return made

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()


@lru_cache(maxsize=1)
def _loaded(path: str) -> _Units:
    """The vocabulary and the units met so far, kept by a worker from task to task."""
    return _Units(Pieces(path))


def _encoder(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _loaded(path)
        model, end = units.model, str(units.model.end_id)
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                for text in piece.column("text").to_pylist():
                    made = [units[u] for u in model.units(text or "")]
                    ids = " ".join([*[m[0] for m in made], end])
                    decoded = "".join([m[1] for m in made])
                    decoded = decoded[1:] if decoded.startswith(" ") else decoded
                    if digests:
                        rows.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(),
                                     hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        rows.append(([int(i) for i in ids.split(" ")], decoded))
                    units.trim()
                kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
                names = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]],
                    ["id", *names],
                )

    return run


def encode_pieces(
    docs: DataFrame, path: str, digests: bool = False, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ids (with an end id) and the text decoded from them, or their digests.

    path: the model file on every machine. Null text: empty, so the end id alone. Null ids, ties and
    repeated rows are rows like others; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(_encoder(path, digests), f"id {kind}, {made}").withColumnRenamed("id", id_column)
