"""Language identification: the language whose character model finds a text least surprising.

Models are fitted on a bounded sample of labelled rows (`rows_per_language`, a documented bound);
counting runs in Spark. Another sample of the same bound calibrates the score and the rejection.
Every text is then scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_model import Scorer, count_grams, slices, train

UNDETERMINED = "und"
_PARTS = 1 << 20


@dataclass
class Identifier:
    """Models and calibration. score = logistic of the lead over the next language; limits reject."""

    scorer: Scorer
    slope: float
    limits: np.ndarray  #: least mean log probability at which a language is accepted

    def judge(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, accepted) of each text; a text without a letter is undetermined."""
        mean, letters = self.scorer.mean_log_p(texts)
        best = mean.argmax(axis=1)
        top = mean[np.arange(len(texts)), best]
        rest = np.exp(np.clip(self.slope * (mean - top[:, None]), -700, 0)).sum(axis=1)
        return [
            (self.scorer.languages[b], float(1 / r), bool(t >= self.limits[b])) if n else (UNDETERMINED, 0.0, False)
            for b, t, r, n in zip(best, top, rest, letters)
        ]


def _sample(docs: DataFrame, text: str, label: str, rows: int, part: int) -> DataFrame:
    """About `rows` different labelled texts of each language, picked by their digest; part: 0 or 1.

    Copies count once, so a text that most rows of a language have is one of many and cannot break the bound.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count_distinct(F.xxhash64(text)).alias("n")).collect()}
    if not counts:
        return labelled.limit(0).select(F.col(text).alias("text"), F.col(label).alias("lang"))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, rows / n * 2) * _PARTS))])
    digest = F.pmod(F.xxhash64(F.col(text)), F.lit(2 * _PARTS))
    picked = (F.floor(digest / 2) < share[F.col(label)]) & (digest % 2 == part)
    return labelled.where(picked).select(F.col(text).alias("text"), F.col(label).alias("lang")).distinct()


def _counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch.columns, names=batch.schema.names)
            for lang in table.column("lang").unique().to_pylist():
                own = table.filter(pa.compute.equal(table.column("lang"), lang)).column("text").to_pylist()
                for texts in slices(own):
                    grams = count_grams(texts, order)
                    yield from grams.append_column("lang", pa.array([lang] * grams.num_rows)).to_batches()

    return run


def _measure(scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for own, langs in zip(slices(texts), _aligned(texts, batch.column("lang").to_pylist())):
                mean, letters = scorer.value.mean_log_p(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs), pa.array(list(mean.astype(np.float64))), pa.array(letters)], ["lang", "mean", "letters"])

    return run


def _aligned(texts: list[str], values: list) -> Iterator[list]:
    at = 0
    for own in slices(texts):
        yield values[at: at + len(own)]
        at += len(own)


def fit(
    docs: DataFrame, label_column: str = "lang", text_column: str = "text", order: int = 4, rows_per_language: int = 1500,
    reject_share: float = 0.001,
) -> Identifier | None:
    """Models from labelled rows; None if no row is labelled. Sample texts per language: the bound."""
    spark = docs.sparkSession
    names = [*[f"end_{n}" for n in range(1, order + 1)], *[f"head_{n}" for n in range(2, order + 1)]]
    schema = ", ".join([*[f"{c} long" for c in names], "n long", "lang string"])
    grams = _sample(docs, text_column, label_column, rows_per_language, 0).mapInArrow(_counter(order), schema)
    # bounded by the sample; the names of a gram's endings and contexts follow from the gram
    table = grams.groupBy("lang", *names).agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(table.column("lang").unique().to_pylist())
    if not languages:
        return None
    own = {x: table.filter(pa.compute.equal(table.column("lang"), x)).drop_columns(["lang"]) for x in languages}
    scorer = Scorer({x: train(own[x], order) for x in languages}, order)
    scorer.fill(table.drop_columns(["lang", "n"]))
    shared = spark.sparkContext.broadcast(scorer)  # bounded by the sample
    rows = (
        _sample(docs, text_column, label_column, rows_per_language, 1)
        .mapInArrow(_measure(shared), "lang string, mean array<double>, letters long").where("letters > 0").toPandas()
    )
    slope, limits = 20.0, np.full(len(languages), -np.inf)
    rows = rows[rows["lang"].isin(languages)]
    if len(rows):
        mean, truth = np.stack(rows["mean"]), np.searchsorted(languages, rows["lang"])
        slope = min((float(s) for s in np.geomspace(1, 200, 40)), key=lambda s: _log_loss(s * mean, truth))
        for k in range(len(languages)):
            if (truth == k).any():
                limits[k] = np.quantile(mean[truth == k, k], reject_share) - 0.25
    return Identifier(scorer, slope, limits)


def _log_loss(values: np.ndarray, truth: np.ndarray) -> float:
    top = values.max(axis=1)
    return float((np.log(np.exp(values - top[:, None]).sum(axis=1)) + top - values[np.arange(len(truth)), truth]).mean())


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("id"), 0
            for own in slices([t or "" for t in batch.column("text").to_pylist()]):
                judged = shared.value.judge(own) if shared else [(UNDETERMINED, 0.0, False)] * len(own)
                lang, score, accepted = zip(*judged)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(own)), pa.array(lang), pa.array(score), pa.array(accepted)],
                    ["id", "lang_pred", "score", "accepted"])
                at += len(own)

    return run


def identify(docs: DataFrame, identifier: Identifier | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (0 to 1) and accepted, the verdict of the rejection.

    A text that is null or has no letter is `und` with score 0, as is every text without a model. Null
    ids and repeated rows are rows like others; an empty table gives no rows; other columns are
    ignored. A caller that wants rejected texts undetermined takes `und` where accepted is false.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier) if identifier else None
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(
        _predictor(shared), f"id {kind}, lang_pred string, score double, accepted boolean"
    ).withColumnRenamed("id", id_column)


def fold(id_column: str, folds: int = 3) -> Column:
    """The fold of a row: crc32 of its id as text, modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds, F.lit(0))
