"""Training-data pipeline over documents: each stage is written as Parquet and read again.

Stages keep the columns of documents, but for the last. Inside a stage the other columns are carried in one
struct, so columns of any other name pass through. A row is known by its id and a digest of its text,
so null and repeated ids pass through; n_chars follows the text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakescribe.llm.jaccard_join import jaccard_groups
from lakescribe.llm.line_templates import line_dedup
from lakescribe.llm.packing import pack
from lakescribe.llm.pii import find_personal_data, masked
from lakescribe.llm.quality import quality_filter
from lakescribe.llm.shipping import ship_package
from lakescribe.sources.shared import materialize


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the rest of the row, which holds the id once more and never the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("doc_id", "text", row.alias("row"))


def _unpacked(carried: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The carried rows, with another text where one is given; n_chars is then its length."""
    new = {"text": F.col("text")} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return carried.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them. Copies share one verdict."""
    return _unpacked(quality_filter(_carried(docs)), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first.

    A null text stays null. Rows that repeat id and text lose the same lines; of documents that share the smallest id all
    keep theirs. A document can be left with an empty text.
    """
    done = line_dedup(_carried(docs), keep=("row",))
    return _unpacked(done, docs.columns, F.col("kept_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once.

    Null texts and those without a word are like no other, so all stay, but rows that repeat id and text stay once.
    A null id is the smallest.
    """
    groups = jaccard_groups(docs.select("doc_id", "text")).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # one key without null for the join and for the first of each, so texts are shuffled once
    own = ["id", "no_id", "name"]
    known = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "no_id": F.isnull("doc_id")}
    stays = groups.withColumns({**known, "name": F.col("text_name")}).select(*own).distinct()
    named = _carried(docs).withColumns({**known, "name": F.xxhash64("text")})
    first = F.row_number().over(Window.partitionBy(*own).orderBy("id"))
    return _unpacked(named.join(stays, own, "left_semi").withColumn("place", first).where("place = 1"), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind. Null and empty texts stay as they are; copies are masked alike."""
    found = find_personal_data(docs.select("doc_id", "text")).select("doc_id", "text_name", F.concat("base", "more").alias("spans"))
    found = found.where(F.size("spans") > 0).groupBy(
        F.col("doc_id").alias("found_id"), F.col("text_name").alias("found_name")).agg(F.max("spans").alias("spans"))
    own = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("found_name"))
    joined = _carried(docs).join(found, own, "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("spans")))
    return _unpacked(joined.select("row", text.alias("new_text")), docs.columns, F.col("new_text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of every document; a null or empty text is one end mark. Copies are packed as documents of their own."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("packing", packing),
]

#: Packing and personal data have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after another."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
