"""Readers and writers of snapshots, run manifests, metrics, files and JDBC catalogues."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.json_leaves import json_leaves
from ..operators.compare import CompareSpec, delta_columns, run_columns
from ..operators.statements import statement_safety
from .workspace import project_declared


def jdbc_options(
    url: str, query: str, properties: Mapping[str, str] | None = None,
    partition: tuple[str, int, int, int] | None = None,
) -> dict[str, str]:
    """Reader options of one registered catalogue query; only a plain SELECT is accepted.

    ``partition`` is (column, lower bound, upper bound, partitions): the query is then read by so
    many tasks, each with a range of the column.
    """
    first = query.lstrip().split(None, 1)[0].upper() if query.strip() else ""
    if first not in ("SELECT", "WITH") or ";" in query.rstrip().rstrip(";"):
        raise ValueError("a catalogue query must be one SELECT")
    text = query.strip().rstrip(";")
    if partition is None:
        return {"url": url, "query": text, **(properties or {})}
    column, lower, upper, count = partition
    return {
        "url": url, "dbtable": f"({text}) catalogue_rows", "partitionColumn": column, "lowerBound": str(lower),
        "upperBound": str(upper), "numPartitions": str(count), **(properties or {}),
    }


def read_catalogue_jdbc(
    spark: SparkSession, url: str, query: str, schema: str, properties: Mapping[str, str] | None = None,
    partition: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """The result of a registered query under its declared columns.

    The whole query is judged by the rules of :func:`statement_safety` before anything is sent.
    """
    options = jdbc_options(url, query, properties, partition)
    judged = statement_safety(spark.createDataFrame([(query,)], "definition string")).first()
    if not judged["is_read_only"]:
        raise ValueError(f"a catalogue query must only read: {judged['reason']}")
    return project_declared(spark.read.format("jdbc").options(**options).load(), schema)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_snapshot(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> tuple[DataFrame, bool]:
    """(rows, available) of one CSV artifact, every column a string.

    Quoted newlines, doubled quotes and a byte order mark are read as such. A missing file gives no
    rows and ``False``, which is not the same as an empty file.
    """
    if not _exists(spark, path):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns or ("value",)])
        return spark.createDataFrame([], schema), False
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    rows = reader.csv(path)
    if columns:
        rows = project_declared(rows, ", ".join(f"`{c}` string" for c in columns))
    return rows, True


def read_parquet_snapshot(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """(rows, available) of one Parquet row set; only a path that does not exist is unavailable."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema), False
    return project_declared(spark.read.parquet(path), schema), True


def write_snapshot(
    tables: Mapping[str, DataFrame], path: str, columns: Mapping[str, Sequence[str]] | None = None,
    file_format: str = "parquet",
) -> None:
    """One directory per row set, its declared columns only."""
    for name, df in tables.items():
        wanted = (columns or {}).get(name)
        chosen = df.select(*wanted) if wanted else df
        writer = chosen.write.mode("overwrite")
        if file_format == "csv":
            writer = writer.options(header=True, quote='"', escape='"')
        writer.format(file_format).save(f"{path}/{name}")


#: Leaves that a task hands on at once.
LEAF_ROWS = 1 << 16


def _leaf_rows(schema: T.StructType):
    """Batches of (keys, text) as batches of (keys, metric, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves = [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = json_leaves(text) or ()
                rows.extend([row] * len(found))
                leaves.extend(found)
                if len(rows) >= LEAF_ROWS:
                    yield made(batch, rows, leaves)
                    rows, leaves = [], []
            yield made(batch, rows, leaves)

    def made(batch: pa.RecordBatch, rows: list[int], leaves: list[tuple[str, str | None]]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        keys = [batch.column(k).take(at) for k in range(batch.num_columns - 1)]
        ends = [pa.array([leaf[k] for leaf in leaves], pa.string()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*keys, *ends], schema.names)

    return run


def flatten_metrics(df: DataFrame, json_column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, value): the scalar leaves of JSON objects under dotted names, in one scan.

    Values are texts: ``1`` with all digits, ``1.0``, ``1e+16``, ``nan``, ``true``, null; a text that looks
    like an object or a list stays a text. Of equal names in an object the last one counts. Lists and
    what they hold are left out; a document that is a single scalar has the name ''. Nulls and texts that
    are no JSON give no rows; repeated rows give theirs again. The engine's own parsed form is not used: it
    refuses equal names and NaN and rounds numbers.
    """
    names = [f"key_{k}" for k in range(len(keys))]
    source = df.where(F.col(json_column).isNotNull()).select(
        *[F.col(c).alias(n) for c, n in zip(keys, names)], F.col(json_column).cast("string").alias("document"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("metric", T.StringType()), T.StructField("value", T.StringType())])
    return source.mapInArrow(_leaf_rows(schema), schema).toDF(*keys, "metric", "value")


MANIFEST_SCHEMA = (
    "run_id string, database string, timestamp_utc string, tool_version string, errors int, "
    "warnings array<string>, expected_stage_count int, "
    "stages array<struct<prompt:string,status:string>>, configuration map<string,string>"
)


def list_snapshots(spark: SparkSession, pattern: str, expected_stages: int = 0) -> DataFrame:
    """One row per readable run manifest with the status its stages add up to."""
    raw = spark.read.schema(MANIFEST_SCHEMA).options(multiLine=True, mode="DROPMALFORMED").json(pattern)
    return run_statuses(raw.select("*", F.col("_metadata.file_path").alias("manifest_path")), expected_stages)


def run_statuses(manifests: DataFrame, expected_stages: int = 0) -> DataFrame:
    """COMPLETED, COMPLETED_WITH_WARNINGS, FAILED, CANCELLED or PARTIAL, with stage coverage.

    ``expected_stages`` serves where a manifest with stages does not say how many there should be.
    """
    stages = F.coalesce("stages", F.array().cast("array<struct<prompt:string,status:string>>"))
    statuses = F.transform(stages, lambda s: s["status"])

    def having(*values: str) -> Column:
        return F.size(F.filter(statuses, lambda s: s.isin(*values)))

    total = F.size(stages)
    errors = F.coalesce(
        F.nullif("errors", F.lit(0)), F.when(F.col("warnings").isNotNull(), F.size("warnings")), F.lit(0)
    )
    expected = F.coalesce(F.nullif("expected_stage_count", F.lit(0)), F.when(total > 0, expected_stages).otherwise(0))
    done = having("PASS", "SKIPPED_BY_MODE")
    complete = (expected > 0) & (total >= expected) & (done == total)
    failed = having("FAILED")
    mode = F.col("configuration").getItem("discovery_mode")
    return manifests.select(
        "run_id", "database", "timestamp_utc",
        F.coalesce(mode, F.lit("UNKNOWN")).alias("mode"),
        F.when(having("CANCELLED") > 0, "CANCELLED").when(failed > 0, "FAILED")
        .when(complete & (errors > 0), "COMPLETED_WITH_WARNINGS").when(complete, "COMPLETED")
        .otherwise("PARTIAL").alias("status"),
        having("PASS").alias("completed_stage_count"),
        F.when(expected > 0, F.concat_ws("/", done, expected)).otherwise("0/0").alias("completion_coverage"),
        failed.alias("error_count"), F.greatest(errors - failed, F.lit(0)).alias("warning_count"),
        *[c for c in ("manifest_path",) if c in manifests.columns],
    )


#: Files up to so many bytes are hashed as one value; larger ones by chunks of CHUNK bytes of a stream.
WHOLE_FILE, CHUNK = 64 << 20, 8 << 20
#: Bytes of streamed files that one task takes, about, where there are more of them than shuffle partitions.
STREAMED = 1 << 30


def open_file(path: str) -> BinaryIO:
    """A stream of a file: local paths, and those of file systems that Arrow knows (hdfs, s3, gs, abfs)."""
    scheme, found, rest = path.partition(":")
    if found and scheme == "file":
        return open(re.sub("^/{2,}", "/", rest), "rb")
    if not found:
        return open(path, "rb")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(inside)


def _digests(opened: Callable[[str], BinaryIO]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with opened(path) as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "sha256"])

    return run


def _shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The files below a directory; a task lists a batch of its folders, not one."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    most = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(most), _shuffle_partitions(spark))))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    finally:
        spark.conf.set(setting, most)


def file_inventory(
    spark: SparkSession, path: str, whole: int = WHOLE_FILE, opened: Callable[[str], BinaryIO] = open_file
) -> DataFrame:
    """(file_name, path, bytes, sha256) of every file below a directory of artifacts.

    Files of at most ``whole`` bytes are read by Spark and hashed as values. Larger ones, of any size, are
    streams: a task updates the digest chunk by chunk, so its memory does not follow the file. They are dealt
    to as many tasks as there are such files, up to the session's number of shuffle partitions, or one for
    STREAMED bytes. Folders are listed in batches. ``opened`` opens their path where Arrow has no file system for it.
    """
    files = _listed(spark, path)
    named = [F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path"), F.col("length").alias("bytes")]
    small = files.where(F.col("length") <= whole).select(*named, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select(*named)  # the content is not read
    schema = "file_name string, path string, bytes long, sha256 string"
    streamed = F.col("length") > whole
    lengths = files.agg(F.count(F.lit(1)), F.count_if(streamed), F.sum(F.when(streamed, F.col("length")))).first()
    parts = [small]
    if lengths[1]:
        tasks = min(lengths[1], max(_shuffle_partitions(spark), -(-lengths[2] // STREAMED)))
        parts.append(large.repartition(tasks, "path").mapInArrow(_digests(opened), schema))
    listed = files.inputFiles()
    if len(listed) > lengths[0]:  # scans leave out files without a byte
        paths = spark.createDataFrame([(re.sub("^file:///", "file:/", unquote(f)),) for f in listed], "path string")
        empty = paths.join(files.select("path"), "path", "left_anti")
        parts.append(empty.select(
            F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.lit(0).cast("long").alias("bytes"),
            F.lit(hashlib.sha256().hexdigest()).alias("sha256")))
    return reduce(DataFrame.unionByName, parts)


def export_comparison(compared: DataFrame, spec: CompareSpec, path: str) -> None:
    """A comparison as JSON lines and as CSV whose nested columns are JSON texts."""
    compared.write.mode("overwrite").json(f"{path}/json")
    export_rows(compared, spec).write.mode("overwrite").options(
        header=True, quote='"', escape='"'
    ).csv(f"{path}/csv")


def export_rows(compared: DataFrame, spec: CompareSpec) -> DataFrame:
    """(status, identity, intervals, timeline_events, runs, numeric_deltas) with JSON texts.

    ``spec`` is what was compared; it tells which column belongs where.
    """
    intervals = [c for c in ("a_to_b", "b_to_c", "a_to_c") if c in compared.columns]
    deltas, runs = delta_columns(compared, spec), run_columns(compared, spec)
    diffs = [f"diff_{i}" for i in intervals if f"diff_{i}" in compared.columns]
    if spec.definition:
        runs += [c for c in (f"{spec.definition}_{x}" for x in "abc") if c in compared.columns]

    def as_json(names: Iterable[str]) -> Column:
        names = sorted(names)
        return F.to_json(F.struct(*names)) if names else F.lit("{}")

    events = F.to_json("timeline_events") if "timeline_events" in compared.columns else F.lit("[]")
    category = [F.col("category")] if "category" in compared.columns else []
    return compared.select(
        *category, "status", as_json(spec.keys).alias("identity"), events.alias("timeline_events"),
        as_json(intervals).alias("intervals"), as_json(runs).alias("runs"),
        as_json(deltas).alias("numeric_deltas"), as_json(diffs).alias("definition_diffs"),
    )


def read_text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(file_path, text): whole text files, for secret scans and line searches."""
    return spark.read.text(pattern, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
