import datetime
import decimal

import pytest
from pyspark.sql import functions as F, types as T

from lakescribe.functions.types import family_of, family_of_name
from lakescribe.operators import profile
from lakescribe.operators import frequency
from lakescribe.operators.frequency import distinct_counts, value_frequencies
from lakescribe.policy import Policy


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def test_profile_of_mixed_types(spark):
    schema = T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("name with.dot", T.StringType()),
        T.StructField("d", T.DecimalType(10, 2)), T.StructField("f", T.FloatType()),
        T.StructField("flag", T.BooleanType()), T.StructField("day", T.DateType()),
        T.StructField("raw", T.BinaryType()), T.StructField("zero", T.DoubleType()),
    ])
    day = datetime.date(2024, 1, 2)
    rows = [
        (1, "", decimal.Decimal("1.50"), 0.5, True, day, b"x", 0.0),
        (2, "  ", decimal.Decimal("-2.00"), 1.5, False, day, b"y", -0.0),
        (3, "b" * 100, None, 0.5, None, None, None, None),
        (4, "b" * 99 + "c", decimal.Decimal("1.50"), None, False, day, None, 0.0),
    ]
    found = by_column(profile.column_profile(spark.createDataFrame(rows, schema), "t"))
    assert found["raw"]["profile_status"] == "SKIPPED_FOR_SAFETY_OR_TYPE"
    name = found["name with.dot"]
    assert (name["distinct_count"], name["empty_string_count"], name["whitespace_string_count"]) == (4, 1, 2)
    assert (name["minimum_length"], name["maximum_length"]) == (0, 100)
    assert name["maximum_value"] == "b" * 99 + "c"
    assert found["id"]["candidate_unique"] and not found["d"]["candidate_unique"]
    d = found["d"]
    assert (d["distinct_count"], d["negative_count"], d["minimum_value"], d["maximum_value"]) == (2, 1, "-2.00", "1.50")
    assert (found["f"]["minimum_value"], found["f"]["maximum_value"], found["f"]["distinct_count"]) == ("0.5", "1.5", 2)
    flag = found["flag"]
    assert (flag["true_count"], flag["false_count"], flag["zero_count"]) == (1, 2, 2)
    assert (flag["minimum_value"], flag["maximum_value"]) == ("false", "true")
    assert found["day"]["constant_value"] and found["day"]["minimum_value"] == "2024-01-02"
    assert found["zero"]["distinct_count"] == 1 and found["zero"]["zero_count"] == 3
    assert found["day"]["null_percent"] == 25.0


def test_empty_table_is_unique_and_all_null(spark):
    row = profile.column_profile(spark.createDataFrame([], "a int"), "t").first()
    assert row["candidate_unique"] and row["all_null"] and not row["constant_value"]
    assert row["distinct_percent"] is None and row["null_percent"] == 0.0


def test_skipped_table_keeps_its_columns(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    found = profile.column_profile(df, "t", status="SKIPPED_FOR_SAFETY_LARGE_TABLE").collect()
    assert [r["profile_status"] for r in found] == ["SKIPPED_FOR_SAFETY_LARGE_TABLE"] * 2
    assert found[0]["total_rows"] is None


def test_approximate_profile_has_extrema(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit("x").alias("s"))
    found = by_column(profile.column_profile(df, "t", approx=True))
    assert found["k"]["distinct_count"] == 7 and found["k"]["maximum_value"] == "6"


def test_hot_value_and_wide_table(spark):
    columns = [((F.col("id") % (i + 2)) if i else F.when(F.col("id") < 700, 0).otherwise(F.col("id"))).alias(f"c{i}")
               for i in range(20)]
    df = spark.range(1000).select(*columns)
    found = by_column(profile.column_profile(df, "t"))
    assert found["c0"]["distinct_count"] == 301
    assert all(found[f"c{i}"]["distinct_count"] == i + 2 for i in range(1, 20))


def test_distribution_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    rows = profile.low_cardinality_values(df, "t", 2).collect()
    assert [(r["value"], r["value_count"], r["value_percent"]) for r in rows] == [("a", 2, 50.0), (None, 1, 25.0), ("b", 1, 25.0)]
    assert profile.low_cardinality_values(df, "t", 1).collect() == []


def test_bounded_frequencies_equal_counting(spark, monkeypatch):
    monkeypatch.setattr(frequency, "PROOF_ROWS", 20)
    i = F.col("id")
    df = spark.range(0, 4000, 1, 7).select(
        F.when(i % 3 == 0, 0).otherwise(i % 5).alias("few"), (i / 500).cast("int").alias("sorted"), (i % 11).alias("eleven"), i.alias("key"),
        F.when(i < 3990, F.lit("x")).otherwise(i.cast("string")).alias("late"), F.lit(None).cast("string").alias("none"),
        F.when(i % 2 == 0, float("nan")).otherwise(F.when(i % 3 == 0, -0.5)).alias("real"), F.concat(F.repeat(F.lit("long "), 40), (i % 3).cast("string")).alias("long"),
        (i % 2 == 0).alias("flag"), F.when(i % 4 > 0, i % 10).alias("ten"), F.expr("timestamp_seconds(id % 4)").alias("at"))
    for limit in (1, 2, 4, 8, 10):
        wanted = {}
        for name in df.columns:
            rows = df.groupBy(df[name].cast("string").alias("v")).count().collect()
            if sum(r["v"] is not None for r in rows) <= limit:
                wanted |= {(name, r["v"]): r["count"] for r in rows}
        found = frequency.bounded_frequencies(df, df.columns, limit).collect()
        assert {(r["column_name"], r["value"]): r["value_count"] for r in found} == wanted and len(found) == len(wanted)
    assert "key" not in frequency.not_proven_above(df, df.columns, 10)
    empty = df.limit(0)
    assert frequency.bounded_frequencies(empty, df.columns, 3).count() == 0 and profile.low_cardinality_columns(empty, 3) == []
    assert profile.low_cardinality_columns(df, 8, ["key", "sorted", "eleven"]) == ["sorted"]


def test_distribution_from_a_profile(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "a int, b string")
    known = profile.column_profile(df, "t")
    rows = profile.low_cardinality_values(df, "t", 2, profile=known).collect()
    assert {r["column_name"] for r in rows} == {"b"}


def test_distinct_counts_and_frequencies_agree(spark):
    df = spark.range(500).select((F.col("id") % 9).alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b"),
                                 F.repeat(F.lit("long "), 30).alias("c"))
    counts = {r["position"]: r["distinct_count"] for r in distinct_counts(df).collect()}
    listed = {r["column_name"]: r["count"] for r in value_frequencies(df).groupBy("column_name").count().collect()}
    assert counts == {0: 9, 1: 500, 2: 1} and listed == {"a": 9, "b": 500, "c": 1}


@pytest.mark.parametrize("text, expected", [
    ("100", 100), ("100001", 100001), ("", None), ("unknown", None), ("-5", None), (None, None), (" 7 ", 7),
    ("99999999999999999999999", None),
])
def test_row_estimates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "row_count string")
    row = df.select(profile.known_row_estimate(F.col("row_count")).alias("e"),
                    profile.within_threshold(F.col("row_count"), 100_000).alias("w")).first()
    assert row["e"] == expected and row["w"] == (expected is not None and expected <= 100_000)


def test_gate_depends_on_policy(frame):
    columns = frame("schema_name string, object_name string, column_name string, data_type string, is_computed boolean",
                    ("dbo", "Fact", "Value", "int", False), ("dbo", "Fact", "Doc", "XML", False),
                    ("dbo", "Fact", "Sum", "int", True), ("dbo", "Gone", "x", "int", False))
    sizes = frame("schema_name string, object_name string, row_count bigint", ("dbo", "Fact", 2_000_000))
    status = lambda p: {r["column_name"]: r["profile_status"] for r in profile.profile_status(columns, sizes, p).collect()}
    assert status(Policy(profile_row_limit=1_000_000))["Value"] == "SKIPPED_FOR_SAFETY_LARGE_TABLE"
    full = status(Policy(profile_row_limit=5_000_000))
    assert full == {"Value": "PROFILED", "Doc": "SKIPPED_FOR_SAFETY_OR_TYPE", "Sum": "SKIPPED_COMPUTED",
                    "x": "SKIPPED_ROW_ESTIMATE_UNAVAILABLE"}
    assert status(Policy())["Value"] == "PROFILED"


def test_type_families(spark):
    names = {"nvarchar": "STRING", "decimal(10,2)": "NUMERIC", "datetime2": "DATE_TIME", "bit": "NUMERIC",
             "varbinary": "BINARY", "array<int>": "OTHER", "timestamp_ntz": "DATE_TIME"}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r["t"]: r["f"] for r in df.select("t", family_of_name(F.col("t")).alias("f")).collect()} == names
    assert family_of(T.MapType(T.StringType(), T.StringType())) == "OTHER"


def test_exact_count_ceiling(spark):
    df = spark.range(11)
    assert profile.exact_row_count(df, "t", 10, 100).first()["row_count"] == 11
    above = profile.exact_row_count(df, "t", 1000, 100).first()
    assert (above["row_count"], above["row_count_type"]) == (1000, "ESTIMATED")
    assert profile.exact_row_count(df, "t", None, 100).first()["row_count"] is None


def test_numbers_and_times_are_not_shuffled_as_text(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("x"))
    plan = distinct_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(id" not in plan.lower() or "string" not in plan.lower()
