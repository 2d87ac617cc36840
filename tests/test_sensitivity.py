import hashlib

import pytest
from pyspark.sql import functions as F

from lakescribe.functions.text import glob_to_regex, mask_value, redact_text
from lakescribe.operators import masking, sampling, sensitivity
from lakescribe.plans.publication import PublicationRefused, publish_profiles


def classify(spark, *names, **kw):
    df = spark.createDataFrame([("dbo", "Visitor", n) for n in names], "schema_name string, object_name string, column_name string")
    return {r["column_name"]: r for r in sensitivity.classify_columns(df, **kw).collect()}


def test_legacy_names(spark):
    names = ("GuardianNm", "SName", "PAddr", "EmailId", "MobileNo", "DOB", "Passport")
    for row in classify(spark, *names).values():
        assert tuple(row)[3:] == ("PII", "PSEUDONYMIZE", "HIGH", "BUILTIN_LEGACY_COLUMN_NAME")


def test_exact_override_comes_first(spark, tmp_path):
    path = tmp_path / "rules.toml"
    path.write_text("""
[[rules]]
match = "pattern"
database = "shop*"
schema = "dbo"
table = "visitor*"
column = "*label"
category = "Potentially Sensitive"
action = "PSEUDONYMIZE"
reason = "labels of visitors"

[[rules]]
match = "exact"
database = "shop"
schema = "dbo"
table = "visitor"
column = "badge_label"
category = "Non-sensitive"
action = "PRESERVE"
reason = "badges are printed"
""")
    rules = sensitivity.load_overrides(path)
    found = classify(spark, "badge_label", "last_label", "Other", rules=rules, database="shop")
    assert found["badge_label"]["evidence"] == "OVERRIDE: badges are printed"
    assert found["last_label"]["evidence"] == "OVERRIDE: labels of visitors"
    assert found["Other"]["sensitivity_category"] == "Unknown"
    assert sensitivity.load_overrides(tmp_path / "none.toml") == []


def test_bad_rules_are_refused():
    with pytest.raises(ValueError):
        sensitivity.OverrideRule(match="regex")
    with pytest.raises(ValueError):
        sensitivity.OverrideRule(category="Secret")


@pytest.mark.parametrize("glob, yes, no", [
    ("*_label", "a_label", "a_labels"), ("user?id", "user_id", "userid"), ("t[0-4]", "t3", "t5"),
    ("t[!0-4]", "t5", "t3"), ("a.b", "a.b", "axb"), ("[x", "[x", "x"),
])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "v string")
    assert [r[0] for r in df.select(F.col("v").rlike(glob_to_regex(glob))).collect()] == [True, False]


def test_description_and_values(spark):
    df = spark.createDataFrame([("dbo", "t", "Value1", "mobile of the guide"), ("dbo", "t", "Value2", None)],
                               "schema_name string, object_name string, column_name string, description string")
    signals = sensitivity.value_signals(spark.createDataFrame([(" guide@museum.invalid\n",), ("[REDACTED]",)], "Value2 string"), "t")
    keyed = signals.select(F.lit("dbo").alias("schema_name"), F.col("table_name").alias("object_name"), "column_name", "signal_rank")
    found = {r["column_name"]: r for r in sensitivity.classify_columns(df, signals=keyed).collect()}
    assert (found["Value1"]["sensitivity_category"], found["Value1"]["confidence"]) == ("PII", "MEDIUM")
    assert found["Value2"]["evidence"] == "VALUE_SIGNAL: email value pattern"


def test_signals_of_numbers_and_dates(spark):
    df = spark.sql("SELECT 9876543210 AS phone, 12345 AS small, date'2024-01-01' AS day, 'ABCDE1234f' AS tax, "
                   "CAST(123456789012 AS DECIMAL(20,0)) AS id12, 1.5e12 AS big, '1234-5678 9012' AS id_text")
    found = {r["column_name"]: r["signal_rank"] for r in sensitivity.value_signals(df, "t").collect()}
    assert found == {"phone": 2, "small": None, "day": 2, "tax": 4, "id12": 2, "big": None, "id_text": 2}


def test_mask_tokens(spark):
    df = spark.createDataFrame([("clerk@museum.invalid",), (None,)], "v string")
    column = F.col("v")
    rows = df.select(mask_value(column, "PII", "s").alias("pii"), mask_value(column, "Credential", "s", enabled=False).alias("cred"),
                     mask_value(column, "PII", "s", enabled=False).alias("off"), mask_value(column, "Unknown", "s").alias("plain")).collect()
    token = "[MASKED:" + hashlib.sha256(b"s|clerk@museum.invalid").hexdigest()[:16] + "]"
    assert tuple(rows[0]) == (token, "[REDACTED]", "clerk@museum.invalid", "clerk@museum.invalid")
    assert tuple(rows[1]) == (None,) * 4


def test_binary_is_never_shown(spark):
    df = spark.createDataFrame([(b"\x01\x02", 1)], "b binary, n int")
    assert tuple(masking.mask_table(df, {}, "s").first()) == ("[BINARY_REDACTED]", 1)


def test_reconciled_rows_are_masked_once(spark):
    final = spark.createDataFrame([("Ledger", "slip", "PII", "PSEUDONYMIZE", "HIGH", "VALUE_SIGNAL: phone value pattern")],
                                  "table_name string, column_name string, sensitivity_category string, masking_action string, confidence string, evidence string")
    rows = spark.createDataFrame([("Ledger", "slip", "", "70314265")], "table_name string, column_name string, minimum_value string, maximum_value string")
    found = masking.reconcile_sensitivity(rows, final, ("minimum_value", "maximum_value"), "s").first()
    assert found["sensitivity_category"] == "PII"
    assert found["maximum_value"] == "[MASKED:" + hashlib.sha256(b"s|70314265").hexdigest()[:16] + "]"


@pytest.mark.parametrize("text, literals, gone, kept", [
    ("SERVER=x;UID=user;PWD=hunter2;Encrypt=yes", (), "hunter2", "PWD=[REDACTED]"),
    ("token=abc123 error", (), "abc123", "token=[REDACTED] error"),
    ("Connection to secret-server failed for reader", ("secret-server", "reader"), "reader", "Connection"),
    (r"connection to HOST\\INSTANCE failed", (r"HOST\INSTANCE",), "INSTANCE", "failed"),
])
def test_redaction(spark, text, literals, gone, kept):
    out = spark.createDataFrame([(text,)], "t string").select(redact_text(F.col("t"), literals)).first()[0]
    assert gone not in out and kept in out


PROFILE = "table_name string, column_name string, data_type string, sensitivity_category string, sensitivity_evidence string, minimum_value string, maximum_value string"
ROWS = [
    ("Fix", "Value1", "nvarchar", "Unknown", "NO_SENSITIVITY_SIGNAL", "Ruth Sample", "Zara Example"),
    ("Fix", "Value2", "nvarchar", "Unknown", "NO_SENSITIVITY_SIGNAL", "42 Example Street", "99 Sample Road"),
    ("Fix", "EmailAddress", "nvarchar", "PII", "BUILTIN_COLUMN_NAME", "a@example.test", "z@example.test"),
    ("Fix", "PasswordValue", "nvarchar", "Credential", "BUILTIN_COLUMN_NAME", "hunter2", "open-sesame"),
    ("Fix", "ReviewedName", "nvarchar", "Non-sensitive", "OVERRIDE: operator-reviewed label", "Active", "Inactive"),
    ("Fix", "SequenceValue", "int", "Unknown", "NO_SENSITIVITY_SIGNAL", "1", "900"),
    ("Fix", "BinaryValue", "varbinary", "Unknown", "NO_SENSITIVITY_SIGNAL", "0x0102", "0xFEFF"),
]


@pytest.fixture
def profiles(spark):
    rows = spark.createDataFrame(ROWS, PROFILE)
    classes = rows.select("table_name", F.lower("column_name").alias("column_name"), "sensitivity_category",
                          F.col("sensitivity_evidence").alias("evidence"))
    return rows, classes


FIELDS = ("minimum_value", "maximum_value")


def test_publication_policy(profiles):
    rows, classes = profiles
    published = masking.publication_policy(rows, classes, FIELDS, "s")
    found = {r["column_name"]: r for r in published.collect()}
    for name in ("Value1", "Value2", "EmailAddress"):
        assert found[name]["minimum_value"].startswith("[MASKED:")
    assert found["PasswordValue"]["maximum_value"] == "[REDACTED]"
    assert (found["ReviewedName"]["minimum_value"], found["SequenceValue"]["maximum_value"]) == ("Active", "900")
    assert found["BinaryValue"]["minimum_value"] == "[BINARY_REDACTED]"
    assert masking.publication_counters(published).first()["profile_values_masked"] == 10
    blank = masking.publication_policy(rows, classes, FIELDS, "s", "aggregate_only")
    assert masking.publication_counters(blank).first()["profile_values_omitted"] == 14
    with pytest.raises(ValueError):
        masking.publication_policy(rows, classes, FIELDS, "s", "everything")


def test_audit_finds_raw_values_and_passes_tokens(spark):
    classes = spark.createDataFrame([("Person", "EmailAddress", "PII", "BUILTIN_COLUMN_NAME")], "table_name string, column_name string, sensitivity_category string, evidence string")

    def audit(value):
        rows = spark.createDataFrame([("Person", "EmailAddress", value, value)], "table_name string, column_name string, minimum_value string, maximum_value string")
        values = rows.select("table_name", "column_name", F.col("minimum_value").alias("value"))
        audited = masking.audit_profile_values(rows, classes, FIELDS, "profile").unionByName(
            masking.audit_profile_values(values, classes, ("value",), "values"))
        return masking.audit_violations(audited).count(), masking.audit_summary(audited).first()

    assert audit("clerk@museum.invalid")[0] == 3
    violations, summary = audit("[MASKED:0123456789abcdef]")
    assert violations == 0 and summary["values_checked"] == 3 and summary["passed"]


def test_publish_releases_only_what_passes(spark, profiles, tmp_path):
    rows, classes = profiles
    target = str(tmp_path / "out")
    summary = publish_profiles({"column_profile": (rows, FIELDS)}, classes, "s", target)
    assert all(r["passed"] for r in summary.collect())
    released = spark.read.parquet(f"{target}/column_profile")
    assert "hunter2" not in str(released.collect())
    leaky = spark.createDataFrame([("Fix", "Seen", "int", "Non-sensitive", "OVERRIDE: fine", "token=abc", "1")], PROFILE)
    reviewed = leaky.select("table_name", "column_name", "sensitivity_category", F.col("sensitivity_evidence").alias("evidence"))
    with pytest.raises(PublicationRefused):
        publish_profiles({"column_profile": (leaky, FIELDS)}, reviewed, "s", str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_published_sample_masks_all_but_classed_columns(spark):
    df = spark.createDataFrame([(7, "Ruth", None, "")], "VisitorId int, SName string, a string, b string")
    row = masking.publish_sample(df, {"studnm": "PII"}, "s").first()
    assert row["VisitorId"].startswith("[MASKED:") and row["SName"].startswith("[MASKED:")
    assert (row["a"], row["b"]) == ("", "")


def test_sample_is_masked_from_names_and_values(spark):
    df = spark.createDataFrame([(1, "Ruth Sample", "x"), (2, "Rob", "rob@museum.invalid")], "VisitorId int, SName string, free string")
    rows = sampling.sample_and_mask(df, "Visitor", 10, "s", ["VisitorId"]).collect()
    assert rows[0]["VisitorId"] == "1" and rows[0]["SName"].startswith("[MASKED:")
    assert rows[0]["free"].startswith("[MASKED:")
    assert sampling.sample_and_mask(df, "Visitor", 1, "s", ["VisitorId"]).first()["free"] == "x"
    index = sampling.sample_index(df, "Visitor", 10, ["VisitorId"]).first()
    assert (index["returned_rows"], index["status"], index["masked_sensitive_column_count"]) == (2, "SAMPLED", 2)


def test_sample_order_and_plan(frame):
    keys = frame("schema_name string, object_name string, constraint_name string, key_ordinal int, column_name string",
                 ("dbo", "A", "pk", 2, "y"), ("dbo", "A", "pk", 1, "x"))
    index = "schema_name string, object_name string, index_id int, index_name string, key_ordinal int, column_name string, is_unique boolean, is_disabled boolean, has_filter boolean, is_included_column boolean"
    indexes = frame(index, ("dbo", "A", 1, "ux", 1, "z", True, False, False, False),
                    ("dbo", "B", 3, "late", 1, "q", True, False, False, False),
                    ("dbo", "B", 2, "Code", 1, "code", True, False, False, False),
                    ("dbo", "C", 1, "ix", 1, "n", False, False, False, False))
    ordering = sampling.ordering_columns(keys, indexes)
    assert {r["object_name"]: (r["order_columns"], r["ordering_strategy"]) for r in ordering.collect()} == {
        "A": ("x,y", "PRIMARY_KEY"), "B": ("code", "UNIQUE_INDEX")}
    objects = frame("schema_name string, object_name string, object_type string", ("dbo", "A", "USER_TABLE"),
                    ("dbo", "C", "TABLE"), ("dbo", "V", "view"), ("dbo", "P", "PROC"))
    sizes = frame("schema_name string, object_name string, row_count bigint", ("dbo", "A", 2_000_000))
    from lakescribe.policy import Policy
    plan = {r["object_name"]: r for r in sampling.sample_plan(objects, sizes, ordering, Policy(profile_row_limit=1_000_000)).collect()}
    assert plan["A"]["status"] == "READY" and plan["C"]["ordering_strategy"] == "UNORDERED_TOP"
    assert plan["V"]["eligibility_reason"] == "VIEW_ELIGIBILITY_EVIDENCE_NOT_PROVIDED"
    assert plan["P"]["status"] == "SKIPPED_UNSUPPORTED_OBJECT_TYPE"
    strict = Policy(profile_row_limit=1_000_000, sample_large_tables=False)
    denied = {r["object_name"]: r["status"] for r in sampling.sample_plan(objects, sizes, ordering, strict).collect()}
    assert denied["A"] == "SKIPPED_LARGE_TABLE_SAMPLING_DISABLED"


def test_failure_texts(spark):
    df = spark.createDataFrame([("HYT00 query timeout",), ("SELECT permission denied",), ("invalid object",)], "m string")
    assert [r[0] for r in df.select(sampling.sample_failure_status(F.col("m"))).collect()] == ["FAILED_TIMEOUT", "INACCESSIBLE", "FAILED_QUERY"]
    assert [r[0] for r in df.select(sampling.is_access_limitation(F.col("m"))).collect()] == [False, True, False]


def test_indexed_rules_equal_conditions(spark, monkeypatch):
    import random

    rng = random.Random(12)
    words = ["id", "name", "user", "é", "no", "x", "a[b", "order", "_", "[a-c]", "[!u]", "?", "*", "**", "1", "Status"]
    make = lambda n: "".join(rng.choice(words) for _ in range(rng.randrange(n)))
    wild = lambda n: rng.choice(["*", "", make(n), make(n)])
    rules = [
        sensitivity.OverrideRule(rng.choice(["*", "*", "sh*", "shop"]), wild(3), wild(4), wild(5), rng.choice(["exact", "pattern", "pattern"]),
                                 rng.choice(["PII", "Health"]), reason=f"r{i}") for i in range(300)]
    names = [(rng.choice(["dbo", "ref", None, "x"]), make(4), make(5)) for _ in range(250)]
    rules += [sensitivity.OverrideRule("*", "*", t or "*", c or "*", "exact", reason="own") for _, t, c in names[:20]]
    columns = spark.createDataFrame([(*n, "k") for n in [*names, names[0]]], "schema_name string, object_name string, column_name string, key string")
    for chosen in (rules, rules[:40], rules[-20:], rules[150:]):
        done = []
        for most in (0, 10_000):
            monkeypatch.setattr(sensitivity, "INLINE_RULES", most)
            filled = columns.fillna("")
            found = sensitivity.classify_columns(filled, chosen, database="Shop")
            assert found.columns == [*columns.columns, *sensitivity.CLASS_FIELDS]
            done.append(sorted(map(str, found.collect())))
        assert done[0] == done[1]
    monkeypatch.setattr(sensitivity, "INLINE_RULES", 0)
    plans = [sensitivity.classify_columns(columns, rules * n)._jdf.queryExecution().optimizedPlan().toString() for n in (1, 9)]
    assert len(plans[1]) < 1.5 * len(plans[0])


def test_rules_meet_a_value_once_however_many_names_have_it(spark):
    rules = [sensitivity.OverrideRule(column=f"*none{i}?") for i in range(40)] + [
        sensitivity.OverrideRule(table="t_[0-4]*", category="Health"), sensitivity.OverrideRule(column="*oa*", table="*_7", category="Financial"),
        sensitivity.OverrideRule(schema="[sS]", column="?", category="Credential"),
        sensitivity.OverrideRule(column="load", table="t_9", match="exact", category="Non-sensitive")]
    names = spark.range(40).selectExpr(
        "IF(id % 2 = 0, 'load', 'x') AS column", "concat('t_', id DIV 2) AS table", "IF(id < 30, 's', 'dbo') AS schema", "'' AS database")
    found = sensitivity.override_matches(names, rules)
    assert "Generate explode" in (plan := found._jdf.queryExecution().optimizedPlan().toString())
    spread = [b.count("Aggregate [table") + b.count("Aggregate [column") for b in plan.split("Generate explode")[1:]]
    assert sum(spread) >= 2, plan
    inline = {(r["column"], r["table"], r["schema"]): r["result"] for r in names.select(
        "*", sensitivity.override_result(rules, **{p: F.col(p) for p in sensitivity.PARTS}).alias("result")).collect()}
    assert {(r["column"], r["table"], r["schema"]): r["result"] for r in found.collect()} == {k: v for k, v in inline.items() if v}
    assert len({v for v in inline.values() if v}) == 4
