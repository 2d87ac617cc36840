import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lakescribe import Policy, Workspace
from lakescribe.operators import browse
from lakescribe.plans.discovery import JOB_STEP_SCHEMA, STATEMENT_SCHEMA, Logic, discover, samples
from lakescribe.sources import readers, shared, workspace


def test_csv_with_mark_quotes_and_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿name,text\r\n"x","line one\nline ""two"""\r\n', encoding="utf-8")
    rows, available = readers.read_snapshot(spark, str(path), ("name", "text", "extra"))
    assert available and [tuple(r) for r in rows.collect()] == [("x", 'line one\nline "two"', None)]
    rows, available = readers.read_snapshot(spark, str(tmp_path / "none.csv"), ("name",))
    assert not available and rows.columns == ["name"] and rows.count() == 0
    assert readers.read_parquet_snapshot(spark, str(tmp_path / "none"), "a int")[1] is False


def test_large_text_field(spark, tmp_path):
    text = "SELECT 1 -- sanitized\n" * 10_000
    (tmp_path / "c.csv").write_text('definition\n"' + text + '"\n')
    assert readers.read_snapshot(spark, str(tmp_path / "c.csv"))[0].first()[0] == text


def test_manifests(spark, tmp_path):
    def write(name, **extra):
        folder = tmp_path / "db" / name
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(json.dumps({"run_id": name, "database": "Db", **extra}, indent=1))
    done = [{"prompt": "1", "status": "PASS"}, {"prompt": "2", "status": "SKIPPED_BY_MODE"}]
    write("r1", stages=done, expected_stage_count=2, configuration={"discovery_mode": "safe"})
    write("r2", stages=done, expected_stage_count=2, warnings=["w"])
    write("r3", stages=done + [{"prompt": "3", "status": "FAILED"}], expected_stage_count=2, errors=3)
    write("r4", stages=done)
    write("r5")
    (tmp_path / "db" / "r5" / "manifest.json").write_text('{"run_id": "r5", "database": "Db"}')
    found = {r["run_id"]: r for r in readers.list_snapshots(spark, str(tmp_path / "*" / "*" / "manifest.json"), 20).collect()}
    assert {k: r["status"] for k, r in found.items()} == {
        "r1": "COMPLETED", "r2": "COMPLETED_WITH_WARNINGS", "r3": "FAILED", "r4": "PARTIAL", "r5": "PARTIAL"}
    assert (found["r1"]["mode"], found["r1"]["completion_coverage"]) == ("safe", "2/2")
    assert (found["r3"]["error_count"], found["r3"]["warning_count"]) == (1, 2)
    assert (found["r4"]["completion_coverage"], found["r5"]["completion_coverage"]) == ("2/20", "0/0")


def test_metrics(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x", "d": {"e": null}}, "l": [1]}'), (2, "not json"), (3, None)], "id int, j string")
    found = {(r["id"], r["metric"]): r["value"] for r in readers.flatten_metrics(df, "j", ["id"]).collect()}
    assert found == {(1, "a"): "1", (1, "b.c"): "x", (1, "b.d.e"): None}
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":1,"t":"{not json}"}}}}},"s":"[x]","n":null,"l":[{"k":1}],"o":{}}'
    rows = {r["metric"]: r["value"] for r in readers.flatten_metrics(spark.createDataFrame([(deep,)], "j string"), "j").collect()}
    assert rows == {"a.b.c.d.e.f": "1", "a.b.c.d.e.t": "{not json}", "s": "[x]", "n": None}


def test_metrics_are_exact(spark):
    digits = "1234567890" * 5
    texts = [
        '{"a":1,"a":2,"b":3}', '{"a":NaN,"b":3}', '{"a":1.0,"b":-0,"c":-0.0,"d":1e5,"e":1E400,"f":-Infinity}', f'{{"a":{digits},"b":{digits}.5}}',
        '{"a":{"x":1},"a":{"y":[{"z":1}],"w":{}}}', '{"":{"":1},"a.b":{"c":false}}', '{"t":"\\ud800\\u00e9"}', "5", "[1]", '{"a":01}', "", "{", '{"a":1} x',
        '{"a":' * 3000 + "1" + "}" * 3000, None,
    ]
    df = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate([*texts, texts[0]])], "metric int, j string, value string, key_0 int")
    rows = [tuple(r) for r in readers.flatten_metrics(df, "j", ["metric", "key_0"]).collect()]
    found = {}
    for i, key, metric, value in rows:
        found.setdefault(i, {})[metric] = value
    assert found == {
        0: {"a": "2", "b": "3"}, 1: {"a": "nan", "b": "3"}, 2: {"a": "1.0", "b": "0", "c": "-0.0", "d": "100000.0", "e": "inf", "f": "-inf"},
        3: {"a": digits, "b": repr(float(digits + ".5"))}, 5: {"": "1", "a.b.c": "false"}, 6: {"t": "?é"}, 7: {"": "5"},
        13: {".".join("a" * 3000): "1"}, 15: {"a": "2", "b": "3"}}
    assert readers.flatten_metrics(df.limit(0), "j").count() == 0
    plan = readers.flatten_metrics(df, "j", ["metric"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan


def test_large_files_are_hashed_by_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    rng = random.Random(3)
    wanted = {}
    for name, size in (("empty", 0), ("small", 9), ("edge", 1 << 12), ("a b%20é", 100_000), ("deep/large", 300_001)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(rng.randbytes(size))
        wanted[name.split("/")[-1]] = (size, hashlib.sha256((tmp_path / name).read_bytes()).hexdigest())
    for whole in (0, 1 << 12, 1 << 30):
        found = readers.file_inventory(spark, str(tmp_path), whole=whole).collect()
        assert {r["bytes"]: r["sha256"] for r in found} == dict(wanted.values())
    # a sparse file beyond what one value can hold
    with open(tmp_path / "huge", "wb") as file:
        file.truncate((2 << 30) + 5)
    huge = readers.file_inventory(spark, str(tmp_path)).where("file_name = 'huge'").first()
    digest = hashlib.sha256()
    for _ in range(256):
        digest.update(bytes(8 << 20))
    digest.update(bytes(5))
    assert (huge["bytes"], huge["sha256"]) == ((2 << 30) + 5, digest.hexdigest())
    assert readers.open_file(str(tmp_path / "small")).read() == readers.open_file(f"file://{tmp_path}/small").read()


def test_jdbc_sends_only_reads(spark):
    with pytest.raises(ValueError, match="only read"):
        readers.read_catalogue_jdbc(spark, "jdbc:none:none", "WITH x AS (SELECT 1 AS n) DELETE FROM x", "n int")


def test_jdbc_takes_one_select_only():
    options = readers.jdbc_options("jdbc:x:y", " SELECT 1; ", {"user": "u"})
    assert options == {"url": "jdbc:x:y", "query": "SELECT 1", "user": "u"}
    ranged = readers.jdbc_options("jdbc:x:y", "SELECT id FROM t", partition=("id", 0, 900, 9))
    assert ranged == {"url": "jdbc:x:y", "dbtable": "(SELECT id FROM t) catalogue_rows", "partitionColumn": "id",
                      "lowerBound": "0", "upperBound": "900", "numPartitions": "9"}
    for query in ("DELETE FROM t", "SELECT 1; DROP TABLE t", ""):
        with pytest.raises(ValueError):
            readers.jdbc_options("jdbc:x:y", query)


def test_catalogue(spark):
    df = spark.sql("SELECT 1 AS id, CAST(1 AS DECIMAL(8,3)) AS d, named_struct('x', 1, 'y', named_struct('z', 'q')) AS s")
    df = df.withMetadata("id", {"comment": "the key"})
    ws = Workspace(spark, {"t": df}, schema_name="m")
    rows = {r["column_name"]: r for r in workspace.catalogue_columns(ws, nested=True).collect()}
    assert list(rows) == ["id", "d", "s", "s.x", "s.y", "s.y.z"]
    assert rows["id"]["description"] == "the key" and (rows["d"]["precision"], rows["d"]["scale"]) == (8, 3)
    assert [r["column_id"] for r in rows.values()] == [1, 2, 3, 4, 5, 6]
    assert workspace.catalogue_tables(ws).first()["object_name"] == "t"
    assert {r["schema_name"]: r["is_system"] for r in workspace.catalogue_schemas(spark).collect()}["default"] is False


def test_constraints_under_one_schema(frame):
    checks = frame("schema_name string, object_name string, constraint_name string, definition string, is_disabled int", ("d", "T", "ck", "x > 0", 1))
    keys = frame("schema_name string, object_name string, constraint_name string", ("d", "T", "pk"))
    rows = workspace.constraint_catalogue(checks, checks.limit(0), keys).collect()
    assert [(r["constraint_type"], r["is_disabled"]) for r in rows] == [("CHECK", True), ("KEY", None)]
    primary, foreign = workspace.declared_keys(keys, keys)
    assert "key_ordinal" in primary.columns and foreign.first()["source_object"] is None
    assert workspace.unique_index_columns(keys).first()["is_unique"] is None


def test_files_and_sizes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    size = workspace.table_sizes({"t": df}).first()
    assert (size["file_count"], size["row_count"]) == (3, 100) and size["total_bytes"] > 0
    parts = workspace.partition_row_counts(df, "t").collect()
    assert sum(r["row_count"] for r in parts) == 100 and {r["compression"] for r in parts} == {"snappy"}
    before = readers.file_inventory(spark, path)
    assert {len(r["sha256"]) for r in before.collect()} == {64}


def test_secrets_in_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("fine\nwith two lines")
    (tmp_path / "b.txt").write_text("x\npassword = hunter2\n")
    from lakescribe.operators.masking import secret_scan
    found = secret_scan(readers.read_text_files(spark, str(tmp_path / "*.txt")), "text").collect()
    assert [r["file_path"].endswith("b.txt") for r in found] == [True]


def test_export(spark, tmp_path):
    from lakescribe.operators.compare import CompareSpec, compare
    a = spark.createDataFrame([("k", 'say "hi"')], "k string, v string")
    readers.export_comparison(compare([a, a], ["k"], ["v"]), CompareSpec(("k",), ("v",)), str(tmp_path / "x"))
    row = readers.read_snapshot(spark, str(tmp_path / "x" / "csv"))[0].first()
    assert json.loads(row["runs"]) == {"v_a": 'say "hi"', "v_b": 'say "hi"'}
    assert spark.read.json(str(tmp_path / "x" / "json")).first()["status"] == "UNCHANGED"


def test_browse(spark):
    df = spark.createDataFrame([(i, f"Name {i % 3}", None) for i in range(30)], "id int, name string, gap string")
    page = browse.browse_rows(df, "NAME 1", sort="name", page=2, per_page=4, tiebreak=("id",)).collect()
    assert [r["id"] for r in page] == [13, 16, 19, 22]
    assert browse.browse_total(df, "name 1").first()["total"] == 10
    assert browse.page_of(0, 1000) == (0, 1000)
    lines = spark.createDataFrame([(1, "one\r\nTwo\n\nfour two\n")], "id int, t string")
    assert [tuple(r) for r in browse.search_lines(lines, "id", "t", "TWO").collect()] == [(1, 2, "Two"), (1, 4, "four two")]
    assert browse.text_lines(lines, "id", "t").count() == 4


def test_shared_folder_is_read_from_the_session(spark, shared_dir):
    assert shared.shared_folder(spark) == str(shared_dir)
    kept = shared.materialize(spark.range(5), "five")
    assert kept.count() == 5 and [p for p in shared_dir.iterdir() if p.name.startswith("five-")]


def test_a_scope_deletes_what_was_written_in_it(spark, shared_dir):
    before = set(shared_dir.iterdir())
    with shared.run_scope(spark, "outer") as outer:
        kept = shared.materialize(spark.range(5), "a")
        with pytest.raises(RuntimeError), shared.run_scope(spark, "inner"):
            shared.materialize(spark.range(3), "b")
            raise RuntimeError
        assert kept.count() == 5 and outer.startswith(str(shared_dir))
        total = shared.materialize(spark.range(4), "c").count()
    assert total == 4 and set(shared_dir.iterdir()) == before


def test_shuffle_files_of_a_written_table_are_deleted(spark):
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum("shuffle_" in f.getName() for f in sc_list(disk.getAllFiles()))
    sc_list = lambda found: [found.apply(i) for i in range(found.size())]
    spark._jvm.System.gc()
    setting = spark.conf.get(shared.CLEANUP, None)
    before = files()
    keys = spark.range(20_000).select((F.col("id") % 777).alias("k"))
    kept = shared.materialize(keys.groupBy("k").count().join(keys, "k"), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and kept.count() == 20_000 and spark.conf.get(shared.CLEANUP, None) == setting


def test_discovery(spark):
    people = spark.createDataFrame([(i, f"p{i}@example.test", i % 2) for i in range(20)], "person_id int, contact string, kind int")
    visits = spark.createDataFrame([(i, (i % 25) if i % 7 else None) for i in range(100)], "visit_id int, person_id int")
    ws = Workspace(spark, {"people": people, "visits": visits}, name="Clinic", schema_name="m")
    found = discover(ws, "salt", Policy())
    profiles = {(r["table_name"], r["column_name"]): r for r in found["column_profiles"].collect()}
    assert profiles["people", "contact"]["minimum_value"].startswith("[MASKED:")
    assert profiles["people", "kind"]["distinct_count"] == 2
    assert "example.test" not in str({k: v.collect() for k, v in found.items()})
    orphans = found["orphan_analysis"].where("source_table = 'visits'").first()
    assert (orphans["target_table"], orphans["null_source_values"]) == ("people", 15) and orphans["orphan_rows"] > 0
    assert found["risks"].where("category = 'Relationships'").count() == 2
    limited = discover(ws, "salt", Policy(), skip=["visits"])
    status = {r["table_name"]: r["profile_status"] for r in limited["column_profiles"].collect()}
    assert status == {"people": "PROFILED", "visits": "SKIPPED_FOR_SAFETY_LARGE_TABLE"}
    drawn = samples(ws, "salt", Policy(sample_rows=3), {"people": ["person_id"]})
    assert drawn["people"].count() == 3 and drawn["people"].first()["contact"].startswith("[MASKED:")


def test_discovery_of_programs_and_gates(spark):
    people = spark.createDataFrame([(i, f"p{i}@example.test", i % 2) for i in range(20)], "person_id int, contact string, kind int")
    visits = spark.createDataFrame([(i, (i % 25) if i % 7 else None) for i in range(100)], "visit_id int, person_id int")
    ws = Workspace(spark, {"people": people, "visits": visits}, name="Clinic", schema_name="m")
    texts = [
        ("m", "busy", "VIEW", "SELECT SUM(p.kind) AS n FROM m.people AS p JOIN m.visits v ON v.person_id = p.person_id"),
        ("m", "load", "PROCEDURE", "INSERT INTO m.visits SELECT 1 FROM Other.m.source; EXEC m.next"),
        ("m", "opaque", "PROCEDURE", "EXEC (@q)"), ("m", "away", "VIEW", "SELECT 1 FROM srv.Other.m.t"), ("m", "lost", "VIEW", None),
    ]
    steps = [("Nightly", 1, "copy", "TSQL", "INSERT INTO m.visits SELECT * FROM m.people", "Clinic", "Daily")]
    logic = Logic(spark.createDataFrame(texts, STATEMENT_SCHEMA), None, None, spark.createDataFrame(steps, JOB_STEP_SCHEMA))
    keys = spark.createDataFrame([("m", "people", "pk", 1, "person_id", False)], workspace.PRIMARY_KEY_SCHEMA)
    found = discover(ws, "salt", Policy(sample_rows=5, profile_row_limit=50, sample_large_tables=False), primary_keys=keys, logic=logic)
    rows = {name: df.collect() for name, df in found.items()}
    by = lambda name, key, value: {r[key]: r[value] for r in rows[name]}
    assert {(r["source_object"], r["target_column"], r["lineage_type"]) for r in rows["column_references"]} >= {("busy", "kind", "AGGREGATED")}
    assert {(r["source_object"], r["operation"], r["target_object"]) for r in rows["object_references"]} >= {
        ("busy", "READ", "people"), ("load", "WRITE", "visits"), ("load", "CALL", "next")}
    flows = by("flows", "origin", "classification")
    assert flows["m.load"] == "LIKELY_PIPELINE" and any("Nightly" in str(r) for r in rows["flows"])
    assert {r["source_object"] for r in rows["external_references"]} == {"load", "away"}
    eligible = by("view_eligibility", "object_name", "status")
    assert set(eligible) == {"busy", "away", "lost"} and eligible["away"].startswith("SKIPPED") and eligible["lost"].startswith("SKIPPED")
    # a table over the limit is neither profiled nor joined nor sampled
    assert by("column_profiles", "table_name", "profile_status") == {"people": "PROFILED", "visits": "SKIPPED_FOR_SAFETY_LARGE_TABLE"}
    assert {r["analysis_status"] for r in rows["orphan_analysis"]} <= {"SKIPPED_FOR_SAFETY_OR_ACCESS"}
    assert by("sample_plan", "object_name", "status") == {"people": "READY", "visits": "SKIPPED_LARGE_TABLE_SAMPLING_DISABLED"}
    assert by("sample_plan", "object_name", "ordering_strategy")["people"] == "PRIMARY_KEY"
    assert [r["person_id"] for r in rows["sample of people"]] == list("01234") and "sample of visits" not in rows
    assert [(r["table_name"], r["returned_rows"]) for r in rows["sample_index"]] == [("people", 5)]
    kinds = {(r["category"], r["object_context"]) for r in rows["risks"]}
    assert {("Dynamic SQL", "m.opaque"), ("Static Analysis", "m.lost"), ("External Dependency", "m.away"), ("Coverage", "visits.visit_id"),
            ("Structure", "m.visits")} <= kinds
    assert by("quality_summary", "metric", "value")["dynamic_sql_objects"] == 1
    coverage = by("coverage_summary", "metric", "value")
    assert (coverage["tables_profiled"], coverage["programmable_objects"], coverage["samples_attempted"]) == (1, 5, 1)
    assert coverage["lineage_edges"] == len(rows["lineage"]) == by("database_summary", "metric", "value")["lineage"] > 5
    assert "example.test" not in str(rows)
    nothing = discover(ws, "salt", Policy(sample_tables=False), skip=["people", "visits"])
    assert nothing["low_cardinality_values"].count() == 0 and nothing["sample_index"].count() == 0
    assert {r["profile_status"] for r in nothing["column_profiles"].collect()} == {"SKIPPED_FOR_SAFETY_LARGE_TABLE"}


def test_streamed_files_share_tasks(spark, tmp_path):
    """More large files than shuffle partitions make no more tasks than those; the session's settings stay as they were."""
    for i in range(9):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"f{i}").write_bytes(bytes([i]) * (20 + i))
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tasks = spark.conf.get(setting), int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = readers.file_inventory(spark, str(tmp_path), whole=10)
    scan = readers.file_inventory(spark, str(tmp_path), whole=1 << 20).rdd.getNumPartitions()
    assert found.rdd.getNumPartitions() <= tasks + scan < 9 + scan and spark.conf.get(setting) == before
    assert {(r.file_name, r.bytes, r.sha256) for r in found.collect()} == {
        (f"f{i}", 20 + i, hashlib.sha256(bytes([i]) * (20 + i)).hexdigest()) for i in range(9)}
