import itertools
import random

import pytest
from pyspark.sql import functions as F

from lakescribe.operators import quality, relations, structure

COLUMNS = "schema_name string, object_name string, column_name string, data_type string"
TARGETS = "schema_name string, object_name string, column_name string, unique_evidence string"


def brute_force(columns, targets):
    """The scores of every pair, straight from their definition."""
    import re
    norm = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    types = {(s, o, c): t.lower() for s, o, c, t in columns}
    out = set()
    for s, o, c, t in columns:
        if not re.search("(^id$|id$|_id$|code$|no$)", c, re.I):
            continue
        scored = []
        for ts, to, tc, evidence in targets:
            if (ts, to) == (s, o) or types.get((ts, to, tc)) != t.lower():
                continue
            name, table = norm(c), norm(to)
            score = 2 + 4 * (name == norm(tc))
            if name in (table + "id", table.rstrip("s") + "id"):
                score += 5
            elif table and table in name:
                score += 3
            if score >= 6:
                scored.append((-score, evidence, ts, to, tc))
        out |= {(s, o, c, x[2], x[3], x[4], -x[0]) for x in sorted(scored)[:3]}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_inference_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    tables = ["Members", "Group", "Address", "Due_s", "member"]
    names = ["id", "ID", "MemberId", "member_id", "GroupId", "Group_No", "code", "name", "AddressID", "DueId"]
    columns = sorted({(rng.choice("ab"), rng.choice(tables), rng.choice(names), rng.choice(["int", "INT", "bigint"])) for _ in range(90)})
    columns = list({c[:3]: c for c in columns}.values())
    targets = [(s, o, c, rng.choice(["PRIMARY_KEY", "UNIQUE_INDEX"])) for s, o, c, _ in columns if rng.random() < 0.7]
    found = relations.infer_relationships(spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(targets, TARGETS))
    fields = ("source_schema", "source_object", "source_column", "target_schema", "target_object", "target_column", "inference_score")
    assert {tuple(r) for r in found.select(*fields).collect()} == brute_force(columns, targets)


def test_many_targets_of_the_own_table(spark):
    """A table that fills the first ranks itself still gets three others."""
    own = [("d", "Key", n, "int") for n in ("KeyId", "keyid", "KEY_ID", "Key_id", "kEYiD")]
    others = [("d", f"T{i}", "KeyId", "int") for i in range(5)]
    columns = spark.createDataFrame(own + others, COLUMNS)
    targets = spark.createDataFrame([(s, o, c, "PRIMARY_KEY") for s, o, c, _ in own + others], TARGETS)
    found = relations.infer_relationships(columns, targets)
    assert found.where("source_object = 'Key' AND source_column = 'KeyId'").count() == 3
    assert brute_force(own + others, [(s, o, c, "PRIMARY_KEY") for s, o, c, _ in own + others]) == {
        tuple(r) for r in found.select("source_schema", "source_object", "source_column", "target_schema", "target_object", "target_column", "inference_score").collect()}


def test_key_counted_once(frame):
    keys = frame("schema_name string, object_name string, constraint_name string, key_ordinal int, column_name string",
                 ("d", "A", "pk", 1, "id"), ("d", "B", "pk", 1, "x"), ("d", "B", "pk", 2, "y"))
    indexes = frame("schema_name string, object_name string, index_name string, key_ordinal int, column_name string, is_unique boolean",
                    ("d", "A", "pk", 1, "id", True), ("d", "A", "ux", 1, "code", True), ("d", "A", "ix", 1, "n", False))
    rows = relations.declared_unique_targets(keys, indexes).collect()
    assert {(r["column_name"], r["unique_evidence"]) for r in rows} == {("id", "PRIMARY_KEY"), ("code", "UNIQUE_INDEX")}


def test_validation_with_a_hot_key(spark):
    source = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).when(F.col("id") < 1100, F.lit(None)).otherwise(F.col("id")).alias("k"))
    target = spark.range(2000).select(F.col("id").alias("k"))
    row = relations.validate_relationship(source, "k", target, "k").first()
    assert tuple(row) == (3000, 100, 1901, 1000)
    assert relations.orphan_rows(source, "k", target, "k").count() == 1000


def test_fanout(spark):
    source = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    target = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert tuple(relations.validate_relationship(source, "k", target, "k").first()) == (4, 1, 2, 1)
    assert tuple(relations.validate_relationship(source, "k", target, "k", strict_fanout=True).first()) == (6, 1, 2, 1)


def test_unscanned_relationships_say_why(spark):
    tables = {"a": spark.range(5), "b": spark.range(3)}
    base = {"source_table": "a", "source_column": "id", "target_table": "b", "target_column": "id",
            "classification": "DECLARED_FK", "confidence": "HIGH", "evidence": "x", "evidence_class": "FACT"}
    found = relations.validate_relationships(
        tables, [base, {**base, "composite": True}, {**base, "target_table": "zz"}], {"a": 5, "b": 3}, 10)
    status = [r["validation_status"] for r in found.collect()]
    assert status == ["DATA_VALIDATED", "COMPOSITE_RELATIONSHIP_NOT_SCANNED_PER_COLUMN", "SKIPPED_FOR_SAFETY_OR_ACCESS"]
    kinds = relations.relationship_cardinality(found).collect()
    assert [(r["likely_cardinality"], r["optionality"]) for r in kinds] == [
        ("1:1", "REQUIRED_IN_CURRENT_DATA"), ("UNKNOWN", "UNKNOWN"), ("N:1", "UNKNOWN")]
    assert kinds[0]["classification"] == "DECLARED_FK"
    orphans = relations.orphan_analysis(found).collect()
    assert orphans[0]["orphan_percent"] == 40.0 and orphans[1]["orphan_percent"] is None
    over = relations.validate_relationships(tables, [base], {"a": 50, "b": None}, 10).first()
    assert over["validation_status"] == "SKIPPED_FOR_SAFETY_OR_ACCESS"


def test_relationships_together_equal_one_by_one(spark):
    import random

    rng = random.Random(4)
    schema = "k int, `odd name` bigint, t string, d double, at timestamp, empty string"
    make = lambda n, top: spark.createDataFrame(
        [(*[rng.choice([None, rng.randrange(top)]) for _ in range(2)], rng.choice([None, "", str(rng.randrange(top))]), float(rng.randrange(top)), None, None)
         for _ in range(n)], schema)
    tables = {"a": make(60, 9), "b": make(30, 12), "none": make(5, 3).limit(0), "hot": make(40, 1)}
    columns = ("k", "odd name", "t", "d", "at", "empty")
    listed = [
        {"source_table": s, "source_column": c, "target_table": t, "target_column": e, "classification": "SCHEMA_INFERRED"}
        for s in tables for t in tables for c in columns for e in columns if (c, e) in (
            ("k", "k"), ("k", "odd name"), ("odd name", "k"), ("t", "t"), ("t", "empty"), ("empty", "t"), ("k", "d"), ("d", "d"), ("at", "at"))]
    found = relations.validate_relationships(tables, listed).collect()
    assert len(found) == len(listed)
    for relation, row in zip(listed, found):
        one = relations.validate_relationship(tables[relation["source_table"]], relation["source_column"], tables[relation["target_table"]], relation["target_column"])
        assert tuple(row[c] for c in relations.COUNTS) == tuple(one.first()), relation
    size = lambda n: len(relations.validate_relationships(tables, [r for r in listed if r["source_column"] == "k" and r["target_column"] == "k"] * n)
                         ._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(5) == size(1)


@pytest.mark.parametrize("rows, unique", [
    ([1, 2, 3], True), ([1, 1, 5], False), ([1, None, 3], False), ([3, 3, 3, 4], False), ([], True),
])
def test_measured_uniqueness(spark, rows, unique):
    df = spark.createDataFrame([(r,) for r in rows], "k int")
    assert relations.measure_unique(df, "t").first()["candidate_unique"] is unique


def test_role_of_unknown_size(frame):
    tables = frame("schema_name string, object_name string", ("d", "Plain"), ("d", "Orders"), ("d", "OldLog"))
    shape = frame("schema_name string, object_name string, row_count bigint, column_count int",
                  ("d", "Plain", None, 3), ("d", "Orders", 5000, 30), ("d", "OldLog", 1, 1))
    metrics = frame("schema_name string, object_name string, foreign_key_outbound_count int, foreign_key_inbound_count int",
                    ("d", "Plain", 0, 2))
    roles = lambda strict: {r["object_name"]: r["inferred_category"] for r in structure.table_roles(tables, shape, metrics, strict).collect()}
    assert roles(False) == {"Plain": "MASTER", "Orders": "TRANSACTION", "OldLog": "AUDIT"}
    assert roles(True)["Plain"] == "LOOKUP"


@pytest.mark.parametrize("seed, threshold", itertools.product(range(3), (0.5, 0.8, 1.0)))
def test_similarity_equals_brute_force(spark, seed, threshold):
    rng = random.Random(seed)
    vocabulary = [f"Col{i}" for i in range(7)]
    sets = {f"t{i:02d}": frozenset(rng.sample(vocabulary, rng.randint(1, 6))) for i in range(40)}
    sets |= {f"u{i:02d}": sets["t00"] for i in range(20)}  # a third of all tables are copies
    rows = [("d", t, c if i % 2 else c.upper()) for i, (t, cs) in enumerate(sets.items()) for c in cs]
    columns = spark.createDataFrame(rows, "schema_name string, object_name string, column_name string")
    found = structure.table_similarity(columns, threshold).collect()
    heads = {r["object_name"]: r["group_object"] for r in structure.shape_groups(columns).collect()}
    linked = {frozenset((r["left_object"], r["right_object"])) for r in found}
    for a, b in itertools.combinations(sorted(sets), 2):
        similar = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
        same = heads[a] == heads[b]
        assert similar == (same or frozenset((heads[a], heads[b])) in linked), (a, b)
    members = [r for r in found if r["similarity"] == 1.0]
    assert len(members) == len(sets) - len(set(heads.values()))


def test_risks(frame, spark):
    nothing = spark.createDataFrame([], "source_schema string, source_object string, constraint_name string, is_disabled boolean, is_not_trusted boolean")
    found = quality.risk_register("Db", foreign_keys=nothing).collect()
    assert [(r["severity"], r["object_context"]) for r in found] == [("High", "Db")]
    some = frame("source_schema string, source_object string, constraint_name string, is_disabled boolean, is_not_trusted boolean",
                 ("d", "A", "fk", True, False), ("d", "A", "fk2", False, True), ("d", "A", "fk3", False, False))
    found = quality.risk_register("Db", foreign_keys=some).collect()
    assert [(r["severity"], r["category"]) for r in found] == [("High", "Constraint"), ("Medium", "Constraint")]
    with pytest.raises(ValueError):
        quality.risk_register("Db")


def test_bridges(frame):
    keys = frame("source_schema string, source_object string, target_schema string, target_object string",
                 *[("d", "Link", "d", t) for t in ("B", "A", "B")], ("d", "Leaf", "d", "A"))
    row = relations.bridge_candidates(keys).collect()
    assert [(r["source_object"], r["target_objects"]) for r in row] == [("Link", "d.A, d.B")]


def test_a_name_of_most_columns_is_not_gathered(spark):
    """Sources pick their targets in their own rows: no sort by name and no window over them; a column listed twice shares its three."""
    listed = [("d", f"T{i}", "id", "int") for i in range(60)] + [("d", "T7", "id", "int"), ("d", "T8", "id", "bigint")]
    columns = spark.createDataFrame(listed, COLUMNS)
    targets = spark.createDataFrame([("d", f"T{i}", "id", "PRIMARY_KEY") for i in (0, 1, 2, 3)], TARGETS)
    found = relations.infer_relationships(columns, targets)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    to = lambda name: sorted(r.target_object for r in found.where(f"source_object = '{name}'").collect())
    assert to("T0") == ["T1", "T2", "T3"] and to("T9") == to("T8") == ["T0", "T1", "T2"] and to("T7") == ["T0", "T0", "T1"]
    assert found.count() == 180


@pytest.mark.parametrize("threshold", (0.0, 0.3, 0.5, 0.75, 0.8, 1.0))
def test_similarity_where_all_names_are_common(spark, threshold, monkeypatch):
    """Sets meet by several names at once; every pair is found once, whatever the widths and the size of a key."""
    monkeypatch.setattr(structure, "SETS_PER_BUCKET", 3)
    rng = random.Random(5)
    sets = {f"t{i:02d}": frozenset(rng.sample(range(14), rng.choice((1, 2, 3, 5, 7, 11, 12, 13)))) for i in range(70)}
    sets |= {"u": frozenset(range(40)), "v": frozenset(range(36)), "w": frozenset(range(3, 40))}
    rows = [("d", t, f"c{c}") for t, cs in sets.items() for c in cs]
    columns = spark.createDataFrame(rows, "schema_name string, object_name string, column_name string")
    heads = {r["object_name"]: r["group_object"] for r in structure.shape_groups(columns).collect()}
    firsts = sorted(set(heads.values()))
    listed = [
        (a, b, shared) for a, b in itertools.combinations(firsts, 2)
        if (shared := len(sets[a] & sets[b])) and shared / len(sets[a] | sets[b]) >= threshold]
    found = [(r["left_object"], r["right_object"], r["shared_names"]) for r in structure.table_similarity(columns, threshold).collect()
             if heads[r["right_object"]] != r["left_object"]]
    assert sorted(found) == listed


def test_narrow_sets_meet_by_all_names_they_share(spark, monkeypatch):
    """Sets of six out of twelve common names: a key holds the five that two of them must share, so hardly any have it."""
    monkeypatch.setattr(structure, "SETS_PER_BUCKET", 100)
    names = [f"c{i:02d}" for i in range(12)]
    rows = [("d", f"t{i}", w, 1, list(c), [462] * w) for i, (w, c) in enumerate(
        (w, c) for w in (6, 7) for c in itertools.combinations(names, w))]
    sets = spark.createDataFrame(rows, "schema_name string, object_name string, width long, bits long, names array<string>, spreads array<long>")
    keys = structure._keys(sets, 0.7).groupBy("narrow", "wide", "key").count().collect()
    assert keys and max(k["count"] for k in keys) <= 12
