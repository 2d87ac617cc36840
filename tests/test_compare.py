import random

import pytest
from pyspark.sql import functions as F

from lakescribe.functions import line_diff
from lakescribe.operators import compare as C
from lakescribe.plans.snapshots import compare_catalogues, compare_snapshots


def run(spark, names, *rows):
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(list(rows), schema)


def statuses(df, key="name"):
    return {r[key]: r["status"] for r in df.collect()}


def test_two_runs(spark):
    names = ("schema", "name", "type")
    a = run(spark, names, ("dbo", "same", "int"), ("dbo", "changed", "int"), ("dbo", "gone", "int"))
    b = run(spark, names, ("dbo", "same", "int"), ("dbo", "changed", "bigint"), ("dbo", "only_b", None))
    found = C.compare([a, b], ["schema", "name"], ["type"])
    assert statuses(found) == {"same": "UNCHANGED", "changed": "CHANGED", "gone": "REMOVED", "only_b": "ADDED"}


def test_three_runs(spark):
    names = ("name", "count", "hash", "definition")
    a = run(spark, names, ("proc", "1,000", "a", "SELECT 1"))
    b = run(spark, names, ("proc", "1,200", "b", "SELECT 2"), ("new", "5", "x", "SELECT 3"))
    c = run(spark, names, ("proc", "1,000", "a", "SELECT 1"), ("new", "5", "x", "SELECT 3"))
    found = C.definition_diffs(C.compare([a, b, c], ["name"], ["count", "hash"], ["count"], "definition"), "definition")
    rows = {r["name"]: r for r in found.collect()}
    assert rows["new"]["status"] == "ADDED_IN_B" and rows["proc"]["status"] == "REVERTED_TO_A"
    proc = rows["proc"]
    assert (proc["count_number_a"], proc["count_b_minus_a"], proc["count_c_minus_b"], proc["count_c_minus_a_percent"]) == (1000.0, 200.0, -200.0, 0.0)
    assert proc["count_b_minus_a_percent"] == 20.0 and rows["new"]["count_b_minus_a"] is None
    assert "-SELECT 1" in proc["diff_a_to_b"] and proc["diff_a_to_c"] is None
    assert proc["diff_a_to_b"].startswith("--- A\n+++ B")


def edited(rng, lines, letters):
    out = list(lines)
    for _ in range(rng.randrange(6)):
        i = rng.randrange(len(out) + 1)
        out[i: i + rng.randrange(3)] = [rng.choice(letters) for _ in range(rng.randrange(3))]
    return out


def test_diffs_lead_from_one_text_to_the_other():
    rng = random.Random(8)
    more = least = 0
    for _ in range(3000):
        letters = rng.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz+- @"])
        old = [rng.choice(letters) for _ in range(rng.randrange(25))]
        new = edited(rng, old, letters) if rng.random() < 0.8 else [rng.choice(letters) for _ in range(rng.randrange(25))]
        diff = line_diff.unified_diff(old, new, "A", "B")
        assert (line_diff.apply_diff(old, diff) if diff else old) == new and bool(diff) == (old != new)
        kept = [0] * (len(new) + 1)  # longest common subsequence, row by row
        for x in old:
            row = [0]
            for j, y in enumerate(new):
                row.append(kept[j] + 1 if x == y else max(row[j], kept[j + 1]))
            kept = row
        least += len(old) + len(new) - 2 * kept[-1]
        more += sum(line[0] in "+-" for line in diff[2:])
    assert least <= more <= 1.15 * least


def test_diffs_are_written_in_hunks():
    old = [str(i) for i in range(1, 31)]
    new = ["0", *old[:4], "x", *old[5:11], *old[12:28], "29b", "30", "31"]
    assert line_diff.unified_diff(old, new, "A", "B") == [
        "--- A", "+++ B", "@@ -1,15 +1,15 @@", "+0", " 1", " 2", " 3", " 4", "-5", "+x", " 6", " 7", " 8", " 9", " 10", " 11", "-12", " 13", " 14", " 15",
        "@@ -26,5 +26,6 @@", " 26", " 27", " 28", "-29", "+29b", " 30", "+31"]
    assert line_diff.unified_diff([], ["a"], "A", "B") == ["--- A", "+++ B", "@@ -0,0 +1 @@", "+a"]
    assert line_diff.unified_diff(["a"], [], "A", "B") == ["--- A", "+++ B", "@@ -1 +0,0 @@", "-a"]
    # moved blocks, long repetitions: fast, and right
    for a, b in ((old[:15] + old[15:], old[15:] + old[:15]), (["x"] * 9000, ["x"] * 4000 + ["y"] + ["x"] * 4990), ([str(i % 7) for i in range(9000)], [str(i % 5) for i in range(9000)])):
        assert line_diff.apply_diff(a, line_diff.unified_diff(a, b, "A", "B")) == b


@pytest.mark.parametrize("diff", ["no hunk", "@@ -1 +1 @@\n-b\n+c", "@@ -1,2 +1 @@\n-a", "@@ -1 +1 @@\n-a\n+c\n+d", "@@ -3 +1 @@\n-a"])
def test_diffs_that_do_not_fit(diff, spark):
    with pytest.raises(ValueError):
        line_diff.apply_diff(["a"], ["--- A", "+++ B", *diff.split("\n")])
    texts = run(spark, ("t", "d"), ("a", "--- A\n+++ B\n" + diff), ("a\r\nb", None), (None, ""))
    assert [r[0] for r in texts.select(C.patched(F.col("t"), F.col("d"))).collect()] == [None, "a\nb", ""]


def test_only_changes(spark):
    rng = random.Random(2)
    rows = [(f"K{rng.randrange(60)}", rng.choice([None, "1", "2"]), i) for i in range(150)]
    runs = [spark.createDataFrame(x, "k string, v string, n int") for x in (rows, rows[:140][::-1], rows[:100] + rows[100:] + [("É1", "x", 1)])]
    for number in (2, 3):
        for order in (None, "n"):
            whole = C.compare(runs[:number], ["k"], ["v"], sequence=order)
            few = C.compare(runs[:number], ["k"], ["v"], sequence=order, only_changes=True)
            assert few.columns == whole.columns
            assert sorted(map(str, few.collect())) == sorted(map(str, whole.where("status <> 'UNCHANGED'").collect()))
    # the same rows in another order differ in no bucket; pairs of equal rows do not cancel out
    keys = C._in_buckets(C._tagged(runs[0], "a", C.CompareSpec(("k",), ("v",)), None, ["v"]), ["k"])
    again = keys.withColumn("__run", F.lit("b"))
    assert C.changed_buckets(keys.unionAll(again.orderBy(F.desc("k"))), 2).count() == 0
    assert C.changed_buckets(keys.unionAll(again).unionAll(again), 2).count() == C.changed_buckets(keys, 2).count() > 0
    pair = lambda k: run(spark, ("k", "v"), (k, "1"), (k, "1"))
    assert statuses(C.compare([pair("x"), pair("y")], ["k"], ["v"], only_changes=True), "k") == {"x": "REMOVED", "y": "ADDED"}
    assert C.compare([runs[0], runs[0]], ["k"], ["v"], only_changes=True).count() == 0
    plan = C.changed_buckets(keys.unionAll(again), 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort " not in plan
    unavailable = C.compare(runs[:2], ["k"], ["v"], availability=(True, False), only_changes=True)
    assert {r["status"] for r in unavailable.collect()} == {"NOT_COMPARABLE"}


def test_all_timelines(spark):
    names = ("name", "v")
    a = run(spark, names, ("remove_b", "1"), ("remove_c", "1"), ("both", "1"), ("revert", "1"), ("same", None))
    b = run(spark, names, ("remove_c", "1"), ("both", "2"), ("revert", "2"), ("same", ""))
    c = run(spark, names, ("add_c", "1"), ("both", "3"), ("revert", "1"), ("same", None))
    assert statuses(C.compare([a, b, c], ["name"], ["v"])) == {
        "add_c": "ADDED_IN_C", "remove_b": "REMOVED_IN_B", "remove_c": "REMOVED_IN_C", "both": "CHANGED_BOTH",
        "revert": "REVERTED_TO_A", "same": "UNCHANGED"}


@pytest.mark.parametrize("left, right", [(" DBO ", "dbo"), ("ＤＢＯ", "dbo"), ("Straße", "STRASSE"), ("ﬁle", "FILE"), ("É", "é"),
                                         ("x\x1f", "x"), ("\x1c\x1d\x1e x", "X\x85"), ("é\x1f", "\x0bÉ")])
def test_keys_are_normalized(spark, left, right):
    found = C.compare([run(spark, ("k", "v"), (left, "1")), run(spark, ("k", "v"), (right, "1"))], ["k"], ["v"]).collect()
    assert [r["status"] for r in found] == ["UNCHANGED"]


def test_unavailable_is_not_removed(spark):
    a, b = run(spark, ("name", "v"), ("T", "1")), run(spark, ("name", "v"))
    assert C.compare([a, b], ["name"], ["v"], availability=(True, False)).first()["status"] == "NOT_COMPARABLE"
    assert C.compare([a, b], ["name"], ["v"], availability=(False, False)).first()["status"] == "NOT_AVAILABLE"
    assert [C.availability_status(x) for x in ((True, True), (True, False), (False, False))] == ["AVAILABLE", "NOT_COMPARABLE", "NOT_AVAILABLE"]
    with pytest.raises(ValueError):
        C.compare([a], ["name"], ["v"])


def test_last_row_of_a_repeated_key_counts(spark):
    a = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("n"), (F.col("id") % 3).alias("v"))
    b = spark.createDataFrame([("K", 0, 0)], "k string, n bigint, v bigint")
    row = C.compare([a, b], ["k"], ["v"], sequence="n").first()
    assert (row["status"], row["v_a"]) == ("UNCHANGED", "0")


def test_history_filter(spark):
    names = ("name", "value")
    a = run(spark, names, ("readded", "old"), ("reverted", "old"))
    b = run(spark, names, ("added_changed", "first"), ("reverted", "new"))
    c = run(spark, names, ("added_changed", "second"), ("readded", "new"), ("reverted", "old"))
    found = C.compare([a, b, c], ["name"], ["value"])
    match = lambda **kw: {r["name"] for r in C.filter_comparison(found, C.CompareSpec(("name",), ("value",)), **kw).collect()}
    assert match(status="ADDED") == {"added_changed", "readded"} and match(status="removed") == {"readded"}
    assert match(status="CHANGED_ONLY") == {"added_changed", "readded", "reverted"}
    assert match(status="REVERTED_TO_A") == {"reverted"} and match(search="READ") == {"readded"}
    assert match() == {"added_changed", "readded", "reverted"} and match(severity="second") == {"added_changed"}
    assert match(issues_only=True) == set() and match(issues_only=True, category="risks") == match()


def test_catalogues_and_totals(spark):
    columns = ("schema_name", "object_name", "column_name", "data_type")
    a = {"columns": run(spark, columns, ("d", "T", "id", "int")), "row_counts": run(spark, ("schema_name", "object_name", "row_count"), ("d", "T", "5"))}
    b = {"columns": run(spark, columns, ("D", "t", "ID", "bigint"))}
    meta = run(spark, ("database", "mode"), ("One", "safe"), ("Two", "safe"))
    result = compare_snapshots([a, b], meta)
    rows = {(r["category"], r["status"]): r for r in result["rows"].collect()}
    assert set(rows) == {("columns", "CHANGED"), ("row_counts", "NOT_COMPARABLE"), ("data_types", "REMOVED"), ("data_types", "ADDED")}
    totals = result["summary"].collect()
    primary = [r for r in totals if r["counter"] == "PRIMARY_STATUS"]
    assert sum(r["occurrences"] for r in primary if r["scope"].startswith("GLOBAL")) == 4
    assert sum(r["occurrences"] for r in primary if r["category"] == "data_types") == 2
    assert [r["warning"][:5] for r in result["warnings"].collect()] == ["Mixed"]
    with pytest.raises(ValueError):
        compare_catalogues([{"nonsense": a["columns"]}] * 2)


def test_numbers(spark):
    from lakescribe.functions.text import stable_number
    values = {"1,234.5": 1234.5, "": None, "None": None, "NULL": None, "x": None, "1e3": 1000.0, "5d": None, " 7 ": 7.0}
    df = spark.createDataFrame([(k,) for k in values], "v string")
    assert {r["v"]: r["n"] for r in df.select("v", stable_number(F.col("v")).alias("n")).collect()} == values


def test_one_shuffle_of_rows(spark):
    a = run(spark, ("k", "v"), ("1", "x"))
    plan = C.compare([a, a, a], ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_batch_leaves_arrow_in_slices_of_bounded_bytes():
    import tracemalloc

    import pyarrow as pa

    from lakescribe.operators.compare import SLICE_BYTES, by_bytes

    assert by_bytes(lambda a, b: a and b and a + b, pa.array(["a", None, ""]), pa.array(["b", "c", "d"])).to_pylist() == ["ab", None, ""]
    assert by_bytes(lambda a: a, pa.array([], pa.string())).to_pylist() == []
    texts = pa.array(["x" * 100_000] * 300 + ["y" * (3 * SLICE_BYTES), None, "z"])
    tracemalloc.start()
    sizes = by_bytes(lambda t: str(len(t or "")), texts).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == ["100000"] * 300 + [str(3 * SLICE_BYTES), "0", "1"]
    assert peak < 5 * SLICE_BYTES  # all texts at once are 36 MB
