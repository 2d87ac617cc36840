"""Snapshot comparison, metrics, inventories and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakescribe.operators import compare as comparing, profile, statements
from lakescribe.plans.snapshots import compare_catalogues, definition_records
from lakescribe.sources import readers, workspace
from lakescribe.sources.shared import fresh_folder

from .inputs import TABLES, Registry, derived, table, with_inputs
from .profile_checks import measures_sql

registry = Registry()
FIELDS = ("o_orderstatus", "o_totalprice")
RUNS = ("snapshot_a", "snapshot_b", "snapshot_c")


def with_extra(names, extra: str, body: str) -> str:
    base = with_inputs(names, "SELECT 1")
    return base[: base.rindex("\nSELECT 1")] + extra + body


def pair_sql(left: str, right: str, fields) -> str:
    same = " AND ".join(
        f"coalesce(CAST({left}.{f} AS VARCHAR), '') = coalesce(CAST({right}.{f} AS VARCHAR), '')" for f in fields
    )
    return (
        f"CASE WHEN {left}.k IS NULL AND {right}.k IS NULL THEN 'NOT_AVAILABLE' WHEN {left}.k IS NULL THEN 'ADDED' "
        f"WHEN {right}.k IS NULL THEN 'REMOVED' WHEN {same} THEN 'UNCHANGED' ELSE 'CHANGED' END"
    )


def timeline_sql(runs, key: str, fields, extra: str = "") -> str:
    """CTEs that end in ``timeline``: one row per key with intervals, events and status."""
    sides = "".join(
        f", {label} AS (SELECT lower(trim(CAST({key} AS VARCHAR))) AS k, * FROM {run})" for label, run in zip("abc", runs)
    )
    return f"""{sides},
keys AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c),
intervals AS (SELECT keys.k, {pair_sql('a', 'b', fields)} AS ab, {pair_sql('b', 'c', fields)} AS bc, {pair_sql('a', 'c', fields)} AS ac,
  a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b, c.k IS NOT NULL AS in_c,
  {', '.join(f'CAST({l}.{f} AS VARCHAR) AS {f}_{l}' for f in fields for l in 'abc')}{extra}
  FROM keys LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)),
eventful AS (SELECT *, list_filter([CASE WHEN ab = 'ADDED' THEN 'ADDED_IN_B' END, CASE WHEN bc = 'ADDED' THEN 'ADDED_IN_C' END,
  CASE WHEN ab = 'REMOVED' THEN 'REMOVED_IN_B' END, CASE WHEN bc = 'REMOVED' THEN 'REMOVED_IN_C' END, CASE WHEN ab = 'CHANGED' THEN 'CHANGED_A_TO_B' END,
  CASE WHEN bc = 'CHANGED' THEN 'CHANGED_B_TO_C' END, CASE WHEN ab = 'CHANGED' AND bc = 'CHANGED' THEN CASE WHEN ac = 'UNCHANGED' THEN 'REVERTED_TO_A' ELSE 'CHANGED_BOTH' END END],
  lambda e: e IS NOT NULL) AS events FROM intervals),
timeline AS (SELECT *, CASE {' '.join(f"WHEN list_contains(events, '{e}') THEN '{e}'" for e in (
    'REVERTED_TO_A', 'CHANGED_BOTH', 'ADDED_IN_B', 'ADDED_IN_C', 'REMOVED_IN_B', 'REMOVED_IN_C', 'CHANGED_A_TO_B', 'CHANGED_B_TO_C'))}
  WHEN ab = 'UNCHANGED' AND bc = 'UNCHANGED' AND ac = 'UNCHANGED' THEN 'UNCHANGED' ELSE 'NOT_COMPARABLE' END AS status FROM eventful)
"""


def number_sql(field: str) -> str:
    n = {x: f"TRY_CAST({field}_{x} AS DOUBLE)" for x in "abc"}
    parts = [f"{n[x]} AS {field}_number_{x}" for x in "abc"]
    for left, right in ("ab", "bc", "ac"):
        parts.append(f"round({n[right]} - {n[left]}, 4) AS {field}_{right}_minus_{left}")
        parts.append(f"round(({n[right]} - {n[left]}) * 100.0 / nullif({n[left]}, 0), 4) AS {field}_{right}_minus_{left}_percent")
    return ", ".join(parts)


TIMELINE = timeline_sql(RUNS, "o_orderkey", FIELDS)


THREE_SPEC = comparing.CompareSpec(("o_orderkey",), tuple(FIELDS), ("o_totalprice",))


def three_runs(spark, sf) -> DataFrame:
    runs = [derived(spark, sf, name) for name in RUNS]
    return comparing.compare(runs, ["o_orderkey"], FIELDS, numeric=["o_totalprice"])


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in df.columns if "_minus_" in c})


@registry.add(
    with_extra(
        RUNS, TIMELINE,
        "SELECT k AS o_orderkey, status, ab AS a_to_b, bc AS b_to_c, ac AS a_to_c, array_to_string(events, ',') AS timeline_events, "
        f"{', '.join(f'{f}_{x}' for f in FIELDS for x in 'abc')}, {number_sql('o_totalprice')} FROM timeline",
    )
)
def compare_three_runs(spark, sf):
    found = rounded(three_runs(spark, sf)).drop("present_in")
    return found.withColumn("timeline_events", F.array_join("timeline_events", ","))


@registry.add(with_extra(RUNS, TIMELINE, "SELECT k AS o_orderkey, ab AS status FROM timeline WHERE ab <> 'NOT_AVAILABLE'"))
def compare_two_runs(spark, sf):
    runs = [derived(spark, sf, name) for name in RUNS[:2]]
    return comparing.compare(runs, ["o_orderkey"], FIELDS).select("o_orderkey", "status")


@registry.add(
    with_extra(
        RUNS, TIMELINE,
        "SELECT k AS o_orderkey, status, ab AS a_to_b, bc AS b_to_c, ac AS a_to_c, array_to_string(events, ',') AS timeline_events, "
        f"{', '.join(f'{f}_{x}' for f in FIELDS for x in 'abc')} FROM timeline WHERE status <> 'UNCHANGED'",
    )
)
def compare_only_changes(spark, sf):
    """Rows of key buckets with equal digests in all runs are not shuffled."""
    runs = [derived(spark, sf, name) for name in RUNS]
    found = comparing.compare(runs, ["o_orderkey"], FIELDS, only_changes=True).drop("present_in")
    return found.withColumn("timeline_events", F.array_join("timeline_events", ","))


@registry.add(
    "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, "
    "CASE WHEN l_orderkey % 10007 = 1 THEN 'REMOVED' ELSE 'CHANGED' END AS status FROM lineitem WHERE l_orderkey % 10007 IN (1, 2) "
    "GROUP BY l_orderkey, l_linenumber"
)
def compare_slowly_changing_runs(spark, sf):
    """Two runs of the lines of orders that differ in few orders; repeated keys have the same lines in both."""
    lines = table(spark, sf, "lineitem")
    changed = F.when(F.col("l_orderkey") % 10007 == 2, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    runs = [lines, lines.where("l_orderkey % 10007 <> 1").withColumn("l_quantity", changed)]
    found = comparing.compare(runs, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_shipdate"], only_changes=True)
    return found.select("l_orderkey", "l_linenumber", "status")


@registry.add(
    with_inputs(
        RUNS[:2],
        "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'NOT_COMPARABLE' AS status FROM (SELECT o_orderkey FROM snapshot_a UNION SELECT o_orderkey FROM snapshot_b)",
    )
)
def compare_unavailable_run(spark, sf):
    runs = [derived(spark, sf, name) for name in RUNS[:2]]
    found = comparing.compare(runs, ["o_orderkey"], FIELDS, availability=(True, False))
    return found.select("o_orderkey", "status")


@registry.add(
    "WITH a AS (SELECT lower(trim(o_orderpriority)) AS k, arg_max(o_orderstatus, o_orderkey) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), "
    "b AS (SELECT lower(trim(o_orderpriority)) AS k, arg_max(o_orderstatus, o_orderkey) AS v FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1) "
    "SELECT a.k AS o_orderpriority, CASE WHEN a.v = b.v THEN 'UNCHANGED' ELSE 'CHANGED' END AS status, a.v AS o_orderstatus_a, b.v AS o_orderstatus_b FROM a JOIN b USING (k)"
)
def compare_repeated_keys(spark, sf):
    """Few keys with thousands of rows each: the last row of each run counts."""
    orders = table(spark, sf, "orders")
    padded = orders.withColumn("o_orderpriority", F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" ")))
    found = comparing.compare(
        [padded.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 4 <> 0")],
        ["o_orderpriority"], ["o_orderstatus"], sequence="o_orderkey",
    )
    return found.select("o_orderpriority", "status", "o_orderstatus_a", "o_orderstatus_b")


@registry.add(
    with_extra(
        RUNS, TIMELINE,
        "SELECT k AS o_orderkey, status FROM timeline WHERE contains(k, '7') AND len(list_filter(list_concat([status, ab, bc, ac], events), "
        "lambda t: t = 'CHANGED' OR starts_with(t, 'CHANGED_') OR t = 'REVERTED_TO_A')) > 0",
    )
)
def filter_changed_only(spark, sf):
    found = comparing.filter_comparison(three_runs(spark, sf), THREE_SPEC, status="changed_only", search="7")
    return found.select("o_orderkey", "status")


@registry.add(
    with_extra(
        RUNS, TIMELINE,
        "SELECT k AS o_orderkey, status FROM timeline WHERE len(list_filter(list_concat([status, ab, bc, ac], events), lambda t: t = 'ADDED' OR starts_with(t, 'ADDED_IN_'))) > 0",
    )
)
def filter_added(spark, sf):
    found = comparing.filter_comparison(three_runs(spark, sf), THREE_SPEC, status="ADDED")
    return found.select("o_orderkey", "status")


@registry.add(
    with_extra(
        RUNS, TIMELINE,
        "SELECT k AS o_orderkey, array_to_string(list_filter([CASE WHEN in_a THEN 'First' END, CASE WHEN in_b THEN 'Second' END, CASE WHEN in_c THEN 'Third' END], lambda d: d IS NOT NULL), ',') AS databases "
        "FROM timeline WHERE in_b",
    )
)
def databases_per_row(spark, sf):
    named = comparing.with_databases(three_runs(spark, sf), ("First", "Second", "Third"))
    found = comparing.filter_comparison(named, THREE_SPEC, database="second")
    return found.select("o_orderkey", F.array_join("databases", ",").alias("databases"))


_COUNTERS = """
, counted AS (SELECT k, 'PRIMARY_STATUS' AS counter, status AS value FROM timeline UNION ALL SELECT k, 'INTERVAL_STATUS', ab FROM timeline
  UNION ALL SELECT k, 'INTERVAL_STATUS', bc FROM timeline UNION ALL SELECT k, 'INTERVAL_STATUS', ac FROM timeline
  UNION ALL SELECT k, 'TIMELINE_EVENT', unnest(events) FROM timeline),
placed AS (SELECT *, CASE WHEN k < '5' THEN 'low' ELSE 'high' END AS category FROM counted)
"""


@registry.add(
    with_extra(
        RUNS, TIMELINE + _COUNTERS,
        "SELECT 'CATEGORY_ALL_ROWS' AS scope, category, counter, value, count(*) AS occurrences FROM placed GROUP BY category, counter, value "
        "UNION ALL SELECT 'GLOBAL_ALL_CATEGORY_ROWS', NULL, counter, value, count(*) FROM placed GROUP BY counter, value",
    )
)
def summarize_comparison(spark, sf):
    found = three_runs(spark, sf).withColumn("category", F.when(F.col("o_orderkey") < "5", "low").otherwise("high"))
    return comparing.summarize_comparison(found)


@registry.add()
def definition_diffs(spark, sf):
    """Unified diffs of the notes as they are; the two queries below check diffs in SQL."""
    runs = [derived(spark, sf, n).withColumn("note", F.concat_ws("\n", "note", "o_orderstatus")) for n in RUNS]
    compared = comparing.compare(runs, ["o_orderkey"], FIELDS, definition="note")
    return comparing.definition_diffs(compared, "note").select(
        "o_orderkey", "status", "diff_a_to_b", "diff_b_to_c", "diff_a_to_c"
    )


def _diffed(runs: list[DataFrame], key: str) -> DataFrame:
    runs = [run.withColumn("mark", F.lit("x")) for run in runs]
    return comparing.definition_diffs(comparing.compare(runs, [key], ["mark"], definition="body"), "body")


_NUMBERED = "transform(sequence(1, lines), i -> concat('line ', i, ' of ', o_orderkey))"


@registry.add(
    """WITH texts AS (SELECT o_orderkey, 5 + o_custkey % 20 AS lines FROM orders),
places AS (SELECT *, o_orderkey % lines + 1 AS p FROM texts), ends AS (SELECT *, greatest(1, p - 3) AS lo, least(lines, p + 3) AS hi FROM places)
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, concat('--- A', chr(10), '+++ B', chr(10), '@@ -', lo, ',', hi - lo + 1, ' +', lo, ',', hi - lo + 1, ' @@', chr(10),
  array_to_string(list_transform(range(lo, p), lambda i: concat(' line ', i, ' of ', o_orderkey, chr(10))), ''), '-line ', p, ' of ', o_orderkey, chr(10), '+new ', p,
  array_to_string(list_transform(range(p + 1, hi + 1), lambda i: concat(chr(10), ' line ', i, ' of ', o_orderkey)), '')) AS diff FROM ends"""
)
def definition_diffs_of_one_line(spark, sf):
    """One line of each text is replaced: the whole diff is known."""
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(5 + o_custkey % 20 AS INT) AS lines")
    orders = orders.withColumn("old", F.expr(_NUMBERED)).withColumn("p", F.expr("o_orderkey % lines + 1"))
    new = F.expr("transform(old, (line, i) -> IF(i + 1 = p, concat('new ', p), line))")
    runs = [orders.select("o_orderkey", F.array_join(side, "\n").alias("body")) for side in (F.col("old"), new)]
    return _diffed(runs, "o_orderkey").select("o_orderkey", F.col("diff_a_to_b").alias("diff"))


@registry.add(
    r"""WITH old AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]', ' ', 'g'), ' ') AS words FROM documents),
new AS (SELECT doc_id, list_filter(list_transform(words, lambda w, i: CASE WHEN i % 11 = 0 THEN NULL WHEN i % 13 = 0 THEN concat(w, chr(10), 'added') WHEN i % 17 = 0 THEN 'changed' ELSE w END),
  lambda w: w IS NOT NULL) AS words FROM old)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, array_to_string(words, chr(10)) AS restored FROM new"""
)
def definition_diffs_applied(spark, sf):
    """Every document, a word a line, against itself with lines gone, added and changed: diffs lead from one to the other."""
    breaks = r"[\r\x0b\f\x1c-\x1e\u0085\u2028\u2029]"
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), breaks, " "), " ")
    documents = table(spark, sf, "documents").select("doc_id", words.alias("old"))
    new = F.expr(
        "filter(transform(old, (w, i) -> CASE WHEN (i + 1) % 11 = 0 THEN NULL WHEN (i + 1) % 13 = 0 THEN concat(w, '\n', 'added') "
        "WHEN (i + 1) % 17 = 0 THEN 'changed' ELSE w END), w -> w IS NOT NULL)")
    runs = [documents.select("doc_id", F.array_join(side, "\n").alias("body")) for side in (F.col("old"), new)]
    found = _diffed(runs, "doc_id")
    return found.select("doc_id", comparing.patched(F.col("body_a"), F.col("diff_a_to_b")).alias("restored"))


@registry.add(
    "WITH m AS (SELECT o_orderkey, o_custkey % 3 AS db, o_orderstatus AS mode FROM orders) "
    "SELECT 'Mixed databases: matching structural names do not prove business equivalence.' AS warning FROM m HAVING count(DISTINCT db) > 1 "
    "UNION ALL SELECT 'Discovery modes differ; unavailable evidence may not be comparable.' FROM m HAVING count(DISTINCT mode) > 1"
)
def comparison_warnings(spark, sf):
    runs = table(spark, sf, "orders").selectExpr("concat('Db', o_custkey % 3) AS database", "o_orderstatus AS mode")
    return comparing.comparison_warnings(runs)


# --- whole catalogues ---------------------------------------------------------------------------

_PROFILE_FIELDS = ("null_percent", "distinct_count", "minimum_value", "maximum_value", "profile_status")


def _profile_side(run: str) -> str:
    kinds = {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double"}
    rows = []
    for c, k in kinds.items():
        m = measures_sql("orders", c, k)
        rows.append(
            f"SELECT 'column_profiles' AS category, 'orders/{c}' AS identity, "
            + ", ".join(f"CAST({m[f]} AS VARCHAR) AS {f}" for f in _PROFILE_FIELDS) + f" FROM {run}"
        )
    rows.append(
        "SELECT 'row_counts', 'orders', CAST(count(*) AS VARCHAR), 'EXACT', NULL, NULL, NULL FROM " + run
    )
    return " UNION ALL ".join(rows)


def _catalogue(spark, sf, run: str) -> dict[str, DataFrame]:
    df = derived(spark, sf, run).drop("note")
    named = F.lit("").alias("schema_name"), F.lit("orders").alias("object_name")
    return {
        "column_profiles": profile.column_profile(df, "orders").select(*named, "*"),
        "row_counts": profile.exact_row_count(df, "orders").select(*named, "*"),
    }


@registry.add(
    with_extra(
        RUNS,
        "".join(f", {x} AS (SELECT category || '/' || identity AS k, * FROM ({_profile_side(run)}))" for x, run in zip("abc", RUNS))
        + f", keys AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c), pairs AS (SELECT k, {pair_sql('a', 'b', _PROFILE_FIELDS)} AS ab, "
        f"{pair_sql('b', 'c', _PROFILE_FIELDS)} AS bc, {pair_sql('a', 'c', _PROFILE_FIELDS)} AS ac FROM keys LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)) ",
        "SELECT split_part(k, '/', 1) AS category, substring(k, length(split_part(k, '/', 1)) + 2) AS identity, ab AS a_to_b, bc AS b_to_c, ac AS a_to_c FROM pairs",
    )
)
def compare_profile_catalogues(spark, sf):
    """Profiles and row counts of three snapshots of orders, compared by their catalogue specs."""
    found = compare_catalogues([_catalogue(spark, sf, run) for run in RUNS])
    identity = F.concat_ws("/", F.col("identity")["object_name"], F.col("identity")["column_name"])
    return found.select("category", identity.alias("identity"), "a_to_b", "b_to_c", "a_to_c")


_HASH = "sha256(lower(trim(regexp_replace(definition, '\\s+', ' ', 'g'))))"
_CHANGED = "CASE WHEN statement_id % 9 = 0 THEN definition || ' -- v2' ELSE definition END"


@registry.add(
    with_inputs(
        "statements",
        f"""WITH a AS (SELECT lower(source_type || '/' || schema_name || '/' || object_name) AS k, CASE WHEN definition IS NULL THEN '' ELSE {_HASH} END AS h FROM statements WHERE statement_id % 8 <> 0),
b AS (SELECT lower(source_type || '/' || schema_name || '/' || object_name) AS k, CASE WHEN definition IS NULL THEN '' ELSE {_HASH} END AS h FROM (SELECT * EXCLUDE (definition), {_CHANGED} AS definition FROM statements WHERE statement_id % 7 <> 0))
SELECT k AS identity, CASE WHEN a.h IS NULL THEN 'ADDED' WHEN b.h IS NULL THEN 'REMOVED' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM a FULL JOIN b USING (k)""",
    )
)
def compare_definition_hashes(spark, sf):
    every = derived(spark, sf, "statements")
    sides = (every.where("statement_id % 8 <> 0"), every.where("statement_id % 7 <> 0").withColumn("definition", F.expr(_CHANGED)))
    runs = [{"definition_hashes": definition_records(statements.definition_flags(side))} for side in sides]
    found = compare_catalogues(runs)
    parts = [F.col("identity")[k] for k in ("object_type", "schema_name", "object_name")]
    return found.select(F.concat_ws("/", *parts).alias("identity"), "status")


# --- metrics, files, sinks ----------------------------------------------------------------------


@registry.add("SELECT event_id, 'k' AS metric, json_extract_string(props, '$.k') AS value FROM events")
def flatten_metrics(spark, sf):
    return readers.flatten_metrics(table(spark, sf, "events"), "props", ["event_id"])


@registry.add(
    "SELECT o_orderkey, 'a' AS metric, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'b.c', CAST(o_custkey AS VARCHAR) FROM orders "
    "UNION ALL SELECT o_orderkey, 'b.d.e', 'true' FROM orders"
)
def flatten_nested_metrics(spark, sf):
    nested = F.to_json(
        F.struct(
            F.col("o_orderstatus").alias("a"),
            F.struct(F.col("o_custkey").alias("c"), F.struct(F.lit(True).alias("e")).alias("d"),
                     F.array(F.lit(1)).alias("list")).alias("b"),
        )
    )
    orders = table(spark, sf, "orders").select("o_orderkey", nested.alias("document"))
    return readers.flatten_metrics(orders, "document", ["o_orderkey"])


@registry.add(
    "SELECT o_orderkey, unnest(['a.b.c.d.e.f', 'a.b.c.d.e.t', 's', 'n']) AS metric, "
    "unnest([CAST(o_custkey AS VARCHAR), '{not json}', '[x]', NULL]) AS value FROM orders"
)
def flatten_deep_metrics(spark, sf):
    """Six levels, texts that look like objects and lists, nulls, lists and an empty object."""
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":#,"t":"{not json}"}}},"l":[{"k":1}]}},"s":"[x]","n":null,"o":{}}'
    parts = [F.lit(x) for x in deep.split("#")]
    orders = table(spark, sf, "orders").select("o_orderkey", F.concat(parts[0], F.col("o_custkey"), parts[1]).alias("document"))
    return readers.flatten_metrics(orders, "document", ["o_orderkey"])


_EXACT = (
    ("a", "#", "#"), ("whole", "7#0000000000000000000000000000000000000001", "7#0000000000000000000000000000000000000001"),
    ("tenths", "#.0", "#.0"), ("half", "#.50", "#.5"), ("wide", "1e16", "1e+16"), ("zero", "-0", "0"), ("more", "-1E400", "-inf"), ("not", "NaN", "nan"),
    ("none", "-Infinity", "-inf"), ("yes", "true", "true"), ("text", '"1.0 \\u00e9\\n"', "1.0 é\n"), ("list", "[#]", None),
)


@registry.add(
    "SELECT o_orderkey, unnest(['" + "', '".join(n for n, _, v in _EXACT if v) + "', 'twice', 'inner.last', 'inner.deep.x']) AS metric, unnest(["
    + ", ".join("replace('" + v + "', '#', CAST(o_custkey AS VARCHAR))" for _, _, v in _EXACT if v)
    + ", CAST(o_orderkey AS VARCHAR), '2', 'x']) AS value FROM orders"
)
def flatten_exact_metrics(spark, sf):
    """Numbers as they are written, words that are no numbers, and names that come twice."""
    fields = ", ".join(f'"{n}": {raw}' for n, raw, _ in _EXACT)
    document = '{"twice": {"gone": 1}, "inner": 5, ' + fields + ', "inner": {"last": 1, "deep": {"x": "x"}, "last": 2}, "twice": @}'
    orders = table(spark, sf, "orders")
    text = F.replace(F.replace(F.lit(document), F.lit("#"), F.col("o_custkey").cast("string")), F.lit("@"), F.col("o_orderkey").cast("string"))
    return readers.flatten_metrics(orders.select("o_orderkey", text.alias("document")), "document", ["o_orderkey"])


_TEXT_RUN = "SELECT o_orderkey, concat_ws(chr(10), 'SELECT x', {0}, 'FROM t', {1}) AS body, o_orderstatus AS mark FROM orders"
_TEXT_LINES = (("'a'", "'a'"), ("CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END", "CASE WHEN o_orderkey % 5 = 0 THEN 'FROM t' ELSE 'a' END"))


@registry.add(
    f"""WITH runs AS (SELECT 1 AS side, * FROM ({_TEXT_RUN.format(*_TEXT_LINES[1])}) UNION ALL SELECT -1, * FROM ({_TEXT_RUN.format(*_TEXT_LINES[0])})),
lines AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, side, unnest(string_split(body, chr(10))) AS line FROM runs)
SELECT o_orderkey, 'a_to_b' AS interval, line, CAST(greatest(-sum(side), 0) AS BIGINT) AS removed, CAST(greatest(sum(side), 0) AS BIGINT) AS added
FROM lines GROUP BY o_orderkey, line HAVING sum(side) <> 0"""
)
def definition_changes(spark, sf):
    orders = table(spark, sf, "orders")
    runs = [spark.sql(_TEXT_RUN.format(*x).replace("FROM orders", "FROM {orders}"), orders=orders) for x in _TEXT_LINES]
    compared = comparing.compare(runs, ["o_orderkey"], ["mark"], definition="body")
    return comparing.definition_changes(compared, ["o_orderkey"], "body")


PHONES = comparing.CompareSpec(("o_orderkey",), ("phone_number", "grade"), ("cents",))
_PHONE_RUN = (
    "SELECT o_orderkey, concat('+', o_custkey) AS phone_number, {0} AS grade, CAST(o_custkey + {1} AS BIGINT) AS cents FROM orders"
)
_PHONE_GRADES = (("CASE WHEN o_orderkey % 9 = 0 THEN 'HIGH' ELSE 'fine' END", 0), ("CASE WHEN o_orderkey % 7 = 0 THEN 'a warning' ELSE 'fine' END", 5))


def phone_runs(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    runs = [spark.sql(_PHONE_RUN.format(*g).replace("FROM orders", "FROM {orders}"), orders=orders) for g in _PHONE_GRADES]
    return comparing.compare(runs, PHONES.keys, PHONES.fields, PHONES.numeric)


_PHONES = f"""WITH a AS ({_PHONE_RUN.format(*_PHONE_GRADES[0])}), b AS ({_PHONE_RUN.format(*_PHONE_GRADES[1])}),
both_runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, a.grade AS ga, b.grade AS gb, a.phone_number AS p, a.cents AS ca, b.cents AS cb,
  CASE WHEN a.grade = b.grade THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM a JOIN b USING (o_orderkey))"""


@registry.add(f"{_PHONES} SELECT k AS o_orderkey, status FROM both_runs WHERE contains(lower(ga), 'high') OR contains(lower(gb), 'high')")
def filter_severity(spark, sf):
    return comparing.filter_comparison(phone_runs(spark, sf), PHONES, severity="HIGH").select("o_orderkey", "status")


@registry.add(f"{_PHONES} SELECT k AS o_orderkey, status FROM both_runs WHERE ga = 'HIGH' OR gb = 'a warning'")
def filter_issues(spark, sf):
    return comparing.filter_comparison(phone_runs(spark, sf), PHONES, issues_only=True).select("o_orderkey", "status")


@registry.add(
    f"{_PHONES} SELECT status, json_object('o_orderkey', k) AS identity, "
    "json_object('grade_a', ga, 'grade_b', gb, 'phone_number_a', p, 'phone_number_b', p) AS runs, "
    "concat(ca, '/', cb, '/', cb - ca) AS cents FROM both_runs"
)
def export_runs_and_deltas(spark, sf):
    """A field named like a number stays with the runs; numbers are under the deltas alone."""
    exported = readers.export_rows(phone_runs(spark, sf), PHONES)
    number = lambda name: F.get_json_object("numeric_deltas", f"$.cents_{name}").cast("double").cast("bigint")
    return exported.select(
        "status", "identity", "runs", F.concat_ws("/", number("number_a"), number("number_b"), number("b_minus_a")).alias("cents")
    )


@registry.add(
    "SELECT 'column_profiles' AS category, CAST(count(*) AS BIGINT) AS n, CAST(count_if(o_orderkey % 3 = 0) AS BIGINT) AS changed FROM orders"
)
def compare_runs_of_many_schemas(spark, sf):
    """Two runs in which one column name stands in many tables of many schemas: one row per column."""
    run = lambda extra: table(spark, sf, "orders").select(
        F.concat(F.lit("s"), F.col("o_orderkey") % 7).alias("schema_name"), F.concat(F.lit("t"), "o_orderkey").alias("object_name"),
        F.lit("id").alias("column_name"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, extra).otherwise(0)).alias("distinct_count"))
    found = compare_catalogues([{"column_profiles": run(0)}, {"column_profiles": run(1)}])
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "CHANGED").alias("changed"))


_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'SKIPPED_BY_MODE' WHEN 2 THEN 'CANCELLED' ELSE 'PASS' END"


@registry.add(
    f"""WITH m AS (SELECT o_orderkey, {_STATUS} AS s, CAST(o_custkey % 3 AS INTEGER) AS errors, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS expected FROM orders),
c AS (SELECT *, CASE WHEN expected = 0 THEN 20 ELSE expected END AS wanted, 1 + CASE WHEN s IN ('PASS', 'SKIPPED_BY_MODE') THEN 1 ELSE 0 END AS done, CASE WHEN s = 'FAILED' THEN 1 ELSE 0 END AS failed FROM m)
SELECT concat('run_', o_orderkey) AS run_id, CASE WHEN s = 'CANCELLED' THEN 'CANCELLED' WHEN failed > 0 THEN 'FAILED' WHEN 2 >= wanted AND done = 2 AND errors > 0 THEN 'COMPLETED_WITH_WARNINGS'
  WHEN 2 >= wanted AND done = 2 THEN 'COMPLETED' ELSE 'PARTIAL' END AS status, CAST(1 + CASE WHEN s = 'PASS' THEN 1 ELSE 0 END AS INTEGER) AS completed_stage_count,
  concat(done, '/', wanted) AS completion_coverage, CAST(failed AS INTEGER) AS error_count, CAST(greatest(errors - failed, 0) AS INTEGER) AS warning_count FROM c"""
)
def run_statuses(spark, sf):
    stage = lambda status: F.struct(F.lit("x").alias("prompt"), status.alias("status"))
    manifests = table(spark, sf, "orders").select(
        F.concat(F.lit("run_"), "o_orderkey").alias("run_id"), F.lit("shop").alias("database"),
        F.lit("").alias("timestamp_utc"), (F.col("o_custkey") % 3).cast("int").alias("errors"),
        F.lit(None).cast("array<string>").alias("warnings"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END").alias("expected_stage_count"),
        F.array(stage(F.lit("PASS")), stage(F.expr(_STATUS))).alias("stages"),
        F.create_map(F.lit("discovery_mode"), F.lit("full")).alias("configuration"),
    )
    return readers.run_statuses(manifests, expected_stages=20).select(
        "run_id", "status", "completed_stage_count", "completion_coverage", "error_count", "warning_count"
    )


@registry.add(
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{t}.parquet' AS file_name, count(*) AS row_count FROM {t}" for t in TABLES
    )
)
def partition_row_counts(spark, sf):
    parts = [workspace.partition_row_counts(table(spark, sf, t), t) for t in TABLES]
    return reduce(DataFrame.unionAll, parts).drop("compression")


@registry.add(
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(1 AS BIGINT) AS file_count, count(*) AS row_count, true AS has_bytes FROM {t}" for t in TABLES
    )
)
def table_sizes(spark, sf):
    sizes = workspace.table_sizes({t: table(spark, sf, t) for t in TABLES})
    return sizes.select("table_name", "file_count", "row_count", (F.col("total_bytes") > 0).alias("has_bytes"))


@registry.add()
def file_inventory(spark, sf):
    return readers.file_inventory(spark, sf).drop("path")


#: Customers, and documents, whose rows make one file; so the number of files follows the tables.
CUSTOMERS_A_FILE, DOCUMENTS_A_FILE = 15, 40


def _artifacts(rows: DataFrame, label: str, order: str) -> DataFrame:
    """The inventory of files written from (part, value) rows, one file a part, named by it."""
    spark = rows.sparkSession
    folder = fresh_folder(spark, label)
    rows.repartition("part").sortWithinPartitions("part", order).select("part", "value").write.partitionBy("part").text(folder)
    found = readers.file_inventory(spark, folder, whole=1 << 12).where(F.col("file_name").startswith("part-"))
    return found.withColumn("file_name", F.regexp_extract("path", "part=([0-9]+)/", 1))


@registry.add(
    f"""WITH parts AS (SELECT DISTINCT o_custkey // {CUSTOMERS_A_FILE} AS part FROM orders)
SELECT CAST(part AS VARCHAR) AS file_name, CASE WHEN part % 7 = 3 THEN 'ADDED' WHEN part % 11 = 4 THEN 'REMOVED' WHEN part % 5 = 2 THEN 'CHANGED' ELSE 'UNCHANGED' END AS status
FROM parts WHERE part % 7 <> 3 OR part % 11 <> 4"""
)
def inventory_changed(spark, sf):
    """Two runs of files of orders: some files are added, some gone, and in some one line differs."""
    orders = table(spark, sf, "orders").withColumn("part", F.expr(f"o_custkey div {CUSTOMERS_A_FILE}"))
    line = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus")
    # the changed files have a line of their own at the end
    ends = orders.where("part % 5 = 2").groupBy("part").agg(F.max("o_orderkey").alias("o_orderkey")).select(
        "part", (F.col("o_orderkey") + 1).alias("o_orderkey"), F.lit("one more line").alias("value"))
    plain = orders.select("part", "o_orderkey", line.alias("value"))
    before, after = plain.where("part % 7 <> 3"), plain.unionByName(ends).where("part % 11 <> 4")
    runs = [_artifacts(rows, label, "o_orderkey") for label, rows in (("before", before), ("after", after))]
    return comparing.compare(runs, ["file_name"], ["bytes", "sha256"]).select("file_name", "status")


_FOUND = "CASE WHEN count(*) > 0 THEN '{0}' ELSE '{1}' END"


@registry.add(
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS source_name, {_FOUND.format('PRESENT', 'ABSENT')} AS status, count(*) AS row_count, "
        f"{_FOUND.format('CATALOG_QUERY_RETURNED_ROWS', 'CATALOG_QUERY_RETURNED_ZERO_ROWS')} AS evidence, false AS has_detail FROM {t}" for t in TABLES
    )
    + " UNION ALL SELECT 'nothing', 'ABSENT', 0, 'CATALOG_QUERY_RETURNED_ZERO_ROWS', false UNION ALL SELECT 'gone', 'UNSUPPORTED', 0, 'CATALOG_NOT_SUPPORTED', true "
    "UNION ALL SELECT 'off', 'DISABLED', 0, 'EXPLICIT_CONFIGURATION', false UNION ALL SELECT 'closed', 'INACCESSIBLE', 0, 'CATALOG_QUERY_ACCESS_ERROR', true"
)
def source_availability(spark, sf):
    """All tables, an empty source, one that is not there, one switched off and one that may not be opened."""

    def closed():
        raise PermissionError("permission was denied")

    sources = {t: lambda t=t: table(spark, sf, t) for t in TABLES} | {
        "nothing": lambda: table(spark, sf, "orders").where("o_orderkey < 0"),
        "gone": lambda: table(spark, sf, "no_such_table"), "off": None, "closed": closed,
    }
    found = workspace.source_availability(spark, sources)
    return found.select("source_name", "status", "row_count", "evidence", (F.length("detail") > 0).alias("has_detail"))


@registry.add(
    with_inputs(
        "snapshot_a",
        "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, concat('quoted \"', note, '\"', chr(10), 'two lines, comma') AS note FROM snapshot_a",
    )
)
def csv_snapshot_round_trip(spark, sf):
    """Written as CSV and read back as text: quotes, commas and line breaks survive."""
    path = fresh_folder(spark)
    rows = derived(spark, sf, "snapshot_a").withColumn(
        "note", F.concat(F.lit('quoted "'), "note", F.lit('"\ntwo lines, comma'))
    )
    columns = ("o_orderkey", "o_orderstatus", "note")
    readers.write_snapshot({"orders": rows}, path, {"orders": columns}, file_format="csv")
    found, _ = readers.read_snapshot(spark, f"{path}/orders", columns)
    return found


@registry.add(
    with_extra(
        RUNS, TIMELINE,
        "SELECT status, json_object('o_orderkey', k) AS identity, to_json(events) AS timeline_events, json_object('a_to_b', ab, 'a_to_c', ac, 'b_to_c', bc) AS intervals FROM timeline",
    )
)
def export_comparison(spark, sf):
    exported = readers.export_rows(three_runs(spark, sf), THREE_SPEC)
    return exported.select("status", "identity", "timeline_events", "intervals")



@registry.add(
    f"SELECT CAST(doc_id // {DOCUMENTS_A_FILE} AS VARCHAR) AS file_name, sha256(string_agg(to_base64(encode(coalesce(text, ''))) || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1"
)
def inventory_of_written_texts(spark, sf):
    """Texts written as files, one line a document; their hashes, of values and of streams, are those of the lines."""
    line = F.regexp_replace(F.base64(F.encode(F.coalesce("text", F.lit("")), "utf-8")), "\\s", "")
    part = F.expr(f"doc_id div {DOCUMENTS_A_FILE}")
    documents = table(spark, sf, "documents").select(part.alias("part"), "doc_id", line.alias("value"))
    return _artifacts(documents, "texts", "doc_id").select("file_name", "sha256")


@registry.add(
    "SELECT concat('key ', o_orderkey) AS name, 'UNCHANGED' AS status FROM orders WHERE o_orderkey % 2 = 0 "
    "UNION ALL SELECT concat('é', chr(31), 'key ', o_orderkey), 'UNCHANGED' FROM orders WHERE o_orderkey % 2 = 1"
)
def compare_keys_between_controls(spark, sf):
    """Blanks and separators around a key are trimmed, those inside stay; with and without other letters than ASCII."""
    orders = table(spark, sf, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    run = lambda before, after: orders.select(
        F.concat(F.lit(before), F.when(odd, F.lit("É\x1fKey ")).otherwise(F.lit("Key ")), "o_orderkey", F.lit(after)).alias("name"), "o_orderstatus")
    runs = [run("\x1c\x1d \t", "\x1f\x0b"), run("\x1e", "\n\x1c \r")]
    return comparing.compare(runs, ["name"], ["o_orderstatus"]).select("name", "status")


@registry.add(
    "SELECT concat('été ', o_orderkey) AS name, 'UNCHANGED' AS status FROM orders WHERE o_orderkey % 2 = 0 "
    "UNION ALL SELECT concat('plain ', o_orderkey), 'UNCHANGED' FROM orders WHERE o_orderkey % 2 = 1"
)
def compare_non_ascii_keys(spark, sf):
    """Keys match in their compatibility form, whatever their case: ligatures and wide letters too."""
    orders = table(spark, sf, "orders")
    run = lambda odd, even: orders.select(
        F.concat(F.when(F.col("o_orderkey") % 2 == 1, odd).otherwise(even), "o_orderkey").alias("name"), "o_orderstatus")
    runs = [run("PLAIN ", " ÉTÉ "), run("\uff50lain ", "e\u0301te\u0301 ")]
    return comparing.compare(runs, ["name"], ["o_orderstatus"]).select("name", "status")
