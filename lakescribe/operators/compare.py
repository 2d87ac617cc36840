"""Comparison of two or three snapshots of a table: statuses, timelines, deltas, text diffs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.line_diff import apply_diff, unified_diff
from ..functions.text import BLANKS, stable_number, stable_text

INTERVALS = (("a_to_b", "a", "b"), ("b_to_c", "b", "c"), ("a_to_c", "a", "c"))


@dataclass(frozen=True)
class CompareSpec:
    """What identifies a row, what is compared and what is subtracted."""

    keys: tuple[str, ...]
    fields: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    definition: str | None = None


def _compatibility_form():
    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: unicodedata.normalize("NFKC", t).strip().casefold())

    return nfkc


NOT_ASCII = r"[^\x00-\x7F]"
#: What is trimmed from keys: blanks and the four separators.
KEY_BLANKS = BLANKS + "\x1c\x1d\x1e\x1f"


def stable_key(column: Column, special: bool = False) -> Column:
    """The identity text of a key: compatibility form, trimmed, case-folded.

    For ASCII texts that is trimming and lower case; ``special`` texts need Python's Unicode tables.
    """
    text = stable_text(column)
    return _compatibility_form()(text) if special else F.lower(F.btrim(text, F.lit(KEY_BLANKS)))


def _tagged(
    df: DataFrame, label: str, spec: CompareSpec, sequence: str | None, texts: Sequence[str]
) -> DataFrame:
    """Rows under their normalized keys, with the run they belong to.

    Rows whose keys hold other characters than ASCII are selected in a scan of their own: a Python
    function inside a condition would be fed every row.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    order = F.col(sequence) if sequence else F.lit(0)
    record = F.struct(order.alias("__sequence"), *[stable_text(F.col(c)).alias(c) for c in texts])
    worded = [k for k in spec.keys if types[k] == "string"]

    def selected(rows: DataFrame, special: bool) -> DataFrame:
        keys = [stable_key(F.col(k), special and k in worded).alias(k) for k in spec.keys]
        return rows.select(*keys, F.lit(label).alias("__run"), record.alias("__record"))

    if not worded:
        return selected(df, False)
    exotic = reduce(
        Column.__or__, [F.coalesce(F.col(k).rlike(NOT_ASCII), F.lit(False)) for k in worded]
    )
    return selected(df.where(~exotic), False).unionAll(selected(df.where(exotic), True))


def compare(
    runs: Sequence[DataFrame],
    keys: Sequence[str],
    fields: Sequence[str],
    numeric: Sequence[str] = (),
    definition: str | None = None,
    availability: Sequence[bool] | None = None,
    sequence: str | None = None,
    only_changes: bool = False,
) -> DataFrame:
    """Full outer match of two or three runs on normalized keys.

    All runs are tagged and united, then grouped by key once: one shuffle, pre-aggregated, for two
    runs or three. When a key repeats within a run the row with the highest ``sequence`` counts
    (without one, the highest values, so that the result does not depend on row order).

    ``only_changes`` leaves out the keys whose status is UNCHANGED. The runs are then compared by digests
    of key buckets first, and only rows of buckets that differ are shuffled (:func:`changed_buckets`).

    Per key: ``status``, the status of each interval, per field ``<f>_a`` …, per numeric field
    the differences and percents, and ``timeline_events`` for three runs.
    """
    if len(runs) not in (2, 3):
        raise ValueError("a comparison takes two or three runs")
    spec = CompareSpec(tuple(keys), tuple(fields), tuple(numeric), definition)
    labels = ("a", "b", "c")[: len(runs)]
    available = dict(zip(labels, availability or (True,) * len(runs)))
    texts = list(dict.fromkeys([*fields, *numeric, *([definition] if definition else [])]))
    tagged = reduce(
        DataFrame.unionByName,
        [_tagged(df, label, spec, sequence, texts) for label, df in zip(labels, runs)],
    )
    if only_changes and all(available.values()):
        tagged = _in_buckets(tagged, spec.keys)
        # a number per bucket, of which there are DIGEST_BUCKETS at most
        tagged = tagged.join(F.broadcast(changed_buckets(tagged, len(runs))), "__bucket", "left_semi").drop("__bucket")
    grouped = tagged.groupBy(*spec.keys).agg(
        *[F.max(F.when(F.col("__run") == label, F.col("__record"))).alias(f"__{label}") for label in labels]
    )
    intervals = [i for i in INTERVALS if i[2] in labels]
    staged = grouped.withColumns(
        {name: _pair_status(left, right, spec.fields, available) for name, left, right in intervals}
    )
    outputs: dict[str, Column] = {}
    if len(labels) == 3:
        staged = staged.withColumn("timeline_events", _timeline_events())
        status = _timeline_status()
    else:
        status = F.col("a_to_b")
    for field in spec.fields:
        for label in labels:
            outputs[f"{field}_{label}"] = F.col(f"__{label}").getField(field)
    for field in spec.numeric:
        outputs.update(_deltas(field, labels))
    if definition:
        for label in labels:
            outputs[f"{definition}_{label}"] = F.col(f"__{label}").getField(definition)
    present = F.array_compact(
        F.array(*[F.when(F.col(f"__{label}").isNotNull(), label.upper()) for label in labels])
    )
    extra = ["timeline_events"] if len(labels) == 3 else []
    compared = staged.select(
        *spec.keys, status.alias("status"), *[name for name, _, _ in intervals], *extra,
        present.alias("present_in"), *[column.alias(name) for name, column in outputs.items()],
    )
    return compared.where(F.col("status") != "UNCHANGED") if only_changes else compared


DIGEST_BUCKETS = 1 << 16


def _in_buckets(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tagged.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(DIGEST_BUCKETS)))


def changed_buckets(tagged: DataFrame, runs: int) -> DataFrame:
    """(__bucket): the key buckets whose rows are not the same in all of the runs.

    A bucket is known by its number of rows and the sums of the halves of two 64-bit digests of its rows,
    which do not depend on their order. Equal rows, repeated as often in every run, resolve to the
    same record, so keys of equal buckets are unchanged. Sums of numbers are all that is grouped.
    """
    columns = [c for c in tagged.columns if c not in ("__run", "__bucket")]
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    halves = {"d1": one.bitwiseAND(0xFFFFFFFF), "d2": F.shiftrightunsigned(one, 32),
              "d3": two.bitwiseAND(0xFFFFFFFF), "d4": F.shiftrightunsigned(two, 32)}
    rows = tagged.select("__run", "__bucket", *[h.alias(n) for n, h in halves.items()])
    digests = rows.groupBy("__bucket", "__run").agg(F.count(F.lit(1)).alias("d0"), *[F.sum(n).alias(n) for n in halves])
    names = ["d0", *halves]
    same = reduce(Column.__and__, [F.min(n) == F.max(n) for n in names]) & (F.count(F.lit(1)) == runs)
    return digests.groupBy("__bucket").agg(same.alias("same")).where("NOT same").select("__bucket")


def _pair_status(left: str, right: str, fields: Sequence[str], available: Mapping[str, bool]) -> Column:
    if not available[left] and not available[right]:
        return F.lit("NOT_AVAILABLE")
    if not available[left] or not available[right]:
        return F.lit("NOT_COMPARABLE")
    old, new = F.col(f"__{left}"), F.col(f"__{right}")
    same = reduce(Column.__and__, [old.getField(f) == new.getField(f) for f in fields], F.lit(True))
    return (
        F.when(old.isNull() & new.isNull(), "NOT_AVAILABLE")
        .when(old.isNull(), "ADDED")
        .when(new.isNull(), "REMOVED")
        .when(same, "UNCHANGED")
        .otherwise("CHANGED")
    )


def _timeline_events() -> Column:
    ab, bc, ac = F.col("a_to_b"), F.col("b_to_c"), F.col("a_to_c")
    twice = (ab == "CHANGED") & (bc == "CHANGED")
    return F.array_compact(
        F.array(
            F.when(ab == "ADDED", "ADDED_IN_B"),
            F.when(bc == "ADDED", "ADDED_IN_C"),
            F.when(ab == "REMOVED", "REMOVED_IN_B"),
            F.when(bc == "REMOVED", "REMOVED_IN_C"),
            F.when(ab == "CHANGED", "CHANGED_A_TO_B"),
            F.when(bc == "CHANGED", "CHANGED_B_TO_C"),
            F.when(twice & (ac == "UNCHANGED"), "REVERTED_TO_A").when(twice, "CHANGED_BOTH"),
        )
    )


def _timeline_status() -> Column:
    states = [F.col(name) for name, _, _ in INTERVALS]
    events = F.col("timeline_events")

    def every(state: str) -> Column:
        return reduce(Column.__and__, [s == state for s in states])

    status = F.when(reduce(Column.__or__, [s == "NOT_COMPARABLE" for s in states]), "NOT_COMPARABLE")
    status = status.when(every("NOT_AVAILABLE"), "NOT_AVAILABLE")
    for event in fixed.TIMELINE_PRIORITY:
        status = status.when(F.array_contains(events, event), event)
    return status.when(every("UNCHANGED"), "UNCHANGED").otherwise("NOT_COMPARABLE")


def _deltas(field: str, labels: Sequence[str]) -> dict[str, Column]:
    values = {label: stable_number(F.col(f"__{label}").getField(field)) for label in labels}
    outputs = {f"{field}_number_{label}": value for label, value in values.items()}
    for left, right in (("a", "b"), ("b", "c"), ("a", "c")):
        if right in values:
            difference = values[right] - values[left]
            name = f"{field}_{right}_minus_{left}"
            outputs[name] = difference
            outputs[f"{name}_percent"] = F.try_divide(difference * F.lit(100.0), values[left])
    return outputs


def definition_diffs(compared: DataFrame, definition: str) -> DataFrame:
    """Adds a unified diff per interval whose lines differ; texts that are equal are compared as empty ones.

    Diffs are those of :mod:`lakescribe.functions.line_diff`; `patched` applies them.
    """
    labels = [x for x in ("a", "b", "c") if f"{definition}_{x}" in compared.columns]
    out = compared
    for name, left, right in INTERVALS:
        if right not in labels:
            continue
        old = F.coalesce(f"{definition}_{left}", F.lit(""))
        new = F.coalesce(f"{definition}_{right}", F.lit(""))
        changed = old != new
        diff = _unified_diff(left.upper(), right.upper())(
            F.when(changed, old).otherwise(""), F.when(changed, new).otherwise("")
        )
        out = out.withColumn(f"diff_{name}", F.when(changed, F.nullif(diff, F.lit(""))))
    return out


def definition_changes(compared: DataFrame, keys: Sequence[str], definition: str) -> DataFrame:
    """(keys, interval, line, removed, added): how often each line went or came, per interval.

    Only rows whose texts differ are spread into lines. Lines are counted in the map tasks first; a
    line that only moved within its text is neither removed nor added.
    """
    labels = [x for x in ("a", "b", "c") if f"{definition}_{x}" in compared.columns]
    pairs = []
    for name, left, right in INTERVALS:
        if right in labels:
            old, new = (F.coalesce(f"{definition}_{x}", F.lit("")) for x in (left, right))
            pair = F.struct(F.lit(name).alias("interval"), old.alias("old"), new.alias("new"))
            pairs.append(F.when(old != new, pair))
    differing = compared.select(*keys, F.explode(F.array_compact(F.array(*pairs))).alias("pair"))
    lines = lambda side, change: F.transform(
        F.filter(F.split(F.col(f"pair.{side}"), r"\r?\n"), lambda x: F.col(f"pair.{side}") != ""),
        lambda x: F.struct(x.alias("line"), F.lit(change).alias("change")),
    )
    spread = differing.select(*keys, "pair.interval", F.inline(F.concat(lines("old", -1), lines("new", 1))))
    net = spread.groupBy(*keys, "interval", "line").agg(F.sum("change").alias("net")).where("net <> 0")
    return net.select(
        *keys, "interval", "line", F.greatest(-F.col("net"), F.lit(0)).cast("long").alias("removed"),
        F.greatest(F.col("net"), F.lit(0)).cast("long").alias("added"),
    )


#: Text bytes of a batch that are Python values at a time, one row at least.
SLICE_BYTES = 2 << 20


def by_bytes(made: Callable[..., str | None], *texts: pa.Array) -> pa.Array:
    """The text made of each row's texts; a slice of bounded bytes at a time leaves Arrow, whatever the batch holds."""
    sizes = sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out, row = [pa.array([], pa.string())], 0
    while row < len(sizes):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1)
        rows = zip(*[t.slice(row, stop - row).to_pylist() for t in texts])
        out.append(pa.array([made(*values) for values in rows], pa.string()))
        row = stop
    return pa.concat_arrays(out)


def _unified_diff(before: str, after: str):
    @F.arrow_udf("string")
    def diff(old: pa.Array, new: pa.Array) -> pa.Array:
        return by_bytes(lambda a, b: "\n".join(unified_diff(a.splitlines(), b.splitlines(), before, after)), old, new)

    return diff


def patched(text: Column, diff: Column) -> Column:
    """The text after a unified diff, its lines joined by line feeds; null texts are empty.

    No diff (null or empty) gives the text in that form. A diff that does not fit the text gives null.
    """

    @F.arrow_udf("string")
    def applied(texts: pa.Array, diffs: pa.Array) -> pa.Array:
        def one(lines: list[str], change: str | None) -> str | None:
            try:
                return "\n".join(apply_diff(lines, change.split("\n")) if change else lines)
            except ValueError:
                return None

        return by_bytes(lambda t, d: one((t or "").splitlines(), d), texts, diffs)

    return applied(text, diff)


def _interval_columns(compared: DataFrame) -> list[str]:
    return [name for name, _, _ in INTERVALS if name in compared.columns]


def status_tokens(compared: DataFrame) -> Column:
    """Every status a row carries: its own, its intervals', its timeline's."""
    single = F.array("status", *_interval_columns(compared))
    return F.concat(single, F.col("timeline_events")) if "timeline_events" in compared.columns else single


def matches_status(tokens: Column, wanted: str) -> Column:
    """Whether the history holds a status; CHANGED_ONLY, ADDED and REMOVED stand for families."""
    wanted = wanted.strip().upper()
    if not wanted:
        return F.lit(True)
    if wanted == "CHANGED_ONLY":
        return F.exists(
            tokens,
            lambda t: (t == "CHANGED") | t.startswith("CHANGED_") | (t == "REVERTED_TO_A"),
        )
    if wanted in ("ADDED", "REMOVED"):
        return F.exists(tokens, lambda t: (t == wanted) | t.startswith(f"{wanted}_IN_"))
    return F.array_contains(tokens, wanted)


def run_columns(compared: DataFrame, spec: CompareSpec) -> list[str]:
    """The columns with the runs' values of the compared fields."""
    wanted = [f"{f}_{label}" for f in spec.fields for label in ("a", "b", "c")]
    return [c for c in wanted if c in compared.columns]


def delta_columns(compared: DataFrame, spec: CompareSpec) -> list[str]:
    """The columns with numbers, differences and percents of the numeric fields."""
    labels = ("a", "b", "c") if "b_to_c" in compared.columns else ("a", "b")
    return [name for f in spec.numeric for name in _deltas(f, labels)]


def filter_comparison(
    compared: DataFrame,
    spec: CompareSpec,
    status: str = "",
    search: str = "",
    schema: str = "",
    severity: str = "",
    database: str = "",
    issues_only: bool = False,
    category: str = "",
) -> DataFrame:
    """Rows of a comparison by history status, identity text, schema, severity and database.

    ``spec`` is what was compared; severity and issues are looked for in identities and in the
    runs' values of its fields.
    """
    rows, keys = compared, spec.keys
    if status:
        rows = rows.where(matches_status(status_tokens(compared), status))

    def any_contains(names: Sequence[str], needle: str) -> Column:
        tests = [F.lower(F.coalesce(F.col(n).cast("string"), F.lit(""))).contains(needle.lower()) for n in names]
        return reduce(Column.__or__, tests, F.lit(False))

    values = run_columns(compared, spec)
    if search:
        rows = rows.where(any_contains(keys, search))
    if schema:
        rows = rows.where(any_contains([k for k in keys if "schema" in k.lower()], schema))
    if severity:
        rows = rows.where(any_contains([*values, *keys], severity))
    if database:
        rows = rows.where(F.exists("databases", lambda d: F.lower(d) == database.lower()))
    if issues_only and category not in ("errors", "risks"):
        marked = F.lit(False)
        for word in ("warning", "error", "high", "medium", "critical"):
            marked = marked | any_contains([*values, *keys], word)
        rows = rows.where(F.col("status").isin("NOT_AVAILABLE", "NOT_COMPARABLE") | marked)
    return rows


def with_databases(compared: DataFrame, databases: Sequence[str]) -> DataFrame:
    """Adds the databases of the runs in which each row exists."""
    names = F.create_map(
        *[part for label, name in zip("ABC", databases) for part in (F.lit(label), F.lit(name))]
    )
    return compared.withColumn(
        "databases", F.transform("present_in", lambda label: F.element_at(names, label))
    )


def availability_status(availability: Sequence[bool]) -> str:
    if all(availability):
        return "AVAILABLE"
    return "NOT_COMPARABLE" if any(availability) else "NOT_AVAILABLE"


def summarize_comparison(compared: DataFrame, category: str | None = None) -> DataFrame:
    """Counts of statuses, interval statuses and timeline events, per category and overall.

    ``counter`` tells which; primary statuses add up to the rows, the others may exceed them.
    ``category`` is a column of the comparison unless a name is given; the overall rows have it
    NULL.
    """
    rows = compared.withColumn("category", F.lit(category)) if category else compared
    counters = [F.struct(F.lit("PRIMARY_STATUS").alias("counter"), F.col("status").alias("value"))]
    counters += [
        F.struct(F.lit("INTERVAL_STATUS").alias("counter"), F.col(name).alias("value"))
        for name in _interval_columns(compared)
    ]
    items = F.array(*counters)
    if "timeline_events" in compared.columns:
        events = F.transform(
            "timeline_events",
            lambda e: F.struct(F.lit("TIMELINE_EVENT").alias("counter"), e.alias("value")),
        )
        items = F.concat(items, events)
    per_category = (
        rows.select("category", F.inline(items))
        .groupBy("category", "counter", "value")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    return (
        per_category.rollup("counter", "value", "category")
        .agg(F.sum("occurrences").alias("occurrences"), F.grouping_id().alias("level"))
        .where("level < 2")
        .select(
            F.when(F.col("level") == 0, "CATEGORY_ALL_ROWS").otherwise("GLOBAL_ALL_CATEGORY_ROWS").alias("scope"),
            "category", "counter", "value", "occurrences",
        )
    )


def comparison_warnings(run_metadata: DataFrame) -> DataFrame:
    """Warnings of a comparison across databases or modes; ``run_metadata`` has one row per run."""
    checks = run_metadata.agg(
        F.count_distinct(F.lower("database")).alias("databases"),
        F.count_distinct(F.coalesce(F.col("mode"), F.lit("None"))).alias("modes"),
    )
    texts = F.array_compact(
        F.array(
            F.when(
                F.col("databases") > 1,
                "Mixed databases: matching structural names do not prove business equivalence.",
            ),
            F.when(
                F.col("modes") > 1,
                "Discovery modes differ; unavailable evidence may not be comparable.",
            ),
        )
    )
    return checks.select(F.explode(texts).alias("warning"))
