"""Table metrics, table roles, tables without keys and tables that look alike."""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations, product
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.types import of_tables
from ..sources.shared import materialize

TABLE = ["schema_name", "object_name"]


def tables_without_key(tables: DataFrame, primary_keys: DataFrame) -> DataFrame:
    keyed = primary_keys.select(*TABLE).distinct()
    return tables.select(*TABLE).distinct().join(keyed, TABLE, "left_anti").select(
        *TABLE, F.lit("NO_DECLARED_PRIMARY_KEY").alias("observation"), F.lit("FACT").alias("evidence")
    )


def _counted(rows: DataFrame, schema: str, name: str, measure: Column, alias: str) -> DataFrame:
    return rows.groupBy(F.col(schema).alias(TABLE[0]), F.col(name).alias(TABLE[1])).agg(
        measure.cast("int").alias(alias)
    )


def table_metrics(
    tables: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame,
    indexes: DataFrame, constraints: DataFrame,
) -> DataFrame:
    """Per table: key columns, references out and in, distinct indexes and constraints."""
    every = F.count(F.lit(1))
    counts = (
        _counted(primary_keys, *TABLE, every, "primary_key_column_count"),
        _counted(foreign_keys, "source_schema", "source_object", every, "foreign_key_outbound_count"),
        _counted(foreign_keys, "target_schema", "target_object", every, "foreign_key_inbound_count"),
        _counted(indexes, *TABLE, F.count_distinct(F.coalesce("index_name", F.lit(""))), "index_count"),
        _counted(
            constraints, *TABLE, F.count_distinct(F.coalesce("constraint_name", F.lit(""))),
            "constraint_count",
        ),
    )
    joined = reduce(lambda left, right: left.join(right, TABLE, "left"), counts, tables.select(*TABLE))
    return joined.fillna(0, [c for c in joined.columns if c.endswith("_count")])


def table_roles(
    tables: DataFrame, shape: DataFrame, metrics: DataFrame, strict_roles: bool = False
) -> DataFrame:
    """The likely role of each table from its name, shape and references; first rule wins.

    A table of unknown size is not taken for a small one unless ``strict_roles`` asks for it.
    """
    joined = (
        tables.select(*TABLE)
        .join(shape.select(*TABLE, "row_count", "column_count"), TABLE, "left")
        .join(
            metrics.select(*TABLE, "foreign_key_outbound_count", "foreign_key_inbound_count"),
            TABLE, "left",
        )
    )
    name = F.lower("object_name")
    width = F.coalesce("column_count", F.lit(0))
    rows = F.coalesce("row_count", F.lit(0)) if strict_roles else F.col("row_count")
    small = F.coalesce((rows <= 100) & (width <= 12), F.lit(False))
    outbound = F.coalesce("foreign_key_outbound_count", F.lit(0))
    inbound = F.coalesce("foreign_key_inbound_count", F.lit(0))

    def role(category: str, confidence: str, evidence: str) -> Column:
        return F.struct(
            F.lit(category).alias("inferred_category"), F.lit(confidence).alias("confidence"),
            F.lit(evidence).alias("evidence"),
        )

    cases = [
        (name.rlike(pattern), role(category, "MEDIUM", "name pattern"))
        for category, pattern in fixed.ROLE_NAME_PATTERNS
    ] + [
        (
            (outbound >= 2) & (width <= 16),
            role("BRIDGE", "MEDIUM", "multiple outbound FKs and narrow shape"),
        ),
        (name.rlike(fixed.BRIDGE_NAME) & (width <= 16), role("BRIDGE", "LOW", "name and narrow shape")),
        (name.rlike(fixed.LOOKUP_NAME) | small, role("LOOKUP", "LOW", "name or small narrow shape")),
        (name.rlike(fixed.TRANSACTION_NAME), role("TRANSACTION", "MEDIUM", "name pattern")),
        (inbound >= 2, role("MASTER", "LOW", "multiple inbound FK references")),
    ]
    unknown = role("UNKNOWN", "LOW", "insufficient structural evidence")
    chosen = F.coalesce(*[F.when(test, result) for test, result in cases], unknown)
    return (
        joined.withColumn("role", chosen)
        .select(*TABLE, "role.*")
        .withColumn(
            "evidence_class",
            F.when(F.col("inferred_category") == "UNKNOWN", "UNKNOWN").otherwise("INFERENCE"),
        )
    )


def _name_sets(columns: DataFrame) -> DataFrame:
    """Each table with its sorted column names; a schema's names fit a row."""
    return columns.groupBy(*TABLE).agg(
        F.sort_array(F.collect_set(F.lower("column_name"))).alias("names")
    ).withColumn("signature", F.sha2(F.array_join("names", "\x00"), 256))


def _first_of_each(sets: DataFrame) -> DataFrame:
    return sets.groupBy("signature").agg(
        F.min(F.struct(*TABLE)).alias("first"), F.any_value("names").alias("names")
    )


def shape_groups(columns: DataFrame) -> DataFrame:
    """(schema_name, object_name, group_schema, group_object, width): tables with the same set of
    column names share a group, named after the first of them.
    """
    return _groups_of(_name_sets(columns))


def _groups_of(sets: DataFrame) -> DataFrame:
    firsts = sets.groupBy("signature").agg(F.min(F.struct(*TABLE)).alias("first"))
    sized = sets.select(*TABLE, "signature", F.size("names").cast("bigint").alias("width"))
    return sized.join(firsts, "signature").select(
        *TABLE, F.col("first.schema_name").alias("group_schema"),
        F.col("first.object_name").alias("group_object"), "width",
    )


SETS_PER_BUCKET = 1000
#: Keys that a set offers for one width of others, so many names of them it puts together at most.
KEYS_PER_WIDTH = 16
SIMILARITY_COLUMNS = (
    "left_schema", "left_object", "right_schema", "right_object", "shared_names", "similarity",
)


def _names_a_key(spare: int) -> int:
    """How many names a key may hold if the wider set has ``spare`` names more than must be shared."""
    return max([n for n in range(1, KEYS_PER_WIDTH) if comb(spare + n, n) <= KEYS_PER_WIDTH], default=1)


def _choices(spare: Column, size: Column) -> Column:
    """The places of all choices of ``size`` out of the first ``spare + size`` names."""
    most = [_names_a_key(s) for s in range(KEYS_PER_WIDTH)]
    listed = {
        f"{s} {n}": list(combinations(range(s + n), n))
        for s, n in product(range(KEYS_PER_WIDTH), range(2, KEYS_PER_WIDTH)) if n <= most[s] or s == 0
    }
    single = F.transform(F.sequence(F.lit(0), spare.cast("int")), lambda i: F.array(i))
    several = F.from_json(F.lit(json.dumps(listed)), "map<string,array<array<int>>>")
    return F.when(size == 1, single).otherwise(F.try_element_at(several, F.concat_ws(" ", spare, size)))


def _keys(sets: DataFrame, threshold: float) -> DataFrame:
    """The keys under which each set looks for similar ones; see :func:`table_similarity`."""
    width, kept = F.col("width"), (*TABLE, "width", "bits", "names")
    least = F.greatest(F.ceil(width * F.lit(threshold) - F.lit(1e-9)), F.lit(1))
    names = sets.select(*kept, "spreads", least.alias("least"))
    none = F.lit(0).cast("bigint")
    rare = (
        names.select(*kept, "spreads", F.posexplode(F.slice("names", F.lit(1), width - F.col("least") + 1)).alias("place", "name"))
        .where(F.get("spreads", F.col("place")) <= SETS_PER_BUCKET)
        .select(*kept, "place", none.alias("narrow"), none.alias("wide"), F.array("name").alias("key"))
    )
    # as many as there are different widths
    widths = F.array(*[F.lit(r["width"]) for r in sets.select("width").distinct().collect()]).cast("array<bigint>")
    others = F.filter(widths, lambda w: (w >= F.col("least")) & (w * F.lit(threshold) <= width + F.lit(1e-9)))
    shared = F.greatest(F.ceil((width + F.col("other")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)), F.lit(1))
    narrow, wide = F.least("width", "other"), F.greatest("width", "other")
    spare = F.col("wide") - F.col("shared")
    allowed = reduce(
        lambda found, s: found.when(spare == s, _names_a_key(s)), range(1, KEYS_PER_WIDTH), F.when(spare == 0, KEYS_PER_WIDTH - 1)
    ).otherwise(1)
    common = (
        # names are in order of their spread: the last of the prefix tells whether any is common
        names.where(F.get("spreads", (width - F.col("least")).cast("int")) > SETS_PER_BUCKET)
        .select(*kept, "spreads", F.explode(others).alias("other"))
        .select("*", shared.alias("shared"), narrow.alias("narrow"), wide.alias("wide"))
        # different sets of one width share less than all names
        .where((F.col("shared") <= F.col("narrow")) & ((F.col("narrow") < F.col("wide")) | (F.col("shared") < F.col("wide"))))
        .select("*", F.least("shared", allowed).alias("size"))
        .select("*", F.explode(_choices(width - F.col("shared"), F.col("size"))).alias("places"))
        .select("*", F.get("places", F.lit(0)).alias("place"))
        .where(F.get("spreads", F.col("place")) > SETS_PER_BUCKET)
        .select(*kept, "place", "narrow", "wide", F.transform("places", lambda i: F.get("names", i)).alias("key"))
    )
    return rare.unionAll(common).select(F.xxhash64("key").alias("hash"), "*")


def table_similarity(columns: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Tables whose column-name sets reach a Jaccard similarity, without listing all pairs.

    Identical tables form a group (:func:`shape_groups`); each further member is listed once,
    against the first of its group, with similarity 1. Different sets are compared first against
    first; a join with :func:`shape_groups` tells which tables share the row of their firsts.

    Two sets that reach the threshold must share one of their rarest names: names are ordered by
    how many sets have them, and only a prefix of each set has to be joined. Common names such as
    ``id`` are outside nearly every prefix. Where the first name that two sets share is common all the same, they
    meet by more than one: sets of two given widths share so many names at least, so the first n they share are
    among the first n + spare of each, spare being what a set has beyond that number. A set offers every choice of n of
    those, for every width that a similar set may have; n is as large as few choices allow. Narrow sets thus meet by
    all names they share, and hardly any pair is looked at that is not similar. Pairs are verified in the row that found
    them, on the first names they share, so nothing is shuffled after that join. Only tables are compared where
    ``object_type`` tells them from views.
    """
    # a row per table; groups, names and their spread read it, the catalogue is read once
    named = materialize(_name_sets(of_tables(columns)), "name-sets")
    groups = _groups_of(named)
    members = groups.where("schema_name <> group_schema OR object_name <> group_object").select(
        F.col("group_schema").alias("left_schema"), F.col("group_object").alias("left_object"),
        F.col("schema_name").alias("right_schema"), F.col("object_name").alias("right_object"),
        F.col("width").alias("shared_names"), F.lit(1.0).alias("similarity"),
    )
    names = (
        _first_of_each(named)
        .select("first.*", F.size("names").cast("bigint").alias("width"), F.explode("names").alias("name"))
    )
    spread = names.groupBy("name").agg(F.count(F.lit(1)).alias("spread"))
    by_rarity = F.sort_array(F.collect_list(F.struct("spread", "name")))
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(pmod(xxhash64(name), 64) AS INT))")
    # a row per different set; both sides of the join and the sizes of keys read it
    sets = materialize(
        names.join(spread, "name").groupBy(*TABLE, "width").agg(by_rarity.alias("ranked"), F.bit_or(bit).alias("bits"))
        .select(*TABLE, "width", "bits", F.col("ranked.name").alias("names"), F.col("ranked.spread").alias("spreads")),
        "ranked-sets",
    )
    at = ["hash", "narrow", "wide", "key"]
    keys = _keys(sets, threshold)
    # A key of many sets is spread over several buckets: the left side picks one, the right side
    # visits all.
    large = keys.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SETS_PER_BUCKET).select(
        *at, F.ceil(F.col("n") / SETS_PER_BUCKET).alias("buckets"))

    def side(label: str) -> DataFrame:
        # the narrower set of two widths is the left one
        mine = keys.where((F.col("wide") == 0) | (F.col("width") == F.col("narrow" if label == "left" else "wide")))
        buckets = F.coalesce("buckets", F.lit(1).cast("bigint"))
        if label == "left":
            bucket = F.pmod(F.xxhash64(*TABLE), buckets)
        else:
            bucket = F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1))
        return mine.join(large, at, "left").select(
            F.col("schema_name").alias(f"{label}_schema"), F.col("object_name").alias(f"{label}_object"),
            *[F.col(c).alias(f"{label}_{c}") for c in ("width", "bits", "names", "place")],
            *at, bucket.alias("bucket"),
        )

    # The join is small in bytes and large in work: a fixed number of tasks keeps adaptive
    # execution from merging them by size.
    tasks = int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side(label).repartition(tasks, *at, "bucket") for label in ("left", "right"))

    def ordered(one: str, other: str) -> Column:
        return F.coalesce((F.col(f"{one}_schema") < F.col(f"{other}_schema")) | (
            (F.col(f"{one}_schema") == F.col(f"{other}_schema"))
            & (F.col(f"{one}_object") < F.col(f"{other}_object"))
        ), F.lit(False))

    widths = F.col("left_width") + F.col("right_width")
    needed = F.ceil(widths * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    # Three bounds on what two sets can share: what both hold from this name on, and the names of
    # either whose bit the other lacks.
    def bound(one: str, other: str) -> Column:
        missing = F.bit_count(
            F.col(f"{one}_bits").bitwiseAND(F.bitwise_not(F.col(f"{other}_bits")))
        )
        return F.col(f"{one}_width") - missing

    reachable = F.least(
        F.col("left_width") - F.col("left_place"), F.col("right_width") - F.col("right_place"),
        bound("left", "right"), bound("right", "left"),
    )
    both = F.array_intersect("left_names", "right_names")
    first_match = F.slice(both, F.lit(1), F.size("key")) == F.col("key")
    shared = F.size(both).cast("bigint")
    similarity = shared / (widths - shared)
    forward, backward = ordered("left", "right"), ordered("right", "left")
    # sets of two widths have a left one, others are taken in order
    once = forward | (backward & (F.col("narrow") < F.col("wide")))
    # one predicate, so that the cheap bounds are always tested before the lists are read
    similar = F.when(once & (reachable >= needed), F.when(first_match, similarity >= threshold))
    placed = {
        f"{one}_{part}": F.when(forward, F.col(f"{one}_{part}")).otherwise(F.col(f"{other}_{part}"))
        for one, other in (("left", "right"), ("right", "left")) for part in ("schema", "object")
    }
    return (
        left.join(right, [*at, "bucket"])
        .where(F.coalesce(similar, F.lit(False)))
        .withColumns({"shared_names": shared, "similarity": similarity, **placed})
        .select(*SIMILARITY_COLUMNS)
        .unionAll(members.select(*SIMILARITY_COLUMNS))
    )
