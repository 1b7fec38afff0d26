"""References to records that do not exist.

Parent names and child references are brought into one long form, tagged, and grouped
by key. A key whose group lacks a parent that lived during all of its references is
kept; only the references of kept keys are looked at one by one.

Defined cases: null and blank references are no references; a reference whose own
moment is null is judged against all records whatever their times (it is 'missing' or
nothing); a parent without loaded_at has lived since ever. Rows delivered twice count
once. Empty tables give an empty result. Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions.names import name_key

BEGIN = "0001-01-01 00:00:00"
END = "9999-12-31 00:00:00"


def parent_keys(records: DataFrame, deleted: str | None = "deleted_at") -> DataFrame:
    """(key, since, until): one row for each distinct name or alias and life span."""
    until = F.col(deleted) if deleted else F.lit(None)
    names = F.array_compact(
        F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    )
    return (
        records.select(
            F.explode(names).alias("raw"),
            F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), F.lit(BEGIN).cast("timestamp_ntz")).alias("since"),
            F.coalesce(until.cast("timestamp_ntz"), F.lit(END).cast("timestamp_ntz")).alias("until"),
        )
        .select(name_key(F.col("raw")).alias("key"), "since", "until")
        .filter("key <> '' AND since < until")
    )


def child_keys(rows: DataFrame, tab: str, fields: Sequence[str]) -> DataFrame:
    """(key, tab, ord, field, at, month): one row for each non-blank reference."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields]))
    return (
        rows.select("ord", "recorded_at", F.col("loaded_at").cast("timestamp_ntz").alias("at"), pairs.alias("p"))
        .select(
            name_key(F.col("p.raw")).alias("key"),
            F.lit(tab).alias("tab"),
            "ord",
            F.col("p.field").alias("field"),
            "at",
            F.date_trunc("month", "recorded_at").cast("date").alias("month"),
        )
        .filter("key <> ''")
    )


def merged_lives(parents: DataFrame) -> DataFrame:
    """Overlapping or touching life spans of a key become one.

    Spans are merged within each month of birth first, so that a name borne by a large
    part of all records is spread over many tasks; windows stream and spill.
    """

    def once(df: DataFrame, keys: list[str]) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy("since", "until").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*keys).orderBy("since", "until").rowsBetween(Window.unboundedPreceding, 0)
        opens = F.coalesce(F.col("since") > F.max("until").over(before), F.lit(True)).cast("int")
        return (
            df.withColumn("opens", opens)
            .withColumn("run", F.sum("opens").over(upto))
            .groupBy(*keys, "run")
            .agg(F.min("since").alias("since"), F.max("until").alias("until"))
            .drop("run")
        )

    monthly = once(parents.withColumn("born", F.date_trunc("month", "since")), ["key", "born"]).drop("born")
    return once(monthly, ["key"])


def _suspect_keys(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Keys with at least one reference that no parent may cover, with the merged lives of their parents.

    Children enter the group as first and last moment and a count, so the group of a
    hot key is as small as any other after the map-side step.
    """
    ts = "timestamp_ntz"
    long = merged_lives(parents).select(
        "key", F.lit(None).cast(ts).alias("at"), F.struct("since", "until").alias("life")
    ).unionByName(
        children.select("key", "at", F.lit(None).cast("struct<since:timestamp_ntz,until:timestamp_ntz>").alias("life")).withColumn(
            "at", F.coalesce("at", F.lit(END).cast(ts))
        )
    )
    grouped = long.groupBy("key").agg(
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.count("at").alias("n_refs"),
        F.collect_list("life").alias("lives"),
    )
    covered = F.exists("lives", lambda x: (x.since <= F.col("first_at")) & (x.until > F.col("last_at")))
    return grouped.filter((F.col("n_refs") > 0) & ~covered).select("key", "n_refs", "lives")


def orphan_references(parents: DataFrame, children: DataFrame, hot_share: float = 0.002, most_lives: int = 200_000) -> DataFrame:
    """(tab, ord, field, kind, month): one row for each reference without a live parent.

    Keys that hold more than hot_share of all references number at most 1/hot_share; they
    are broadcast to their references if their lives are at most most_lives together. All
    others are joined by key.
    """
    suspects = _suspect_keys(parents, children).persist(StorageLevel.MEMORY_AND_DISK)
    at = F.coalesce(F.col("at"), F.lit(END).cast("timestamp_ntz"))
    undated = F.col("at").isNull()

    n = children.count()
    hot = suspects.filter(F.col("n_refs") > F.lit(max(1000.0, n * hot_share)))
    hot_rows = hot.select("key", F.size("lives").alias("n")).collect()  # at most 1/hot_share rows
    hot_keys = [r.key for r in hot_rows]
    if hot_keys and sum(r.n for r in hot_rows) <= most_lives:
        is_hot = F.col("key").isin(hot_keys)
        joined = children.filter(is_hot).join(F.broadcast(hot), "key").unionByName(
            children.filter(~is_hot).join(suspects.filter(~is_hot), "key")
        )
    else:
        joined = children.join(suspects, "key")
    alive = F.exists("lives", lambda x: (x.since <= at) & (x.until > at))
    later = F.forall("lives", lambda x: x.since > at)
    kind = (
        F.when(F.size("lives") == 0, "missing")
        .when(undated, F.lit(None))
        .when(alive, F.lit(None))
        .when(later, "late")
        .otherwise("deleted")
    )
    return (
        joined.select("tab", "ord", "field", kind.alias("kind"), "month")
        .filter("kind IS NOT NULL")
        .distinct()
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Number of orphan references for each table, field, month of recording and kind."""
    return found.groupBy("tab", "field", "month", "kind").agg(F.count("*").alias("n_refs"))
