"""Duplicates, caps and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions.normalize import job_id
from matchspark.schema import REFRESHED


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_within_fetch(rows: DataFrame, order: tuple = ("page", "position")) -> DataFrame:
    """First occurrence of a posting across the pages of a fetch."""
    return first_per_key(rows, ["source", "source_job_id"], list(order))


def dedup_within_run(rows: DataFrame, order: tuple = ("source", "query", "position"), keep_all: bool = False) -> DataFrame:
    """First occurrence of a dedup_hash across sources; keep_all for plain ingestion."""
    return rows if keep_all else first_per_key(rows, ["dedup_hash"], list(order))


def interleave_round_robin(rows: DataFrame, group: str, group_order: str | Column, order: list, limit: int | None = None) -> DataFrame:
    """Each group's first row before any group's second, with ``turn``; the limit is the feature."""
    turned = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if limit is None:
        return turned
    # a group gives at most ``limit`` rows, so the top-k below sees little
    return turned.where(F.col("turn") <= limit).orderBy("turn", group_order, *order).limit(limit)


def cap_results(rows: DataFrame, key: list[str], order: list, most: Column | int) -> DataFrame:
    """At most ``most`` rows (a number or a column) of each key."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("_n") <= most).drop("_n")


def split_budget(most: Column, queries: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(most / F.greatest(queries, F.lit(1))).cast("int"))


def upsert_jobs(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The state after ``incoming`` (with fetched_at and seq), one row a (source, source_job_id).

    The last incoming version wins, its nulls too; of versions with one time and
    seq the first in the order of what they say, null before all. job_id is that
    of the current row, or made from the key. is_new marks keys that current did
    not hold.
    """
    key = ["source", "source_job_id"]
    shared = [c for c in REFRESHED if c in incoming.columns and c in current.columns]
    last = first_per_key(incoming, key, [F.desc("fetched_at"), F.desc("seq"), *(F.asc_nulls_first(c) for c in shared if c != "fetched_at")])
    old, new = current.withColumn("_old", F.lit(True)).alias("o"), last.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, key, "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    rest = [c for c in current.columns if c not in [*key, "job_id", *shared]]
    return joined.select(*key, F.coalesce("o.job_id", job_id(F.col("source"), F.col("source_job_id"))).alias("job_id"), *(pick(c) for c in shared), *(F.col(f"o.{c}").alias(c) for c in rest), F.col("_old").isNull().alias("is_new"))


def upsert_matches(current: DataFrame, scored: DataFrame, kept: tuple = ("explanation", "created_at")) -> DataFrame:
    """The state after a re-score: scored columns are replaced, explanation and created_at of known pairs stay."""
    key = ["resume_id", "job_id"]
    old, new = current.alias("o"), scored.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, key, "full_outer")

    def pick(c: str) -> Column:
        if c not in scored.columns:
            return F.col(f"o.{c}").alias(c)
        if c in kept:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*key, *(pick(c) for c in current.columns if c not in key))


def insert_if_absent(current: DataFrame, incoming: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """The incoming rows to append: the first of each key (in an order, else that of all other columns) that current does not hold."""
    order = order or [c for c in incoming.columns if c not in key] or [F.lit(0)]
    return first_per_key(incoming, key, order).join(current.select(*key), key, "left_anti")


def invalidate_matches(matches: DataFrame, changed: DataFrame) -> DataFrame:
    """Matches without those of résumés whose skills changed."""
    return matches.join(changed.select("resume_id").distinct(), "resume_id", "left_anti")
