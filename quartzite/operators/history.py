"""New and old issues, bags, baselines, profiles, streaks: what compares one state with another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(now: DataFrame, then: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows of ``now`` that no row of ``then`` matches under any of the keys."""
    for k in keys:
        now = now.join(then.select(*k).distinct(), k, "left_anti")
    return now


def bag_subtract(now: DataFrame, then: DataFrame, keys: list[str]) -> DataFrame:
    """The occurrences of a key beyond those it had."""
    return now.select(*keys).exceptAll(then.select(*keys))


def as_of(rows: DataFrame, cutoff: Column, by: list[str], at: str, value: str) -> DataFrame:
    """The value at or before the cutoff, by key."""
    return rows.where(F.col(at) <= cutoff).groupBy(*by).agg(F.max_by(value, F.struct(at, value)).alias(value), F.max(at).alias(at))


def effective_profile(chain: DataFrame) -> DataFrame:
    """``rule_id, severity`` of activations with their depth from the profile: the nearest wins."""
    return chain.groupBy("rule_id").agg(F.min_by("severity", "depth").alias("severity"))


def profile_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``rule_id, change``: in one only, or in both with another severity."""
    both = a.select("rule_id", F.col("severity").alias("sa")).join(b.select("rule_id", F.col("severity").alias("sb")), "rule_id", "full")
    change = F.when(F.col("sb").isNull(), "only_a").when(F.col("sa").isNull(), "only_b").when(F.col("sa") != F.col("sb"), "changed")
    return both.select("rule_id", change.alias("change")).where("change is not null")


def streaks(events: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """The running count of consecutive hits of a key, 0 on any other event."""
    w = Window.partitionBy(key).orderBy(*order)
    group = events.withColumn("_hit", hit).withColumn("_island", F.sum(F.when(~F.col("_hit"), 1).otherwise(0)).over(w))
    run = Window.partitionBy(key, "_island").orderBy(*order)
    return group.withColumn("streak", F.when(F.col("_hit"), F.sum(F.col("_hit").cast("long")).over(run)).otherwise(0)).drop("_hit", "_island")


def repeats(events: DataFrame, key: str, order: list[str], signature: Column) -> DataFrame:
    """How often the signature of an event has now come in a row."""
    w = Window.partitionBy(key).orderBy(*order)
    change = events.withColumn("_s", signature).withColumn("_new", F.coalesce((F.col("_s") != F.lag("_s").over(w)).cast("int"), F.lit(1)))
    group = change.withColumn("_run", F.sum("_new").over(w))
    return group.withColumn("in_a_row", F.count("*").over(Window.partitionBy(key, "_run").orderBy(*order))).drop("_s", "_new", "_run")


def seen_before(events: DataFrame, key: str, order: list[str], what: str) -> DataFrame:
    """Whether ``what`` occurred in an earlier event of the key; the event itself is recorded after the lookup."""
    w = Window.partitionBy(key, what).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("seen_before", F.count("*").over(w) > 0)


def pending(events: DataFrame, key: str, order: list[str], clears: Column) -> DataFrame:
    """Events after the last clearing one of their key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return events.withColumn("_c", clears).withColumn("_later", F.max(F.col("_c").cast("int")).over(w)).where("_later = 0").drop("_c", "_later")


def worst_by_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)
