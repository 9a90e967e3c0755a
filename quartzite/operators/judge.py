"""The judgement of proposed writes: what a write newly violates, how hard each rule is, and approvals that let one escalated write through.

An approval is a token of one write (its path and content). It waits until that write is asked for again and is spent by it: whether a token
is pending is what came last under it, an approval or a write that asked. A write with a hard denial asks for nothing and spends nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_violations(now: DataFrame, before: DataFrame) -> DataFrame:
    """Of each write, rule and message the occurrences in ``now`` beyond those in ``before`` (write, rule_id, message): what the old content had
    already isn't held against the write."""
    keys = ["write", "rule_id", "message"]
    had = before.groupBy(*keys).agg(F.count("*").alias("had"))
    order = Window.partitionBy(*keys).orderBy("enforcement")
    return now.withColumn("nth", F.row_number().over(order)).join(had, keys, "left").where(F.col("nth") > F.coalesce("had", F.lit(0))).drop("nth", "had")


def verdicts(writes: DataFrame, violations: DataFrame, approvals: DataFrame) -> DataFrame:
    """``write, verdict``: deny where a rule denies, escalate where one asks for a person and no approval is pending, approved where one was, else
    allow. ``writes``: write, seq, token; ``violations``: write, enforcement (Deny, Escalate, Warn); ``approvals``: seq, token, before a write of equal seq."""
    hard = violations.groupBy("write").agg(F.bool_or(F.col("enforcement") == "Deny").alias("hard"), F.bool_or(F.col("enforcement") == "Escalate").alias("soft"))
    w = writes.join(hard, "write", "left").withColumn("asks", F.coalesce(F.col("soft") & ~F.col("hard"), F.lit(False)))
    events = w.where("asks").select("token", "seq", F.lit(1).alias("kind"), "write").unionByName(approvals.select("token", "seq", F.lit(0).alias("kind"), F.lit(None).cast(writes.schema["write"].dataType).alias("write")))
    last = F.lag("kind").over(Window.partitionBy("token").orderBy("seq", "kind", "write"))
    spent = events.withColumn("spent", last == 0).where("kind = 1").select("write", "spent")
    verdict = F.when(F.coalesce("hard", F.lit(False)), "deny").when(~F.col("asks"), "allow").when(F.coalesce("spent", F.lit(False)), "approved").otherwise("escalate")
    return w.join(spent, "write", "left").select("write", verdict.alias("verdict"))
