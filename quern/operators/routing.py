"""Expert routing: top-k choice, load, queue places and second placing of overflowed tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_experts(probs: DataFrame, group: str, token: str, expert: str, p: str, k: int) -> DataFrame:
    """The ``k`` likeliest experts of each token with ``choice`` from 0; ties go to the lower expert."""
    w = Window.partitionBy(group, token).orderBy(F.desc(p), expert)
    return probs.withColumn("choice", F.row_number().over(w) - 1).where(F.col("choice") < k)


def queue_places(chosen: DataFrame, group: str, token: str, expert: str) -> DataFrame:
    """Adds ``place``: how many earlier (token, choice) pairs of the group chose the same expert."""
    w = Window.partitionBy(group, expert).orderBy(token, "choice")
    return chosen.withColumn("place", F.row_number().over(w) - 1)


def expert_load(chosen: DataFrame, group: str, expert: str, experts: int, capacity: int) -> DataFrame:
    """For every expert of each group: ``load, overflow, available``, and whether it is the one with most room (``least_loaded``)."""
    every = chosen.select(group).distinct().withColumn(expert, F.explode(F.sequence(F.lit(0), F.lit(experts - 1))))
    counted = chosen.groupBy(group, expert).agg(F.count(F.lit(1)).alias("load"))
    out = every.join(counted, [group, expert], "left").withColumn("load", F.coalesce("load", F.lit(0)).cast("long"))
    out = out.withColumn("overflow", F.greatest(F.col("load") - capacity, F.lit(0))).withColumn("available", F.greatest(F.lit(capacity) - F.col("load"), F.lit(0)))
    w = Window.partitionBy(group).orderBy(F.desc("available"), expert)
    return out.withColumn("least_loaded", F.row_number().over(w) == 1)


def replace_last(placed: DataFrame, group: str, token: str, expert: str, experts: int, capacity: int, k: int) -> DataFrame:
    """``group, token, choice, expert``: of a token that came too late anywhere, the last choice goes to the expert with the least load of its group."""
    late = placed.groupBy(group, token).agg(F.max(F.col("place") >= capacity).alias("late"))
    least = expert_load(placed, group, expert, experts, capacity).groupBy(group).agg(F.min_by(expert, F.struct("load", expert)).alias("least"))
    out = placed.join(late, [group, token]).join(least, group)
    return out.select(group, token, "choice", F.when(F.col("late") & (F.col("choice") == k - 1), F.col("least")).otherwise(F.col(expert)).alias(expert))


def peeked(df: DataFrame):
    """The first row (or None) and the table, none of whose rows is used up."""
    return df.first(), df


def redistribute(probs: DataFrame, group: str, token: str, expert: str, p: str, k: int, capacity: int, experts: int, boost: float = 0.2) -> DataFrame:
    """``group, token, expert, again``: pairs within capacity, and pairs that tokens over capacity get in experts with room.

    A token that overflowed somewhere may enter any expert it isn't in; one that overflowed everywhere counts ``1 + boost``
    times. An expert with room for a tokens takes those above the (a+1)-th value, so none of a tie that doesn't fit.
    """
    placed = queue_places(top_experts(probs, group, token, expert, p, k), group, token, expert)
    within = placed.where(F.col("place") < capacity).select(group, token, expert)
    over = placed.groupBy(group, token).agg(F.sum(F.when(F.col("place") >= capacity, 1).otherwise(0)).alias("missed")).where("missed > 0")
    room = expert_load(placed, group, expert, experts, capacity).select(group, expert, "available")
    weight = F.when(F.col("missed") == k, 1.0 + boost).otherwise(1.0)
    wanted = probs.join(over, [group, token]).join(within, [group, token, expert], "left_anti").join(room, [group, expert]).withColumn("q", F.col(p) * weight)
    w = Window.partitionBy(group, expert).orderBy(F.desc("q")).rangeBetween(Window.unboundedPreceding, 0)
    taken = wanted.where("q > 0").withColumn("reach", F.count(F.lit(1)).over(w)).where(F.col("reach") <= F.col("available"))
    return within.withColumn("again", F.lit(False)).unionByName(taken.select(group, token, expert).withColumn("again", F.lit(True)))
