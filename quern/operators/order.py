"""Global order without a global sort in one task.

Operators over a whole ordered table (row numbers, running sums) range-partition narrow rows by their key, number
each partition by itself and add what came before, a sum for each partition.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by ``spark.checkpoint.dir``; one of our own only where Spark runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared checkpoint folder (``spark.cleaner.referenceTracking.cleanCheckpoints`` removes it once unused)."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_global_order(df: DataFrame, keys: list[str], size: Column | None = None, index: str = "idx", offset: str = "offset", total: str | None = None, derive: dict[str, Column] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``index``, the rank from 0 by ``keys`` (which must tell rows apart), and ``offset``, the sum of ``size`` before the row.

    Rows are dealt out by range, sorted within a part and kept once with their places, so that ranks can't change when a
    task is run again; only one row for each part meets on the way. Columns to ``derive`` (tokens of a text, say) are computed
    after the rows have moved, just once, and columns to ``drop`` aren't kept; ``size`` may use the derived ones. Running sums
    are made of places and sizes alone and joined back by place.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    for name, column in (derive or {}).items():
        dealt = dealt.withColumn(name, column)
    if size is not None:
        dealt = dealt.withColumn("_size", size.cast("long"))
    dealt = kept(dealt.drop(*drop).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sums = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), (F.sum("_size") if size is not None else F.lit(0)).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = F.broadcast(sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.sum("_s").over(whole).alias("_total")))
    out = dealt.withColumn("_part", part).join(starts, "_part").withColumn(index, (place + F.col("_n0")).cast("long"))
    if size is not None:
        own = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        running = dealt.select("_id", part.alias("_part"), "_size").select("_id", F.coalesce(F.sum("_size").over(own), F.lit(0)).alias("_o"))
        out = out.join(running, "_id").withColumn(offset, (F.col("_o") + F.col("_s0")).cast("long")).drop("_o", "_size")
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_id", "_part", "_n0", "_s0", "_total")
