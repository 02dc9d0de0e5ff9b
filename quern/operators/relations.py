"""Splitting, sharding, batching and mixing of tables in an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.arrays import hashed_uniform
from quern.operators.order import with_global_order


def global_shards(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """Adds ``idx`` and ``shard``: equal runs of ``ceil(total / shards)`` rows in order; the last shards may stay empty."""
    ranked = with_global_order(df, keys, F.lit(1), total="_rows")
    return ranked.withColumn("shard", F.floor(F.col("idx") / F.ceil(F.col("_rows") / shards)).cast("int")).drop("offset", "_rows")


def row_range(df: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """Rows whose rank lies in ``[start, end)``."""
    return with_global_order(df, keys).where((F.col("idx") >= start) & (F.col("idx") < end))


def even_chunks(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Adds ``chunk``: ``n`` runs in order whose sizes differ by one at most, the longer ones first."""
    ranked = with_global_order(df, keys, F.lit(1), total="_rows")
    return ranked.withColumn("chunk", _even(F.col("idx"), F.col("_rows"), F.lit(n))).drop("offset", "_rows")


def _even(i: Column, total: Column, n: Column) -> Column:
    base, more = F.floor(total / n), F.pmod(total, n)
    head = more * (base + 1)
    return F.when(i < head, F.floor(i / (base + 1))).otherwise(more + F.floor((i - head) / F.greatest(base, F.lit(1)))).cast("int")


def bounded_chunks(df: DataFrame, keys: list[str], most: int, n: int) -> DataFrame:
    """Adds ``block`` (runs of ``most`` rows) and ``chunk``, the block in ``n`` even runs."""
    ranked = with_global_order(df, keys, F.lit(1), total="_rows").withColumn("block", F.floor(F.col("idx") / most).cast("int"))
    size = F.least(F.lit(most), F.col("_rows") - F.col("block") * most)
    return ranked.withColumn("chunk", _even(F.col("idx") - F.col("block") * most, size, F.lit(n))).drop("offset", "_rows")


def modulo_shard(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    return with_global_order(df, keys).withColumn("shard", F.pmod("idx", F.lit(shards)).cast("int"))


def batched(df: DataFrame, keys: list[str], size: int, drop_remainder: bool = False) -> DataFrame:
    """Adds ``idx`` and ``batch`` of ``size`` rows; the last, shorter one can be dropped."""
    out = with_global_order(df, keys, F.lit(1), total="_rows").withColumn("batch", F.floor(F.col("idx") / size).cast("long"))
    if drop_remainder:
        out = out.where((F.col("batch") + 1) * size <= F.col("_rows"))
    return out.drop("offset", "_rows")


def pad_to_multiple(df: DataFrame, keys: list[str], multiple: int) -> DataFrame:
    """All rows with ``valid`` true, and copies of the first row with ``valid`` false until the count is a multiple."""
    first = df.orderBy(*keys).limit(1)
    missing = -df.count() % multiple
    copies = first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(missing)))) if missing else first.limit(0).withColumn("copy", F.lit(0))
    return df.withColumn("copy", F.lit(0)).withColumn("valid", F.lit(True)).unionByName(copies.withColumn("valid", F.lit(False)))


def group_concat(df: DataFrame, keys: list[str], tokens: str, group: int, strip_zero: bool = False, encode: Column | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``gid, tokens``: the tokens of each ``group`` consecutive rows end to end; ``encode`` makes them once the rows are in order."""
    ready = df.select(*keys, tokens) if encode is None or tokens in df.columns else df
    numbered = with_global_order(ready, keys, derive=None if encode is None else {tokens: encode}, drop=drop).withColumn("gid", F.floor(F.col("idx") / group).cast("long"))
    joined = numbered.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("idx", F.col(tokens).alias("x")))).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: p["x"]))
    return joined.select("gid", (F.filter(flat, lambda v: v != 0) if strip_zero else flat).alias(tokens))


def mixture_rates(rates: list[tuple[str, float]], on_duplicate: str = "error") -> dict[str, float]:
    """Rates by task; a task named twice is an error or, if asked, gets the sum."""
    out: dict[str, float] = {}
    for name, rate in rates:
        if name in out and on_duplicate != "sum":
            raise ValueError(f"{name} stands twice in the mixture")
        if rate < 0:
            raise ValueError(f"{name} has a negative rate")
        out[name] = out.get(name, 0.0) + rate
    return out


def interleave(df: DataFrame, task: str, keys: list[str], rates: dict[str, float]) -> DataFrame:
    """Adds ``slot``, a virtual time at which each row of a task is due: the n-th row of a task of rate r at n / r.

    Ordering by ``slot`` mixes tasks in proportion to their rates, whatever the number of tasks that run it. Tasks
    without a rate, or with rate 0, drop out. Rows of one task are numbered range by range, so a large task is spread.
    """
    rate = F.create_map(*[F.lit(v) for name, r in rates.items() for v in (name, float(r))])
    some = df.withColumn("rate", F.element_at(rate, F.col(task))).where("rate > 0")
    ranked = with_global_order(some, [task, *keys])
    first = ranked.groupBy(task).agg(F.min("idx").alias("_first"))  # one row for each rate that was given
    return ranked.join(F.broadcast(first), task).withColumn("slot", F.round((F.col("idx") - F.col("_first") + 1) / F.col("rate"), 9)).drop("idx", "_first")


def epochs(df: DataFrame, n: int, key: Column, seed: int | None = None) -> DataFrame:
    """Every row once for each epoch; with a seed also ``place``, by which an epoch's rows are shuffled."""
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out if seed is None else out.withColumn("place", hashed_uniform(key * F.lit(31) + F.col("epoch"), seed))


def shuffled_shards(df: DataFrame, key: Column, keys: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Adds ``shard`` and ``place``: a shuffle by hash of the key, dealt out in equal runs of the shuffled order."""
    return global_shards(df.withColumn("place", hashed_uniform(key, seed)), ["place", *keys], shards).drop("idx")


def first_n(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Adds ``split``: ``validation`` for the first ``n`` rows, else ``train``."""
    return with_global_order(df, keys).withColumn("split", F.when(F.col("idx") < n, "validation").otherwise("train"))


def zipped(df: DataFrame, columns: list[str], index: str | None = None) -> DataFrame:
    """Parallel array columns as rows, as many as the shortest has; other columns are replicated."""
    n = F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    cut = [F.slice(c, F.lit(1), F.greatest(n, F.lit(0))).alias(c) for c in columns]
    rest = [c for c in df.columns if c not in columns]
    out = df.select(*rest, F.posexplode(F.arrays_zip(*cut)).alias("_pos", "_row"))
    return out.select(*rest, *([F.col("_pos").alias(index)] if index else []), *[F.col(f"_row.{c}").alias(c) for c in columns])


def running_average(df: DataFrame, partition: list[str], keys: list[str], value: Column, rows: int) -> DataFrame:
    """Adds ``moving``, the mean of ``value`` over the last ``rows`` rows."""
    w = Window.partitionBy(*partition).orderBy(*keys).rowsBetween(-(rows - 1), 0)
    return df.withColumn("moving", F.avg(value).over(w))
