"""Next-fit packing of token sequences into fixed lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import autoregressive_inputs, filled
from quern.operators.order import with_global_order


def packing_groups(df: DataFrame, partition: list[str], keys: list[str], examples: int) -> DataFrame:
    """Adds ``idx`` (rank within the partition) and ``block`` of ``examples`` rows; bins never span blocks."""
    ranked = with_global_order(df, [*partition, *keys])
    first = ranked.groupBy(*partition).agg(F.min("idx").alias("_first")) if partition else ranked.agg(F.min("idx").alias("_first"))
    joined = ranked.join(first, partition) if partition else ranked.crossJoin(F.broadcast(first))  # without a partition one row
    return joined.withColumn("idx", F.col("idx") - F.col("_first")).withColumn("block", F.floor(F.col("idx") / examples).cast("long")).drop("_first")


def next_fit(grouped: DataFrame, group: list[str], carry: list[str], sizes: dict[str, Column], lengths: dict[str, int]) -> DataFrame:
    """``bin``, ``off_<feature>`` and ``n_<feature>`` of each row: rows go in order of ``idx`` into the open bin, and a row of
    which any feature would overflow its length opens the next one. A group is one pass over its rows' numbers."""
    names = list(sizes)
    narrow = grouped.select(*group, "idx", *carry, *[F.least(sizes[n], F.lit(lengths[n])).cast("int").alias(f"n_{n}") for n in names])
    most = np.array([lengths[n] for n in names], np.int64)
    kept = [*group, "idx", *carry]

    def fold(got: pa.Table) -> pa.Table:
        got = got.take(pc.sort_indices(got, [("idx", "ascending")]))
        size = np.stack([np.asarray(got.column(f"n_{n}")) for n in names], axis=1).astype(np.int64)
        bins, offsets, at, number = np.zeros(len(size), np.int32), np.zeros_like(size), np.zeros_like(most), 0
        for i, n in enumerate(size):
            if (at + n > most).any():
                number, at = number + 1, np.zeros_like(most)
            bins[i], offsets[i] = number, at
            at = at + n
        out = {c: got.column(c) for c in kept} | {"bin": pa.array(bins)}
        for j, n in enumerate(names):
            out |= {f"off_{n}": pa.array(offsets[:, j].astype(np.int32)), f"n_{n}": got.column(f"n_{n}")}
        return pa.table(out)

    schema = ", ".join([*(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in kept), "bin int", *(f"off_{n} int, n_{n} int" for n in names)])
    return narrow.groupBy(*group).applyInArrow(fold, schema)


def assemble(placed: DataFrame, group: list[str], tokens: str, length: int, pad: int = -1, bos: int = 0, parallel: dict[str, int] | None = None, index: str | None = None, more: dict[str, int] | None = None) -> DataFrame:
    """Bins as arrays of ``length``: targets, segment ids (from 1, 0 is padding), positions and shifted inputs.

    ``parallel``: columns as long as the tokens (loss weights), each with its padding. ``more``: features of their own
    (images), each with its length, end to end and padded by nothing. ``index``: nested positions among the tokens, moved by
    what stands before them in the bin (``off_<tokens>`` of :func:`next_fit`).
    """
    parallel, more = parallel or {}, more or {}
    fields = [F.slice(tokens, 1, length).alias("x"), *[F.slice(c, 1, length).alias(c) for c in parallel], *[F.slice(c, 1, n).alias(c) for c, n in more.items()]]
    if index:
        fields.append(rebase_index(F.col(index), F.col(f"off_{tokens}")).alias(index))
    bins = placed.groupBy(*group, "bin").agg(F.array_sort(F.collect_list(F.struct(F.col("idx"), F.struct(*fields).alias("v"))), lambda a, b: (a["idx"] - b["idx"]).cast("int")).alias("parts"))
    flat = lambda c: F.flatten(F.transform("parts", lambda p: p["v"][c]))
    segment = F.flatten(F.transform("parts", lambda p, i: filled(i + 1, F.size(p["v"]["x"]))))
    position = F.flatten(F.transform("parts", lambda p: F.when(F.size(p["v"]["x"]) > 0, F.sequence(F.lit(0), F.size(p["v"]["x"]) - 1)).otherwise(F.array().cast("array<int>"))))
    out = bins.withColumn("flat", flat("x")).withColumn("seg", segment).withColumn("pos", position)
    room = F.lit(length) - F.size("flat")
    rest = [F.concat(flat(c), filled(F.lit(p).cast(placed.schema[c].dataType.elementType), room)).alias(c) for c, p in parallel.items()]
    rest += [flat(c).alias(c) for c in [*more, *([index] if index else [])]]
    out = out.select(*group, "bin", F.concat("flat", filled(pad, room)).alias("targets"), F.concat("seg", filled(0, room)).alias("segment_ids"), F.concat("pos", filled(pad, room)).alias("positions"), *rest)
    return out.withColumn("inputs", autoregressive_inputs(F.col("targets"), F.col("segment_ids"), bos))


def rebase_index(index: Column, offset: Column) -> Column:
    """Nested positions moved by the tokens that stand before them in the bin."""
    return F.transform(index, lambda row: F.transform(row, lambda v: v + offset))


def strip_packed_name(name: str) -> str:
    return name.removesuffix("_segment_ids").removesuffix("_positions")
