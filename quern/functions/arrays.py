"""Column functions over token arrays: shifting, padding, slicing, appending, masks.

All are built-in expressions.  ``pad`` is a parameter everywhere, and lengths are explicit: no value is taken for
padding because it equals the pad.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` or a lambda within it uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def lit_ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>") if values else F.array().cast("array<int>")


def filled(value, n: Column) -> Column:
    """``n`` copies of a value, none if ``n`` is negative."""
    return F.array_repeat(F.lit(value) if not isinstance(value, Column) else value, F.greatest(n, F.lit(0)).cast("int"))


def append(x: Column, *values: int) -> Column:
    return F.concat(x, lit_ints(list(values)))


def append_innermost(x: Column, value: int, depth: int = 1) -> Column:
    """Appends to the innermost arrays of an array nested ``depth`` deep."""
    return F.concat(x, lit_ints([value])) if depth == 1 else F.transform(x, lambda y: append_innermost(y, value, depth - 1))


def shift_right(x: Column, first: int = 0) -> Column:
    """The array moved by one place with ``first`` in front; an empty array stays empty."""
    return F.when(F.size(x) > 0, F.concat(lit_ints([first]), F.slice(x, F.lit(1), F.size(x) - 1))).otherwise(x)


def autoregressive_inputs(targets: Column, segments: Column | None = None, bos: int = 0) -> Column:
    """Targets shifted right; wherever the segment changes (the first padded place too) stands ``bos``."""
    if segments is None:
        return shift_right(targets, bos)
    before = shift_right(segments, -(2**31))  # no segment has this id, so the first place is a change
    change = F.zip_with(segments, before, lambda a, b: a != b)
    return F.zip_with(shift_right(targets, bos), change, lambda v, c: F.when(c, F.lit(bos)).otherwise(v))


def trim_pad(x: Column, length: int, pad=-1) -> Column:
    kept = F.slice(x, 1, length)
    return F.concat(kept, filled(pad, F.lit(length) - F.size(kept)))


def trim_pad_left(x: Column, length: int, pad: int) -> Column:
    """The last ``length`` values, padded on the left."""
    n = F.least(F.size(x), F.lit(length))
    return F.concat(filled(pad, F.lit(length) - n), F.when(n > 0, F.slice(x, -n, n)).otherwise(x))


def trim_pad_nested(x: Column, lengths: list[int], pad=-1) -> Column:
    """Trims and pads each axis to its length."""
    if len(lengths) == 1:
        return trim_pad(x, lengths[0], pad)
    inner = F.transform(x, lambda y: trim_pad_nested(y, lengths[1:], pad))
    blank = F.lit(pad)
    for n in reversed(lengths[1:]):
        blank = F.array_repeat(blank, n)
    kept = F.slice(inner, 1, lengths[0])
    return F.concat(kept, F.array_repeat(blank, F.greatest(F.lit(lengths[0]) - F.size(kept), F.lit(0))))


@F.arrow_udf(ArrayType(LongType()))
def _running(x: pa.Array) -> pa.Array:
    lists = x if isinstance(x, pa.ListArray) else x.combine_chunks()
    at = np.asarray(lists.offsets, np.int64)
    total = np.concatenate([[0], np.cumsum(np.asarray(lists.values.fill_null(0), np.int64))])
    flat = total[at[0] + 1 : at[-1] + 1] - np.repeat(total[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(flat), mask=pa.compute.is_null(lists) if lists.null_count else None)


def prefix_sums(x: Column) -> Column:
    """Running sums of an integer array, in time linear in its length (an expression would copy the array at each step)."""
    return _running(x.cast("array<bigint>"))


def position_ids(mask: Column, clamp: bool = False) -> Column:
    """Running sum of a 0/1 mask less one; ``clamp`` keeps it from going below 0."""
    p = F.transform(prefix_sums(mask), lambda v: v - 1)
    return F.transform(p, lambda v: F.greatest(v, F.lit(0).cast("bigint"))) if clamp else p


def segments_of(x: Column, length: Column | int) -> Column:
    """The array in pieces of ``length``, the last one shorter; an empty array has none."""
    length = F.lit(length) if isinstance(length, int) else length
    n = F.ceil(F.size(x) / length).cast("int")
    return F.when(F.size(x) > 0, let(x, lambda y: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(y, i * length + 1, length))))


def is_padding(x: Column, *pads: int) -> Column:
    """For each value 1 if it is none of the pads, else 0."""
    return F.transform(x, lambda v: F.when(v.isin(*pads), 0).otherwise(1))


def lengths_agree(df: DataFrame, tokens: str, others: list[str]) -> DataFrame:
    """The rows; one with another array of another length than its tokens fails when it is read."""
    for c in others:
        wrong = F.raise_error(F.lit(f"{c} has another length than {tokens}")).cast("boolean")
        df = df.where(F.coalesce(F.when(F.size(c) != F.size(tokens), wrong), F.lit(True)))
    return df


def same_length(*columns: Column) -> Column:
    """True if arrays that belong together have one length."""
    out = F.lit(True)
    for c in columns[1:]:
        out = out & (F.size(c) == F.size(columns[0]))
    return out


def digest(x: Column) -> Column:
    """A short text that stands for an array in results."""
    return F.md5(F.array_join(x.cast("array<string>"), " "))


def hashed_uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, so that retries agree."""
    small = F.pmod(key.cast("long"), F.lit(2147483648))  # so that no key, however large, overflows
    mixed = F.pmod(small * F.lit(1103515245) + F.lit(seed * 12345 + 6789), F.lit(2147483648))
    mixed = F.pmod(mixed * F.lit(69069) + F.lit(1), F.lit(2147483648))
    return mixed / F.lit(2147483648.0)


def hashed_uniform_sql(key: str, seed: int = 0) -> str:
    """The same as SQL."""
    return f"(((((({key}) * 1103515245 + {seed * 12345 + 6789}) % 2147483648) * 69069 + 1) % 2147483648) / 2147483648.0::DOUBLE)"


def choose(options: Column, key: Column, seed: int = 0) -> Column:
    """One of an array's values by hash of the key; null if there is none."""
    return F.get(options, F.floor(hashed_uniform(key, seed) * F.size(options)).cast("int"))


def sample_marked(mask: Column, n: int, key: Column, seed: int = 0) -> Column:
    """``n`` places of a 0/1 mask in shuffled order, the marked ones first; all places if there are fewer."""
    ranked = F.transform(mask, lambda m, i: F.struct((F.lit(1) - m).alias("last"), hashed_uniform(key * F.lit(4096) + i, seed).alias("u"), i.alias("i")))
    return F.slice(F.transform(F.array_sort(ranked), lambda r: r["i"]), 1, n)


def length_budget(length: int, add_eos: bool) -> int:
    """Tokens of a text that leave room for the end of sequence."""
    if length - add_eos < 1:
        raise ValueError("no room for any token")
    return length - int(add_eos)


def mixed_radix(index: int, sizes: list[int]) -> list[int]:
    """Coordinates of the ``index``-th cell of a grid, the last axis running fastest."""
    out = []
    for n in reversed(sizes):
        out.append(index % n)
        index //= n
    if index:
        raise ValueError("the index lies outside the grid")
    return out[::-1]
