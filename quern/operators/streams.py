"""Token streams cut into batches: all documents end to end, in fixed pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import append, hashed_uniform, lengths_agree, let
from quern.operators.order import with_global_order
from quern.operators.relations import group_concat


def concat_and_chunk(df: DataFrame, keys: list[str], tokens: str, rows: int, length: int, bos: int | None = None, masks: str | None = None, derive: dict[str, Column] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``chunk, inputs, targets`` (and ``loss_masks``): chunk c has tokens [c BL, c BL + BL) and their successors, for B rows of L tokens.

    Chunk c exists if more than ``(c + 1) BL + 1`` tokens do; the tail waits. Documents are cut at offsets that running
    sums give, so no array is longer than a document or a chunk. ``bos`` overwrites the first input of each row. A column
    of ``masks``, as long as the tokens, is cut alike, and loss masks are those of the targets. ``derive`` and ``drop``:
    columns made once the rows are in order (:func:`with_global_order`), so that texts are encoded once.
    """
    size = rows * length
    placed = with_global_order(df, keys, F.size(tokens), total="all_tokens", derive=derive, drop=drop).where(F.size(tokens) > 0)
    if masks:
        placed = lengths_agree(placed, tokens, [masks])
    first = F.greatest(F.floor((F.col("offset") - 1) / size), F.lit(0))
    last = F.floor((F.col("offset") + F.size(tokens) - 1) / size)
    pieces = placed.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long")))).where(F.col("all_tokens") > (F.col("chunk") + 1) * size + 1)
    start = F.greatest(F.col("chunk") * size - F.col("offset"), F.lit(0)).cast("int")
    end = F.least((F.col("chunk") + 1) * size + 1 - F.col("offset"), F.size(tokens).cast("long")).cast("int")
    piece = lambda c: F.slice(c, start + 1, end - start)
    cut = pieces.where(end > start).select("chunk", "idx", piece(tokens).alias("x"), *([piece(masks).alias("m")] if masks else []))
    chunks = cut.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "x", *(["m"] if masks else [])))).alias("parts"))
    flat = lambda name: F.flatten(F.transform("parts", lambda p: p[name]))
    chunks = chunks.select("chunk", flat("x").alias("flat"), *([flat("m").alias("mask")] if masks else []))
    inputs = F.slice("flat", 1, size)
    if bos is not None:
        inputs = F.transform(inputs, lambda v, i: F.when(i % length == 0, F.lit(bos)).otherwise(v))
    return chunks.select("chunk", inputs.alias("inputs"), F.slice("flat", 2, size).alias("targets"), *([F.slice("mask", 2, size).alias("loss_masks")] if masks else []))


def epoch_chunks(df: DataFrame, keys: list[str], tokens: str, rows: int, length: int, epochs: int, carry_tail: bool = True, masks: str | None = None) -> DataFrame:
    """Several passes over the documents as one stream of chunks: ``epoch, chunk, inputs, targets`` (and ``loss_masks``).

    With ``carry_tail`` the tail of a pass goes before the next one's tokens (``epoch`` is then that of none, 0);
    without it every pass begins anew and its tail is lost.
    """
    if carry_tail:
        passes = df.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        return concat_and_chunk(passes, ["_epoch", *keys], tokens, rows, length, masks=masks).select(F.lit(0).alias("epoch"), "*")
    once = concat_and_chunk(df, keys, tokens, rows, length, masks=masks)
    return once.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "*")


def stream_totals(df: DataFrame, keys: list[str], tokens: str, rows: int, length: int) -> DataFrame:
    """For each document the running totals of tokens and of chunks that are complete after it."""
    placed = with_global_order(df.select(*keys, F.size(tokens).alias("_n")), keys, F.col("_n"))
    total = F.col("offset") + F.col("_n")
    ready = F.greatest(F.floor((total - 2) / (rows * length)), F.lit(0))
    return placed.select(*keys, F.col("idx").alias("example_index"), total.cast("long").alias("total_tokens"), ready.cast("long").alias("chunks"))


def chunk_bounds(n: Column, length: Column | int, uniform: Column, uniform_start: bool = False) -> tuple[Column, Column]:
    """Start and size of a piece of at most ``length`` of ``n`` values: one of the aligned pieces, or with ``uniform_start`` one that may hang over either end."""
    length = F.lit(length) if isinstance(length, int) else length
    if uniform_start:
        start = F.floor(uniform * (n + length - 1)).cast("int") - (length - 1)
        end = F.least(start + length, n)
        start = F.greatest(start, F.lit(0))
        return start, end - start
    return (F.floor(uniform * F.ceil(n / length)) * length).cast("int"), length


def random_chunk(tokens, length: int, uniform, uniform_start: bool = False):
    start, size = chunk_bounds(F.size(tokens), length, uniform, uniform_start)
    return F.slice(tokens, start + 1, size)


def _apart(cut: list[str], kept: list[str] | None) -> None:
    both = set(cut) & set(kept or [])
    if both:
        raise ValueError(f"{sorted(both)} can't be both cut and passed through")


def random_chunks(df: DataFrame, tokens: str, length: int, key: Column, parallel: list[str] | None = None, passthrough: list[str] | None = None, min_length: int | None = None, uniform_start: bool = False, seed: int = 0) -> DataFrame:
    """Each row with one chunk of its tokens, chosen by hash of the key; rows without tokens drop out.

    ``parallel`` columns, as long as the tokens, are cut alike. With ``min_length`` the length is drawn from
    [min_length, length). Only the cut columns and those of ``passthrough`` stay (all, if it is None).
    """
    cut = [tokens, *(parallel or [])]
    _apart(cut, passthrough)
    some = lengths_agree(df.where(F.size(tokens) > 0), tokens, parallel or [])
    size = F.lit(length) if min_length is None else (F.lit(min_length) + F.floor(hashed_uniform(key, seed + 1) * (length - min_length))).cast("int")
    bounds = let(size, lambda n: F.struct(*[b.alias(c) for b, c in zip(chunk_bounds(F.size(tokens), n, hashed_uniform(key, seed), uniform_start), ("start", "size"), strict=True)]))
    rest = [c for c in (df.columns if passthrough is None else passthrough) if c not in cut]
    return some.withColumn("_b", bounds).select(*rest, *[F.slice(c, F.col("_b.start") + 1, F.col("_b.size")).alias(c) for c in cut])


def split_rows(df: DataFrame, tokens: str, length, seg: str = "seg", parallel: list[str] | None = None, passthrough: list[str] | None = None) -> DataFrame:
    """A row for each piece of ``length`` tokens (a number or a column); rows without tokens drop out.

    ``parallel`` columns, as long as the tokens, are cut alike; other columns are replicated (all, or those of ``passthrough``).
    """
    cut = [tokens, *(parallel or [])]
    _apart(cut, passthrough)
    length = F.lit(length) if isinstance(length, int) else length
    some = lengths_agree(df.where(F.size(tokens) > 0), tokens, parallel or []).withColumn("_length", length.cast("int"))
    each = some.withColumn(seg, F.explode(F.sequence(F.lit(0), F.ceil(F.size(tokens) / F.col("_length")).cast("int") - 1)))
    rest = [c for c in (df.columns if passthrough is None else passthrough) if c not in cut]
    return each.select(*rest, seg, *[F.slice(c, F.col(seg) * F.col("_length") + 1, F.col("_length")).alias(c) for c in cut])


def full_lm(df: DataFrame, keys: list[str], tokens: str, sequence_length: int, eos: int, bos: int, most: int | None = 65536, group: int = 128, strip_zero: bool = False, seed: int = 0, encode: Column | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``gid, seg, tokens``: a chunk of each document, then end and begin marks, groups end to end, and pieces of a length.

    The chunk is one of the aligned pieces of ``most`` tokens, chosen by key; with None it is the whole document. Where
    ``encode`` gives the tokens of the column that ``drop`` names, texts are encoded once, after they are in order; those
    without tokens must then be out already.
    """
    some = df.where(F.size(tokens) > 0) if encode is None else df
    source = F.col(tokens) if encode is None else encode
    chunk = source if most is None else let(source, lambda x: random_chunk(x, most, hashed_uniform(F.col(keys[0]), seed)))
    grouped = group_concat(some, keys, tokens, group, strip_zero, append(chunk, eos, bos), drop)
    return split_rows(grouped, tokens, sequence_length)
