"""What a table must look like: eager checks of the schema, lazy ones of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    """A feature's element type and how many arrays it lies in."""

    dtype: str
    rank: int = 1
    add_eos: bool = False


def rank_of(kind: T.DataType) -> tuple[str, int]:
    rank = 0
    while isinstance(kind, T.ArrayType):
        kind, rank = kind.elementType, rank + 1
    return kind.simpleString(), rank


def check_schema(df: DataFrame, features: dict[str, FeatureSpec]) -> None:
    """Raises if a feature is missing or has another type or rank."""
    for name, spec in features.items():
        if name not in df.columns:
            raise ValueError(f"feature {name} is missing")
        dtype, rank = rank_of(df.schema[name].dataType)
        if (dtype, rank) != (spec.dtype, spec.rank):
            raise ValueError(f"feature {name} is {dtype} of rank {rank}, not {spec.dtype} of rank {spec.rank}")


def check_lengths(df: DataFrame, lengths: dict[str, int], exact: bool = False) -> DataFrame:
    """The rows; one with a feature over its length (or, if exact, of another length) fails when it is read."""
    for name, n in lengths.items():
        ok = F.size(name) == n if exact else F.size(name) <= n
        df = df.where(F.coalesce(F.when(~ok, F.raise_error(F.lit(f"{name} has the wrong length")).cast("boolean")), F.lit(True)))
    return df


def check_columns(cut: list[str], passthrough: list[str], df: DataFrame) -> None:
    """Raises if a column is both changed and passed through, or missing."""
    both, missing = set(cut) & set(passthrough), [c for c in [*cut, *passthrough] if c not in df.columns]
    if both or missing:
        raise ValueError(f"columns both changed and passed through: {sorted(both)}; missing: {missing}")


def without_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows in which none of the columns is null."""
    return df.dropna(subset=columns)


def check_last_token(df: DataFrame, name: str, forbidden: list[int]) -> DataFrame:
    """The rows; one whose last token is a forbidden one fails when it is read."""
    last = F.get(F.col(name), F.size(name) - 1)
    return df.where(F.coalesce(F.when(last.isin(forbidden), F.raise_error(F.lit(f"{name} ends in a special token")).cast("boolean")), F.lit(True)))


def model_lengths(lengths: dict[str, int], pack: bool) -> dict[str, int]:
    """Lengths of what a decoder reads, from the length of the targets."""
    n = lengths["targets"]
    names = ["decoder_target_tokens", "decoder_input_tokens", "decoder_loss_weights", *(["decoder_segment_ids", "decoder_positions"] if pack else [])]
    return dict.fromkeys(names, n)


def divisible(batch: int, *parts: int) -> None:
    for p in parts:
        if batch % p:
            raise ValueError(f"a batch of {batch} can't be dealt out evenly over {p}")
