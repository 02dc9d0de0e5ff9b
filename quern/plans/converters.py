"""From token features to what a decoder reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import autoregressive_inputs, filled

NAMES = {
    "decoder_input_tokens": "input_tokens",
    "decoder_target_tokens": "target_tokens",
    "decoder_loss_weights": "loss_masks",
    "decoder_segment_ids": "segment_ids",
    "decoder_positions": "positions",
}


def decoder_features(df: DataFrame, targets: str = "targets", weights: str | None = None, segments: str | None = None, positions: str | None = None, bos: int = 0) -> DataFrame:
    """Adds decoder targets, inputs (shifted, segment by segment) and weights (given ones, or 1 where a target is over 0)."""
    t, s = F.col(targets), F.col(segments) if segments else None
    out = df.withColumn("decoder_target_tokens", t).withColumn("decoder_input_tokens", autoregressive_inputs(t, s, bos))
    out = out.withColumn("decoder_loss_weights", F.col(weights) if weights else F.transform(t, lambda v: F.when(v > 0, 1).otherwise(0)))
    if segments:
        out = out.withColumn("decoder_segment_ids", s)
    return out.withColumn("decoder_positions", F.col(positions)) if positions else out


def multimodal_features(df: DataFrame, targets: str, weights: str, images: str, index: str, image_length: int, segments: str | None = None, bos: int = 1, prompt: int = 0) -> DataFrame:
    """Decoder features with image positions moved by the begin token, and by ``prompt`` learnt places put in front."""
    if prompt:
        shift = lambda c: F.concat(filled(0, F.lit(prompt)), F.slice(c, F.lit(1), F.greatest(F.size(c) - prompt, F.lit(0))))
        for c in (targets, weights, *([segments] if segments else [])):
            df = df.withColumn(c, shift(F.col(c)))
        df = df.withColumn(index, F.transform(index, lambda row: F.transform(row, lambda v: v + prompt)))
    out = decoder_features(df, targets, weights, segments, bos=bos)
    out = out.withColumn(index, F.transform(index, lambda row: F.transform(row, lambda v: v + 1)))
    fits = F.size(images) <= image_length
    return out.where(F.coalesce(F.when(~fits, F.raise_error(F.lit("images were cut off")).cast("boolean")), F.lit(True)))


def batch_names(df: DataFrame) -> DataFrame:
    """Decoder features under the names of a batch, packed ones too."""
    return df.withColumnsRenamed({k: v for k, v in NAMES.items() if k in df.columns})


def split_metadata(df: DataFrame, prefix: str = "metadata/") -> tuple[DataFrame, DataFrame]:
    """(columns without, columns with the prefix)."""
    own = [c for c in df.columns if c.startswith(prefix)]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in own]), df.select(*[F.col(f"`{c}`") for c in own])


def rekey(df: DataFrame, names: dict[str, str | None] | None) -> DataFrame:
    """Only the given columns, each from a path (``a.b``); an empty path is the empty text; no mapping is no change."""
    if not names:
        return df
    return df.select(*[(F.col(path.replace("/", ".")) if path else F.lit("")).alias(new) for new, path in names.items()])
