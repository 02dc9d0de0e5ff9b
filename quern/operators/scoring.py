"""Requests for a language-model scorer: preparation as expressions, scoring in Arrow batches, and what comes after."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import filled, lit_ints
from quern.functions.prompts import affixed


def prompt_inputs(tokens: Column, length: int, pad: int, bos: int | None = None) -> tuple[Column, Column]:
    """The last ``length`` tokens padded on the left, and their mask; ``bos`` overwrites the first place."""
    n = F.least(F.size(tokens), F.lit(length))
    kept = F.when(n > 0, F.slice(tokens, -n, n)).otherwise(tokens)
    ids = F.concat(filled(pad, F.lit(length) - n), kept)
    mask = F.concat(filled(0, F.lit(length) - n), filled(1, n))
    if bos is not None:
        ids = F.concat(lit_ints([bos]), F.slice(ids, 2, length - 1))
    return ids, mask


def continuation(prefix: Column, text: Column, bos: int) -> tuple[Column, Column, Column]:
    """Inputs, outputs and mask that score ``text`` after ``prefix``: outputs are both, inputs begin with ``bos``."""
    out = F.concat(prefix, text)
    inputs = F.concat(lit_ints([bos]), F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))))
    return inputs, out, F.concat(filled(0, F.size(prefix)), filled(1, F.size(text)))


def rolling_windows(df: DataFrame, tokens: str, length: int, pad: int, bos: int) -> DataFrame:
    """A row for each window of ``length`` tokens: ``window, inputs, outputs, mask``.

    The last window of a longer text reaches back over tokens that were scored before, which its mask leaves out; a
    shorter text is padded. Every token is scored once.
    """
    padded = df.withColumn("_n", F.size(tokens)).withColumn(tokens, F.concat(tokens, filled(pad, F.lit(length) - F.size(tokens)))).withColumn("_size", F.size(tokens))
    cut = padded.withColumn("window", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_size") / length).cast("int") - 1)))
    start = F.least(F.col("window") * length, F.col("_size") - length)
    cut = cut.withColumn("_start", start)
    outputs = F.slice(tokens, F.col("_start") + 1, F.lit(length))
    before = F.concat(lit_ints([bos]), F.col(tokens))
    inputs = F.slice(before, F.col("_start") + 1, F.lit(length))
    mask = F.transform(outputs, lambda _, i: F.when((F.col("_start") + i >= F.col("window") * length) & (F.col("_start") + i < F.col("_n")), 1).otherwise(0))
    rest = [c for c in df.columns if c != tokens]
    return cut.select(*rest, "window", inputs.alias("inputs"), outputs.alias("outputs"), mask.alias("mask"))


def until(text: Column, stops: list[str]) -> Column:
    """The text up to the first stop, one stop after the other."""
    for s in stops:
        text = F.substring_index(text, s, 1)
    return text


def log_likelihood(token_logprobs: Column, mask: Column, matches: Column) -> tuple[Column, Column]:
    """Sum of log-probabilities under the mask, and whether every masked token was the likeliest one."""
    under = F.zip_with(token_logprobs, mask, lambda p, m: p * m)
    hits = F.zip_with(matches, mask, lambda a, m: a * m)
    add = lambda x, zero: F.aggregate(x, zero, lambda a, v: a + v)
    return add(under, F.lit(0.0)), add(hits, F.lit(0)) == add(mask, F.lit(0))


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


class DummyScorer:
    """Answers without a model: -1 and not greedy, fixed words and the stop, nothing."""

    def loglikelihood(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(log_likelihood=-1.0, is_greedy=False)

    def greedy_until(self, batch: pd.DataFrame) -> pd.DataFrame:
        first = [u if isinstance(u, str) else u[0] for u in batch["until"]]
        return batch.assign(output_text=[f"dummy text {u}" for u in first])

    def generate(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(output_text="")


def score(df: DataFrame, scorer: Scorer, schema: str, batch_rows: int = 256) -> DataFrame:
    """Rows through a scorer in pieces of ``batch_rows``; the scorer takes and gives pandas tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch_rows):
                yield scorer(b.iloc[i : i + batch_rows])

    return df.mapInPandas(run, schema)


def loglikelihood_requests(df: DataFrame, prefix: str, text: str, vocabulary, scorer, length: int, pad: int, schema: str, affixes: dict[str, str] | None = None, batch_rows: int = 256) -> DataFrame:
    """Requests from a table to answers: words around prefix and text, tokens, ``inputs, outputs, mask`` of ``length``, and the scorer's columns.

    A missing prefix is empty; the prefix loses its beginning and the text its end where they are too long together.
    """
    before, after = affixed(F.col(prefix), F.col(text), **(affixes or {}))
    rest = [c for c in df.columns if c not in (prefix, text)]
    coded = df.select(*rest, vocabulary.encode(before).alias("_p"), vocabulary.encode(after).alias("_t"))
    kept = coded.withColumn("_t", F.slice("_t", 1, length)).withColumn("_n", F.least(F.size("_p"), F.lit(length) - F.size("_t")))
    kept = kept.withColumn("_p", F.when(F.col("_n") > 0, F.slice("_p", F.size("_p") - F.col("_n") + 1, F.col("_n"))).otherwise(F.array().cast("array<int>")))
    inputs, outputs, mask = continuation(F.col("_p"), F.col("_t"), vocabulary.bos)
    room = lambda x, value: F.concat(x, filled(value, F.lit(length) - F.size(x)))
    asked = kept.select(*rest, room(inputs, pad).alias("inputs"), room(outputs, pad).alias("outputs"), room(mask, 0).alias("mask"))
    return score(asked, scorer, schema, batch_rows)


def generation_requests(df: DataFrame, prefix: str, vocabulary, scorer, length: int, pad: int, schema: str, stops: list[str], batch_rows: int = 256) -> DataFrame:
    """Prompts from a table to generated words, cut at the stops: the scorer sees ``inputs, mask`` and gives ``output_text``."""
    ids, mask = prompt_inputs(vocabulary.encode(F.coalesce(F.col(prefix), F.lit(""))), length, pad, vocabulary.bos)
    asked = df.select(*[c for c in df.columns if c != prefix], ids.alias("inputs"), mask.alias("mask"), F.array(*map(F.lit, stops)).alias("until"))
    return score(asked, scorer, schema, batch_rows).withColumn("output_text", until(F.col("output_text"), stops))


def evaluate(scored: DataFrame, item: str, choice: str, value: str, gold: DataFrame) -> DataFrame:
    """``n, accuracy``: how often the choice of the greatest value is the right one (``gold``: item, answer); ties go to the lower choice."""
    best = scored.groupBy(item).agg(F.max_by(choice, F.struct(F.col(value), F.negative(choice))).alias("best"))
    return best.join(gold, item).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("best") == F.col("answer"), 1.0).otherwise(0.0)).alias("accuracy"))
