"""Losses, norms, schedules and metrics as scalar expressions over arrays and columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.arrays import let


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda top: top + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def smoothing_constants(classes: int, smoothing: float) -> tuple[float, float, float]:
    """(probability of the true class, of each other one, the entropy of that)."""
    on, off = 1.0 - smoothing, smoothing / (classes - 1)
    return on, off, -(on * math.log(on) + (classes - 1) * off * math.log(off + 1e-20))


def token_losses(logits: Column, target: Column, classes: int, z_alpha: float = 0.0, smoothing: float = 0.0) -> tuple[Column, Column]:
    """Cross entropy of one token and its z loss."""
    on, off, entropy = smoothing_constants(classes, smoothing)
    z = log_sum_exp(logits)
    hit = F.get(logits, target)
    loss = z - (on - off) * hit - off * total(logits) - entropy
    return loss, z_alpha * F.pow(z, 2.0)


def argmax(x: Column) -> Column:
    """The first place of the greatest value, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def mean_by_rows(value: Column, valid: Column) -> Column:
    """Aggregate of a row: sum over valid tokens by their number (1e-10 at least); the mean of rows is taken after."""
    return F.sum(F.when(valid > 0, value).otherwise(0.0)) / F.greatest(F.sum(F.when(valid > 0, 1.0).otherwise(0.0)), F.lit(1e-10))


def mean_by_tokens(value: Column, valid: Column) -> Column:
    """Aggregate over all tokens: sum over valid ones by their number (1 at least)."""
    ok = F.when(valid > 0, 1.0).otherwise(0.0)
    return F.sum(value * ok) / F.greatest(F.sum(ok), F.lit(1.0))


def masked_squared_error(a: Column, b: Column, valid: Column) -> Column:
    """Mean over all cells, of which invalid ones count as 0."""
    return F.avg(F.when(valid, (a - b) * (a - b)).otherwise(0.0))


def tempered(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda v: v / F.lit(max(temperature, 1e-8)))


def rms_norm(x: Column, eps: float = 1e-6, weight: Column | None = None, add_one: bool = False) -> Column:
    """Each value by the root of the mean square; a weight multiplies it (``1 + weight`` with ``add_one``)."""
    scale = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x) + F.lit(eps))
    normed = let(scale, lambda r: F.transform(x, lambda v: v / r))
    if weight is None:
        return normed
    return F.zip_with(normed, weight, lambda v, w: v * ((1.0 + w) if add_one else w))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


# The names of the factors, and the defaults of their parameters below.
SCHEDULE_FACTORS = ("constant", "linear_warmup", "linear_decay", "rsqrt_decay", "rsqrt_normalized_decay", "decay_every", "cosine_decay")


def learning_rate(step: Column, factors: str = "constant * linear_warmup * rsqrt_decay", base: float = 0.5, warmup: int = 1000, decay: float = 0.5, steps_per_decay: int = 20000, steps_per_cycle: int = 100000, offset: int = 0, least: float = 1e-8) -> Column:
    """The product of named factors at a step, ``least`` at least; an unknown name is an error when the plan is built."""
    s = F.greatest(F.lit(0.0), step.cast("double") - offset)
    w = float(warmup)
    late = F.sqrt(F.greatest(s, F.lit(w)))
    cycle = F.greatest(F.lit(0.0), (s - w) / float(steps_per_cycle))
    made = {
        "constant": lambda: F.lit(float(base)),
        "linear_warmup": lambda: F.least(F.lit(1.0), s / w),
        "linear_decay": lambda: base * F.least(s / w, 1.0 + decay * (w - s)),
        "rsqrt_decay": lambda: F.lit(1.0) / late,
        "rsqrt_normalized_decay": lambda: F.lit(math.sqrt(w)) / late,
        "decay_every": lambda: F.pow(F.lit(float(decay)), F.floor(s / steps_per_decay)),
        "cosine_decay": lambda: F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(math.pi * (cycle - F.floor(cycle))))),
    }
    out = F.lit(1.0)
    for name in (f.strip() for f in factors.split("*")):
        if name not in made:
            raise ValueError(f"unknown factor {name!r}")
        out = out * made[name]()
    return F.greatest(out, F.lit(least))


def inverse_root_schedule(step: Column, rate: float, warmup: int, decay: float = 1e-4) -> tuple[Column, Column]:
    """Rate over the root of the step (``warmup`` at least), scaled by 100, and the factor of the weights that decays them:
    the square of the rate, below 0, as many times as ``decay`` has 1e-4."""
    lr = F.lit(rate / 0.01) / F.sqrt(F.greatest(step.cast("double"), F.lit(float(warmup))))
    return lr, F.lit(-decay / 1e-4) * lr * lr


def warmup_cosine(step: Column, start: float, peak: float, end: float, warmup: int, total_steps: int) -> Column:
    """Linear to the peak, then a half cosine to the end."""
    s = step.cast("double")
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - warmup) / float(total_steps - warmup)))
    return F.when(s < warmup, start + (peak - start) * s / float(warmup)).otherwise(end + (peak - end) * 0.5 * (1.0 + F.cos(math.pi * progress)))
