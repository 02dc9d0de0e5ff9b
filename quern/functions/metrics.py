"""Metrics that merge: values on the driver, and the same as partial aggregates in a plan.

A metric is made of parts that add up.  ``partial`` gives the struct of a group's parts, ``merged`` adds such structs up
and ``computed`` is the result, so totals may be taken in any number of steps.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import ClassVar, Self

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    PARTS: ClassVar[tuple[str, ...]] = ()

    def merge(self, other: Self) -> Self:
        if type(self) is not type(other):
            raise TypeError(f"a {type(self).__name__} doesn't merge with a {type(other).__name__}")
        return replace(self, **{p: getattr(self, p) + getattr(other, p) for p in self.PARTS})

    @classmethod
    def partial(cls, **parts: Column) -> Column:
        """Aggregate of a group: a column to add up for each part."""
        return F.struct(*[F.sum(parts[p]).alias(p) for p in cls.PARTS])

    @classmethod
    def merged(cls, partial: Column) -> Column:
        return F.struct(*[F.sum(partial[p]).alias(p) for p in cls.PARTS])


def _needed(value, name: str):
    if value is None:
        raise ValueError(f"{name} must be set first")
    return value


@dataclass(frozen=True)
class Sum(Metric):
    total: float = 0.0
    PARTS: ClassVar = ("total",)

    @classmethod
    def of(cls, values) -> Self:
        return cls(float(np.sum(values)))

    def compute(self) -> float:
        return self.total

    @staticmethod
    def computed(parts: Column) -> Column:
        return parts["total"]


@dataclass(frozen=True)
class Step(Metric):
    steps: int | None = 1
    PARTS: ClassVar = ("steps",)

    def compute(self):
        return _needed(self.steps, "steps")

    @staticmethod
    def computed(parts: Column) -> Column:
        return parts["steps"]


@dataclass(frozen=True)
class AveragePerStep(Step):
    total: float | None = None
    PARTS: ClassVar = ("total", "steps")

    @classmethod
    def of(cls, values, steps: int | None = 1) -> Self:
        return cls(steps, float(np.sum(values)))

    def compute(self) -> float:
        return _needed(self.total, "total") / super().compute()

    @staticmethod
    def computed(parts: Column) -> Column:
        return parts["total"] / parts["steps"]


@dataclass(frozen=True)
class Time(Metric):
    """A duration, which is set from outside; merging keeps the first."""

    duration: float | None = None

    def compute(self) -> float:
        return _needed(self.duration, "duration")

    @staticmethod
    def span(ts: Column) -> Column:
        """Seconds between a group's first and last time."""
        return (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1e6)


@dataclass(frozen=True)
class TimeRate(Time):
    numerator: float = 0.0
    PARTS: ClassVar = ("numerator",)

    def merge(self, other: Self) -> Self:
        if self.duration is not None or getattr(other, "duration", None) is not None:
            raise ValueError("rates merge before their duration is set")
        return super().merge(other)

    def compute(self) -> float:
        return self.numerator / super().compute()

    @staticmethod
    def computed(parts: Column, seconds: Column) -> Column:
        return parts["numerator"] / seconds


@dataclass(frozen=True)
class StepsPerTime(Step):
    duration: float | None = None

    def compute(self) -> float:
        return super().compute() / _needed(self.duration, "duration")

    @staticmethod
    def computed(parts: Column, seconds: Column) -> Column:
        return parts["steps"] / seconds


def sums(values: Mapping[str, float]) -> dict[str, Sum]:
    return {k: Sum(v) for k, v in values.items()}


def _mapped(tree, f):
    return {k: _mapped(v, f) for k, v in tree.items()} if isinstance(tree, Mapping) else f(tree)


def zeroed(tree):
    """The same metrics with all parts at 0."""
    return _mapped(tree, lambda m: replace(m, **{p: 0 for p in m.PARTS}))


def with_duration(tree, seconds: float):
    """The duration set wherever a metric has one."""
    return _mapped(tree, lambda m: replace(m, duration=seconds) if hasattr(m, "duration") else m)


def with_steps(tree, steps: int):
    return _mapped(tree, lambda m: replace(m, steps=steps) if isinstance(m, Step) else m)


def merged(a: dict | None, b: dict | None) -> dict | None:
    """Metrics of two dictionaries merged name by name; nothing merges with anything."""
    if a is None or b is None:
        return b if a is None else a
    if a.keys() != b.keys():
        raise ValueError("the dictionaries name other metrics")
    return {k: a[k].merge(b[k]) for k in a}


def averaged(many: list[Mapping[str, float]]) -> dict[str, float]:
    """The plain mean of each name over dictionaries of values."""
    return {k: float(np.mean([m[k] for m in many])) for k in many[0]} if many else {}
