"""Tasks and mixtures by name: a source, a chain of table functions, and a contract for what comes out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.relations import interleave, mixture_rates
from quern.plans.contracts import FeatureSpec, check_schema

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Task:
    name: str
    source: Callable[[SparkSession], DataFrame]
    steps: tuple[Step, ...] = ()
    features: dict[str, FeatureSpec] = field(default_factory=dict)

    def dataset(self, spark: SparkSession) -> DataFrame:
        df = self.source(spark)
        for step in self.steps:
            df = df.transform(step)
        check_schema(df, self.features)
        return df


@dataclass(frozen=True)
class Mixture:
    name: str
    rates: dict[str, float]


class Registry:
    def __init__(self):
        self.tasks: dict[str, Task] = {}
        self.mixtures: dict[str, Mixture] = {}

    def add_task(self, task: Task) -> Task:
        if task.name in self.tasks or task.name in self.mixtures:
            raise ValueError(f"{task.name} is registered already")
        self.tasks[task.name] = task
        return task

    def add_mixture(self, name: str, rates: list[tuple[str, float]], on_duplicate: str = "error") -> Mixture:
        if name in self.tasks or name in self.mixtures:
            raise ValueError(f"{name} is registered already")
        mixture = self.mixtures[name] = Mixture(name, mixture_rates(rates, on_duplicate))
        return mixture

    def dataset(self, name: str, spark: SparkSession, keys: list[str] | None = None) -> DataFrame:
        """A task's rows, or a mixture's rows with ``task`` and ``slot``, by which they interleave."""
        if name in self.tasks:
            return self.tasks[name].dataset(spark)
        if name not in self.mixtures:
            raise ValueError(f"neither a task nor a mixture is called {name!r}")
        rates = self.mixtures[name].rates
        missing = [t for t in rates if t not in self.tasks]
        if missing:
            raise ValueError(f"the mixture names tasks that don't exist: {missing}")
        union: DataFrame | None = None
        for task in rates:
            part = self.tasks[task].dataset(spark).withColumn("task", F.lit(task))
            union = part if union is None else union.unionByName(part)
        return interleave(union, "task", keys or [union.columns[0]], rates)


# The published sampling ratios of an open corpus, in per cent.
OPEN_CORPUS_RATES = [
    ("cc_en", 46.23),
    ("stack", 21.37),
    ("c4", 16.19),
    ("reddit", 6.94),
    ("peS2o", 5.49),
    ("books", 2.10),
    ("wiki", 1.66),
]
WIKIPEDIA_RATES = [
    ("cc_en", 9.09),
    ("wiki", 90.91),
]
