"""The named corpora as tasks: where each lies below a root, and the chain that makes training sequences of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.prompts import instruction_prompt, supervised, template
from quern.functions.vocab import Vocabulary
from quern.operators.relations import first_n
from quern.operators.streams import full_lm
from quern.plans.contracts import FeatureSpec
from quern.plans.converters import rekey
from quern.plans.registry import OPEN_CORPUS_RATES, WIKIPEDIA_RATES, Registry, Task

# The files of each corpus below the root, and the names of the instruction sets.
CORPUS_FILES = {
    "c4": "c4/1.0.0/c4-train*",
    "cc_en": "cc*/1.0.0/cc_en_*",
    "peS2o": "pes2o/1.0.0/pes2o-train*",
    "stack": "stack/1.0.0/stack-train*",
    "reddit": "reddit/1.0.0/reddit-train*",
    "books": "books/1.0.0/books-train*",
    "wiki": "wiki/1.0.0/wiki-train*",
}
INSTRUCTION_SETS = ["Flan2021", "T0", "NIv2", "CoT", "Dialog"]

Reader = Callable[[SparkSession, str], DataFrame]


def parquet(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.parquet(pattern)


def dataset(spark: SparkSession, root: str, path: str = "c4", name: str = "en", split: str = "train") -> DataFrame:
    """A table by its name: Parquet in ``root/path/name/split``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{path}/{name}/{split}")


def training_sequences(vocabulary: Vocabulary, length: int) -> Callable[[DataFrame], DataFrame]:
    """Texts as ``gid, seg, targets``: end to end in groups, cut into sequences of a length."""

    def run(df: DataFrame) -> DataFrame:
        some = df.where(F.length("text") > 0)
        return full_lm(some, ["id"], "targets", length, vocabulary.eos, vocabulary.bos, encode=vocabulary.encode(F.col("text")), drop=("text",))

    return run


def instruction_features(vocabulary: Vocabulary, style: str = "llama2") -> Callable[[DataFrame], DataFrame]:
    """``inputs, targets`` as ``targets, loss_weights``: the request without loss, the answer with it; rows without loss drop out."""

    def run(df: DataFrame) -> DataFrame:
        p, a = vocabulary.encode(instruction_prompt(F.col("inputs"), template(style))), vocabulary.encode(F.col("targets"))
        coded = df.select(*[c for c in df.columns if c not in ("inputs", "targets")], p.alias("_p"), a.alias("_a"))
        weights = F.concat(F.array_repeat(F.lit(0), F.size("_p")), F.array_repeat(F.lit(1), F.size("_a")))
        return coded.withColumn("loss_weights", weights).where(supervised(F.col("loss_weights"))).withColumn("targets", F.concat("_p", "_a")).drop("_p", "_a")

    return run


def register_corpora(registry: Registry, root: str, vocabulary: Vocabulary, length: int, read: Reader = parquet) -> Registry:
    """A task for each corpus, and the two published mixtures of them."""
    for name, pattern in CORPUS_FILES.items():
        source = lambda spark, p=pattern: read(spark, f"{root.rstrip('/')}/{p}")
        keep = lambda df: rekey(df, {"id": "id", "text": "text"})
        registry.add_task(Task(name, source, (keep, training_sequences(vocabulary, length)), {"targets": FeatureSpec("int")}))
    registry.add_mixture("open_corpus", OPEN_CORPUS_RATES)
    registry.add_mixture("wikipedia", WIKIPEDIA_RATES)
    return registry


def register_instructions(registry: Registry, root: str, vocabulary: Vocabulary, style: str = "llama2", validation: int = 2000, key: str = "id") -> Registry:
    """Two tasks for each instruction set: the first rows in order of their key are for validation, the rest for training."""
    for name in INSTRUCTION_SETS:
        for split in ("train", "validation"):
            def source(spark: SparkSession, n: str = name, s: str = split) -> DataFrame:
                return first_n(spark.read.parquet(f"{root.rstrip('/')}/{n.lower()}"), [key], validation).where(F.col("split") == s).drop("split", "idx")

            registry.add_task(Task(f"{name.lower()}_{split}", source, (instruction_features(vocabulary, style),)))
    return registry
