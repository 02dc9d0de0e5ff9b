"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

All stages take whole texts, however long. Null texts stay null (to a stage they are empty texts), rows with null ids,
repeated rows and extra columns (whatever their names) are kept or go as rows; an empty table gives an empty one. Ties
are said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.blocks import documents
from quern.llm.bpe_transducer import bpe_encode, default_spec
from quern.llm.decontamination import decontaminate
from quern.llm.ngram_join import drop_near_duplicates
from quern.llm.quality_ranking import keep_good
from quern.llm.suffix_dedup import cut_repeats
from quern.operators.order import checkpoint_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking puts over the cut; what it rejects goes. A score of just the cut is kept."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles (Jaccard of 0.75 or more) the one with the least id.

    Of rows with the same least id one stays, and a row without an id only where its group has none with one; documents
    without words all stay.
    """
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 50-byte strings that a document with a smaller id holds; ``n_chars`` follows, and no row is lost.

    Rows with equal ids don't cut each other; one without an id counts as last. A null text keeps its ``n_chars``.
    """
    cut = cut_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without three quarters of a benchmark item's shingles; just three quarters go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of what is left, a row for each row."""
    return bpe_encode(docs, default_spec())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("contamination", contamination),
    ("tokens", tokens),
]

#: A learnt ranking isn't expressible in SQL; ``tests/llm/test_pipeline.py`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them lies in the shared checkpoint folder, and goes once the next one is written."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _remove(spark, f"{folder}/{i - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
