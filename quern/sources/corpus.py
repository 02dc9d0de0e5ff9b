"""Reading and writing corpora: JSON lines, counts, shards, manifests and checkpoint tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.prompts import kept_turns
from quern.operators.order import with_global_order
from quern.operators.relations import global_shards, shuffled_shards

RECORD = "id string, text string"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores if the scan has fewer parts than there are (a few large files); else nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD, nested: bool = False) -> DataFrame:
    """JSON lines (``.gz`` too) of a folder, or of the folders one level below it, with the file of each row."""
    pattern = f"{path.rstrip('/')}/{'*/' if nested else ''}*"
    return spark.read.schema(schema).json(pattern).withColumn("file", F.col("_metadata.file_path"))


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds ``record`` and ``malformed``: blank lines give a null record, broken ones are marked, none stops the scan."""
    kind = T.StructType.fromDDL(schema)
    read = F.from_json(F.col(column), T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    blank = F.trim(column) == ""
    out = lines.withColumn("_r", F.when(~blank, read))
    broken = F.coalesce(F.col("_r._corrupt").isNotNull(), F.lit(False))
    return out.withColumn("malformed", broken).withColumn("record", F.when(~broken & F.col("_r").isNotNull(), F.struct(*[F.col(f"_r.{f.name}").alias(f.name) for f in kind.fields]))).drop("_r")


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Lines of a growing folder as a stream; its checkpoint remembers what has been read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_lines(lines, "value", schema)


INSTRUCTIONS = "id string, image string, conversations array<struct<from:string,value:string,text:string>>"


def read_instructions(spark: SparkSession, path: str, images: str | None = None, roles: tuple[str, ...] = ("human", "gpt")) -> DataFrame:
    """Records of a visual-instruction file (one JSON array, or lines): ``key, has_image, image, conversations``.

    Only turns of the given roles stay. Images are joined by file name from a folder of files; a record without one has
    ``has_image`` 0. The key is a digest of the record, so it is the same in every run.
    """
    raw = spark.read.schema(INSTRUCTIONS).option("multiLine", True).json(path)
    turns = kept_turns(F.col("conversations"), roles)
    out = raw.select(F.sha2(F.to_json(F.struct("*")), 256).alias("key"), F.col("image").alias("name"), turns.alias("conversations"))
    if images is None:
        return out.select("key", F.lit(0).alias("has_image"), F.lit(None).cast("binary").alias("image"), "conversations")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(images).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("image"))
    joined = out.join(files, F.element_at(F.split("name", "/"), -1) == F.col("file"), "left")
    return joined.select("key", F.when(F.col("image").isNotNull(), 1).otherwise(0).alias("has_image"), "image", "conversations")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Records of a captioning file as they are: ``key`` (the record's own id), ``image``, all turns."""
    raw = spark.read.schema(INSTRUCTIONS).option("multiLine", True).json(path)
    turns = F.transform("conversations", lambda c: F.struct(c["from"].alias("from"), F.coalesce(c["value"], c["text"]).alias("value")))
    return raw.select(F.col("id").alias("key"), "image", turns.alias("conversations"))


def repeated_lines(lines: DataFrame, column: str, schema: str, passes: int, after: int = 0) -> DataFrame:
    """Lines (``file_order`` tells their order) read ``passes`` times over, from the ``after``-th on: ``pass, index, offset`` and ``record``.

    ``index`` counts lines from 0 in each pass, broken ones too; ``offset`` is the byte at which the line begins. Blank and
    broken lines give no row.
    """
    placed = with_global_order(lines, ["file_order"], F.octet_length(column) + 1, index="index")
    each = parse_lines(placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))), column, schema)
    total = F.col("pass") * F.lit(lines.count()) + F.col("index")
    return each.where((total >= after) & F.col("record").isNotNull()).select("pass", "index", "offset", "record")


def save_state(spark: SparkSession, path: str, config: dict, index: int, offset: int, tokens: int) -> None:
    """Where a reader of a stream stands, as one row."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True), index, offset, tokens)], STATE).coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> dict:
    r = spark.read.schema(STATE).parquet(path).first()
    return {"config": json.loads(r["config"]), "index": r["index"], "offset": r["offset"], "tokens": r["tokens"]}


STATE = "config string, index long, offset long, tokens long"


def convert(df: DataFrame, parse, schema: str, key: str, path: str, shards: int, seed: int = 0) -> None:
    """Each row (a dictionary) through ``parse`` into a new one or None, which is left out; what comes is shuffled and written in shards."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches):
        for b in batches:
            found = [x for x in map(parse, b.to_dict("records")) if x is not None]
            yield pd.DataFrame([[x[n] for n in names] for x in found], columns=names)

    parsed = df.mapInPandas(run, schema)
    dealt = shuffled_shards(parsed, F.abs(F.xxhash64(key) % F.lit(1 << 20)), [key], shards, seed)
    dealt.drop("place").write.mode("overwrite").partitionBy("shard").parquet(path)


def count_lines(df: DataFrame, *by: str) -> DataFrame:
    """Rows by file (or whatever tells sources apart)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def shard_name(base: str, folder: str, prefix: str, split: str, shard: int, shards: int) -> str:
    return f"{base}/{folder}/1.0.0/{prefix}-{split}-{shard:05d}-of-{shards:05d}"


def write_shards(df: DataFrame, keys: list[str], path: str, shards: int, missing_only: bool = False) -> None:
    """Parquet with a folder for each balanced shard; with ``missing_only`` shards that are there stay untouched."""
    dealt = global_shards(df, keys, shards).drop("idx")  # in order already, so a shard's rows stand in few parts
    if missing_only:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [int(s.getPath().getName().split("=")[1]) for s in (fs.listStatus(hadoop) if fs.exists(hadoop) else []) if s.getPath().getName().startswith("shard=")]
        dealt = dealt.where(~F.col("shard").isin(there)) if there else dealt
    dealt.write.mode("append" if missing_only else "overwrite").partitionBy("shard").parquet(path)


def manifest(corpora: DataFrame, base_url: str, pad: int = 4) -> DataFrame:
    """``corpus, file, url`` of every numbered file: a row of ``corpora`` has ``corpus, prefix, files``."""
    each = corpora.withColumn("i", F.explode(F.when(F.col("files") > 0, F.sequence(F.lit(0), F.col("files") - 1))))
    name = F.concat("prefix", F.lpad(F.col("i").cast("string"), pad, "0"), F.lit(".json.gz"))
    return each.select("corpus", name.alias("file"), F.concat(F.lit(base_url.rstrip("/")), F.lit("/"), "corpus", F.lit("/"), name).alias("url"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Folder and file of a URL: its last two parts (the folder is null if there is none)."""
    parts = F.split(url, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, F.when(F.size(parts) > 1, F.lit(-2)).otherwise(F.lit(-1)))), F.element_at(parts, -1)


def write_parameters(spark: SparkSession, flat: dict, path: str, floats: str | None = None, names: list[str] | None = None) -> None:
    """Leaves of a parameter tree (or those of ``names``) as a table of ``path, shape, dtype, data``; floating ones as ``floats``."""
    import numpy as np

    cast = lambda v: np.asarray(v).astype(floats) if floats and np.asarray(v).dtype.kind == "f" else np.asarray(v)
    flat = {k: cast(v) for k, v in flat.items() if names is None or k in names}
    rows = [(k, [int(n) for n in np.shape(v)], str(np.asarray(v).dtype), np.asarray(v).tobytes()) for k, v in flat.items()]
    spark.createDataFrame(rows, "path string, shape array<int>, dtype string, data binary").write.mode("overwrite").parquet(path)


def read_parameters(spark: SparkSession, path: str, names: list[str] | None = None) -> dict:
    import numpy as np

    df = spark.read.parquet(path)
    if names is not None:
        df = df.where(F.col("path").isin(names))
    return {r["path"]: np.frombuffer(r["data"], r["dtype"]).reshape(r["shape"]) for r in df.toLocalIterator()}


def sample_page(df: DataFrame, keys: list[str], n: int) -> str:
    """The first ``n`` rows as an HTML table, to look at."""
    return df.orderBy(*keys).limit(n).toPandas().to_html(index=False)
