"""Corpora: shards, chunks, mixtures, counts, scans and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.arrays import hashed_uniform_sql
from quern.operators import relations as R
from quern.plans.registry import OPEN_CORPUS_RATES, WIKIPEDIA_RATES
from quern.sources import corpus as C
from quern.suite.base import Suite, quoted, table

suite = Suite()
BY_SOURCE = "row_number() OVER (ORDER BY source, doc_id) - 1"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")


@suite.query(f"SELECT doc_id, CAST(i AS BIGINT) AS idx, CAST(i // CAST(ceil(n / 7) AS BIGINT) AS INTEGER) AS shard FROM (SELECT doc_id, {BY_SOURCE} AS i, count(*) OVER () AS n FROM documents)")
def global_shards(spark, sf_dir):
    return R.global_shards(docs(spark, sf_dir), ["source", "doc_id"], 7).select("doc_id", "idx", "shard")


@suite.query(f"SELECT doc_id, CAST(i AS BIGINT) AS idx FROM (SELECT doc_id, {BY_SOURCE} AS i FROM documents) WHERE i >= 100 AND i < 250")
def shard_row_range(spark, sf_dir):
    return R.row_range(docs(spark, sf_dir), ["source", "doc_id"], 100, 250).select("doc_id", "idx")


@suite.query("SELECT doc_id, CAST(ntile(8) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS chunk FROM documents")
def ntile_chunks(spark, sf_dir):
    return R.even_chunks(docs(spark, sf_dir), ["doc_id"], 8).select("doc_id", "chunk")


@suite.query("SELECT doc_id, CAST(block AS INTEGER) AS block, CAST(ntile(4) OVER (PARTITION BY block ORDER BY doc_id) - 1 AS INTEGER) AS chunk FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS block FROM documents)")
def chunk_max(spark, sf_dir):
    return R.bounded_chunks(docs(spark, sf_dir), ["doc_id"], 300, 4).select("doc_id", "block", "chunk")


@suite.query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 6 AS INTEGER) AS shard FROM documents")
def modulo_shard(spark, sf_dir):
    return R.modulo_shard(docs(spark, sf_dir), ["doc_id"], 6).select("doc_id", "shard")


@suite.query("SELECT doc_id, CAST(i // 64 AS BIGINT) AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE (i // 64 + 1) * 64 <= n")
def batch_drop_remainder(spark, sf_dir):
    return R.batched(docs(spark, sf_dir), ["doc_id"], 64, True).select("doc_id", "batch")


@suite.query("""
WITH c AS (SELECT conv_id, turn FROM conversations), k AS (SELECT (64 - count(*) % 64) % 64 AS k FROM c)
SELECT conv_id, turn, CAST(0 AS INTEGER) AS copy, true AS valid FROM c
UNION ALL SELECT conv_id, turn, CAST(i AS INTEGER), false FROM (SELECT * FROM c ORDER BY conv_id, turn LIMIT 1), k, range(1, k + 1) r(i)""")
def valid_padding_batches(spark, sf_dir):
    return R.pad_to_multiple(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 64)


RATES = [("src0", 46.23), ("src1", 21.37), ("src2", 16.19), ("src3", 6.94), ("src4", 0.0)]
RATE_ROWS = ", ".join(f"('{n}', {r}::DOUBLE)" for n, r in RATES)


@suite.query(f"""
SELECT doc_id, source, round(row_number() OVER (PARTITION BY source ORDER BY doc_id) / rate, 9) AS slot
FROM documents JOIN (VALUES {RATE_ROWS}) r(source, rate) USING (source) WHERE rate > 0""")
def mixture_interleave(spark, sf_dir):
    return R.interleave(docs(spark, sf_dir), "source", ["doc_id"], R.mixture_rates(RATES)).select("doc_id", "source", "slot")


def _named(rates):
    return ", ".join(f"({quoted(n)}, {r}::DOUBLE)" for n, r in rates)


@suite.query(f"""
SELECT mixture, task, round(rate / sum(rate) OVER (PARTITION BY mixture), 9) AS share FROM (
  SELECT 'open' AS mixture, * FROM (VALUES {_named(OPEN_CORPUS_RATES)}) a(task, rate) UNION ALL SELECT 'wikipedia', * FROM (VALUES {_named(WIKIPEDIA_RATES)}) b(task, rate))""")
def mixture_shares(spark, sf_dir):
    from pyspark.sql import Window

    rows = [(m, t, r) for m, rates in (("open", OPEN_CORPUS_RATES), ("wikipedia", WIKIPEDIA_RATES)) for t, r in R.mixture_rates(rates).items()]
    df = spark.createDataFrame(rows, "mixture string, task string, rate double")
    return df.select("mixture", "task", F.round(F.col("rate") / F.sum("rate").over(Window.partitionBy("mixture")), 9).alias("share"))


@suite.query("SELECT source, round(v / sum(v) OVER (), 9) AS ratio FROM (SELECT source, CAST(sum(n_chars) AS DOUBLE) * CASE WHEN source IN ('src0', 'src1') THEN 2.0 ELSE 1.0 END AS v FROM documents GROUP BY source)")
def mixture_rates(spark, sf_dir):
    """Sampling ratios from sizes times a factor."""
    size = docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").cast("double").alias("v")).withColumn("v", F.col("v") * F.when(F.col("source").isin("src0", "src1"), 2.0).otherwise(1.0))
    total = size.agg(F.sum("v").alias("total"))
    return size.crossJoin(F.broadcast(total)).select("source", F.round(F.col("v") / F.col("total"), 9).alias("ratio"))


@suite.query("SELECT source, CAST(count(*) AS BIGINT) AS count FROM documents GROUP BY source")
def count_files(spark, sf_dir):
    return C.count_lines(docs(spark, sf_dir), "source")


@suite.query("SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(max(length(text)) AS INTEGER) AS max_len FROM documents")
def corpus_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("total_chars"), F.max(F.length("text")).alias("max_len"))


@suite.query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 200 THEN 'validation' ELSE 'train' END AS split FROM documents")
def split_train_validation(spark, sf_dir):
    return R.first_n(docs(spark, sf_dir), ["doc_id"], 200).select("doc_id", "split")


@suite.query(f"SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, round({hashed_uniform_sql('doc_id * 31 + epoch', 9)}, 9) AS place FROM documents, range(0, 3) r(epoch)")
def epoch_shuffle(spark, sf_dir):
    return R.epochs(docs(spark, sf_dir), 3, F.col("doc_id"), 9).select("doc_id", "epoch", F.round("place", 9).alias("place"))


@suite.query(f"""
WITH p AS (SELECT doc_id, {hashed_uniform_sql('doc_id', 7)} AS place FROM documents), i AS (SELECT doc_id, row_number() OVER (ORDER BY place, doc_id) - 1 AS i, count(*) OVER () AS n FROM p)
SELECT doc_id, CAST(i // CAST(ceil(n / 6) AS BIGINT) AS INTEGER) AS shard FROM i""")
def shuffled_shards(spark, sf_dir):
    return R.shuffled_shards(docs(spark, sf_dir), F.col("doc_id"), ["doc_id"], 6, 7).select("doc_id", "shard")


CORPORA = [("cc_en_head", "cc_en_head-", 612), ("cc_en_middle", "cc_en_middle-", 777), ("cc_en_tail", "cc_en_tail-", 1493), ("peS2o", "s2_v3-", 42), ("c4", "c4-", 86), ("books", "books-", 3), ("wiki", "en_simple_wiki-", 2)]


@suite.query(f"""
SELECT corpus, prefix || lpad(CAST(i AS VARCHAR), 4, '0') || '.json.gz' AS file, 'https://example.org/data/' || corpus || '/' || prefix || lpad(CAST(i AS VARCHAR), 4, '0') || '.json.gz' AS url
FROM (SELECT corpus, prefix, unnest(range(0, files)) AS i FROM (VALUES {', '.join(str(c) for c in CORPORA)}) c(corpus, prefix, files))""")
def download_manifest(spark, sf_dir):
    return C.manifest(spark.createDataFrame(CORPORA, "corpus string, prefix string, files int"), "https://example.org/data")


@suite.query("SELECT page_id, string_split(url, '/')[-2] AS folder, string_split(url, '/')[-1] AS file FROM pages")
def url_split(spark, sf_dir):
    folder, file = C.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", folder.alias("folder"), file.alias("file"))


@suite.query("SELECT event_id, CAST(CASE WHEN event_id % 10 > 1 THEN json_extract(props, '$.k') END AS INTEGER) AS k, event_id % 10 = 1 AS malformed FROM events")
def json_permissive_scan(spark, sf_dir):
    line = F.when(F.col("event_id") % 10 == 0, " ").when(F.col("event_id") % 10 == 1, "{bad").otherwise(F.col("props"))
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return C.parse_lines(lines, "line", "k int").select("event_id", F.col("record.k").alias("k"), "malformed")
