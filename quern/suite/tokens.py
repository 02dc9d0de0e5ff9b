"""Tokens: vocabularies, sequence algebra, packing and streams over ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions.fields import FieldProcessor
from quern.functions.vocab import CodepointVocabulary, DictionaryVocabulary, words
from quern.operators import packing, streams
from quern.operators.order import kept
from quern.operators.relations import group_concat
from quern.plans.converters import decoder_features, rekey
from quern.suite.base import CODEPOINTS, WORDS_SQL, Suite, cp, digest_sql, table

suite = Suite()
T = f"SELECT doc_id, source, {cp('text')} AS t FROM documents"
D = digest_sql


def tokens(spark, sf_dir, *more):
    return table(spark, sf_dir, "documents").select("doc_id", *more, CODEPOINTS.encode(F.col("text")).alias("t"))


@suite.query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, {D('t')} AS digest FROM ({T})")
def codepoint_tokenize(spark, sf_dir):
    return tokens(spark, sf_dir).select("doc_id", F.size("t").alias("n_tokens"), A.digest(F.col("t")).alias("digest"))


@suite.query(f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, {D('w')} AS digest FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
def ws_tokenize(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_tokens"), A.digest(F.col("w")).alias("digest"))


TOP_WORDS = 500


@suite.query(f"""
WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents),
v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM (SELECT word, count(*) AS n FROM w GROUP BY word) QUALIFY id <= {TOP_WORDS})
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (WHERE id IS NULL) AS BIGINT) AS n_unk, CAST(sum(coalesce(id, {TOP_WORDS + 1})) AS BIGINT) AS id_sum
FROM w LEFT JOIN v USING (word) GROUP BY doc_id""")
def unigram_vocab_encode(spark, sf_dir):
    """A dictionary of the commonest words, which is a bounded table, and every word's id."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    top = w.groupBy("word").count().orderBy(F.desc("count"), "word").limit(TOP_WORDS)
    ids = top.select("word", F.row_number().over(Window.orderBy(F.desc("count"), "word")).cast("long").alias("id"))
    joined = DictionaryVocabulary.join_ids(w, F.broadcast(ids), TOP_WORDS + 1)
    return joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.when(F.col("id") == TOP_WORDS + 1, 1).otherwise(0)).alias("n_unk"), F.sum("id").alias("id_sum"))


@suite.query(f"""
WITH k AS (SELECT doc_id, list_transform(t, lambda x: CASE WHEN x >= 200 THEN 63 ELSE x END) AS k FROM ({T})),
p AS (SELECT doc_id, k, coalesce(list_position(k, 46), 0) AS pos FROM k)
SELECT doc_id, CAST(CASE WHEN pos > 0 THEN pos ELSE len(k) END AS INTEGER) AS n_kept, {D('CASE WHEN pos > 0 THEN k[1:pos] ELSE k END')} AS kept,
  {D('list_transform(k, lambda x, i: CASE WHEN pos > 0 AND i > pos THEN -1 ELSE x END)')} AS padded FROM p""")
def decode_until_eos(spark, sf_dir):
    v = CodepointVocabulary(eos=46, unk=63)
    v.base_size = 200
    t = tokens(spark, sf_dir)
    kept = v.until_eos(F.col("t"))
    return t.select("doc_id", F.size(kept).alias("n_kept"), A.digest(kept).alias("kept"), A.digest(v.padded_after_eos(F.col("t"))).alias("padded"))


@suite.query("SELECT doc_id AS id, '' AS inputs, md5(text) AS targets FROM documents")
def rekey_fields(spark, sf_dir):
    record = table(spark, sf_dir, "documents").select(F.struct("doc_id", "text").alias("rec"))
    return rekey(record, {"id": "rec/doc_id", "inputs": None, "targets": "rec/text"}).withColumn("targets", F.md5("targets"))


@suite.query("SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS caption, CAST(doc_id AS BIGINT) AS image_id FROM documents")
def metadata_ws_collapse(spark, sf_dir):
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".jpg"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", r"[ \t\n\f\r]+", " ")).alias("caption"), F.substr(name, F.lit(1), F.length(name) - 4).cast("long").alias("image_id"))


@suite.query(f"SELECT doc_id, CAST(seg AS INTEGER) AS seg, CAST(len(x) AS INTEGER) AS n_tokens, {D('x')} AS digest FROM (SELECT doc_id, seg, t[seg * 64 + 1:seg * 64 + 64] AS x FROM (SELECT doc_id, t, unnest(range(0, CAST(ceil(len(t) / 64) AS BIGINT))) AS seg FROM ({T})))")
def split_tokens(spark, sf_dir):
    return streams.split_rows(tokens(spark, sf_dir), "t", 64).select("doc_id", "seg", F.size("t").alias("n_tokens"), A.digest(F.col("t")).alias("digest"))


@suite.query(f"""
WITH l AS (SELECT doc_id, t, CAST(floor(exp(ln(32.0) + {A.hashed_uniform_sql('doc_id', 3)} * (ln(256.0) - ln(32.0)))) AS BIGINT) AS n FROM ({T})),
s AS (SELECT *, unnest(range(0, CAST(ceil(len(t) / n) AS BIGINT))) AS seg FROM l)
SELECT doc_id, CAST(seg AS INTEGER) AS seg, CAST(len(t[seg * n + 1:seg * n + n]) AS INTEGER) AS n_tokens FROM s""")
def split_tokens_ranged(spark, sf_dir):
    """Piece lengths drawn log-uniformly from [32, 256) by document."""
    u = A.hashed_uniform(F.col("doc_id"), 3)
    length = F.floor(F.exp(F.ln(F.lit(32.0)) + u * (F.ln(F.lit(256.0)) - F.ln(F.lit(32.0)))))
    return streams.split_rows(tokens(spark, sf_dir), "t", length).select("doc_id", "seg", F.size("t").alias("n_tokens"))


@suite.query(f"""
WITH u AS (SELECT doc_id, t, {A.hashed_uniform_sql('doc_id', 5)} AS u, len(t) AS n FROM ({T})),
s AS (SELECT *, CAST(floor(u * ceil(n / 256)) AS BIGINT) * 256 AS a, CAST(floor(u * (n + 255)) AS BIGINT) - 255 AS b FROM u)
SELECT doc_id, {D('t[a + 1:a + 256]')} AS aligned, {D('t[greatest(b, 0) + 1:least(b + 256, n)]')} AS free FROM s""")
def random_chunk(spark, sf_dir):
    u = A.hashed_uniform(F.col("doc_id"), 5)
    return tokens(spark, sf_dir).select("doc_id", A.digest(streams.random_chunk(F.col("t"), 256, u)).alias("aligned"), A.digest(streams.random_chunk(F.col("t"), 256, u, True)).alias("free"))


@suite.query(f"SELECT doc_id, CAST(len(t) + 2 AS INTEGER) AS n_tokens, {D('list_concat(t, [2, 1])')} AS digest FROM ({T})")
def append_eos_bos(spark, sf_dir):
    x = A.append(F.col("t"), CODEPOINTS.eos, CODEPOINTS.bos)
    return tokens(spark, sf_dir).select("doc_id", F.size(x).alias("n_tokens"), A.digest(x).alias("digest"))


@suite.query(f"SELECT doc_id, {D('list_concat([1], t[1:len(t) - 1])')} AS digest FROM ({T})")
def shift_right(spark, sf_dir):
    return tokens(spark, sf_dir).select("doc_id", A.digest(A.shift_right(F.col("t"), 1)).alias("digest"))


@suite.query(f"SELECT doc_id, {D('list_concat(t[1:128], list_transform(range(0, greatest(128 - len(t), 0)), lambda i: -1))')} AS digest FROM ({T})")
def trim_pad(spark, sf_dir):
    return tokens(spark, sf_dir).select("doc_id", A.digest(A.trim_pad(F.col("t"), 128, -1)).alias("digest"))


@suite.query(f"""
WITH g AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS gid, doc_id, list_concat(t, [2, 1]) AS t FROM ({T})),
f AS (SELECT gid, flatten(list(t ORDER BY doc_id)) AS t FROM g GROUP BY gid)
SELECT CAST(gid AS BIGINT) AS gid, CAST(len(t) AS INTEGER) AS n_tokens, {D('t')} AS digest FROM f""")
def concat_groups_128(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_concat(docs, ["doc_id"], "t", 128, encode=A.append(CODEPOINTS.encode(F.col("text")), 2, 1), drop=("text",)).select("gid", F.size("t").alias("n_tokens"), A.digest(F.col("t")).alias("digest"))


@suite.query(f"""
WITH g AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS gid, doc_id, list_concat(t, [2, 1]) AS t FROM ({T})),
f AS (SELECT gid, flatten(list(t ORDER BY doc_id)) AS t FROM g GROUP BY gid),
s AS (SELECT gid, t, unnest(range(0, CAST(ceil(len(t) / 2048) AS BIGINT))) AS seg FROM f)
SELECT CAST(gid AS BIGINT) AS gid, CAST(seg AS INTEGER) AS seg, CAST(len(t[seg * 2048 + 1:seg * 2048 + 2048]) AS INTEGER) AS n_tokens, {D('t[seg * 2048 + 1:seg * 2048 + 2048]')} AS digest FROM s""")
def full_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.length("text") > 0)
    out = streams.full_lm(docs, ["doc_id"], "t", 2048, 2, 1, most=None, encode=CODEPOINTS.encode(F.col("text")), drop=("text",))
    return out.select("gid", "seg", F.size("t").alias("n_tokens"), A.digest(F.col("t")).alias("digest"))


@suite.query(f"""
WITH p AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, v FROM (SELECT doc_id, unnest(t) AS v, unnest(range(0, len(t))) AS i FROM ({T}))),
n AS (SELECT count(*) AS total FROM p),
a AS (SELECT pos // 1024 AS chunk, list(CASE WHEN pos % 256 = 0 THEN 1 ELSE v END ORDER BY pos) AS x FROM p GROUP BY 1),
b AS (SELECT (pos - 1) // 1024 AS chunk, list(v ORDER BY pos) AS x FROM p WHERE pos > 0 GROUP BY 1)
SELECT CAST(chunk AS BIGINT) AS chunk, CAST(len(a.x) AS INTEGER) AS n, {D('a.x')} AS inputs, {D('b.x')} AS targets FROM a JOIN b USING (chunk), n WHERE total > (chunk + 1) * 1024 + 1""")
def concat_chunk_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = streams.concat_and_chunk(docs, ["doc_id"], "t", 4, 256, bos=1, derive={"t": CODEPOINTS.encode(F.col("text"))}, drop=("text",))
    return out.select("chunk", F.size("inputs").alias("n"), A.digest(F.col("inputs")).alias("inputs"), A.digest(F.col("targets")).alias("targets"))


@suite.query(f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS example_index, CAST(sum(len(t)) OVER (ORDER BY doc_id) AS BIGINT) AS total_tokens,
  CAST(greatest(floor((sum(len(t)) OVER (ORDER BY doc_id) - 2) / 1024), 0) AS BIGINT) AS chunks FROM ({T})""")
def stream_totals(spark, sf_dir):
    return streams.stream_totals(tokens(spark, sf_dir), ["doc_id"], "t", 4, 256)


LENGTH, EXAMPLES = 512, 64
PACK = f"""
WITH RECURSIVE d AS (SELECT source, doc_id, t[1:{LENGTH}] AS t, least(len(t), {LENGTH}) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM ({T})),
g AS (SELECT *, idx // {EXAMPLES} AS block, idx % {EXAMPLES} AS j FROM d),
f AS (SELECT source, block, j, doc_id, n, 0 AS bin, 0 AS off FROM g WHERE j = 0
  UNION ALL SELECT g.source, g.block, g.j, g.doc_id, g.n, CASE WHEN f.off + f.n + g.n > {LENGTH} THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.off + f.n + g.n > {LENGTH} THEN 0 ELSE f.off + f.n END
  FROM f JOIN g ON g.source = f.source AND g.block = f.block AND g.j = f.j + 1)
"""


def _packed(spark, sf_dir, t=None):
    t = tokens(spark, sf_dir, "source") if t is None else t
    groups = packing.packing_groups(t.select("doc_id", "source", F.size("t").alias("n")), ["source"], ["doc_id"], EXAMPLES)
    return packing.next_fit(groups, ["source", "block"], ["doc_id"], {"t": F.col("n")}, {"t": LENGTH})


@suite.query(f"{PACK} SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(bin AS INTEGER) AS bin, CAST(off AS INTEGER) AS off FROM f")
def pack_next_fit(spark, sf_dir):
    return _packed(spark, sf_dir).select("doc_id", "source", "block", "bin", F.col("off_t").alias("off"))


@suite.query(f"""{PACK}, b AS (SELECT source, block, bin, count(*) AS segments, sum(n) AS n FROM f GROUP BY ALL)
SELECT source, CAST(count(*) AS BIGINT) AS n_bins, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(max(segments) AS BIGINT) AS most_segments FROM b GROUP BY source""")
def pack_segment_stats(spark, sf_dir):
    bins = _packed(spark, sf_dir).groupBy("source", "block", "bin").agg(F.count(F.lit(1)).alias("segments"), F.sum("n_t").alias("n"))
    return bins.groupBy("source").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n_tokens"), F.max("segments").alias("most_segments"))


@suite.query(f"""{PACK}, s AS (SELECT f.*, g.t, row_number() OVER (PARTITION BY f.source, f.block, bin ORDER BY f.j) AS seg FROM f JOIN g USING (source, block, j)),
b AS (SELECT source, block, bin, flatten(list(t ORDER BY j)) AS t, flatten(list(list_transform(t, lambda x: seg) ORDER BY j)) AS seg, flatten(list(range(0, n) ORDER BY j)) AS pos FROM s GROUP BY source, block, bin),
p AS (SELECT source, block, bin, list_concat(t, list_transform(range(0, {LENGTH} - len(t)), lambda i: -1)) AS t, list_concat(seg, list_transform(range(0, {LENGTH} - len(t)), lambda i: 0)) AS seg,
  list_concat(pos, list_transform(range(0, {LENGTH} - len(t)), lambda i: -1)) AS pos FROM b)
SELECT source, CAST(block AS BIGINT) AS block, CAST(bin AS INTEGER) AS bin, {D('t')} AS targets, {D('seg')} AS segment_ids, {D('pos')} AS positions,
  {D(f'list_transform(list_zip(list_concat([1], t[1:{LENGTH - 1}]), seg, list_concat([-9], seg[1:{LENGTH - 1}])), lambda z: CASE WHEN z[2] <> z[3] THEN 1 ELSE z[1] END)')} AS inputs FROM p""")
def packed_sequences(spark, sf_dir):
    t = kept(tokens(spark, sf_dir, "source"))  # encoded once
    placed = _packed(spark, sf_dir, t).join(t.select("doc_id", "t"), "doc_id")
    out = packing.assemble(placed, ["source", "block"], "t", LENGTH, pad=-1, bos=1)
    return out.select("source", "block", "bin", *[A.digest(F.col(c)).alias(c) for c in ("targets", "segment_ids", "positions", "inputs")])


@suite.query(f"""
WITH x AS (SELECT doc_id, {cp("lang || ' ' || source")} AS a, {cp('text')} AS b FROM documents)
SELECT doc_id, CAST(len(a) + len(b) + 5 AS INTEGER) AS n_tokens, CAST(len(b) + 4 AS DOUBLE) AS mask_sum, {D('list_concat(list_concat(list_concat([1], a), list_concat([7], b)), [1, -1, 2])')} AS digest FROM x""")
def text_processor_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("buf", F.base64(F.unhex(F.lit("01000000FFFFFFFF"))))
    t, m = FieldProcessor("[lang+source],<|7|>,text,{buf}", CODEPOINTS).columns()
    return docs.select("doc_id", F.size(t).alias("n_tokens"), F.aggregate(m, F.lit(0.0), lambda a, v: a + v).alias("mask_sum"), A.digest(t).alias("digest"))


@suite.query(f"""
WITH p AS (SELECT doc_id, list_concat(t[1:256], list_transform(range(0, greatest(256 - len(t), 0)), lambda i: 0)) AS t FROM ({T}))
SELECT doc_id, CAST(list_sum(list_transform(t, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS INTEGER) AS n_loss, {D('list_concat([0], t[1:255])')} AS inputs, {D('t')} AS targets FROM p""")
def lm_features(spark, sf_dir):
    f = decoder_features(tokens(spark, sf_dir).select("doc_id", A.trim_pad(F.col("t"), 256, 0).alias("targets")))
    return f.select("doc_id", F.aggregate("decoder_loss_weights", F.lit(0), lambda a, v: a + v).alias("n_loss"), A.digest(F.col("decoder_input_tokens")).alias("inputs"), A.digest(F.col("decoder_target_tokens")).alias("targets"))


@suite.query(f"""
WITH m AS (SELECT doc_id, list_concat(list_transform(range(0, 96 - least(len(t), 96)), lambda i: 0), list_transform(range(0, least(len(t), 96)), lambda i: 1)) AS m FROM ({T}))
SELECT doc_id, {D('list_transform(range(1, 97), lambda i: CAST(list_sum(m[1:i]) AS BIGINT) - 1)')} AS positions, {D('list_transform(range(1, 97), lambda i: greatest(CAST(list_sum(m[1:i]) AS BIGINT) - 1, 0))')} AS clamped FROM m""")
def position_ids(spark, sf_dir):
    n = F.least(F.size("t"), F.lit(96))
    m = tokens(spark, sf_dir).select("doc_id", F.concat(A.filled(0, F.lit(96) - n), A.filled(1, n)).alias("m"))
    return m.select("doc_id", A.digest(A.position_ids(F.col("m"))).alias("positions"), A.digest(A.position_ids(F.col("m"), True)).alias("clamped"))


MASKED = f"SELECT doc_id, {cp('text')} AS t, list_transform(range(0, length(text)), lambda i: (i + doc_id) % 2) AS m FROM documents"


def masked(spark, sf_dir):
    """Tokens and, as long, a loss mask that depends on place and document."""
    t = tokens(spark, sf_dir)
    return t.withColumn("m", F.transform("t", lambda x, i: ((i + F.col("doc_id")) % 2).cast("long")))


@suite.query(f"""
WITH p AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, v, m FROM (SELECT doc_id, unnest(t) AS v, unnest(m) AS m, unnest(range(0, len(t))) AS i FROM ({MASKED}))),
n AS (SELECT count(*) AS total FROM p), b AS (SELECT (pos - 1) // 1024 AS chunk, list(v ORDER BY pos) AS x, list(m ORDER BY pos) AS m FROM p WHERE pos > 0 GROUP BY 1)
SELECT CAST(chunk AS BIGINT) AS chunk, {D('x')} AS targets, {D('m')} AS loss_masks FROM b, n WHERE total > (chunk + 1) * 1024 + 1""")
def concat_chunk_masks(spark, sf_dir):
    """Loss masks go with their targets through the stream of chunks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    derive = {"t": CODEPOINTS.encode(F.col("text")), "m": F.transform("t", lambda x, i: ((i + F.col("doc_id")) % 2).cast("long"))}
    out = streams.concat_and_chunk(docs, ["doc_id"], "t", 4, 256, masks="m", derive=derive, drop=("text",))
    return out.select("chunk", A.digest(F.col("targets")).alias("targets"), A.digest(F.col("loss_masks")).alias("loss_masks"))


@suite.query(f"""
SELECT doc_id, CAST(seg AS INTEGER) AS seg, {D('t[seg * 100 + 1:seg * 100 + 100]')} AS tokens, {D('m[seg * 100 + 1:seg * 100 + 100]')} AS masks
FROM (SELECT *, unnest(range(0, CAST(ceil(len(t) / 100) AS BIGINT))) AS seg FROM ({MASKED}))""")
def split_tokens_parallel(spark, sf_dir):
    out = streams.split_rows(masked(spark, sf_dir), "t", 100, parallel=["m"], passthrough=["doc_id"])
    return out.select("doc_id", "seg", A.digest(F.col("t")).alias("tokens"), A.digest(F.col("m")).alias("masks"))


@suite.query(f"""
WITH u AS (SELECT *, 100 + CAST(floor({A.hashed_uniform_sql('doc_id', 6)} * 156) AS BIGINT) AS n, {A.hashed_uniform_sql('doc_id', 5)} AS u FROM ({MASKED}) WHERE len(t) > 0),
s AS (SELECT *, CAST(floor(u * ceil(len(t) / n)) AS BIGINT) * n AS a FROM u)
SELECT doc_id, {D('t[a + 1:a + n]')} AS tokens, {D('m[a + 1:a + n]')} AS masks FROM s""")
def random_chunk_parallel(spark, sf_dir):
    """Chunks of a drawn length, of tokens and masks alike."""
    out = streams.random_chunks(masked(spark, sf_dir), "t", 256, F.col("doc_id"), parallel=["m"], min_length=100, seed=5)
    return out.select("doc_id", A.digest(F.col("t")).alias("tokens"), A.digest(F.col("m")).alias("masks"))


@suite.query(f"""{PACK}, s AS (SELECT f.source, f.block, f.bin, f.j, f.n, f.off, f.doc_id, g.t FROM f JOIN g USING (source, block, j)),
b AS (SELECT source, block, bin, flatten(list(t ORDER BY j)) AS t, flatten(list(list_transform(range(0, n), lambda i: (i + doc_id) % 2) ORDER BY j)) AS w, list(off + 3 ORDER BY j) AS pl FROM s GROUP BY source, block, bin)
SELECT source, CAST(block AS BIGINT) AS block, CAST(bin AS INTEGER) AS bin, {D('w')} AS weights, {D('pl')} AS places, CAST(len(t) AS INTEGER) AS n_tokens FROM b""")
def packed_features(spark, sf_dir):
    """Loss weights and positions packed with their tokens: weights as long as they, positions moved by what stands before."""
    t = kept(masked(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"))
    placed = _packed(spark, sf_dir, t).join(t.select("doc_id", "t", F.col("m").alias("weights"), F.array(F.array(F.lit(3))).alias("places")), "doc_id")
    out = packing.assemble(placed, ["source", "block"], "t", LENGTH, pad=-1, bos=1, parallel={"weights": -1}, index="places")
    n = F.aggregate("segment_ids", F.lit(0), lambda a, v: a + F.when(v > 0, 1).otherwise(0))
    return out.select("source", "block", "bin", A.digest(F.slice("weights", F.lit(1), n)).alias("weights"), A.digest(F.flatten("places")).alias("places"), n.alias("n_tokens"))


SPECS = ["[lang],text", "<|7|>,[source+lang],text"]


@suite.query(f"""
WITH x AS (SELECT doc_id, {cp('lang')} AS l, {cp("source || ' ' || lang")} AS s, {cp('text')} AS b FROM documents)
SELECT doc_id, {D('CASE WHEN doc_id % 2 = 0 THEN list_concat(list_concat(list_concat([1], l), b), [2]) ELSE list_concat(list_concat(list_concat([1, 7], s), b), [2]) END')} AS tokens,
  CAST(len(b) + 1 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS mask_sum FROM x""")
def text_processor_row_fields(spark, sf_dir):
    """Each row names its own field specification."""
    docs = table(spark, sf_dir, "documents").withColumn("spec", F.when(F.col("doc_id") % 2 == 0, SPECS[0]).otherwise(SPECS[1]))
    t, m = FieldProcessor(SPECS[0], CODEPOINTS).columns_by_row(F.col("spec"), SPECS)
    return docs.select("doc_id", A.digest(t).alias("tokens"), F.aggregate(m, F.lit(0.0), lambda a, v: a + v).alias("mask_sum"))
