"""Expert routing, parameter names, image geometry and scoring requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions import geometry as G
from quern.operators import routing, scoring, trees
from quern.suite.base import CODEPOINTS, Suite, cp, digest_sql, quoted, table

suite = Suite()
D = digest_sql
EXPERTS, GROUP, CAPACITY = 8, 50, 13
PROBS = f"SELECT vec_id // {GROUP} AS g, vec_id AS token, e, exp(5.0 * CAST(embedding[e + 1] AS DOUBLE)) AS p FROM embeddings, range(0, {EXPERTS}) r(e)"
CHOSEN = f"""WITH p AS ({PROBS}), c AS (SELECT *, row_number() OVER (PARTITION BY g, token ORDER BY p DESC, e) - 1 AS choice FROM p QUALIFY choice < 2),
q AS (SELECT *, row_number() OVER (PARTITION BY g, e ORDER BY token, choice) - 1 AS place FROM c)"""


def probs(spark, sf_dir):
    first = F.slice("embedding", 1, EXPERTS)
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / GROUP).cast("long").alias("g"), F.col("vec_id").alias("token"), F.posexplode(first).alias("e", "x"))
    return e.select("g", "token", "e", F.exp(F.lit(5.0) * F.col("x").cast("double")).alias("p"))


@suite.query(f"{CHOSEN} SELECT token, CAST(choice AS INTEGER) AS choice, CAST(e AS INTEGER) AS e, CAST(place AS INTEGER) AS place FROM q")
def moe_topk_places(spark, sf_dir):
    return routing.queue_places(routing.top_experts(probs(spark, sf_dir), "g", "token", "e", "p", 2), "g", "token", "e").select("token", "choice", "e", "place")


LOAD = f"load AS (SELECT g, e, count(c.token) AS load FROM (SELECT DISTINCT g FROM p) x CROSS JOIN range(0, {EXPERTS}) r(e) LEFT JOIN c USING (g, e) GROUP BY g, e)"


@suite.query(f"""{CHOSEN}, {LOAD}
SELECT CAST(g AS BIGINT) AS g, CAST(e AS INTEGER) AS e, CAST(load AS BIGINT) AS load, CAST(greatest(load - {CAPACITY}, 0) AS BIGINT) AS overflow, CAST(greatest({CAPACITY} - load, 0) AS BIGINT) AS available,
  row_number() OVER (PARTITION BY g ORDER BY greatest({CAPACITY} - load, 0) DESC, e) = 1 AS least_loaded FROM load""")
def moe_load_capacity(spark, sf_dir):
    return routing.expert_load(routing.top_experts(probs(spark, sf_dir), "g", "token", "e", "p", 2), "g", "e", EXPERTS, CAPACITY)


@suite.query(f"""{CHOSEN}, {LOAD}, within AS (SELECT g, token, e FROM q WHERE place < {CAPACITY}),
over AS (SELECT g, token, count(*) AS missed FROM q WHERE place >= {CAPACITY} GROUP BY g, token),
w AS (SELECT p.g, p.token, p.e, p.p * CASE WHEN missed = 2 THEN 1.2 ELSE 1.0 END AS v, greatest({CAPACITY} - load, 0) AS room FROM p JOIN over USING (g, token) JOIN load USING (g, e) ANTI JOIN within USING (g, token, e)),
t AS (SELECT *, count(*) OVER (PARTITION BY g, e ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM w)
SELECT CAST(g AS BIGINT) AS g, token, CAST(e AS INTEGER) AS e, false AS again FROM within UNION ALL SELECT CAST(g AS BIGINT), token, CAST(e AS INTEGER), true FROM t WHERE reach <= room""")
def moe_redistribute(spark, sf_dir):
    return routing.redistribute(probs(spark, sf_dir), "g", "token", "e", "p", 2, CAPACITY, EXPERTS)


NAMES = ["transformer/wte/embedding", "transformer/h/0/attention/wq/kernel", "transformer/h/0/attention/wo/kernel", "transformer/h/1/feed_forward/w2/kernel", "transformer/h/1/attention_norm/kernel", "lm_head/kernel", "step"]
NAME_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {quoted(n)}" for i, n in enumerate(NAMES)) + " END || '/' || source"


def names(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(name, F.lit("/"), "source").alias("path"))


@suite.query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(path, {quoted(p)}) THEN {quoted(v)}" for p, v in trees.PARTITION_RULES) + f" END AS rule FROM (SELECT doc_id, {NAME_SQL} AS path FROM documents)")
def partition_rules_first_match(spark, sf_dir):
    return names(spark, sf_dir).select("doc_id", trees.first_match(F.col("path"), trees.PARTITION_RULES).alias("rule"))


@suite.query(f"""
SELECT doc_id, CASE WHEN regexp_matches(path, 'attention/w[qo]|lm_head') THEN 'trainable' ELSE 'frozen' END AS part, NOT (regexp_matches(path, 'norm') OR regexp_matches(path, 'embedding')) AS decayed,
  CASE WHEN starts_with(path, 'transformer/') THEN substr(path, 13) ELSE path END AS short FROM (SELECT doc_id, {NAME_SQL} AS path FROM documents)""")
def trainable_mask(spark, sf_dir):
    p = F.col("path")
    return names(spark, sf_dir).select("doc_id", trees.trainable(p, ["attention/w[qo]", "lm_head"]).alias("part"), trees.decayed(p, ["norm", "embedding"]).alias("decayed"), trees.normalised_key(p, "transformer/").alias("short"))


SIZE = "SELECT doc_id, CAST(100 + (doc_id * 37) % 1900 AS DOUBLE) AS h, CAST(100 + (doc_id * 91) % 1900 AS DOUBLE) AS w FROM documents"


def sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (100 + (F.col("doc_id") * 37) % 1900).cast("double").alias("h"), (100 + (F.col("doc_id") * 91) % 1900).cast("double").alias("w"))


OPTIONS = ", ".join(f"({n}, {i}, {j})" for n, (i, j) in enumerate(G.tilings(4)))


@suite.query(f"""
WITH s AS (SELECT *, least(i * 336.0::DOUBLE / h, j * 336.0::DOUBLE / w) AS scale FROM ({SIZE}), (VALUES {OPTIONS}) t(n, i, j)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY scale >= 1 DESC, CASE WHEN scale >= 1 THEN scale ELSE -scale END, n) AS k FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS rows, CAST(j AS INTEGER) AS cols FROM r WHERE k = 1""")
def image_tiling(spark, sf_dir):
    best = G.select_tiling(F.col("h"), F.col("w"), 336, 4)
    return sizes(spark, sf_dir).select("doc_id", best.alias("t")).select("doc_id", F.col("t.rows").alias("rows"), F.col("t.cols").alias("cols"))


@suite.query(f"""
WITH x AS (SELECT doc_id, list_transform(range(0, 16), lambda i: (i * 5 + doc_id) % 16) AS o FROM documents)
SELECT doc_id, {D('list_transform(range(0, 16), lambda i: list_position(o, i) - 1)')} AS inverse FROM x""")
def patch_inverse_perm(spark, sf_dir):
    order = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((i * 5 + F.col("doc_id")) % 16).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", A.digest(G.inverse_permutation(order)).alias("inverse"))


@suite.query(f"""
WITH s AS (SELECT doc_id, 1 + doc_id % 3 AS r, 1 + doc_id % 4 AS c FROM documents),
t AS (SELECT doc_id, c, list_concat(list_concat([90], flatten(list_transform(range(0, r), lambda i: list_concat(list_transform(range(0, c), lambda j: 91), [92])))), [93]) AS t FROM s),
p AS (SELECT doc_id, c, t, list_filter(list_transform(t, lambda x, i: CASE WHEN x = 91 THEN i - 1 ELSE -1 END), lambda i: i >= 0) AS pos FROM t)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, {D('t')} AS layout, CAST(len(pos) // c AS INTEGER) AS n_rows, {D('pos')} AS positions FROM p""")
def patch_token_layout(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("r"), (1 + F.col("doc_id") % 4).cast("int").alias("c"))
    t = d.withColumn("t", G.patch_layout(F.col("r"), F.col("c"), 91, 92, 90, 93))
    one = [G.token_positions(F.col("t"), 91, k) for k in (1, 2, 3, 4)]
    rows = F.when(F.col("c") == 1, one[0]).when(F.col("c") == 2, one[1]).when(F.col("c") == 3, one[2]).otherwise(one[3])
    return t.withColumn("rows", rows).select("doc_id", F.size("t").alias("n_tokens"), A.digest(F.col("t")).alias("layout"), F.size("rows").alias("n_rows"), A.digest(F.flatten("rows")).alias("positions"))


BOX = f"SELECT doc_id, h, w, (doc_id % 10) / 20.0::DOUBLE * h AS y0, (doc_id % 7) / 20.0::DOUBLE * w AS x0, (doc_id % 13) / 12.0::DOUBLE * h AS y1, (doc_id % 11) / 10.0::DOUBLE * w AS x1 FROM ({SIZE})"


@suite.query(f"""
WITH b AS ({BOX}), r AS (SELECT doc_id, h, w, y0 * 1.5 - 10 + 4 AS y0, x0 * 1.5 - 20 + 6 AS x0, y1 * 1.5 - 10 + 4 AS y1, x1 * 1.5 - 20 + 6 AS x1 FROM b),
c AS (SELECT doc_id, greatest(least(y0, h), 0.0) AS y0, greatest(least(x0, w), 0.0) AS x0, greatest(least(y1, h), 0.0) AS y1, greatest(least(x1, w), 0.0) AS x1 FROM r)
SELECT doc_id, round(y0, 6) AS y0, round(x0, 6) AS x0, round(y1, 6) AS y1, round(x1, 6) AS x1 FROM c WHERE y1 - y0 > 0 AND x1 - x0 > 0""")
def box_clip(spark, sf_dir):
    s = sizes(spark, sf_dir)
    k = F.col("doc_id")
    share = [(k % 10) / F.lit(20.0), (k % 7) / F.lit(20.0), (k % 13) / F.lit(12.0), (k % 11) / F.lit(10.0)]
    box = G.denormalized(share, F.col("h"), F.col("w"))
    box = G.clipped(G.resized(box, F.lit(1.5), F.lit(1.5), (F.lit(10.0), F.lit(20.0)), (F.lit(4.0), F.lit(6.0))), F.col("h"), F.col("w"))
    named = s.select("doc_id", *[b.alias(n) for b, n in zip(box, ("y0", "x0", "y1", "x1"), strict=True)])
    return named.where(G.has_area([F.col(n) for n in ("y0", "x0", "y1", "x1")])).select("doc_id", *[F.round(n, 6).alias(n) for n in ("y0", "x0", "y1", "x1")])


@suite.query(f"""
WITH s AS (SELECT doc_id, h, w, least(336.0::DOUBLE / h, 336.0::DOUBLE / w) AS scale FROM ({SIZE})),
r AS (SELECT *, CAST(least(round(h * scale), 336.0) AS INTEGER) AS sh, CAST(least(round(w * scale), 336.0) AS INTEGER) AS sw FROM s)
SELECT doc_id, sh AS scaled_h, sw AS scaled_w, CAST(floor((336 - sh) / 2) AS INTEGER) AS pad_top, CAST(floor((336 - sw) / 2) AS INTEGER) AS pad_left, h >= w * 4.0 / 3 AS tall FROM r""")
def resize_and_pad(spark, sf_dir):
    f = G.fit_and_pad(F.col("h"), F.col("w"), 336, 336)
    return sizes(spark, sf_dir).select("doc_id", *[f[n].alias(n) for n in ("scaled_h", "scaled_w", "pad_top", "pad_left")], G.is_tall(F.col("h"), F.col("w")).alias("tall"))


@suite.query(f"""
WITH m AS (SELECT doc_id, i, CASE WHEN (doc_id + i) % 3 = 0 THEN 1 ELSE 0 END AS m, {A.hashed_uniform_sql('doc_id * 4096 + i', 1)} AS u FROM documents, range(0, 20) r(i)),
o AS (SELECT doc_id, list(i ORDER BY 1 - m, u, i) AS o FROM m GROUP BY doc_id) SELECT doc_id, {D('o[1:10]')} AS places FROM o""")
def sample_patches(spark, sf_dir):
    mask = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.when((F.col("doc_id") + i) % 3 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "documents").select("doc_id", A.digest(A.sample_marked(mask, 10, F.col("doc_id"), 1)).alias("places"))


TOKENS = f"SELECT doc_id, {cp('text')} AS t FROM documents"


def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", CODEPOINTS.encode(F.col("text")).alias("t"))


@suite.query(f"""
WITH p AS (SELECT doc_id, greatest(64 - len(t), 0) AS k, t FROM ({TOKENS})),
x AS (SELECT doc_id, list_concat(list_transform(range(0, k), lambda i: 0), t[greatest(len(t) - 63, 1):]) AS x, list_concat(list_transform(range(0, k), lambda i: 0), list_transform(range(0, 64 - k), lambda i: 1)) AS m FROM p)
SELECT doc_id, {D('list_concat([1], x[2:])')} AS inputs, {D('m')} AS mask FROM x""")
def prefix_left_trunc(spark, sf_dir):
    ids, mask = scoring.prompt_inputs(F.col("t"), 64, 0, bos=1)
    return tokens(spark, sf_dir).select("doc_id", A.digest(ids).alias("inputs"), A.digest(mask).alias("mask"))


@suite.query(f"""
WITH p AS (SELECT doc_id, len(t) AS n, list_concat(t, list_transform(range(0, greatest(512 - len(t), 0)), lambda i: 0)) AS t FROM ({TOKENS})),
w AS (SELECT *, unnest(range(0, CAST(ceil(len(t) / 512) AS BIGINT))) AS k FROM p),
s AS (SELECT *, least(k * 512, len(t) - 512) AS a FROM w)
SELECT doc_id, CAST(k AS INTEGER) AS "window", {D('list_concat([1], t)[a + 1:a + 512]')} AS inputs, {D('t[a + 1:a + 512]')} AS outputs, CAST(least(a + 512, n) - k * 512 AS INTEGER) AS n_scored FROM s""")
def rolling_windows(spark, sf_dir):
    out = scoring.rolling_windows(tokens(spark, sf_dir), "t", 512, 0, 1)
    return out.select("doc_id", "window", A.digest(F.col("inputs")).alias("inputs"), A.digest(F.col("outputs")).alias("outputs"), F.aggregate("mask", F.lit(0), lambda a, v: a + v).alias("n_scored"))


@suite.query(f"""
WITH x AS (SELECT doc_id, {cp('lang')} AS p, t AS c FROM (SELECT doc_id, lang, {cp('text')} AS t FROM documents)), y AS (SELECT *, list_concat(p, c) AS o FROM x)
SELECT doc_id, {D('list_concat([1], o[1:len(o) - 1])')} AS inputs, {D('o')} AS outputs, CAST(len(c) AS INTEGER) AS n_scored FROM y""")
def prefix_continuation(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", CODEPOINTS.encode(F.col("lang")).alias("p"), CODEPOINTS.encode(F.col("text")).alias("c"))
    inputs, outputs, mask = scoring.continuation(F.col("p"), F.col("c"), 1)
    return t.select("doc_id", A.digest(inputs).alias("inputs"), A.digest(outputs).alias("outputs"), F.aggregate(mask, F.lit(0), lambda a, v: a + v).alias("n_scored"))


@suite.query("SELECT doc_id, md5(split_part(split_part(text, '. ', 1), chr(10), 1)) AS text FROM documents")
def stop_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scoring.until(F.col("text"), [". ", "\n"])).alias("text"))


@suite.query("SELECT doc_id, CAST(-1.0 AS DOUBLE) AS log_likelihood, false AS is_greedy, 'dummy text ' || source AS output_text FROM documents")
def dummy_score(spark, sf_dir):
    """Requests through the scorer interface with the scorer that needs no model."""
    dummy = scoring.DummyScorer()
    asked = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("until"))
    out = scoring.score(asked, lambda b: dummy.greedy_until(dummy.loglikelihood(b)), "doc_id long, until string, log_likelihood double, is_greedy boolean, output_text string")
    return out.drop("until")


@suite.query(f"""
WITH c AS (SELECT vec_id, e, CAST(embedding[e + 1] AS DOUBLE) AS v FROM embeddings, range(0, 4) r(e)), b AS (SELECT vec_id, e FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, e) = 1)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN e = label % 4 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM b JOIN embeddings USING (vec_id)""")
def eval_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scored = e.select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("e", "v"))
    gold = e.select("vec_id", (F.col("label") % 4).alias("answer"))
    return scoring.evaluate(scored, "vec_id", "e", "v", gold).withColumn("accuracy", F.round("accuracy", 9))
