"""Metrics and losses over ``events`` and ``embeddings`` (components as logits, labels as tokens)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.functions import numeric as N
from quern.operators import trees
from quern.operators.relations import running_average
from quern.suite.base import Suite, table

suite = Suite()


@suite.query("SELECT event_type, round(sum(value), 4) AS total, CAST(count(*) AS BIGINT) AS steps FROM events GROUP BY event_type")
def metric_sums(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(M.Sum.partial(total=F.col("value")).alias("s"), M.Step.partial(steps=F.lit(1)).alias("n"))
    return g.select("event_type", F.round(M.Sum.computed(F.col("s")), 4).alias("total"), M.Step.computed(F.col("n")).alias("steps"))


@suite.query("SELECT event_type, round(sum(t) / sum(s), 6) AS per_step, round(avg(t / s), 6) AS mean_of_parts FROM (SELECT event_type, user_id, sum(value) AS t, count(*) AS s FROM events GROUP BY ALL) GROUP BY event_type")
def metric_avg_per_step(spark, sf_dir):
    """Totals by steps, from partial totals that merge, and beside it the plain mean of the parts."""
    average = M.AveragePerStep
    parts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(average.partial(total=F.col("value"), steps=F.lit(1)).alias("p"))
    both = parts.groupBy("event_type").agg(average.merged(F.col("p")).alias("all"), F.avg(average.computed(F.col("p"))).alias("mean"))
    return both.select("event_type", F.round(average.computed(F.col("all")), 6).alias("per_step"), F.round("mean", 6).alias("mean_of_parts"))


@suite.query("""
SELECT event_type, round(sum(value) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS rate, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS steps_per_second,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration FROM events GROUP BY event_type""")
def time_rate(spark, sf_dir):
    parts = M.TimeRate.partial(numerator=F.col("value")).alias("r"), M.StepsPerTime.partial(steps=F.lit(1)).alias("n"), M.Time.span(F.col("ts").cast("timestamp")).alias("seconds")
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(*parts)
    rate, steps = M.TimeRate.computed(F.col("r"), F.col("seconds")), M.StepsPerTime.computed(F.col("n"), F.col("seconds"))
    return g.select("event_type", F.round(rate, 9).alias("rate"), F.round(steps, 9).alias("steps_per_second"), F.round("seconds", 3).alias("duration"))


@suite.query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS moving FROM events")
def moving_throughput(spark, sf_dir):
    """Mean of the last 200 values; the billionth keeps ties of rounding from falling either way."""
    return running_average(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("value"), 200).select("event_id", F.round(F.col("moving") + 1e-9, 6).alias("moving"))


CLASSES = 10
L = f"SELECT vec_id, vec_id // 8 AS batch_row, vec_id % 3 <> 0 AS valid, CAST(label AS INTEGER) AS label, list_transform(embedding[1:{CLASSES}], lambda x: 8.0 * CAST(x AS DOUBLE)) AS l FROM embeddings"
BASE = f"WITH l AS (SELECT *, list_max(l) AS m FROM ({L})), z AS (SELECT *, m + ln(list_sum(list_transform(l, lambda x: exp(x - m)))) AS z FROM l)"


def logits(spark, sf_dir):
    first = F.transform(F.slice("embedding", 1, CLASSES), lambda x: F.lit(8.0) * x.cast("double"))
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 8).cast("long").alias("batch_row"), (F.col("vec_id") % 3 != 0).cast("int").alias("valid"), F.col("label").cast("int").alias("label"), first.alias("l"))


@suite.query(f"""{BASE}, r AS (SELECT batch_row, sum(CASE WHEN valid THEN z - l[label + 1] ELSE 0 END) / greatest(sum(CASE WHEN valid THEN 1.0 ELSE 0 END), 1e-10) AS loss,
  sum(CASE WHEN valid AND list_position(l, m) = label + 1 THEN 1.0 ELSE 0 END) / greatest(sum(CASE WHEN valid THEN 1.0 ELSE 0 END), 1e-10) AS acc FROM z GROUP BY batch_row)
SELECT round(avg(loss), 6) AS loss, round(avg(acc), 6) AS accuracy FROM r""")
def xent_accuracy(spark, sf_dir):
    """Mean over rows of each row's mean over valid tokens."""
    t = logits(spark, sf_dir)
    loss, _ = N.token_losses(F.col("l"), F.col("label"), CLASSES)
    hit = F.when(N.argmax(F.col("l")) == F.col("label"), 1.0).otherwise(0.0)
    rows = t.groupBy("batch_row").agg(N.mean_by_rows(loss, F.col("valid")).alias("loss"), N.mean_by_rows(hit, F.col("valid")).alias("acc"))
    return rows.agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("acc"), 6).alias("accuracy"))


SMOOTH, ALPHA = 0.1, 0.001
ON, OFF, ENTROPY = N.smoothing_constants(CLASSES, SMOOTH)


@suite.query(f"""{BASE}, t AS (SELECT valid, z - {ON - OFF!r}::DOUBLE * l[label + 1] - {OFF!r}::DOUBLE * list_sum(l) - ({ENTROPY!r}::DOUBLE) AS loss, {ALPHA}::DOUBLE * z * z AS zl FROM z)
SELECT round(sum(CASE WHEN valid THEN loss ELSE 0 END) / greatest(sum(CASE WHEN valid THEN 1.0 ELSE 0 END), 1), 6) AS loss,
  round(sum(CASE WHEN valid THEN zl ELSE 0 END) / greatest(sum(CASE WHEN valid THEN 1.0 ELSE 0 END), 1), 6) AS z_loss FROM t""")
def xent_zloss_smoothed(spark, sf_dir):
    loss, z = N.token_losses(F.col("l"), F.col("label"), CLASSES, ALPHA, SMOOTH)
    t = logits(spark, sf_dir)
    return t.agg(F.round(N.mean_by_tokens(loss, F.col("valid")), 6).alias("loss"), F.round(N.mean_by_tokens(z, F.col("valid")), 6).alias("z_loss"))


@suite.query("SELECT round(avg(CASE WHEN vec_id % 3 <> 0 THEN pow(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE), 2) ELSE 0 END), 9) AS mse FROM embeddings")
def mse_masked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    return e.agg(F.round(N.masked_squared_error(F.col("a"), F.col("b"), F.col("vec_id") % 3 != 0), 9).alias("mse"))


@suite.query(f"{BASE} SELECT vec_id, round(m / 0.7, 6) AS hottest, round(list_sum(list_transform(l, lambda x: x / 0.7)), 6) AS total FROM z")
def temperature_scaling(spark, sf_dir):
    t = logits(spark, sf_dir).withColumn("s", N.tempered(F.col("l"), 0.7))
    return t.select("vec_id", F.round(F.array_max("s"), 6).alias("hottest"), F.round(N.total(F.col("s")), 6).alias("total"))


@suite.query(f"""{BASE} SELECT batch_row, round(sum(CASE WHEN valid THEN l[label + 1] - z ELSE 0 END), 6) AS log_likelihood,
  bool_and(NOT valid OR list_position(l, m) = label + 1) AS is_greedy FROM z GROUP BY batch_row""")
def loglik_greedy(spark, sf_dir):
    t = logits(spark, sf_dir)
    loss, _ = N.token_losses(F.col("l"), F.col("label"), CLASSES)
    hit = N.argmax(F.col("l")) == F.col("label")
    return t.groupBy("batch_row").agg(F.round(F.sum(F.when(F.col("valid") > 0, -loss).otherwise(0.0)), 6).alias("log_likelihood"), F.bool_and((F.col("valid") == 0) | hit).alias("is_greedy"))


@suite.query("""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), s AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-6) AS s FROM x)
SELECT vec_id, round(list_sum(list_transform(x, lambda v: abs(v / s))), 6) AS normed, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm FROM s""")
def rms_norm(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    normed = N.rms_norm(F.col("x"), 1e-6)
    return x.select("vec_id", F.round(F.aggregate(normed, F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias("normed"), F.round(N.norm(F.col("x")), 6).alias("norm"))


@suite.query("SELECT round(sqrt(sum(v * v)), 6) AS norm FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)")
def global_norm(spark, sf_dir):
    sq = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v)
    return table(spark, sf_dir, "embeddings").agg(F.round(F.sqrt(F.sum(sq)), 6).alias("norm"))


@suite.query("""
SELECT dim, round(sum(exp(0.1 * label) * v) / sum(exp(0.1 * label)), 6) AS value
FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim FROM embeddings) GROUP BY dim""")
def soup_weighted_avg(spark, sf_dir):
    """Parameters averaged over experts (labels) with softmax weights."""
    flat = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return trees.soup(flat, ["dim"], "label", F.col("label") * 0.1, F.col("v").cast("double")).select("dim", F.round("value", 6).alias("value"))


@suite.query("""
WITH r AS (SELECT vec_id % 4 AS model, label AS row, avg(CAST(embedding[1] AS DOUBLE)) AS v FROM embeddings GROUP BY ALL), m AS (SELECT DISTINCT model FROM r)
SELECT CAST(model AS BIGINT) AS model, CAST(row AS INTEGER) AS row, round(v, 6) AS v FROM r WHERE row < 6
UNION ALL SELECT CAST(m.model AS BIGINT), CAST(row AS INTEGER), round(avg(v), 6) FROM r, m WHERE row >= 6 AND row < 9 GROUP BY m.model, row""")
def soup_vocab_extension(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("model"), F.col("label").cast("int").alias("row"), F.get("embedding", F.lit(0)).cast("double").alias("x"))
    rows = e.groupBy("model", "row").agg(F.avg("x").alias("v"))
    return trees.extended_rows(rows, "model", "row", "v", 6, 9).withColumn("v", F.round("v", 6))


S = "CAST(step AS DOUBLE)"
PI = repr(math.pi)


@suite.query(f"""
SELECT CAST(step AS BIGINT) AS step, round(greatest(0.5 * least(1.0, {S} / 1000) / sqrt(greatest({S}, 1000.0)), 1e-8), 10) AS rsqrt,
  round(greatest(0.5 * least(1.0, {S} / 1000) * pow(0.5::DOUBLE, floor({S} / 20000)), 1e-8), 10) AS steps,
  round(greatest(0.5 * least(1.0, {S} / 1000) * greatest(0.0, 0.5 * (1 + cos({PI} * (greatest(0.0, ({S} - 1000) / 100000.0) - floor(greatest(0.0, ({S} - 1000) / 100000.0)))))), 1e-8), 10) AS cosine,
  round(1.0 / sqrt(greatest({S}, 1000.0)), 10) AS inverse_root, round(-(3e-4::DOUBLE / 1e-4::DOUBLE) * pow(1.0 / sqrt(greatest({S}, 1000.0)), 2), 10) AS weight_decay,
  round(CASE WHEN {S} < 500 THEN 0.1 * {S} / 500 ELSE 0.01 + 0.09 * 0.5 * (1 + cos({PI} * least(1.0, greatest(0.0, ({S} - 500) / 29500.0)))) END, 10) AS warmup_cosine
FROM (SELECT range * 250 AS step FROM range(0, 200))""")
def lr_schedules(spark, sf_dir):
    step = F.col("step")
    lr, wd = N.inverse_root_schedule(step, 0.01, 1000, 3e-4)
    columns = {
        "rsqrt": N.learning_rate(step),
        "steps": N.learning_rate(step, "constant * linear_warmup * decay_every"),
        "cosine": N.learning_rate(step, "constant * linear_warmup * cosine_decay"),
        "inverse_root": lr,
        "weight_decay": wd,
        "warmup_cosine": N.warmup_cosine(step, 0.0, 0.1, 0.01, 500, 30000),
    }
    return spark.range(200).select((F.col("id") * 250).alias("step")).select("step", *[F.round(c, 10).alias(n) for n, c in columns.items()])
