"""Sources, sinks, registry, prompts, geometry, trees and streams."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import geometry as G
from quern.functions import prompts as P
from quern.operators import scoring, trees
from quern.plans.registry import Registry, Task
from quern.sources import corpus as C
from quern.streaming.continuous import run_available, stream_chunks


def test_jsonl_scan_counts_and_shards(spark, tmp_path):
    for i, n in enumerate((4, 3, 5)):
        d = tmp_path / "in" / f"lang{i}"
        d.mkdir(parents=True)
        with gzip.open(d / "a.json.gz", "wt") as f:
            f.writelines(json.dumps({"id": f"{i}-{j}", "text": "x", "more": 1}) + "\n" for j in range(n))
    df = C.read_jsonl(spark, str(tmp_path / "in"), nested=True)
    assert df.columns == ["id", "text", "file"]
    assert sorted(r["count"] for r in C.count_lines(df, "file").collect()) == [3, 4, 5]
    out = str(tmp_path / "out")
    C.write_shards(df.select("id", "text"), ["id"], out, 5)
    assert [r["count"] for r in spark.read.parquet(out).groupBy("shard").count().orderBy("shard").collect()] == [3, 3, 3, 3]
    C.write_shards(df.select("id", "text"), ["id"], out, 5, missing_only=True)
    assert spark.read.parquet(out).count() == 12
    assert C.shard_name("b", "f", "p", "train", 3, 64) == "b/f/1.0.0/p-train-00003-of-00064"


def test_instruction_records(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"pixels")
    turns = [{"from": "human", "value": "hi"}, {"from": "system", "value": "no"}, {"from": "gpt", "text": "yes"}]
    (tmp_path / "x.json").write_text(json.dumps([{"id": "1", "image": "sub/a.jpg", "conversations": turns}, {"id": "2", "conversations": turns[:1]}]))
    out = C.read_instructions(spark, str(tmp_path / "x.json"), str(tmp_path / "img")).orderBy("has_image").collect()
    assert [(r["has_image"], r["image"]) for r in out] == [(0, None), (1, b"pixels")]
    assert [t["value"] for t in out[1]["conversations"]] == ["hi", "yes"]
    assert {r["has_image"] for r in C.read_instructions(spark, str(tmp_path / "x.json")).collect()} == {0}


def test_plan_time_arithmetic():
    from quern.functions.arrays import length_budget, mixed_radix

    assert length_budget(8, True) == 7 and mixed_radix(5, [2, 3]) == [1, 2]
    for bad in (lambda: length_budget(1, True), lambda: mixed_radix(6, [2, 3])):
        with pytest.raises(ValueError):
            bad()


def test_malformed_lines(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("",), ("{bad",), ('{"z": 1}',)], "line string")
    out = C.parse_lines(df, "line", "k int").collect()
    assert [r["malformed"] for r in out] == [False, False, True, False]
    assert [r["record"] and r["record"]["k"] for r in out] == [3, None, None, None]


def test_parameters_round_trip(spark, tmp_path):
    tree = {"a": {"w": np.arange(6, dtype=np.float32).reshape(2, 3)}, "b": np.array([1, 2], np.int64)}
    C.write_parameters(spark, trees.flatten_tree(tree), str(tmp_path / "p"))
    back = C.read_parameters(spark, str(tmp_path / "p"))
    assert set(back) == {"a/w", "b"}
    assert (back["a/w"] == tree["a"]["w"]).all()
    assert set(C.read_parameters(spark, str(tmp_path / "p"), ["b"])) == {"b"}
    assert trees.recover_tree({"a.b": 1, "c": 2}) == {"a": {"b": 1}, "c": 2}
    assert "<table" in C.sample_page(spark.range(3), ["id"], 2)


def test_rules_and_soup(spark):
    df = spark.createDataFrame([("x/attention/wq/kernel", False), ("x/y", False), ("x/attention/wq/kernel", True)], "p string, s boolean")
    rules = [("attention/wq", "a"), ("x", "b")]
    assert [r[0] for r in df.select(trees.first_match(F.col("p"), rules, F.col("s"))).collect()] == ["a", "b", ""]
    with pytest.raises(Exception):
        df.select(trees.first_match(F.col("p"), [("zzz", "a")])).collect()


def test_registry(spark):
    reg = Registry()
    rows = lambda n: lambda s: s.range(n).select(F.col("id").alias("k"))
    reg.add_task(Task("a", rows(30), (lambda d: d.where("k >= 0"),)))
    reg.add_task(Task("b", rows(10)))
    reg.add_mixture("m", [("a", 3.0), ("b", 1.0)])
    first = reg.dataset("m", spark).orderBy("slot", "task").limit(20)
    assert {r["task"]: r["count"] for r in first.groupBy("task").count().collect()} == {"a": 15, "b": 5}
    for bad in (lambda: reg.add_task(Task("a", rows(1))), lambda: reg.dataset("nothing", spark), lambda: (reg.add_mixture("n", [("zz", 1.0)]), reg.dataset("n", spark))):
        with pytest.raises(ValueError):
            bad()


def test_prompts(spark):
    for bad in ("unknown", "null"):
        with pytest.raises(ValueError):
            P.template(bad)
    with pytest.raises(ValueError):
        P.separator(F.lit("x"), P.template("mistral"))
    turns = spark.createDataFrame([(1, 2, "gpt", "<image> yes"), (1, 1, "human", "hi")], "c int, t int, r string, x string")
    out = P.render(turns, "c", "t", "r", "x", P.template("vicuna_v1"), image="[I]").first()
    assert out["prompt"] == "USER: hi ASSISTANT: [I] yes</s>"
    conv = spark.createDataFrame([([("human", "a", None), ("system", "b", None), ("gpt", None, "c")],)], "c array<struct<from:string,value:string,text:string>>")
    kept = conv.select(P.kept_turns(F.col("c")).alias("k")).first()["k"]
    assert [(k["from"], k["value"]) for k in kept] == [("human", "a"), ("gpt", "c")]


def test_tilings(spark):
    df = spark.createDataFrame([(672, 336), (336, 672), (1000, 1000), (200, 800), (500, 400), (2000, 300)], "h int, w int")
    out = df.select(G.select_tiling(F.col("h"), F.col("w"), 336, 4).alias("t")).collect()
    assert [(r["t"]["rows"], r["t"]["cols"]) for r in out] == [(2, 1), (1, 2), (2, 2), (1, 3), (2, 2), (4, 1)]
    x = spark.createDataFrame([([0.0, 1.0],)], "x array<double>")
    assert x.select(G.unnormalized(G.normalized(F.col("x"), 0.5, 0.25), 0.5, 0.25).alias("x")).first()["x"] == [0.0, 1.0]


def test_rolling_windows_score_each_token_once(spark):
    df = spark.createDataFrame([(n, list(range(n))) for n in (1, 4, 5, 9)], "id int, t array<int>")
    out = scoring.rolling_windows(df, "t", 4, -1, 99).collect()
    for n in (1, 4, 5, 9):
        scored = sorted(v for r in out if r["id"] == n for v, m in zip(r["outputs"], r["mask"], strict=True) if m)
        assert scored == list(range(n))


def test_stream_carries_the_tail(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    docs = [("s", i, [10 * i + j for j in range(5)]) for i in range(6)]
    for d in docs:
        spark.createDataFrame([d], "shard string, k int, t array<int>").coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema("shard string, k int, t array<int>").option("maxFilesPerTrigger", 1).parquet(src)
    run_available(stream_chunks(read(), "shard", "k", "t", 2, 2), out, ckpt)
    got = [(r["inputs"], r["targets"]) for r in spark.read.parquet(out).orderBy("chunk").collect()]
    assert len(got) == 7 and all(b[:-1] == a[1:] for a, b in got)
    spark.createDataFrame([("s", 6, [60, 61, 62, 63, 64])], "shard string, k int, t array<int>").coalesce(1).write.mode("append").parquet(src)
    run_available(stream_chunks(read(), "shard", "k", "t", 2, 2), out, ckpt)
    again = [r["inputs"] for r in spark.read.parquet(out).orderBy("chunk").collect()]
    assert again[:7] == [a for a, _ in got] and len(again) == 8
    flat = [v for c in again for v in c]
    assert flat[28:] == got[6][1][3:] + [v for v in flat[29:]]
