"""Golden vectors and invariants of the sequence algebra."""

import base64
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions import numeric as N
from quern.functions.fields import FieldProcessor, decoded_ids
from quern.functions.vocab import CodepointVocabulary, DictionaryVocabulary, ModelVocabulary, PassThroughVocabulary, sentence_pieces, special_token_mask, vocabulary
from quern.operators import packing, streams
from quern.operators.relations import bounded_chunks, even_chunks, global_shards, group_concat, mixture_rates, zipped
from quern.plans.contracts import FeatureSpec, check_last_token, check_lengths, check_schema, divisible, model_lengths
from quern.plans.converters import batch_names, decoder_features, multimodal_features, rekey, split_metadata

SPARE = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, expr, **columns):
    names = list(columns)
    kinds = ", ".join(f"{n} array<int>" for n in names)
    return spark.createDataFrame([tuple(columns[n] for n in names)], kinds).select(expr.alias("x")).first()["x"]


def rows(spark, lists):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id long, t array<int>")


def test_autoregressive_inputs(spark):
    t, s = [3, 8, 2, 9, 2, 5, 4, 2, -1, -1], [1, 1, 1, 2, 2, 3, 3, 3, 0, 0]
    assert one(spark, A.autoregressive_inputs(F.col("t"), F.col("s"), 1), t=t, s=s) == [1, 3, 8, 1, 9, 1, 5, 4, 1, -1]
    assert one(spark, A.autoregressive_inputs(F.col("t"), F.col("s"), 0), t=[3, 9, 1, 4, 1, 0], s=[1, 1, 1, 2, 2, 0]) == [0, 3, 9, 0, 4, 0]
    assert one(spark, A.shift_right(F.col("t"), 1), t=[3, 9, 1, 4, 1, 0]) == [1, 3, 9, 1, 4, 1]
    assert one(spark, A.shift_right(F.col("t"), 1), t=[]) == []


def packed(spark, lists, length, examples=None):
    groups = packing.packing_groups(rows(spark, lists).withColumn("n", F.size("t")), [], ["id"], examples or length)
    placed = packing.next_fit(groups.drop("t"), ["block"], ["id"], {"t": F.col("n")}, {"t": length}).join(rows(spark, lists), "id")
    out = packing.assemble(placed, ["block"], "t", length).orderBy("block", "bin").collect()
    return [(r["targets"], r["positions"], r["segment_ids"]) for r in out]


def test_packing_golden(spark):
    assert packed(spark, [[3, 9, 1], [4, 1]], 6) == [([3, 9, 1, 4, 1, -1], [0, 1, 2, 0, 1, -1], [1, 1, 1, 2, 2, 0])]
    bins = packed(spark, [[7] * n for n in (4, 3, 5, 2, 9, 1)], 8)
    assert [b[2] for b in bins] == [[1, 1, 1, 1, 2, 2, 2, 0], [1, 1, 1, 1, 1, 2, 2, 0], [1] * 8, [1] + [0] * 7]


@SPARE
@given(st.lists(st.lists(st.integers(1, 9), min_size=1, max_size=12), min_size=1, max_size=10))
def test_packing_keeps_all_tokens(spark, lists):
    bins = packed(spark, lists, 10, examples=4)
    assert all(len(t) == len(p) == len(s) == 10 for t, p, s in bins)
    back = [[v for v, s in zip(t, seg, strict=True) if s == k] for t, _, seg in bins for k in range(1, max(seg) + 1)]
    assert back == [x[:10] for x in lists]


def test_two_features_pack_together(spark):
    df = spark.createDataFrame([(0, 6, 1), (1, 8, 2), (2, 8, 1)], "id long, n int, images int")
    groups = packing.packing_groups(df, [], ["id"], 30)
    out = packing.next_fit(groups, ["block"], ["id"], {"t": F.col("n"), "i": F.col("images")}, {"t": 30, "i": 4}).orderBy("id").collect()
    assert [(r["bin"], r["off_t"], r["off_i"]) for r in out] == [(0, 0, 0), (0, 6, 1), (0, 14, 3)]
    tight = packing.next_fit(groups, ["block"], ["id"], {"t": F.col("n"), "i": F.col("images")}, {"t": 30, "i": 3}).orderBy("id").collect()
    assert [r["bin"] for r in tight] == [0, 0, 1]
    idx = spark.createDataFrame([([[0, 1, 2], [4, 5, 6]], 14)], "x array<array<int>>, o int").select(packing.rebase_index(F.col("x"), F.col("o")).alias("x")).first()["x"]
    assert idx == [[14, 15, 16], [18, 19, 20]]
    assert packing.strip_packed_name("targets_segment_ids") == packing.strip_packed_name("targets_positions") == "targets"


def test_full_lm_golden(spark):
    lists = [[5, 6, 7], [8, 0, 9], [], [10]]
    all_ = streams.full_lm(rows(spark, lists), ["id"], "t", 4, 2, 1, strip_zero=True).orderBy("gid", "seg").collect()
    assert [r["t"] for r in all_] == [[5, 6, 7, 2], [1, 8, 9, 2], [1, 10, 2, 1]]
    two = streams.full_lm(rows(spark, [x for x in lists if x]), ["id"], "t", 4, 2, 1, group=2, strip_zero=True).orderBy("gid", "seg").collect()
    assert [r["t"] for r in two] == [[5, 6, 7, 2], [1, 8, 9, 2], [1], [10, 2, 1]]


@pytest.mark.parametrize(("n", "batches"), [(9, 1), (5, 0), (6, 1), (0, 0)])
def test_stream_needs_a_spare_token(spark, n, batches):
    out = streams.concat_and_chunk(rows(spark, [[i] for i in range(1, n + 1)]), ["id"], "t", 2, 2).collect()
    assert len(out) == batches
    if batches:
        assert (out[0]["inputs"], out[0]["targets"]) == ([1, 2, 3, 4], [2, 3, 4, 5])


@SPARE
@given(st.lists(st.lists(st.integers(0, 99), max_size=9), max_size=9))
def test_stream_equals_one_long_list(spark, lists):
    flat = [v for x in lists for v in x]
    out = streams.concat_and_chunk(rows(spark, lists), ["id"], "t", 2, 2).orderBy("chunk").collect() if lists else []
    want = [(flat[c : c + 4], flat[c + 1 : c + 5]) for c in range(0, len(flat), 4) if len(flat) > c + 5]
    assert [(r["inputs"], r["targets"]) for r in out] == want


@SPARE
@given(st.lists(st.lists(st.integers(0, 9), max_size=20), min_size=1, max_size=6), st.integers(1, 7))
def test_split_and_join_again(spark, lists, n):
    out = streams.split_rows(rows(spark, lists), "t", n).orderBy("id", "seg").collect()
    back = {i: [] for i, x in enumerate(lists) if x}
    for r in out:
        assert 0 < len(r["t"]) <= n
        back[r["id"]] += r["t"]
    assert back == {i: x for i, x in enumerate(lists) if x}


def test_random_chunk_stays_inside(spark):
    df = rows(spark, [list(range(n)) for n in (1, 3, 10, 50)])
    for free in (False, True):
        for u in (0.0, 0.5, 0.999999):
            for r in df.select("t", streams.random_chunk(F.col("t"), 7, F.lit(u), free).alias("x")).collect():
                x = r["x"]
                assert 0 < len(x) <= 7
                assert x == r["t"][x[0] : x[0] + len(x)]


def test_group_sizes(spark):
    ids = spark.range(10).withColumnRenamed("id", "k")
    sizes = lambda df, c: [n for _, n in sorted(df.groupBy(c).count().collect())]
    assert sizes(even_chunks(ids, ["k"], 4), "chunk") == [3, 3, 2, 2]
    assert sizes(even_chunks(ids.limit(2), ["k"], 4), "chunk") == [1, 1]
    assert sizes(global_shards(spark.range(12).withColumnRenamed("id", "k"), ["k"], 5), "shard") == [3, 3, 3, 3]
    assert sizes(global_shards(ids, ["k"], 7), "shard") == [2, 2, 2, 2, 2]
    blocks = bounded_chunks(ids, ["k"], 6, 2).groupBy("block", "chunk").count().collect()
    assert sorted(tuple(r) for r in blocks) == [(0, 0, 3), (0, 1, 3), (1, 0, 2), (1, 1, 2)]


def test_order_is_the_same_for_any_partitions(spark):
    df = rows(spark, [[i, i + 1] for i in range(40)])
    a = group_concat(df.repartition(1), ["id"], "t", 7).orderBy("gid").collect()
    b = group_concat(df.repartition(9), ["id"], "t", 7).orderBy("gid").collect()
    assert a == b


def test_small_array_functions(spark):
    assert one(spark, A.position_ids(F.col("m"), True), m=[0, 0, 1, 1]) == [0, 0, 0, 1]
    assert one(spark, A.position_ids(F.col("m")), m=[1, 1, 0]) == [0, 1, 1]
    assert one(spark, A.is_padding(F.col("m"), -1, 0), m=[-1, 0, 5]) == [0, 0, 1]
    assert one(spark, A.trim_pad_left(F.col("m"), 3, 9), m=[1]) == [9, 9, 1]
    assert one(spark, A.segments_of(F.col("m"), 2), m=[1, 2, 3]) == [[1, 2], [3]]
    nested = spark.createDataFrame([([[1], [2, 3]],)], "x array<array<int>>")
    assert nested.select(A.append_innermost(F.col("x"), 7, 2).alias("x")).first()["x"] == [[1, 7], [2, 3, 7]]
    assert nested.select(A.trim_pad_nested(F.col("x"), [3, 1]).alias("x")).first()["x"] == [[1], [2], [-1]]
    both = spark.createDataFrame([([1], [2], True), ([1], [], False)], "a array<int>, b array<int>, same boolean")
    assert all(r["same"] == r["s"] for r in both.withColumn("s", A.same_length(F.col("a"), F.col("b"))).collect())


def test_vocabularies(spark):
    text = spark.createDataFrame([("héllo",), ("",)], "s string")
    v = CodepointVocabulary()
    coded = text.select("s", v.encode(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in coded] == [[ord(c) for c in "héllo"], []]
    assert text.select(v.decode(v.encode(F.col("s"))).alias("s")).collect() == text.collect()
    d = DictionaryVocabulary(["héllo", "x"])
    assert [r[0] for r in text.select(d.encode(F.col("s"))).collect()] == [1, 3]
    assert d.size == 4
    assert text.select(d.decode(F.array(F.lit(1), F.lit(2))).alias("s")).first()["s"] == "héllo x"
    assert PassThroughVocabulary(5, extra_ids=2).size == 7
    with pytest.raises(ValueError):
        vocabulary("gemini")
    assert one(spark, special_token_mask(F.size("m"), True, True), m=[5, 6]) == [1, 0, 0, 1]


def test_model_vocabulary_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    v = ModelVocabulary(sentence_pieces(P.path("piece_bpe_32k.model")), 32000, bos=1, eos=2)
    text = spark.createDataFrame([("a small sentence",), ("another one",)], "s string")
    coded = text.select("s", v.encode(F.col("s")).alias("t"))
    assert all(r["s"] == r["b"] for r in coded.select("s", v.decode(F.col("t")).alias("b")).collect())


def test_field_processor(spark):
    buf = base64.b64encode(struct.pack("<3i", 5, -1, 2**31 - 1)).decode()
    df = spark.createDataFrame([("ab", "c", buf)], "a string, b string, buf string")
    assert df.select(decoded_ids(F.col("buf")).alias("x")).first()["x"] == [5, -1, 2**31 - 1]
    tokens, mask = FieldProcessor("[a+b],<|eos|>,{buf}", CodepointVocabulary(bos=1, eos=2), prepend_text=">").columns()
    r = df.select(tokens.alias("t"), mask.alias("m")).first()
    assert r["t"] == [1, *map(ord, ">ab c"), 2, 5, -1, 2**31 - 1, 2]
    assert r["m"] == [0.0] * 6 + [1.0] * 5
    with pytest.raises(ValueError):
        FieldProcessor("", CodepointVocabulary())


def test_converters(spark):
    df = spark.createDataFrame([([3, 8, 0], [1, 1, 0])], "targets array<int>, seg array<int>")
    out = batch_names(decoder_features(df, segments="seg", bos=1))
    r = out.first()
    assert (r["input_tokens"], r["target_tokens"], r["loss_masks"], r["segment_ids"]) == ([1, 3, 1], [3, 8, 0], [1, 1, 0], [1, 1, 0])
    mm = spark.createDataFrame([([0, 0, 0, 3], [0, 0, 0, 1], [[0, 1, 2]], 1)], "t array<int>, w array<int>, idx array<array<int>>, n int").withColumn("images", F.array_repeat(F.lit(0.5), F.col("n")))
    r = multimodal_features(mm, "t", "w", "images", "idx", 4).first()
    assert (r["decoder_input_tokens"], r["idx"]) == ([1, 0, 0, 0], [[1, 2, 3]])
    assert multimodal_features(mm, "t", "w", "images", "idx", 4, prompt=1).first()["idx"] == [[2, 3, 4]]
    with pytest.raises(Exception):
        multimodal_features(mm, "t", "w", "images", "idx", 0).collect()
    a, b = split_metadata(spark.createDataFrame([(1, 2)], "`x` int, `metadata/y` int"))
    assert (a.columns, b.columns) == (["x"], ["metadata/y"])
    nested = spark.createDataFrame([(("u", "v"),)], "r struct<foo:string,bar:string>")
    assert rekey(nested, {"a": "r/foo", "b": None}).first().asDict() == {"a": "u", "b": ""}
    assert rekey(nested, None).columns == ["r"]


def test_contracts(spark):
    df = spark.createDataFrame([([1, 2], [[1.0]])], "t array<int>, im array<array<double>>")
    check_schema(df, {"t": FeatureSpec("int"), "im": FeatureSpec("double", 2)})
    for bad in ({"u": FeatureSpec("int")}, {"t": FeatureSpec("bigint")}, {"im": FeatureSpec("double", 1)}):
        with pytest.raises(ValueError):
            check_schema(df, bad)
    assert check_lengths(df, {"t": 2}, exact=True).count() == 1
    with pytest.raises(Exception):
        check_lengths(df, {"t": 1}).collect()
    with pytest.raises(Exception):
        check_last_token(df, "t", [2]).collect()
    assert check_last_token(df, "t", [1]).count() == 1
    assert set(model_lengths({"targets": 5}, True).values()) == {5}
    divisible(8, 2, 4)
    with pytest.raises(ValueError):
        divisible(8, 3)
    with pytest.raises(ValueError):
        mixture_rates([("a", 1.0), ("a", 2.0)])
    assert mixture_rates([("a", 1.0), ("a", 2.0)], "sum") == {"a": 3.0}


def test_zipped_goes_as_far_as_the_shortest(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"])], "k int, x array<int>, y array<string>")
    assert [tuple(r) for r in zipped(df, ["x", "y"], "i").orderBy("i").collect()] == [(1, 0, 1, "a"), (1, 1, 2, "b")]


def test_losses_golden(spark):
    df = spark.createDataFrame([([2.0, 1.0, 0.0], 0), ([0.0, 3.0, 1.0], 2)], "l array<double>, y int")
    loss, z = N.token_losses(F.col("l"), F.col("y"), 3, 0.001)
    out = df.select(loss.alias("loss"), z.alias("z")).collect()
    assert [r["loss"] for r in out] == pytest.approx([0.4076059644, 2.1698460196])
    assert [r["z"] for r in out] == pytest.approx([0.0057965665, 0.0100479238])
    steps = spark.createDataFrame([(s,) for s in (0, 500, 1000, 4000, 20000)], "s long")
    assert [r[0] for r in steps.select(N.learning_rate(F.col("s"))).collect()] == pytest.approx([1e-8, 0.0079056942, 0.0158113883, 0.0079056942, 0.0035355339])
    with pytest.raises(ValueError):
        N.learning_rate(F.col("s"), "constant * magic")
