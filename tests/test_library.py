"""Metric algebra, vocabularies with pieces of their own, image layouts and examples, corpora, records and requests."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.functions import geometry as G
from quern.functions import metrics as M
from quern.functions import multimodal as MM
from quern.functions import numeric as N
from quern.functions import prompts as P
from quern.functions import vocab as V
from quern.operators import packing, routing, scoring, streams, trees
from quern.plans import contracts, corpora
from quern.plans.registry import Registry
from quern.sources import corpus as C
from quern.sources import records as R


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def ints(*values):
    return A.lit_ints(list(values))


# ---------------------------------------------------------------- metrics and schedules


def test_metrics_merge():
    assert M.Sum.of([1, 2, 3]).merge(M.Sum(4.0)).compute() == 10
    a = M.AveragePerStep.of([4.0, 6.0], steps=2).merge(M.AveragePerStep.of(2.0))
    assert (a.total, a.steps, a.compute()) == (12, 3, 4)
    r = M.TimeRate(numerator=6.0).merge(M.TimeRate(numerator=4.0))
    assert M.with_duration({"a": {"r": r}, "s": M.Sum(1.0)}, 5.0)["a"]["r"].compute() == 2
    assert M.with_duration({"x": M.StepsPerTime(8)}, 2.0)["x"].compute() == 4 and M.with_steps({"x": M.Step()}, 7)["x"].compute() == 7
    assert M.zeroed({"a": a, "s": M.Sum(3.0)}) == {"a": M.AveragePerStep(0, 0), "s": M.Sum(0)}
    assert M.merged(None, {"a": a}) == {"a": a} and M.merged(M.sums({"x": 1.0}), M.sums({"x": 2.0})) == {"x": M.Sum(3.0)}
    assert M.averaged([{"x": 1.0}, {"x": 4.0}]) == {"x": 2.5} and M.averaged([]) == {}
    for bad in (lambda: M.AveragePerStep().compute(), lambda: M.Step(None).compute(), lambda: M.TimeRate(numerator=1.0).compute(), lambda: M.StepsPerTime(1).compute(), lambda: M.TimeRate(1.0).merge(M.TimeRate()), lambda: M.merged(M.sums({"x": 1}), M.sums({"y": 1}))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        M.Sum().merge(M.Step())


def test_decay_schedule_has_its_sign_and_factor(spark):
    lr, wd = N.inverse_root_schedule(F.lit(400), 0.02, 100, 2e-4)
    assert tuple(one(spark, lr, wd)) == pytest.approx((0.1, -0.02))
    lr, wd = N.inverse_root_schedule(F.lit(1), 0.01, 100)
    assert tuple(one(spark, lr, wd)) == pytest.approx((0.1, -0.01))


def test_running_sums_are_linear_and_keep_nulls(spark):
    rows = [(0, [1, 2, 3]), (1, []), (2, None), (3, list(range(50_000)))]
    got = {r["id"]: r["s"] for r in spark.createDataFrame(rows, "id int, x array<int>").select("id", A.prefix_sums(F.col("x")).alias("s")).collect()}
    assert got[0] == [1, 3, 6] and got[1] == [] and got[2] is None and got[3][-1] == sum(range(50_000))


# ---------------------------------------------------------------- streams and packing


def test_parallel_keys_are_cut_alike_and_checked(spark):
    df = spark.createDataFrame([(1, list(range(10)), list(range(10, 20)), "x"), (2, [], [], "y")], "id int, t array<int>, m array<int>, more string")
    cut = sorted(streams.split_rows(df, "t", 4, parallel=["m"], passthrough=["id"]).collect())
    assert [(r["id"], r["t"], r["m"]) for r in cut] == [(1, [0, 1, 2, 3], [10, 11, 12, 13]), (1, [4, 5, 6, 7], [14, 15, 16, 17]), (1, [8, 9], [18, 19])]
    r = streams.random_chunks(df, "t", 4, F.col("id"), parallel=["m"], min_length=2, seed=3).first()
    assert [v + 10 for v in r["t"]] == r["m"] and 1 <= len(r["t"]) <= 4 and r["more"] == "x"
    for call in (streams.split_rows, lambda d, t, n, **k: streams.random_chunks(d, t, n, F.col("id"), **k)):
        with pytest.raises(ValueError):
            call(df, "t", 4, parallel=["m"], passthrough=["m"])
    with pytest.raises(Exception, match="another length"):
        streams.split_rows(df.withColumn("m", F.slice("m", 1, 3)), "t", 4, parallel=["m"]).collect()


@pytest.mark.parametrize("carry", [True, False])
def test_epochs_carry_or_lose_their_tail(spark, carry):
    df = spark.createDataFrame([(i, [i * 10 + j for j in range(3)], [j % 2 for j in range(3)]) for i in range(5)], "id int, t array<int>, m array<int>")
    got = sorted(streams.epoch_chunks(df, ["id"], "t", 1, 4, 2, carry, "m").collect(), key=lambda r: (r["epoch"], r["chunk"]))
    flat, mask = [i * 10 + j for i in range(5) for j in range(3)], [j % 2 for _ in range(5) for j in range(3)]
    want = []
    for epoch, (s, w) in enumerate([(flat * 2, mask * 2)] if carry else [(flat, mask)] * 2):
        c = 0
        while len(s) > (c + 1) * 4 + 1:
            want.append((epoch, c, s[4 * c : 4 * c + 4], s[4 * c + 1 : 4 * c + 5], w[4 * c + 1 : 4 * c + 5]))
            c += 1
    assert [(r["epoch"], r["chunk"], r["inputs"], r["targets"], r["loss_masks"]) for r in got] == want


def test_packing_of_several_features(spark):
    rows = [(0, 0, [1, 2, 3], [0.0, 1.0, 1.0], [[0]], ["a"]), (0, 1, [4, 5], [1.0, 1.0], [[1]], ["b"]), (0, 2, [6, 7, 8, 9], [1.0] * 4, [[0]], ["c", "d"])]
    df = spark.createDataFrame(rows, "block int, idx int, t array<int>, w array<float>, at array<array<int>>, images array<string>")
    placed = packing.next_fit(df, ["block"], [], {"t": F.size("t"), "images": F.size("images")}, {"t": 8, "images": 2}).join(df, ["block", "idx"])
    got = {r["bin"]: r for r in packing.assemble(placed, ["block"], "t", 8, parallel={"w": -1}, more={"images": 2}, index="at").collect()}
    assert got[0]["targets"] == [1, 2, 3, 4, 5, -1, -1, -1] and got[0]["w"] == [0, 1, 1, 1, 1, -1, -1, -1]
    assert got[0]["images"] == ["a", "b"] and got[0]["at"] == [[0], [4]] and got[0]["segment_ids"] == [1, 1, 1, 2, 2, 0, 0, 0]
    assert got[1]["targets"][:4] == [6, 7, 8, 9] and got[1]["images"] == ["c", "d"]


# ---------------------------------------------------------------- vocabularies


@pytest.fixture(scope="module")
def pieces():
    P_ = pytest.importorskip("public_tokenizers")
    return P_.path("piece_bpe_32k.model")


def test_pieces_of_ones_own(spark, pieces):
    tokens = ("<im_start>", "<im_end>", "<im_patch>", "<im_col>")
    v = V.PieceVocabulary(pieces, extra_ids=3, reverse=True, extra_tokens=tokens)
    assert (v.size, v.base_size, v.bos, v.eos, v.unk) == (32007, 32004, 1, 2, 0)
    ids = V.special_ids(v, tokens)
    assert sorted(ids.values()) == list(range(32003, 32007)) and v.encode_text("<extra_id_0>")[-1] == 32002 and v.encode_text("<extra_id_2>")[-1] == 32000
    up = V.PieceVocabulary(pieces, extra_ids=3, extra_tokens=tokens)
    assert up.encode_text("<extra_id_0>")[-1] == 32000 and up != v and v == V.PieceVocabulary(pieces, 3, True, tokens)
    first = V.PieceVocabulary(pieces, start_first=True)
    assert (first.bos, first.eos, first.unk) == (0, 1, 2)
    df = spark.createDataFrame([("hello there world",)], "text string")
    r = df.select(v.encode(F.col("text")).alias("i")).select("i", v.decode(F.col("i")).alias("t")).first()
    assert r["i"] == v.encode_text("hello there world") and r["t"] == "hello there world"
    mixed = F.concat(F.lit([1]).cast("array<int>"), F.col("i"), ints(ids["<im_patch>"], ids["<im_col>"]))
    text = df.select(v.encode(F.col("text")).alias("i")).select(V.SpecialDecoder(v, ids | {"<s>": 1}).decode(mixed).alias("a"), V.SpecialDecoder(v, ids | {"<s>": 1}).decode(mixed, True).alias("b")).first()
    assert text["a"] == "<s>hello there world<im_patch><im_col>" and text["b"] == "hello there world"
    with pytest.raises(ValueError):
        V.special_ids(V.PieceVocabulary(pieces), tokens)


def test_families_and_shared_files(spark, pieces):
    V.register_family("llama", V.shared_file(spark, pieces), 2)
    assert V.vocabulary("llama").size == 32002
    got = spark.createDataFrame([("a b",)], "t string").select(V.vocabulary("llama").encode(F.col("t")).alias("i")).first()["i"]
    assert got == V.PieceVocabulary(pieces).encode_text("a b")
    for bad in (lambda: V.register_family("other", pieces), lambda: V.vocabulary("unheard")):
        with pytest.raises(ValueError):
            bad()
    r = one(spark, V.with_special(ints(5, 6), 1, 2), V.with_special(ints(5), 1, None, ints(7)), V.token_types(ints(1, 2, 3)), V.special_token_mask(F.lit(2), True, True))
    assert tuple(r) == ([1, 5, 6, 2], [1, 5, 1, 7], [0, 0, 0], [1, 0, 0, 1])


class _Shifted:
    def __init__(self, by):
        self.by = by

    def encode(self, text):
        return [ord(c) + self.by for c in text]


def test_models_of_one_factory_are_told_apart(spark):
    def made(by):
        return V.ModelVocabulary(lambda: _Shifted(by), 1 << 20)

    r = spark.createDataFrame([("ab",)], "t string").select(made(0).encode(F.col("t")).alias("x"), made(100).encode(F.col("t")).alias("y")).first()
    assert tuple(r) == ([97, 98], [197, 198])


# ---------------------------------------------------------------- images

IDS = {"<im_start>": 90, "<im_end>": 91, "<im_patch>": 92, "<im_col>": 93}


@pytest.mark.parametrize("mode", MM.MODES)
def test_image_layouts(spark, mode):
    rows, cols, h, w = 2, 3, 2, 2
    grid = lambda a, b: [90] + ([92] * b + [93]) * a + [91]
    tokens, order = MM.image_layout(mode, F.lit(rows), F.lit(cols), h, w, IDS)
    r = one(spark, tokens, order if order is not None else F.lit(None))
    whole, tiles = grid(h, w), grid(rows * h, cols * w)
    assert r[0] == (whole if mode == "resize" else whole + tiles if "c2" in mode else tiles + whole if "resize" in mode else tiles)
    across = np.arange(rows * cols * h * w).reshape(rows, h, cols, w).transpose(0, 2, 1, 3).ravel().tolist()
    want = list(range(4)) if mode == "resize" else None if "v2" not in mode else across if "resize" not in mode else [*range(4), *[v + 4 for v in across]] if "c2" in mode else [*across, *range(24, 28)]
    assert r[1] == want
    bare, _ = MM.image_layout(mode, F.lit(1), F.lit(1), 1, 2, IDS, ends=False, columns=False)
    assert set(one(spark, bare)[0]) == {92}
    with pytest.raises(ValueError):
        MM.image_layout("other", F.lit(1), F.lit(1), 1, 1, IDS)


def test_examples_of_an_image_and_words(spark):
    encode = V.CodepointVocabulary(bos=1, eos=2).encode
    points = lambda s: [ord(c) for c in s]
    tokens, order = MM.image_layout("patchify-v2", F.lit(1), F.lit(2), 1, 2, IDS, ends=False, columns=False)
    plain = MM.example(MM.request_prefix("plain-v1", tokens, F.lit(3), encode), MM.caption_answer(F.lit("cat"), encode, 2), 92, order, 2)
    r = one(spark, *plain.values())
    assert "".join(map(chr, r[0][:-8])) in MM.PLAIN_STYLES and r[0][-4:] == [*points("cat"), 2] and r[1] == [0] * (len(r[0]) - 4) + [1] * 4
    at = len(r[0]) - 8
    assert r[2] == [[at, at + 1], [at + 2, at + 3]]
    chat = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("value")) for a, b in (("human", "what?"), ("gpt", "this"))])
    full = MM.example(MM.request_prefix("vicuna_v1", tokens, F.lit(1), encode), MM.conversation_answer(chat, "vicuna_v1", encode), 92, None, 4)
    r = one(spark, *full.values())
    t = P.template("vicuna_v1")
    head = points(t["SYS_PREFIX"] + t["B_INST"])
    said = points(t["B_INST"] + "what?" + t["SEP"] + t["E_INST"])
    assert r[0] == head + [92] * 4 + said + points("this" + t["SEP2"]) and sum(r[1]) == len("this" + t["SEP2"]) and r[2] == [[len(head) + i for i in range(4)]]
    ask = MM.example(MM.request_prefix("mistral", tokens, F.lit(1), encode, F.lit("PIC")), None, 92, None, 4)
    r = one(spark, *ask.values())
    text = "".join(map(chr, r[0]))
    assert text[len("[INST]") : -len("[/INST]")] in [s.replace("<image>", "PIC") for s in MM.CAPTION_STYLES] and sum(r[1]) == 0
    other = one(spark, MM.request_prefix("llama2", tokens, F.lit(1), encode), MM.request_prefix("null", tokens, F.lit(1), encode))
    assert other[0][-7:] == points("[/INST]") and other[1] == [92] * 4
    with pytest.raises(ValueError):
        MM.request_prefix("mistral", tokens, F.lit(1), encode)
    with pytest.raises(ValueError):
        MM.conversation_answer(chat, "null", encode)


def test_random_resizing(spark):
    rng = random.Random(0)
    for _ in range(6):
        h, w, s, widest, uy, ux = rng.randint(80, 900), rng.randint(80, 900), rng.uniform(0.3, 2), rng.random() < 0.5, rng.random(), rng.random()
        g = G.random_resize(F.lit(h), F.lit(w), 100, 120, F.lit(s), F.lit(widest), (F.lit(uy), F.lit(ux)))
        r = one(spark, *g.values(), G.image_info(F.lit(h), F.lit(w), g), G.image_mask(g, 100, 120))
        got = dict(zip(g, r, strict=False))
        both = int(s * 100) / h, int(s * 120) / w
        scale = max((max if widest else min)(both), 64 / min(h, w))
        assert got["inverse_scale"] == pytest.approx(1 / scale) and abs(got["scaled_h"] - h * scale) <= 1 and abs(got["scaled_w"] - w * scale) <= 1
        shown = [min(got[f"scaled_{a}"] - got[f"offset_{b}"], n) for a, b, n in (("h", "y", 100), ("w", "x", 120))]
        assert 0 <= got["offset_y"] <= max(0, got["scaled_h"] - 100) and got["pad_top"] == (100 - shown[0]) // 2 and got["pad_left"] == (120 - shown[1]) // 2
        info, mask = r[-2], np.array(r[-1])
        assert len(info) == 11 and info[3:5] == [h, w] and mask.shape == (100, 120) and mask.sum() == shown[0] * shown[1]
    assert tuple(one(spark, *G.flipped([F.lit(1), F.lit(2), F.lit(3), F.lit(5)], F.lit(10)))) == (1, 5, 3, 8)


# ---------------------------------------------------------------- sources and corpora


def _field(number, body):
    return bytes([number << 3 | 2]) + _varint(len(body)) + body


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _record(features):
    entries = b"".join(_field(1, _field(1, k.encode()) + _field(2, _field(1, _field(1, v.encode())))) for k, v in features.items())
    body = _field(1, entries)
    return struct.pack("<Q", len(body)) + b"\0\0\0\0" + body + b"\0\0\0\0"


def test_records_of_text_features(spark, tmp_path):
    long = "é" * 5000
    for i in range(2):
        (tmp_path / f"c4-train-{i}").write_bytes(b"".join(_record({"id": f"{i}{j}", "text": long if j == 1 else f"t{j}", "other": "x"}) for j in range(3)))
    got = sorted((r["id"], r["text"]) for r in R.read_records(spark, f"{tmp_path}/c4-train*").collect())
    assert got == sorted((f"{i}{j}", long if j == 1 else f"t{j}") for i in range(2) for j in range(3))
    assert [r["text"] for r in R.read_records(spark, f"{tmp_path}/c4-train-0", "text string").collect()] == ["t0", long, "t2"]
    (tmp_path / "cut").write_bytes(_record({"id": "a"})[:-3])
    with pytest.raises(ValueError):
        list(R.records(str(tmp_path / "cut")))


def test_corpora_by_name(spark, tmp_path):
    rows = [(f"{i:03d}", "abc" * (i + 1), i) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, text string, more int")
    for name, pattern in corpora.CORPUS_FILES.items():
        df.write.parquet(f"{tmp_path}/{pattern.replace('cc*', 'cc').replace('*', '-0')}")
    v = V.CodepointVocabulary(bos=1, eos=2)
    registry = corpora.register_corpora(Registry(), str(tmp_path), v, 16)
    out = registry.dataset("wiki", spark).collect()
    flat = [x for _, t, _ in rows for x in [*map(ord, t), 2, 1]]
    assert [x for r in sorted(out, key=lambda r: (r["gid"], r["seg"])) for x in r["targets"]] == flat
    assert set(registry.mixtures) == {"open_corpus", "wikipedia"} and {r["task"] for r in registry.dataset("wikipedia", spark, ["gid", "seg"]).select("task").distinct().collect()} == {"cc_en", "wiki"}
    pairs = spark.createDataFrame([(i, f"q{i}", "" if i == 7 else f"a{i}") for i in range(10)], "id int, inputs string, targets string")
    for name in corpora.INSTRUCTION_SETS:
        pairs.write.parquet(f"{tmp_path}/{name.lower()}")
    corpora.register_instructions(registry, str(tmp_path), v, "mistral", validation=3)
    assert sorted(r["id"] for r in registry.dataset("cot_validation", spark).collect()) == [0, 1, 2]
    train = {r["id"]: r for r in registry.dataset("cot_train", spark).collect()}
    assert sorted(train) == [3, 4, 5, 6, 8, 9]  # without an answer there is no loss
    assert "".join(map(chr, train[3]["targets"])) == "[INST]  q3 [/INST]a3" and sum(train[3]["loss_weights"]) == 2
    df.write.parquet(f"{tmp_path}/c4/en/train")
    assert corpora.dataset(spark, str(tmp_path)).count() == 12


def test_lines_read_again_and_state(spark, tmp_path):
    lines = ['{"k": 1}', "", "{bad", '{"k": 2}', '{"k": 3}']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "file_order long, line string")
    got = sorted((r["pass"], r["index"], r["offset"], r["record"]["k"]) for r in C.repeated_lines(df, "line", "k int", 2, after=1).collect())
    at = [0, 9, 10, 15, 24]
    assert got == [(0, 3, 15, 2), (0, 4, at[4], 3), (1, 0, 0, 1), (1, 3, 15, 2), (1, 4, at[4], 3)]
    state = {"config": {"rows": 4}, "index": 7, "offset": 99, "tokens": 1234}
    C.save_state(spark, str(tmp_path / "state"), *state.values())
    assert C.load_state(spark, str(tmp_path / "state")) == state


def test_conversion_leaves_out_what_parses_to_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "i long, t string")
    C.convert(df, lambda r: None if r["i"] % 4 == 0 else {"name": f"n{r['i']}", "size": r["i"]}, "name string, size long", "name", str(tmp_path / "out"), 3)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["name"] for r in out.collect()} == {f"n{i}" for i in range(20) if i % 4} and {r["shard"] for r in out.collect()} == {0, 1, 2}
    C.write_parameters(spark, {"a/b": np.ones(2), "c": np.arange(3)}, str(tmp_path / "p"), floats="float32")
    back = C.read_parameters(spark, str(tmp_path / "p"))
    assert back["a/b"].dtype == np.float32 and back["c"].dtype.kind == "i"
    (tmp_path / "caps.json").write_text('[{"id": "7", "image": "x.jpg", "conversations": [{"from": "system", "value": "a"}, {"from": "gpt", "text": "b"}]}]')
    r = C.read_captions(spark, str(tmp_path / "caps.json")).first()
    assert r["key"] == "7" and [(c["from"], c["value"]) for c in r["conversations"]] == [("system", "a"), ("gpt", "b")]
    with pytest.raises(ValueError):
        contracts.check_columns(["t"], ["t"], df)
    assert contracts.without_missing(spark.createDataFrame([(1, None), (2, "x")], "i int, s string"), ["s"]).count() == 1


# ---------------------------------------------------------------- routing, names, requests


def test_the_last_choice_of_a_late_token_goes_to_the_idle_expert(spark):
    rows = [(0, t, c, e) for t, pair in enumerate([(0, 1), (0, 2), (0, 1)]) for c, e in enumerate(pair)]
    df = routing.queue_places(spark.createDataFrame(rows, "g int, token int, choice int, e int"), "g", "token", "e")
    got = sorted(tuple(r) for r in routing.replace_last(df, "g", "token", "e", 4, 2, 2).collect())
    assert got == [(0, 0, 0, 0), (0, 0, 1, 1), (0, 1, 0, 0), (0, 1, 1, 2), (0, 2, 0, 0), (0, 2, 1, 3)]
    first, same = routing.peeked(df)
    assert first is not None and same.count() == 6


def test_names_that_a_target_knows(spark):
    df = spark.createDataFrame([("opt/mu/x",), ("opt/count",), ("other/mu",)], "path string")
    got = sorted(r["path"] for r in trees.loaded_names(df, "opt", ["mu/inner_opt_state/x", "count"]).collect())
    assert got == ["count", "mu/inner_opt_state/x"]
    assert trees.loaded_names(df).count() == 3


def test_requests_from_table_to_answers(spark):
    v, dummy = V.CodepointVocabulary(bos=1, eos=2), scoring.DummyScorer()
    df = spark.createDataFrame([(1, "ab", "cd"), (2, None, "abcdefgh"), (3, "xyzxyz", "pq")], "id int, prefix string, text string")
    schema = "id int, inputs array<int>, outputs array<int>, mask array<int>, log_likelihood double, is_greedy boolean"
    got = {r["id"]: r for r in scoring.loglikelihood_requests(df, "prefix", "text", v, dummy.loglikelihood, 6, 0, schema, {"after_prefix": ":"}).collect()}
    word = lambda s: [ord(c) for c in s]
    assert got[1]["outputs"] == [*word("ab:cd"), 0] and got[1]["inputs"] == [1, *word("ab:c"), 0] and got[1]["mask"] == [0, 0, 0, 1, 1, 0]
    assert got[2]["outputs"] == word("abcdef") and got[2]["mask"] == [1] * 6
    assert got[3]["outputs"] == word("xyz:pq") and got[3]["log_likelihood"] == -1 and got[3]["is_greedy"] is False
    schema = "id int, text string, inputs array<int>, mask array<int>, until array<string>, output_text string"
    made = scoring.generation_requests(df, "prefix", v, dummy.greedy_until, 4, 0, schema, ["END", "text"]).collect()
    assert {r["output_text"] for r in made} == {"dummy "} and all(len(r["inputs"]) == 4 and r["inputs"][0] == 1 for r in made)
