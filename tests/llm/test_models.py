"""op4, op8, op9 and op10: exact parts against brute force, learnt parts by held-out figures."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe_transducer as B
from quern.llm.language_id import counts, languages
from quern.llm.language_id import fit as fit_centroids
from quern.llm import lm_scoring as LM
from quern.llm.lm_scoring import lm_scores
from quern.llm import quality_ranking
from quern.llm.quality_ranking import _CLASS, features, fit, keep_good, quality_scores
from quern.llm.quality_ranking import text_buffers

SF = "/root/testdata/sf0.01"


def test_lm_base_equals_brute_force(docs, texts):
    words = [(t or "").encode().lower().split() + [None] for t in texts]
    c = Counter(w for i, x in enumerate(words) if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for r in lm_scores(docs).collect():
        x = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(c[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0


def test_lm_of_odd_rows(spark, odd, empty):
    out = lm_scores(odd).collect()
    assert len(out) == odd.count() and all(r["n_tokens"] >= 1 and np.isfinite(r["score"]) for r in out)
    assert lm_scores(empty).count() == 0
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = lm_scores(only).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0)


def test_lm_beats_unigrams_on_held_out_documents(spark):
    out = lm_scores(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out["s"] > 0.98 * out["b"]


def brute_log_probability(model, each, w, contexts):
    """Of one token: the class among all classes, and the outcome among its class, one product at a time."""
    h = [sum(float(model.r[c][i]) * float(model.c[j][i][k]) for j, c in enumerate(contexts) for i in range(len(model.r[c]))) for k in range(model.r.shape[1])]
    dot = lambda v, bias: sum(a * float(b) for a, b in zip(h, v, strict=True)) + float(bias)
    softmax = lambda s, i: s[i] - math.log(sum(math.exp(x) for x in s))
    first = w // each * each
    own = range(first, min(first + each, len(model.q)))
    return softmax([dot(v, x) for v, x in zip(model.a, model.d, strict=True)], w // each) + softmax([dot(model.q[o], model.b[o]) for o in own], w - first)


def test_lm_scores_equal_brute_force_on_the_learnt_model(spark):
    """All probabilities of a context sum to 1, and scores are sums over tokens of plain products of the frozen model."""
    rng = random.Random(6)
    word = lambda: rng.choice(["ka", "lo", "mi", "ne", "ru", f"x{rng.randint(0, 40)}"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(70, None), (71, "never seen"), (72, "KA Lo ka")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {}
    real = LM.fitted
    try:
        LM.fitted = lambda *a, **k: kept.setdefault("fitted", real(*a, **k))
        got = {r["doc_id"]: r for r in lm_scores(df, vocabulary=20, dimensions=4).collect()}
    finally:
        LM.fitted = real
    vocab, model = kept["fitted"]
    counts_ = Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in [*(t or "").lower().split(), None])
    start, each = len(vocab.p), LM.CLASS
    for contexts in ([start, start], [0, 3], [19, start], [20, 5]):
        assert sum(math.exp(brute_log_probability(model, each, w, contexts)) for w in range(start)) == pytest.approx(1, abs=1e-4)

    def outcome(x):
        h = LM.END if x is None else _token_hash(x)
        w = int(vocab.outcomes(np.array([h], np.uint64))[0])
        inside = 0.0 if w < len(vocab.hashes) else math.log10((counts_[x] + 1) / vocab.other[w - len(vocab.hashes)])
        return w, inside

    for i, t in rows:
        want, before = 0.0, [start] * LM.CONTEXT
        for x in [*(t or "").lower().split(), None]:
            w, inside = outcome(x)
            want += brute_log_probability(model, each, w, before) / math.log(10) + inside
            before = [w, *before[:-1]]
        assert got[i]["score"] == pytest.approx(want, abs=1e-3)


def _token_hash(word):
    import pyarrow as pa

    from quern.llm.blocks import Block

    return LM.Tokens(Block.of(pa.array([1]), pa.array([word])), 7, 2).hash[0]


def test_lm_scores_do_not_depend_on_how_rows_lie(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = ({r["doc_id"]: r for r in lm_scores(docs.repartition(n), **more).collect()} for n, more in ((2, {}), (7, {"block_bytes": 20_000, "fan": 4})))
    assert len(a) == len(b) and all(a[i]["score"] == pytest.approx(b[i]["score"], rel=1e-5, abs=1e-3) and a[i]["base_score"] == pytest.approx(b[i]["base_score"]) for i in a)


def test_lm_merges_groups_in_a_tree(spark):
    parts = spark.createDataFrame([(i, LM.pack(np.array([i, 1.0]))) for i in range(150) if i % 10], "slot long, payload binary").repartition(5)
    got = LM.tree(parts, 150, lambda x: [np.sum([p[0] for p in x], axis=0)], fan=4)
    assert got[0].tolist() == [sum(i for i in range(150) if i % 10), 135]
    assert LM.tree(parts.limit(0), 1, lambda x: next(x)) is None


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_scores(docs, labels)
    assert scored.count() == docs.count()
    hit = scored.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert hit >= 0.97
    kept = keep_good(docs, labels)
    assert kept.schema == docs.schema
    good = kept.join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert good >= 0.97


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None), (6, 7)], "doc_id long, quality int")
    out = quality_scores(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    none = quality_scores(odd, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert quality_scores(empty, labels).count() == keep_good(empty, labels).count() == 0
    assert keep_good(odd, labels).columns == odd.columns


def test_ranking_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    r = fit(x, y, pairs=5000)
    assert ((r.score(x) >= 0.5) == y).mean() > 0.97
    import pyarrow as pa

    f = features(*text_buffers(pa.array(["", "A a a\nb!", None])))
    assert np.isfinite(f).all() and (f[0] == f[2]).all()


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = languages(docs)
    assert out.count() == docs.count()
    hit = out.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.min("score"), F.max("score")).first()
    assert hit[0] >= 0.97 and 0 <= hit[1] <= hit[2] <= 1


def brute_ngrams(text):
    """Counts of folded 2- to 4-grams of bytes that aren't blank at both ends, by dimension."""
    b = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").encode()]
    out = Counter()
    for k in (2, 3, 4):
        for i in range(len(b) - k + 1):
            h = int.from_bytes(bytes(b[i : i + k]), "big")
            if b[i] != 32 or b[i + k - 1] != 32:
                out[(h * 0x9E3779B97F4A7C15 % 2**64) >> 52] += 1
    return out


def brute_cosines(text, model):
    v = {d: math.log1p(n) * float(model.idf[d]) for d, n in brute_ngrams(text).items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return [sum(x / norm * float(c[d]) for d, x in v.items()) for c in model.centre]


def test_languages_equal_brute_force(spark, texts):
    """Every prediction against centroids taken from the same training rows and vectors made one n-gram at a time."""
    rng = random.Random(1)
    words = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sht", "örl", "grum", "zak"], "cc": ["oui", "bleu", "çah", "eux"]}
    rows = [(i, " ".join(rng.choice(words[l]) for _ in range(rng.randint(1, 30))), l) for i, l in enumerate(sorted(words) * 20)]
    rows += [(100, None, "aa"), (101, "12 !", "bb"), (102, "KA lo " * 3000, None), (103, "x", None)]
    train = sorted((l, t) for i, t, l in rows if l and t and any(c.isalpha() for c in t) and zlib.crc32(str(i).encode()) % 4 != 2)
    import pyarrow as pa

    c = counts(*text_buffers(pa.array([t for _, t in train])))
    for row, (_, t) in zip(c, train, strict=True):
        assert {int(d): int(row[d]) for d in np.flatnonzero(row)} == dict(brute_ngrams(t))
    order = sorted(range(len(train)), key=lambda i: (train[i][0], _sparse(c[i])))
    model = fit_centroids(c[order], [train[i][0] for i in order])
    got = {r["doc_id"]: r for r in languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not t or not any(ch.isalpha() for ch in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cos = brute_cosines(t, model)
        best = max(range(len(cos)), key=cos.__getitem__)
        assert r["lang_pred"] == model.langs[model.of[best]] and r["score"] == pytest.approx(min(max(cos[best], 0), 1), abs=1e-4)


def _sparse(row):
    at = np.flatnonzero(row)
    return at.astype(np.int16).tobytes() + row[at].astype(np.float32).tobytes()


def test_language_sample_is_bounded_and_the_same_however_rows_lie(spark):
    rows = [(i, f"ka lo {i % 7} mi" if i % 3 else "sht grum", "aa" if i % 3 else "bb") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (sorted(tuple(r) for r in languages(df.repartition(n), sample_rows=10).collect()) for n in (1, 7))
    assert a == b and {r[2] for r in a} == {"aa", "bb"}


def brute_features(text):
    """Shares of byte classes and of neighbouring ones, one byte at a time, and counts of words and lines."""
    b = (text or "").encode()
    cls = [int(_CLASS[c]) for c in b]
    words, lines = b.split(), [x for x in b.split(b"\n") if x]
    one = [cls.count(k) / max(len(b), 1) for k in range(14)]
    pairs = Counter(zip(cls, cls[1:], strict=False))
    two = [pairs[i, j] / max(len(b) - 1, 1) for i in range(14) for j in range(14)]
    low = [w.lower() for w in words]
    return one, two, len(words), len(set(low)) / max(len(words), 1), len(lines), sum(map(len, words)) / max(len(words), 1) / 10


def test_quality_features_equal_brute_force(texts):
    import pyarrow as pa

    own = [t for t in [*texts, "A b\nA b\n!? <x> é"]]
    x = features(*text_buffers(pa.array(own)))
    for row, t in zip(x, own, strict=True):
        one, two, n_words, distinct, n_lines, mean = brute_features(t)
        assert row[:14] == pytest.approx(one) and row[14 : 14 + 196] == pytest.approx(two)
        tail = row[14 + 196 :]
        assert tail[1] == pytest.approx(math.log1p(n_words)) and tail[2] == pytest.approx(mean) and tail[6] == pytest.approx(distinct)
        assert tail[12] == pytest.approx(math.log1p(max(n_lines, 1))) and tail[13] == float(not (t or ""))


def test_quality_is_learnt_from_all_labels(spark):
    """Of each label the 4,001 documents of least hash say one thing, and 6,000 others the opposite."""
    ids = [r["id"] for r in spark.range(20_002).orderBy(F.xxhash64("id"), "id").collect()]
    rows, labels = [], []
    for k, i in enumerate(ids):
        q, early = k % 2, k < 8002
        rows.append((i, "river stone walks." if bool(q) == early else "!! x1 $$ BUY"))
        labels.append((i, q))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r["text"] for r in keep_good(docs, labels).select("text").distinct().collect()} == {"!! x1 $$ BUY"}


def test_quality_groups_hold_every_labelled_document(spark, monkeypatch):
    """By broadcast and by shuffle, however rows lie; a rare label is copied to all groups, and counted once."""
    import pyarrow as pa

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["river", "stone", "walks", "X1", "!!"]) for _ in range(rng.randint(1, 9)))) for i in range(300)] + [(7, "river"), (None, "stone")]
    labels = spark.createDataFrame([(i, int(i % 60 > 0)) for i in range(250)] + [(999, 1), (None, 1)], "doc_id long, quality int")
    scores, x = [], features(*text_buffers(pa.array([t for i, t in rows if i is not None and i < 250]))).astype(np.float32)
    for bound, parts in ((1 << 14, 1), (0, 5)):
        monkeypatch.setattr(quality_ranking, "BROADCAST_LABELS", bound)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        _, groups = quality_ranking._groups(docs, labels.where("doc_id is not null"), 50)
        found = [g for b in groups.toArrow().to_batches() for g in quality_ranking._unpacked(b)]
        assert len(found) == 6 and all((y == 0).sum() == 5 for _, _, y, _ in found)
        assert sorted(r.astype(np.float32).tobytes() for _, own, _, first in found for r in own[first]) == sorted(r.tobytes() for r in x)
        n, mean, m2 = quality_ranking.merged([quality_ranking.moments(own[first]) for _, own, _, first in found])
        assert n == 251 and mean == pytest.approx(x.astype(float).mean(axis=0)) and np.sqrt(m2 / n) == pytest.approx(x.astype(float).std(axis=0), abs=1e-9)
        scores.append(sorted((str(r["doc_id"]), r["score"]) for r in quality_scores(docs, labels, group_rows=50).collect()))
    (ids, a), (same, b) = (zip(*s, strict=True) for s in scores)
    assert ids == same and a == pytest.approx(b, abs=1e-12)


def test_quality_ranking_equals_brute_force(spark):
    """The pair loss of the learnt weights against small changes, the cut against every cut, and the query against the model."""
    rng = random.Random(2)
    good, bad = (lambda: " ".join(rng.choice(["river", "stone", "walks", "under"]) for _ in range(30)) + "."), (lambda: " ".join(rng.choice(["!!", "x1", "$$", "BUY"]) for _ in range(30)))
    rows = [(i, good() if i % 2 else bad()) for i in range(120)]
    labels = [(i, i % 2 if i % 11 else 1 - i % 2) for i, _ in rows]
    train = [(i, t, q) for (i, t), (_, q) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1]
    import pyarrow as pa

    x = features(*text_buffers(pa.array([t for _, t, _ in train]))).astype(np.float32)
    order = sorted(range(len(train)), key=lambda i: (train[i][2], x[i].tobytes()))
    x, y = x[order].astype(float), np.array([train[i][2] for i in order])
    model = fit(x, y)
    z = np.clip((x - model.mean) / model.scale, -8, 8)

    def loss(w):
        s = z @ w
        return float(np.mean([math.log1p(math.exp(-(s[i] - s[j]))) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)]))

    noise = np.random.default_rng(0)
    assert loss(model.w) < loss(np.zeros_like(model.w)) and np.mean([loss(model.w) <= loss(model.w + noise.normal(0, 0.3, len(model.w))) for _ in range(20)]) >= 0.9
    s = model.worth(x)
    right = lambda cut: (s[y == 1] >= cut).mean() + (s[y == 0] < cut).mean()
    assert right(model.cut) == pytest.approx(max(right(c) for c in [*s, s.max() + 1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for i, t in rows:
        v = np.clip((features(*text_buffers(pa.array([t])))[0] - model.mean) / model.scale, -8, 8)
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(v, model.w, strict=True)) - model.cut) / model.width))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["predicted"] == int(want >= 0.5)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_very_long_texts(spark):
    long = "ka lo mi " * 120_000
    df = spark.createDataFrame([(1, long, "aa"), (3, "sht grum örl", "bb"), (4, "ka lo", "aa"), (5, long, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in languages(df).collect()}[5] == "aa"
    scores = {r["doc_id"]: r["score"] for r in quality_scores(df, spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "doc_id long, quality int")).collect()}
    assert scores[1] == scores[5] and len(scores) == 4


def test_languages_of_odd_rows(spark, odd, empty):
    out = languages(odd).collect()
    assert len(out) == odd.count()
    assert {r["lang_pred"] for r in out if r["doc_id"] == 6} == {"und"}
    assert languages(empty).count() == 0
    some = spark.createDataFrame([(1, "the cat sat", "en"), (3, "the dog sat", "en"), (4, "le chat noir", "fr"), (5, "123 !?", None), (6, "日本", None), (7, "", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in languages(some).collect()}
    assert got[5] == got[7] == "und" and got[6] in ("en", "fr")
    assert {r["lang_pred"] for r in languages(some.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.fixture(scope="module")
def pair():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    return B.load_spec(path), Tokenizer.from_file(path)


TRICKY = ["Hello wörld's 123 <|endoftext|> x<|startoftext|>y ÉÇ!!! ", "", "  ", "İstanbul ǅ ſ K", "à ﬁ é", "日本語テキスト😀😀", "\x00\x01a\tb\x0bc d​e\xa0f\x1cg\x1fh", "<|EndOfText|> <|endoftext|", "'LL 'Re'ſ they're", "a" * 500 + " " + "!" * 300 + " abab" * 50, "ΟΔΟΣ ΣΑΣ", "<|endoftext|><|endoftext|>"]


def test_bpe_equals_the_library(spark, docs, texts, pair):
    spec, lib = pair
    own = [*texts, *TRICKY]
    out = {r["doc_id"]: r for r in B.bpe_encode(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(4), spec).collect()}
    for i, t in enumerate(own):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert list(out[i]["ids"]) == ids and out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert B.WordBpe(spec).decode(lib.encode(TRICKY[0]).ids) == lib.decode(lib.encode(TRICKY[0]).ids, skip_special_tokens=False)


def test_bpe_of_odd_rows(odd, empty, pair):
    assert B.bpe_encode(odd, pair[0]).count() == odd.count() and B.bpe_encode(empty, pair[0]).count() == 0


def test_transducer_is_minimal_and_finds_its_words(pair):
    words = sorted([b"tap", b"taps", b"top", b"tops", b"stop", b"stops", "é".encode()])
    a = B.minimal_automaton(words)
    lex = B.Lexicon(B.Lexicon.compiled({w: [i, i + 1] for i, w in enumerate(words)}))
    assert list(lex.ranks([*words, b"ta", b"tapsx", b"x"])) == [*range(len(words)), -1, -1, -1]
    assert list(lex.ids[lex.at[2] : lex.at[3]]) == [2, 3]
    right = {}
    for s in range(len(a["final"])):  # no two states have the same words after them
        seen = frozenset(_language(a, s))
        assert seen not in right
        right[seen] = s
    bpe = B.WordBpe(pair[0], extra_words=["supercalifragilistic"])
    assert bpe.lexicon.ranks([b"supercalifragilistic"])[0] >= 0


def _language(a, s):
    out = [b""] if a["final"][s] else []
    for i in np.flatnonzero(a["key"] // 256 == s):
        out += [bytes([a["key"][i] % 256]) + w for w in _language(a, a["to"][i])]
    return out


def test_lexicon_holds_frequent_words_of_the_corpus(spark, pair):
    plain = B.WordBpe(pair[0])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["zorblaxian zorblaxian quix", "Zorblaxian once", None, "onlyoncehere " + "y" * 30_000])], "doc_id long, text string")
    words = B.frequent_words(df, plain)
    assert words[0] == "zorblaxian" and "onlyoncehere" not in words
    bpe = B.WordBpe(pair[0], plain.with_words(words))
    raw = b"zorblaxian"
    assert plain.lexicon.ranks([raw])[0] < 0 <= bpe.lexicon.ranks([raw])[0]
    r = bpe.lexicon.ranks([raw])[0]
    at, ids = bpe.merges.encode([raw])
    assert len(ids) > 1 and list(bpe.lexicon.ids[bpe.lexicon.at[r] : bpe.lexicon.at[r + 1]]) == list(ids)


def test_lexicon_comes_from_counts_of_all_texts(spark, pair, monkeypatch):
    plain = B.WordBpe(pair[0])
    own = ["common words"] * 2100 + ["zorblaxian", "Zorblaxian rare", None, "quixolent <|endoftext|> " * 1500, "y" * 65 + " " + "y" * 65]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").coalesce(1)
    assert B.frequent_words(df, plain) == ["common", "words", "quixolent", "zorblaxian"]
    assert B.frequent_words(df, plain, most=3) == ["common", "words", "quixolent"] and B.frequent_words(df, plain, most=1) == []
    monkeypatch.setattr(B, "COUNTED_WORDS", 1)  # counts handed on in many parts are the same
    assert B.frequent_words(df.repartition(7), plain) == ["common", "words", "quixolent", "zorblaxian"]
    want = Counter(w for t in TRICKY for w in plain.pieces.words(t) if not w.startswith(" ") and len(w.encode()) <= 64)
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    assert {r["word"]: r["n"] for r in B.word_counts(tricky, plain.pieces).collect()} == want


def test_merges_of_many_words_equal_one_by_one(pair):
    m = B.WordBpe(pair[0]).merges
    words = [b"aaaaaaa", b"banana", b"x", b"mississippi", "über".encode(), b"aaaa", b"thethethe"]
    at, ids = m.encode(words)
    for i, w in enumerate(words):
        assert list(ids[at[i] : at[i + 1]]) == list(m.encode([w])[1])
