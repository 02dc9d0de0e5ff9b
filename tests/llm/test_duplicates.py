"""op1 and op3 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import ngram_join as N
from quern.llm import suffix_dedup as S
from quern.llm.blocks import Block, pack, unpack
from quern.llm.ngram_join import drop_near_duplicates, ngram_join
from tests.llm.conftest import CLASHING


def brute_spans(rows, length=50):
    """(covered bytes of each row) for (id, text) rows; a missing id is later than all others."""
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            least[w] = min(least.get(w, float("inf")), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        c = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < key(i):
                c[s : s + length] = True
        out.append(c)
    return out


def expected(rows, length=50):
    out = []
    for (i, t), c in zip(rows, brute_spans(rows, length), strict=True):
        b = np.frombuffer((t or "").encode(), np.uint8)
        out.append((i, len(b), int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()), hashlib.sha256(b[~c].tobytes()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize(("length", "gram", "more"), [(50, 20, {}), (50, 7, {}), (20, 11, {}), (50, 20, {"fan": 4, "block_bytes": 5000})])
def test_suffix_dedup_equals_brute_force(docs, texts, length, gram, more):
    got = sorted((tuple(r) for r in S.suffix_dedup(docs, length=length, gram=gram, **more).select(COLUMNS).collect()), key=str)
    assert got == expected(list(enumerate(texts)), length)


def test_suffix_dedup_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in S.suffix_dedup(odd).select(COLUMNS).collect()), key=str) == expected(rows)
    assert S.suffix_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        S.suffix_dedup(empty, length=10, gram=10)


def test_every_place_of_a_fragment_within_its_document_goes(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for i in range(8):
        passage, before, after = text(50), text(90), text(90)
        rows.append((i, text(90) + passage + text(90)))
        rows.append((100 + i, (before + passage + after) * 3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.suffix_dedup(df).select(COLUMNS).collect()), key=str) == expected(rows)


@pytest.mark.parametrize("hits", [64, 8])
def test_a_string_of_all_documents_fills_no_bucket(spark, monkeypatch, hits):
    """One string of 20 and one of 40 bytes in every document, each time among other words."""
    from quern.llm.blocks import to_blocks
    from quern.llm.exchange import scattered

    monkeypatch.setattr(S, "HOT_HITS", hits)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    common, longer = text(20), text(40)
    rows = [(i, text(100) + common + text(60) + longer + text(80)) for i in range(1500)] + [(9000, None), (9001, ""), (9002, longer + common)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blocks = to_blocks(df, "doc_id", "text", 50_000)
    total = sum(len((t or "").encode()) for _, t in rows)
    hot = S.hot_grams(blocks, 50, 20, total, 16)

    def largest(h):
        sent = scattered(blocks, S._keys_of(50, 20, 16, 4096, spark.sparkContext.broadcast(h)), 16).collect()
        size = Counter()
        for r in sent:
            size[r["bucket"]] += len(unpack(r["payload"])[0])
        return max(size.values()) / sorted(size.values())[len(size) // 2]

    assert len(hot.grams) and largest(hot) < 2 < largest(S.NONE_HOT)
    assert sorted((tuple(r) for r in S.suffix_dedup(df).select(COLUMNS).collect()), key=str) == expected(rows)


def test_cut_repeats_keeps_rows_columns_and_characters(docs, odd, empty, texts):
    cut = {r["doc_id"]: r["text"] for r in S.cut_repeats(docs).collect()}
    for (i, t), c in zip(enumerate(texts), brute_spans(list(enumerate(texts))), strict=True):
        at, want = 0, ""
        for ch in t or "":
            n = len(ch.encode())
            want += "" if c[at : at + n].all() else ch
            at += n
        assert cut[i] == (None if t is None else want)
    out = S.cut_repeats(odd)
    assert out.schema.simpleString() == odd.schema.simpleString()
    assert out.count() == odd.count() and all(r[c] == i for r in out.collect() for i, c in enumerate(CLASHING))
    assert S.cut_repeats(empty).collect() == []


def test_runs_of_long_texts_cover_each_window_once(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)).decode() for n in (10, 5000, 50, 3000)]
    block = Block.of(pa.array(range(4)), pa.array(texts))
    whole = S.Runs(block, 50, 20)
    monkeypatch.setattr(S, "_PIECE", 100)
    pieces = S.Runs(block, 50, 20)
    for r in (whole, pieces):
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(r.s0, r.s1, strict=True)])
        want = np.concatenate([np.arange(lo, hi - 49) for lo, hi in zip(block.offsets[:-1], block.offsets[1:], strict=True)])
        assert sorted(starts) == sorted(want)
    of = lambda r: dict(x for a, b, k in zip(r.s0, r.s1, r.a, strict=True) for x in ((s, k) for s in range(a, b + 1)))
    assert of(whole) == of(pieces)


def test_suffix_order_sorts():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 600, dtype=np.uint8)
    start = rng.integers(0, 590, 200)
    group = np.sort(rng.integers(0, 3, 200))
    so = S.SuffixOrder(data, group, start, 600 - start, 40)
    raw = data.tobytes()
    for g in range(3):
        own = [i for i in so.order if group[i] == g]
        assert [raw[start[i] : start[i] + 40] for i in own] == sorted(raw[start[i] : start[i] + 40] for i in own)
    x, y = so.order[:-1], so.order[1:]
    for a, b, n in zip(x, y, so.common(x, y), strict=True):
        s, t = raw[start[a] : start[a] + 40], raw[start[b] : start[b] + 40]
        assert n == next((i for i in range(min(len(s), len(t))) if s[i] != t[i]), min(len(s), len(t)))


def test_blobs_round_trip():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.int64), np.array([True, False]), np.array([1.5])]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def sets_of(rows, k=5):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows, percent=75):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            members[find(i)].append(d)
    return [(d, len(sets[i]), (min(members[find(i)], default=None) if sets[i] else d)) for i, (d, _) in enumerate(rows)]


LIMITS = [{}, {"big": 40, "group_tokens": 150}, {"big": 40, "group_tokens": 1000, "fan": 4, "block_bytes": 5000}, {"big": 400, "group_tokens": 60}]


@pytest.mark.parametrize("limits", LIMITS)
def test_ngram_join_equals_brute_force(docs, texts, limits):
    got = ngram_join(docs, **limits).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(list(enumerate(texts))))
    size = defaultdict(int)
    for r in got:
        size[r["component_id"]] += 1
    assert all((r["n_links"] > 0) == (size[r["component_id"]] > 1) for r in got)


def brute_links(rows, percent=75):
    sets = sets_of(rows)
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    return [(d, sum(linked(sets[i], sets[j]) for j in range(len(rows)) if j != i)) for i, (d, _) in enumerate(rows)]


def test_ngram_join_is_the_same_for_all_limits(docs):
    own = [sorted(tuple(r) for r in ngram_join(docs, **limits).collect()) for limits in LIMITS[:3]]
    assert own[0] == own[1] == own[2]


def test_chains_lose_no_pair_that_passes_the_filters():
    rng = np.random.default_rng(4)
    h, u = rng.integers(0, 40, 600).astype(np.uint64), np.arange(600)
    n = rng.integers(5, 80, 600)
    left = np.maximum(1, (n * rng.uniform(0.5, 1, 600)).astype(int))
    a, b = N.chained(h, u, n.astype(np.uint32), left.astype(np.uint32), 75)
    parent = {}

    def find(i):
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[find(x)] = find(y)
    links = cut = 0
    for i in range(600):
        for j in range(i):
            if h[i] == h[j]:
                passes = 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) and 175 * min(left[i], left[j]) >= 75 * (n[i] + n[j])
                links += passes
                cut += find(i) != find(j)
                assert not passes or find(i) == find(j)
    assert links and cut


@pytest.mark.parametrize("limits", LIMITS)
def test_ngram_join_counts_every_link(spark, texts, odd, limits):
    family = [" ".join(w if j != i else "other" for j, w in enumerate(f"w{k}" for k in range(80))) for i in range(20)]
    rows = list(enumerate([*texts, *family, family[0], family[7]]))
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits).collect()
    want = brute_links(rows)
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == sorted(want) and max(n for _, n in want) >= 21
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(((r["doc_id"], r["n_links"]) for r in ngram_join(odd, **limits).collect()), key=str) == sorted(brute_links(rows), key=str)


def test_ngram_join_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join(odd).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)
    assert ngram_join(empty).count() == 0


def test_one_of_each_group_stays(docs, odd, empty, texts):
    kept = sorted(r["doc_id"] for r in drop_near_duplicates(docs).collect())
    assert kept == sorted({c for _, _, c in brute_components(list(enumerate(texts)))})
    out = drop_near_duplicates(odd)
    assert out.schema.simpleString() == odd.schema.simpleString()
    rows = sorted(((r["doc_id"], len(r["text"] or "")) for r in out.collect()), key=str)
    long = max(len(t or "") for t in texts)
    assert rows == sorted([(3, len(texts[30])), (3, long), (None, 0), (6, 0)], key=str)
    assert drop_near_duplicates(empty).collect() == []
