"""op2, op5, op6 and op7 against brute force and SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination
from quern.llm import license_scan as license_scan_module
from quern.llm import queries as Q
from quern.llm.decontamination import contained_items, decontaminate
from quern.llm.license_scan import license_scan
from quern.llm.metric_search import MTree, top_k
from quern.llm.token_counts import attribute, field_tokens, load_ranks, section_tokens
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    assert_same(Q.QUERIES[name](spark, small), Q.ORACLE_SQL[name], small)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_contained_items_equal_brute_force(spark, docs, texts):
    words = [t.split() for t in texts if t and len(t.split()) > 40]
    parts = [" ".join(w[5:37]) for w in words] + [" ".join(w[3:20] + ["other"] * n) for n, w in enumerate(words[:9])] + [" ".join(w[:7]) for w in words[:5]] + ["one two", "", None]
    items = spark.createDataFrame(list(enumerate(parts)), "item_id long, text string")
    want = set()
    for i, p in enumerate(parts):
        s = shingles(p)
        for d, t in enumerate(texts):
            if s and 100 * len(s & shingles(t)) >= 75 * len(s):
                want.add((d, i, len(s & shingles(t)), len(s)))
    for most in (10**6, 0):
        got = contained_items(docs, items, broadcast_rows=most).collect()
        assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got} == want and len(got) == len(want)
    left = sorted(r["doc_id"] for r in decontaminate(docs, items).collect())
    assert left == sorted(set(range(len(texts))) - {d for d, *_ in want})


def test_signatures_choose_the_candidates(spark, docs, texts, monkeypatch):
    words = [t.split() for t in texts if t and len(t.split()) > 40]
    parts = [" ".join(w[5:37]) for w in words] + [" ".join(w[3:9] + ["other"] * 30) for w in words]
    items = spark.createDataFrame(list(enumerate(parts)), "item_id long, text string")
    each = decontamination.item_sets(items, "item_id", "text", 5).select("item_id", "item_h", "n_item", F.explode("shingles").alias("shingle"))
    signed = decontamination.signatures(each, 5, 75)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    pairs = {(r["doc_id"], r["item_id"]) for r in decontamination.candidates(own, signed, 5).collect()}
    sets = [shingles(t) for t in texts]
    touching = {(d, i) for i, p in enumerate(parts) for d, s in enumerate(sets) if shingles(p) & s}
    holding = {(d, i) for d, i in touching if 100 * len(shingles(parts[i]) & sets[d]) >= 75 * len(shingles(parts[i]))}
    assert holding <= pairs < touching  # the signature prunes pairs, and none that counts
    sizes = {r["item_id"]: r["n"] for r in signed.groupBy("item_id").agg(F.count("s").alias("n")).collect()}
    assert all(sizes[i] < len(shingles(p)) for i, p in enumerate(parts) if len(shingles(p)) > 8)
    real = decontamination.signatures
    monkeypatch.setattr(decontamination, "signatures", lambda each, k, percent: real(each, k, percent).where("item_id <> 3"))
    assert {r["item_id"] for r in contained_items(docs, items).collect()} == {i for _, i in holding} - {3}  # what isn't found by it isn't in the result


def test_decontamination_of_odd_rows(spark, odd, empty, texts):
    items = spark.createDataFrame([(1, " ".join(texts[-1].split()[:30])), (None, texts[30])], "item_id long, text string")
    assert Counter((r["doc_id"], r["item_id"]) for r in contained_items(odd, items).collect()) == Counter([(3, 1), (5, 1), (None, None), (3, None), (3, None)])
    out = decontaminate(odd, items)
    assert out.columns == odd.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [6, None]
    twins = spark.createDataFrame([(7, "a b c d e f"), (7, "b c d e f g"), (7, "b c d e f g")], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert [(r["n_shared"], r["n_item"]) for r in contained_items(one, twins).collect()] == [(2, 2)]
    assert contained_items(empty, items).count() == contained_items(odd, items.limit(0)).count() == decontaminate(empty, items).count() == 0
    assert decontaminate(odd, items.limit(0)).count() == odd.count()


def brute_top(rows, every, k):
    q = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for i in q:
        if i % every == 0:
            n = lambda a, b: int(a[: min(len(a), len(b))] @ b[: min(len(a), len(b))])
            best = sorted((-n(q[i], v), j) for j, v in q.items() if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size", [{}, {"shard": 40, "page": 4}, {"shard": 20, "page": 4, "cells": 3}])
def test_top_k_equals_brute_force(spark, size):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in centre[i % 5] + rng.normal(size=8) * 0.3]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # one common vector, with more ties than results
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (405, []), (450, [1.0, -2.0]), (rows[9][0], rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(4)
    got = sorted(tuple(r) for r in top_k(df, every=5, **size).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 5, 5)


def test_top_k_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(few).collect()] == [(0, 1, 1, 256 * 256 * 11)]
    assert top_k(few.limit(0)).count() == top_k(few.where("vec_id = 1")).count() == 0


def test_an_invalid_vector_does_not_hide_a_valid_one_of_its_id(spark):
    rows = [(0, [None, 1.0]), (0, [2.0, 1.0]), (0, [float("nan"), 0.0]), (0, None), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [0.5])]
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3 * 65536), (0, 2, 3, 65536), (0, 3, 2, 0)]


def test_quantising_equals_one_by_one():
    import pyarrow as pa

    from quern.llm.metric_search import quantise

    lists = [[0.5, -0.001, 0.0], None, [], [None], [1.0, float("inf")], [0.0, 0.0], [3.0], [0.0, 2.0]]
    for a in (pa.array(lists, pa.list_(pa.float64())), pa.array([[9.0], *lists], pa.list_(pa.float64())).slice(1)):
        at, raw = quantise(a)
        assert at.tolist() == [0, 2, 5, 6, 7]
        assert [np.frombuffer(r, "<i8").tolist() for r in raw] == [[128, -1], [], [], [768], [0, 512]]


def test_m_tree_skips_pages():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (400, 6)) for c in (-40, 0, 40)]).round().astype(np.int64)
    top = float((x**2).sum(axis=1).max())
    t = MTree(x, top, page=16)
    q = x[5].astype(float)
    d = np.sqrt(np.maximum((q * q).sum() + top - 2 * (x @ q), 0))
    found = t.nearest(q, top, 5, np.inf, None)
    assert sorted(d[found])[:5] == pytest.approx(sorted(d)[:5])


def test_license_scan_of_odd_texts(spark, odd, empty):
    texts = ["Under the MIT  License; under-the-mit-license, under the mitt license", "CC BY-NC cc by nc", None, "", "plünder the mit license", "under the mit licenseé", "GNU general public\nLICENSE version 3", "this work IS licensed under the gnu general public license v3", "x " * 5000 + "apache license, version 2"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (0, texts[0])]
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))).collect()}
    got = [(out[i]["n_base"], out[i]["first_word"], out[i]["last_word"], out[i]["base_labels"]) for i in range(len(texts))]
    assert got == [(2, 0, 4, "mit"), (2, 0, 3, "cc-by-nc"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (1, 5000, 5000, "apache-2")]
    assert [out[i]["n_words"] for i in range(6)] == [12, 6, 0, 0, 4, 4]
    assert out[7]["labels"] == "gpl-3" and 0.8 <= out[7]["score"] < 1 and out[6]["labels"] == ""
    assert out[None]["n_base"] == 2
    assert license_scan(odd).count() == odd.count() and license_scan(empty).count() == 0


BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted"
GPL3 = "This work is licensed under the GNU General Public License, version 3."


def labels_of(spark, texts):
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [out[i] for i in range(len(texts))]


def test_wrapped_notices_are_found(spark):
    texts = [
        "Some name\n\n * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that\n",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
        "\n".join(GPL3.split()),
        "\n\n".join(BSD.split()) + "\nand more",
        "licensed under cc by\nnc 4.0",
        "licensed under cc by 4.0\nother words",
        "redistribution and use in source\n" + "word " * 40 + "\nand binary forms with or without modification are permitted",
    ]
    got = labels_of(spark, texts)
    assert [x for x, _ in got] == ["bsd", "mpl-2", "gpl-3", "bsd", "cc-by-nc", "cc-by", ""]
    assert [y for _, y in got[:6]] == [1.0] * 6 and got[6][1] == 0


def test_every_notice_of_a_line_is_labelled(spark):
    texts = [f"{GPL3} x y {BSD}", f"{BSD} {GPL3} This Source Code Form is subject to the terms of the Mozilla Public License", "licensed under cc by nc 4 0", GPL3, f"{GPL3} {GPL3.replace('3', '2')}"]
    assert [x for x, _ in labels_of(spark, texts)] == ["bsd,gpl-3", "bsd,gpl-3,mpl-2", "cc-by-nc", "gpl-3", "gpl-2,gpl-3"]


def test_word_places_after_characters_outside_the_basic_plane(spark):
    texts = ["\U0001F600\U0001F600 a b under the mit license c under the mit license", "x\U0001D400y \U0001F600" * 40 + " cc by nc", "apache license version 2 \U0001F600"]
    out = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"]) for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in texts]
    assert out == {0: (2, 3, 8), 1: (1, len(words[1]) - 3, len(words[1]) - 3), 2: (1, 0, 0)}


MIT = next(t for label, t in license_scan_module.TEMPLATES if label == "mit" and "merge" in t)


def test_every_match_is_reported_with_its_share(spark):
    texts = ["This library is licensed under the GNU General Public License, version 3", GPL3, MIT, "\n".join(MIT[i : i + 40] for i in range(0, len(MIT), 40)).replace("\n", "- "), "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software", "nothing"]
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0]["matches"] == "gpl-2:83,gpl-3:91,lgpl:90" and out[0]["labels"] == "gpl-3,lgpl"
    assert out[1]["matches"] == "gpl-2:91,gpl-3:100,lgpl:81" and out[1]["labels"] == "gpl-3"
    assert out[2]["labels"] == "mit" and out[2]["score"] == 1 and "mit:100" in out[2]["matches"]
    assert out[4]["labels"] == "mit" and out[5]["matches"] == out[5]["labels"] == ""


def test_wrapped_full_notices_equal_sql(spark, tmp_path):
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    texts = [wrap(t, n) for _, t in license_scan_module.TEMPLATES for n in (3, 9)] + [f"{GPL3} {BSD}\nother", None, "", "a\n\nb"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = license_scan(df)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.sql(license_scan_module.ORACLE_SQL).fetchall()) == sorted(tuple(r) for r in got.collect())
    labels = {r["doc_id"]: r["labels"].split(",") for r in got.collect()}
    assert all(label in labels[2 * i] and label in labels[2 * i + 1] for i, (label, _) in enumerate(license_scan_module.TEMPLATES))


def test_boundary_rules():
    start, end, cuts = np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 4, 6])
    assert [list(attribute(start, end, cuts, r)[0]) for r in ("start", "end", "most")] == [[2, 1, 0], [1, 1, 1], [2, 0, 1]]
    assert list(attribute(start, end, cuts, "start")[1]) == [1, 1, 0]
    assert list(attribute(np.array([], int), np.array([], int), np.array([0]), "most")[0]) == [0]


def test_section_tokens_add_up(spark, docs, odd, empty, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = [*texts, "a \n b\n\n\nc<|endoftext|>\n", "é\n\n  ü\n日本\n語"]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = sorted(section_tokens(df, ranks, P.PATTERN).collect(), key=lambda r: (r["doc_id"], r["section"]))
    for i, t in enumerate(own):
        rows = [r for r in got if r["doc_id"] == i]
        e = lib.encode(t or "", add_special_tokens=False)
        assert sum(r["n_tokens"] for r in rows) == len(e.ids)
        assert "".join((t or "")[r["first_char"] : r["first_char"] + r["n_chars"]] for r in rows) == (t or "")
        count = Counter(sum(r["first_char"] <= a for r in rows) - 1 for a, _ in e.offsets)
        assert [r["n_tokens"] for r in rows] == [count.get(k, 0) for k in range(len(rows))]
    fields = field_tokens(df.withColumn("name", F.lit("ab")), ranks, P.PATTERN, ["name", "text"]).collect()
    assert len(fields) == 2 * len(own)
    assert section_tokens(odd, ranks, P.PATTERN).where("section = 0").count() == odd.count()
    assert section_tokens(empty, ranks, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        section_tokens(docs, ranks, P.PATTERN, rule="half")
