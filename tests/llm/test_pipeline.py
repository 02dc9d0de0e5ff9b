"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from quern.llm.quality_ranking import keep_good
from tests.llm.conftest import CLASHING
from tests.llm.test_duplicates import brute_components, brute_spans
from tests.llm.test_searches import shingles


def test_stages_one_after_the_other(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        results[name] = (sorted(docs.select("doc_id", "text").collect()), out)
        docs = out
    before, out = results["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in out.collect()}
    assert sum((i in kept) == (labels[i] == 1) for i, _ in before if i in labels) >= 0.97 * len(labels)
    before, out = results["near_duplicates"]
    assert {r["doc_id"] for r in out.collect()} == {c for _, _, c in brute_components([tuple(r) for r in before])}
    before, out = results["repeats"]
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert len(text) == len(before)
    for (i, t), c in zip(before, brute_spans([tuple(r) for r in before]), strict=True):
        at, want = 0, ""
        for ch in t:
            n = len(ch.encode())
            want += "" if c[at : at + n].all() else ch
            at += n
        assert text[i] == (want, len(want))
    before, out = results["contamination"]
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = {i for i, t in before if not any(4 * len(s & shingles(t)) >= 3 * len(s) for s in items)}
    assert {r["doc_id"] for r in out.collect()} == want
    before, out = results["tokens"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in before} and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    run = {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert run == {(r["doc_id"], r["ids_sha256"]) for r in rows}


def _by_row(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_stages_of_odd_tables(spark, small, odd):
    """Null ids, null texts, repeated rows and ids, a very long text and columns with clashing names, stage by stage."""
    own = ["doc_id", "text", "lang", "source"]
    before = _by_row(odd, own)
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r["text"] for r in keep_good(odd.select("doc_id", "text").distinct(), labels).collect()}
    out = stages["quality"](spark, odd, small)
    assert out.columns == odd.columns and _by_row(out, own) == Counter({r: n for r, n in before.items() if r[1] in good})
    out = stages["near_duplicates"](spark, odd, small)
    least = {}  # the least id of each text, a null one last
    for i, t, *_ in before:
        if t:
            least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    got = out.collect()
    assert Counter(r["text"] for r in got if r["text"]) == Counter(least.keys()) and all((r["doc_id"] is None, r["doc_id"] or 0) == least[r["text"]] for r in got if r["text"])
    assert Counter(r["doc_id"] for r in got if r["text"] is None) == Counter(i for (i, t, *_), n in before.items() for _ in range(n) if t is None)
    out = stages["repeats"](spark, odd, small)
    assert out.count() == odd.count() and Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in odd.collect())
    assert {r["n_chars"] for r in out.collect() if r["text"] is None} == {r["n_chars"] for r in odd.collect() if r["text"] is None}
    assert all(r[c] == i for r in out.collect() for i, c in enumerate(CLASHING))
    out = stages["contamination"](spark, odd, small)
    assert _by_row(out, own) == before and out.columns == odd.columns
    rows = stages["tokens"](spark, odd, small).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect()) and {r["n_tokens"] for r in rows if r["doc_id"] == 6} == {0}


def test_stages_of_the_empty_table(spark, small, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, small)
        assert out.count() == 0
        if name != "tokens":
            assert out.columns == empty.columns


def test_registered(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert {f"op{n}_" for n in range(1, 11)} <= {f"{q.split('_')[0]}_" for q in entry.queries()}


def test_lexicon_of_the_tokens_stage_comes_from_all_its_rows(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    from quern.llm.bpe_transducer import WordBpe

    seen, compiled = [], WordBpe.with_words
    monkeypatch.setattr(WordBpe, "with_words", lambda self, words: seen.append(list(words)) or compiled(self, seen[-1]))
    own = ["common words"] * 2100 + ["zorblaxian"] * 2
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").coalesce(1)
    assert corpus_pipeline.tokens(spark, df, "").count() == len(own)
    assert ["common", "words", "zorblaxian"] in seen
