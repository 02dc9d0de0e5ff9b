"""Language by nearest centroid: TF-IDF vectors of byte n-grams against several centroids a language.

Vectors have ``1 + log(count)`` times inverse document frequency in hashed dimensions and length 1.  Each
language's training vectors are clustered by cosine (spherical k-means), and a text gets the language of the
nearest centroid.  A text farther from it than nearly all training texts are from theirs is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.blocks import U64, documents, durable, slices, text_buffers
from quern.llm.quality_ranking import held_out

#: Bounds of the sample a classifier is fitted on: rows of each language, and rows in all.
SAMPLE_ROWS = 600
MOST_ROWS = 12_000
DIMENSIONS = 4096
CENTROIDS = 4
CHUNK_BYTES = 1 << 20
#: Rows of a piece, as each has a dense vector while it is worked on.
CHUNK_ROWS = 1024
#: Parts of a language's rows, each cut to the sample by itself first.
SALTS = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123, dtype=np.uint8)


def counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Counts of hashed 2- to 4-grams of bytes, documents by dimensions; whatever is no letter counts as a space."""
    n = len(offsets) - 1
    out = np.zeros(n * DIMENSIONS, np.float32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    b = _FOLD[data]
    code = b.astype(U64)
    h = code
    for k in range(2, 5):
        if len(data) < k:
            break
        h = (h[:-1] << U64(8)) | code[k - 1 :]
        ok = (doc[k - 1 :] == doc[: len(h)]) & ((b[: len(h)] != 32) | (b[k - 1 :] != 32))
        d = ((h * U64(0x9E3779B97F4A7C15)) >> U64(52)).astype(np.int64) % DIMENSIONS
        out += np.bincount((doc[: len(h)] * DIMENSIONS + d)[ok], minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]
    centre: np.ndarray
    of: np.ndarray
    least: np.ndarray

    def vectors(self, c: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(c) * self.idf)

    def nearest(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine in 0 to 1, and whether the text is too far away."""
        cos = self.vectors(c) @ self.centre.T
        at = cos.argmax(axis=1)
        best = cos[np.arange(len(at)), at]
        return self.of[at], np.clip(best, 0, 1), best < self.least[at]


def fit(c: np.ndarray, lang: list[str], centroids: int = CENTROIDS, rounds: int = 12, seed: int = 3, reject: float = 0.005) -> Centroids:
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))).astype(np.float32) + 1
    x, langs = _unit(np.log1p(c) * idf), sorted(set(lang))
    label = np.array([langs.index(v) for v in lang], int)
    centre, of, least = [], [], []
    rng = np.random.default_rng(seed)
    for l in range(len(langs)):
        own = x[label == l]
        k = min(centroids, len(own))
        m = own[rng.choice(len(own), k, replace=False)]
        for _ in range(rounds):
            near = (own @ m.T).argmax(axis=1)
            m = _unit(np.stack([own[near == i].sum(axis=0) if (near == i).any() else m[i] for i in range(k)]))
        near = own @ m.T
        at = near.argmax(axis=1)
        for i in range(k):
            centre.append(m[i])
            of.append(l)
            least.append(np.quantile(near[at == i, i], reject) if (at == i).any() else 0.0)
    return Centroids(idf, langs, np.array(centre, np.float32).reshape(-1, DIMENSIONS), np.array(of, int), np.array(least))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def languages(docs: DataFrame, *, parts: int = 4, part: int = 2, sample_rows: int = SAMPLE_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, rejected``.

    Fitted on at most ``sample_rows`` documents of each language, fewer if that would make over ``most_rows`` in all
    (documented bounds; those of least hash are taken), never on those whose
    ``crc32(doc_id) % parts`` is ``part``; every whole text is classified, however long. ``lang_pred`` is a learnt
    language, or ``und`` (score 0) if the text is null, has no letter, or nothing was learnt; ``score`` is the cosine
    with the nearest centroid. Rows with a null language or id teach nothing; equal texts get equal answers, ties go to
    the first language in order. An empty table gives an empty result. Extra columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = own.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    # a language may hold most rows, so its parts are cut to the sample before they meet
    first = Window.partitionBy("lang", "salt").orderBy("h", "doc_id")
    salted = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_rows)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = durable(some.withColumn("rank", rank).where(F.col("rank") <= sample_rows).select("doc_id", "lang", "rank"))
    each = max(1, most_rows // max(1, picked.select("lang").distinct().count()))
    few = picked.where(F.col("rank") <= each).select("doc_id").distinct()
    few = F.broadcast(few) if few.count() <= most_rows else few

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, 1, CHUNK_BYTES, CHUNK_ROWS):
                x = counts(*text_buffers(piece.column(1)))
                rows = []
                for r in x:
                    at = np.flatnonzero(r)
                    rows.append(at.astype(np.int16).tobytes() + r[at].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, pa.binary())], ["lang", "x"])

    got = known.join(few, "doc_id", "left_semi").select("lang", "text").mapInArrow(count, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    c = np.zeros((len(got), DIMENSIONS), np.float32)
    for i, r in enumerate(got):
        n = len(r["x"]) // 6
        c[i, np.frombuffer(r["x"], np.int16, n)] = np.frombuffer(r["x"], np.float32, n, 2 * n)
    shared = docs.sparkSession.sparkContext.broadcast(fit(c, [r["lang"] for r in got]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for piece in slices(b, 1, CHUNK_BYTES, CHUNK_ROWS):
                some = np.array([has_letter(t) for t in piece.column(1).to_pylist()], bool)
                if model.langs:
                    l, s, far = model.nearest(counts(*text_buffers(piece.column(1))))
                    names = [model.langs[i] if ok else "und" for i, ok in zip(l, some, strict=True)]
                else:
                    names, s, far = ["und"] * len(some), np.zeros(len(some)), np.ones(len(some), bool)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(np.where(some, s, 0).astype(float), pa.float64()), pa.array(far | ~some)], ["doc_id", "lang_pred", "score", "rejected"])

    found = own.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "lang_pred", "score", "rejected")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))
