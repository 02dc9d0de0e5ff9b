"""Document quality by Bradley-Terry ranking.

A document's score is a linear function of its features.  It is learnt from preference pairs (a document of
label 1 beats one of label 0) by the logistic loss on the difference of their features.  All labelled documents
take part: they are dealt by hash into groups of bounded size, every one stands in pairs of its group, and the
groups' weights are averaged.  Means and scales of the features are those of all of them, and so is the cut between
the classes, a quantile of their scores; a logistic curve around it gives the score in 0 to 1.

Features are shares and lengths of the whole text, counted in numpy over blocks of bytes: classes of bytes and
of neighbouring bytes, lengths of words and lines, repeated words and lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import documents, durable, give_back, pack, slices, text_buffers, unpack
from quern.llm.words import word_hashes, word_spans

#: Labelled documents of a group, about; of the rarer label each has some ``LEAST`` (copies, if there are fewer).
GROUP_ROWS, LEAST = 8000, 64
PAIRS = 200_000
#: Equal steps of the range of scores in which those of labelled documents are counted for the cut.
BINS = 1 << 16
#: Labels up to which they are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1 << 14
#: Groups whose sums are merged by one task.
FAN = 256
CHUNK_BYTES = 2 << 20

_CLASSES = 14


def _byte_classes() -> np.ndarray:
    c = np.full(256, 9, np.int64)  # other ASCII punctuation
    c[:32] = 13
    c[127] = 13
    c[[9, 11, 12, 13, 32]] = 0
    c[10] = 1
    c[97:123] = 2
    c[65:91] = 3
    c[48:58] = 4
    c[[44, 46]] = 5
    c[[33, 63]] = 6
    c[[39, 34, 40, 41, 45, 58, 59]] = 7
    c[[124, 60, 62, 123, 125, 91, 93, 61, 95, 47, 92]] = 8
    c[128:192] = 10
    c[192:224] = 11
    c[224:] = 12
    return c


_CLASS = _byte_classes()
_LINE = np.zeros(256, bool)
_LINE[10] = True
FEATURES = _CLASSES * _CLASSES + _CLASSES + 14


def _repeats(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each group: different values, the count of its commonest value, and neighbours that are equal."""
    n = len(at) - 1
    distinct, most, same = np.zeros(n), np.zeros(n), np.zeros(n)
    s = hashes.copy()
    for d in range(n):
        x = s[at[d] : at[d + 1]]
        if len(x):
            same[d] = (x[1:] == x[:-1]).sum()
            x.sort()
            cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            distinct[d] = len(cut)
            most[d] = np.diff(np.append(cut, len(x))).max()
    return distinct, most, same


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of features for each document of a block; an empty text has zeros."""
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    cls = _CLASS[data]
    one = np.bincount(doc * _CLASSES + cls, minlength=n * _CLASSES).reshape(n, -1) / np.maximum(size, 1)[:, None]
    inner = doc[1:] == doc[:-1]
    key = (doc[:-1] * _CLASSES + cls[:-1]) * _CLASSES + cls[1:]
    two = np.bincount(key[inner], minlength=n * _CLASSES**2).reshape(n, -1) / np.maximum(size - 1, 1)[:, None]
    starts, ends, woff = word_spans(offsets, data)
    words = np.diff(woff)
    w = np.maximum(words, 1)
    wh = word_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    owner = np.repeat(np.arange(n), words)
    total = np.bincount(owner, length, n)
    mean = total / w
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / w - mean**2, 0))
    letters = np.isin(cls, (2, 3, 10, 11, 12))
    count = np.concatenate([[0], np.cumsum(letters)])
    worded = np.bincount(owner, count[ends] > count[starts], n) / w
    tail = np.bincount(owner, ~letters[ends - 1], n) / w if len(ends) else np.zeros(n)
    distinct, most, same = _repeats(wh, woff)
    ls, le, loff = word_spans(offsets, data, _LINE)
    lines = np.maximum(np.diff(loff), 1)
    ldistinct, _, _ = _repeats(word_hashes(data, ls, le), loff)
    own = [np.log1p(size), np.log1p(words), mean / 10, spread / 10, worded, tail, distinct / w, most / w, same / w, np.log1p(distinct) - np.log1p(words), ldistinct / lines, np.log1p(size / lines), np.log1p(lines), (size == 0).astype(float)]
    return np.concatenate([one, two, np.stack(own, axis=1)], axis=1)


@dataclass
class Ranking:
    """``sigmoid((w . (x - mean) / scale - cut) / width)``."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    width: float

    def standardized(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.standardized(x) @ self.w

    @property
    def reach(self) -> float:
        """A bound of what ``worth`` gives, either side of zero."""
        return max(8 * float(np.abs(self.w).sum()), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.worth(x) - self.cut) / self.width, -40, 40)))


def standard(n: int, mean: np.ndarray, m2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and scales; a feature that doesn't vary keeps its size."""
    scale = np.sqrt(m2 / max(n, 1))
    return mean, np.where(scale > 1e-9, scale, 1)


def moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of squares around them."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    return len(x), mean, ((x - mean) ** 2).sum(axis=0)


def merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of several parts together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / max(n, 1)
    return n, mean, sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)


def weights(z: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 250, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights from random preference pairs, by gradient steps with momentum and adaptive scale.

    There are ``pairs`` of them, more if that is too few for every row to stand in one; rounds go over all at least once.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = max(pairs, len(good), len(bad))
    rng = np.random.default_rng(seed)
    w = np.zeros(z.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    i, j = rng.permutation(np.resize(good, pairs)), rng.permutation(np.resize(bad, pairs))
    step = max(1, min(pairs, 2048))
    t = 0
    for r in range(max(rounds, -(-pairs // step))):
        at = (r * step) % pairs
        a, b = i[at : at + step], j[at : at + step]
        d = z[a] - z[b]
        g = -((1 / (1 + np.exp(np.clip(d @ w, -40, 40)))) @ d) / len(d) + decay * w
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def histogram(ranking: Ranking, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of each label (two rows of ``BINS`` counts) by worth, in equal steps of all that the weights can give."""
    at = np.floor((ranking.worth(x) / ranking.reach + 1) * (BINS // 2)).astype(np.int64).clip(0, BINS - 1)
    return np.stack([np.bincount(at[y == q], minlength=BINS) for q in (0, 1)])


def with_cut(ranking: Ranking, counts: np.ndarray) -> Ranking:
    """The ranking cut where the shares of label 1 above and of label 0 below are greatest together, by counts of all rows.

    Cuts lie between two steps of the histogram; of equal ones the middle one counts.
    """
    bad, good = counts
    full = np.flatnonzero(bad + good)
    edges = np.arange(full[0], full[-1] + 2)
    above_good = good.sum() - np.concatenate([[0], np.cumsum(good)])[edges]
    below_bad = np.concatenate([[0], np.cumsum(bad)])[edges]
    right = above_good * int(bad.sum()) + below_bad * int(good.sum())
    best = np.flatnonzero(right == right.max())
    worth = lambda at: (at / (BINS // 2) - 1) * ranking.reach
    middle, n = worth(np.arange(BINS) + 0.5), bad + good
    mean = (n @ middle) / n.sum()
    width = np.sqrt(n @ (middle - mean) ** 2 / n.sum())
    return Ranking(ranking.mean, ranking.scale, ranking.w, float(worth(edges[best[(len(best) - 1) // 2]])), max(float(width) / 4, 1e-6))


def one_sided(mean: np.ndarray, scale: np.ndarray, good: bool) -> Ranking:
    """With one label only there are no pairs: the score is then the same side for all."""
    return Ranking(mean, scale, np.zeros(len(mean)), -1.0 if good else 1.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 250, decay: float = 1e-4, seed: int = 7) -> Ranking:
    """The ranking of rows that make one group, weights and cut."""
    mean, scale = standard(*moments(x))
    if not (y == 1).any() or not (y == 0).any():
        return one_sided(mean, scale, bool((y == 1).any()))
    ranking = Ranking(mean, scale, np.zeros(len(mean)), 0.0, 1.0)
    ranking.w = weights(ranking.standardized(x), y, pairs, rounds, decay, seed)
    return with_cut(ranking, histogram(ranking, x, y))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def _groups(docs: DataFrame, labels: DataFrame, group_rows: int) -> tuple[dict[int, int], DataFrame | None]:
    """How many documents have each label, and all of them as a durable table of ``group, payload`` (none with one label only).

    A payload holds features, labels and which rows are no copies.

    The number of groups follows from the count of labelled documents, and a document's group from its id and features;
    rows of a group are sorted, so nothing depends on how rows lie. Copies of the rarer label are pairs' other halves only.
    """
    few = labels.count() <= BROADCAST_LABELS
    named = F.broadcast(labels) if few else labels
    n = {r["quality"]: r["count"] for r in docs.select("doc_id").join(named, "doc_id").groupBy("quality").count().collect()}
    if len(n) < 2:
        return n, None
    groups = -(-sum(n.values()) // group_rows)
    bad, good = (min(groups, max(1, -(-LEAST * groups // n[q]))) for q in (0, 1))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, 1, CHUNK_BYTES):
                x = features(*text_buffers(piece.column(1))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([r.tobytes() for r in x], pa.binary()), *piece.columns[2:]], ["doc_id", "x", *piece.schema.names[2:]])

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        give_back()
        raw, y, first = table["x"].to_pylist(), table["quality"].to_pylist(), table["first"].to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (y[i], raw[i]))
        x = np.frombuffer(b"".join(raw[i] for i in order), np.float32)
        return pa.table({"group": pa.array([key[0].as_py()], pa.int64()), "payload": pa.array([pack(x, np.array([y[i] for i in order], np.uint8), np.array([first[i] for i in order], bool))], pa.binary())})

    if few:  # other documents' features aren't needed
        rows = docs.select("doc_id", "text").join(named, "doc_id").select("doc_id", "text", "quality").mapInArrow(compute, "doc_id long, x binary, quality int")
    else:
        rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(compute, "doc_id long, x binary").join(named, "doc_id")
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == 1, good - 1).otherwise(bad - 1)))
    dealt = rows.select("quality", "x", F.xxhash64("doc_id", "x").alias("h"), copy.alias("copy"))
    dealt = dealt.select("quality", "x", (F.col("copy") == 0).alias("first"), F.pmod(F.pmod("h", F.lit(groups)) + F.col("copy"), F.lit(groups)).cast("long").alias("group"))
    parts = min(groups, max(1024, groups // 16))
    return n, durable(dealt.repartition(parts, "group").groupBy("group").applyInArrow(packed, "group long, payload binary"))


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for group, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        give_back()
        x, y, first = unpack(payload.as_py())
        yield group, x.reshape(len(y), -1).astype(float), y, first


_SUMS = "group long, n long, mean binary, m2 binary"


def _sums(found: list[tuple]) -> pa.RecordBatch:
    group, n, mean, m2 = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(n, pa.int64()), pa.array([a.tobytes() for a in mean], pa.binary()), pa.array([a.tobytes() for a in m2], pa.binary())], ["group", "n", "mean", "m2"])


def _merged(sums: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of all groups, merged in order of groups: ``FAN`` of them by a task, what that gives by the driver."""

    def parts(rows: list[dict]) -> list[tuple]:
        return [(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"])) for r in sorted(rows, key=lambda r: r["group"])]

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_sums([(key[0].as_py(), *merged(parts(table.to_pylist())))])])

    some = sums.groupBy(F.floor(F.col("group") / FAN).alias("fan")).applyInArrow(merge, _SUMS)
    return merged(parts([r.asDict() for r in some.collect()]))


def _learnt(docs: DataFrame, labels: DataFrame, group_rows: int) -> Ranking:
    """The ranking by all labelled documents; a task holds a group at a time, the driver sums of fixed size."""
    n, groups = _groups(docs, labels, group_rows)
    if groups is None:
        return one_sided(np.zeros(FEATURES), np.ones(FEATURES), 1 in n)

    def own_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, x, _, first in _unpacked(b):
                yield _sums([(group, *moments(x[first]))])

    mean, scale = standard(*_merged(groups.mapInArrow(own_moments, _SUMS)))
    plain = Ranking(mean, scale, np.zeros(FEATURES), 0.0, 1.0)

    def own_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, x, y, first in _unpacked(b):
                if y.any() and not y.all():
                    w = weights(plain.standardized(x), y)
                    yield _sums([(group, int(first.sum()), w, np.zeros_like(w))])

    ranking = Ranking(mean, scale, _merged(groups.mapInArrow(own_weights, _SUMS))[1], 0.0, 1.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, BINS), np.int64)
        for b in batches:
            for _, x, y, first in _unpacked(b):
                count += histogram(ranking, x[first], y[first])
        at = np.flatnonzero(count.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[0, at]), pa.array(count[1, at])], ["at", "bad", "good"])

    counts = np.zeros((2, BINS), np.int64)
    for r in groups.mapInArrow(counted, "at long, bad long, good long").groupBy("at").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():
        counts[:, r["at"]] = r["bad"], r["good"]
    return with_cut(ranking, counts)


def _fitted(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, keep: Column, group_rows: int):
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = named.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & keep)
    return docs.sparkSession.sparkContext.broadcast(_learnt(own, known, group_rows))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", *, parts: int = 3, part: int = 1, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Fitted on all labelled documents, in groups of about ``group_rows``, but never on those whose
    ``crc32(doc_id) % parts`` is ``part``; every whole text is scored, however long. A null text is the empty text and
    is scored as that; a null id is scored and never learnt from; labels that are null or neither 0 nor 1 are passed
    over; without labels every score is under 0.5. Equal texts get equal scores, and a score of just 0.5 counts as 1.
    Repeated rows each get a row; an empty table gives an empty result. Extra columns are ignored. Texts are
    read twice: for the features of labelled documents, and for scores; between texts and labels only features are shuffled.
    """
    shared = _fitted(docs, labels, doc_id, text, ~held_out(F.col("doc_id"), parts, part), group_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, 1, CHUNK_BYTES):
                s = shared.value.score(features(*text_buffers(piece.column(1))))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = own.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The documents that score 0.5 or more, whole rows and all columns; learnt from all labels.

    Null texts are scored as empty ones and, if kept, stay null; null ids, repeated rows and extra columns (whatever their
    names) are kept with their rows; an empty table gives an empty result.
    """
    shared = _fitted(docs, labels, doc_id, text, F.lit(True), group_rows)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, at, CHUNK_BYTES):
                yield piece.filter(pa.array(shared.value.score(features(*text_buffers(piece.column(at)))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_ranking(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
