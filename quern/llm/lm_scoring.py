"""Language-model scores of whole documents: a log-bilinear model learnt by noise-contrastive estimation.

The model predicts a token from the three before it: the sum of their vectors, each through a matrix of its place, is
compared with vectors of what may come.  Its outcomes are the 16,384 most frequent training tokens and 64 groups of all
others by their ending; ordered by frequency they make up classes of 128, and a token's probability is that of its
class times that within the class, both log-bilinear.  Within a group a token has its smoothed unigram probability, so
probabilities sum to 1 over all training tokens and one unknown one of each group.  The normalising constants, over all
classes and over all outcomes of the token's class, come from batched matrix products, so each token's score is exact.

1. Texts are cut into tokens once, and blocks keep them.  Blocks send their distinct tokens with training counts to buckets by hash; a bucket adds up the counts over
   the whole corpus and answers each block.  Totals and the most frequent tokens are merged from the buckets in a tree.
2. Training documents go, as outcomes, to groups by their content.  A start is learnt on one group; from it every
   group learns on its distinct (context, token) with their counts, in an order of their own, and the groups' parameters
   are averaged in a tree, each vector weighted by how often the group met it.  So neither the number of tasks nor the
   order of rows has a say in what is learnt.
3. Every document is scored, held out or not.

Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import BLOCK_BYTES, U64, Block, bucket_count, documents, durable, give_back, mix, pack, rows, slices, table, text_buffers, unpack
from quern.llm.exchange import ANSWER, FAN, SUMMARY, answers_at, bounds_of, bucket_of, exchanged, stretches
from quern.llm.quality_ranking import held_out
from quern.llm.words import word_hashes, word_spans

#: The model's size: frequent tokens, outcomes of a class, numbers of a vector, tokens of context.
VOCABULARY = 16_384
CLASS = 128
DIMENSIONS = 32
CONTEXT = 3
#: Noise classes of a step, noise tokens of each class in it, examples of a step.
NOISE, OWN_NOISE, STEP = 48, 16, 4096
#: Steps that a group takes at least (with fewer examples each).
STEPS = 128
#: Text that a group learns on, and rounds over the one that gives the start.
GROUP_BYTES = 8 << 20
START_ROUNDS = 1
TREE = 32
#: Groups of tokens by their last two bytes, kept in the low bits of a token's hash.
GROUPS = 64
_LOW = U64(GROUPS - 1)
_LOWER = np.arange(256, dtype=U64)
_LOWER[65:91] += U64(32)
END = mix(np.array([0x656E64], U64))[0]
_BITS = 15
TEXT = -1


class Tokens:
    """The token hashes of a block, an end after each document, and where each document's begin."""

    def __init__(self, block: Block, parts: int, part: int):
        starts, ends, woff = word_spans(block.offsets, block.data)
        n = len(block.ids)
        self.off = woff + np.arange(n + 1)
        self.hash = np.full(self.off[-1], END, U64)
        inner = np.ones(len(self.hash), bool)
        inner[self.off[1:] - 1] = False
        data = block.data
        tail = _LOWER[data[ends - 1]] * U64(256) + np.where(ends - starts > 1, _LOWER[data[ends - 2]], U64(0))
        self.hash[inner] = (word_hashes(data, starts, ends) & ~_LOW) | (mix(tail) & _LOW)
        self.learn = np.array([bool(has) and zlib.crc32(str(d).encode()) % parts != part for d, has in zip(block.ids.tolist(), block.has_id.tolist(), strict=True)], bool)


class TokenBlock:
    """A block's documents as places among its different tokens; texts are cut into tokens once and not needed again."""

    def __init__(self, ids: np.ndarray, has_id: np.ndarray, learn: np.ndarray, spread: np.ndarray, off: np.ndarray, u: np.ndarray, place: np.ndarray):
        self.ids, self.has_id, self.learn, self.spread, self.off, self.u, self.place = ids, has_id, learn, spread, off, u, place

    @classmethod
    def of(cls, block: Block, parts: int, part: int) -> TokenBlock:
        t = Tokens(block, parts, part)
        u, place = np.unique(t.hash, return_inverse=True)
        o = block.offsets.tolist()
        spread = [zlib.crc32(block.data[i:j], d & 0xFFFFFFFF) for i, j, d in zip(o[:-1], o[1:], block.ids.tolist(), strict=True)]  # the document's content in one number
        return cls(block.ids, block.has_id, t.learn, np.array(spread, np.uint32), t.off, u, place.reshape(-1).astype(np.uint32))

    def blob(self) -> bytes:
        return pack(self.ids, self.has_id, self.learn, self.spread, np.diff(self.off).astype(np.uint32), np.diff(self.u, prepend=U64(0)), self.place)

    @classmethod
    def from_blob(cls, blob: bytes) -> TokenBlock:
        ids, has_id, learn, spread, size, u, place = unpack(blob)
        return cls(ids, has_id, learn, spread, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), np.cumsum(u, dtype=U64), place)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The different tokens in order of bucket, and where they stand in ``u``."""
        order = np.argsort(bucket_of(self.u >> U64(6), buckets), kind="stable")
        return self.u[order], order


def _token_blocks(docs: DataFrame, doc_id: str, text: str, parts: int, part: int, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for piece in slices(b, 1, block_bytes):
                block = Block.of(piece.column(0), piece.column(1))
                blob = TokenBlock.of(block, parts, part).blob()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(block.data)], pa.int64()), pa.array([blob], pa.binary())], ["block", "n_bytes", "payload"])
                number += 1

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return durable(own.mapInArrow(run, "block long, n_bytes long, payload binary"))


def _count_keys(buckets: int):
    def keys(b: pa.RecordBatch):
        for row in rows(b):
            t = TokenBlock.from_blob(row["payload"])
            u, order = t.by_bucket(buckets)
            count = np.bincount(t.place[np.repeat(t.learn, np.diff(t.off))], minlength=len(u)).astype(np.uint32)
            yield row["block"], u >> U64(6), [(u & _LOW).astype(np.uint8), count[order]]

    return keys


def _add_up(vocabulary: int):
    """The counts over the whole corpus, and of the bucket its sums by group and its most frequent tokens."""

    def answer(h: np.ndarray, values: list[np.ndarray]):
        low, count = values
        key = h << U64(6) | low
        u, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, count, len(u)).astype(np.int64)
        group = (u & _LOW).astype(np.int64)
        summary = _top(u[total > 0], total[total > 0], vocabulary)
        return np.ones(len(h), bool), [total[at]], pack(_by_group(group, total), _by_group(group, total > 0), *summary)

    return answer


def _top(u: np.ndarray, total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((u, -total))[:n]
    return u[order], total[order]


def _merged(vocabulary: int):
    """Summaries of several buckets as one; no token is in two buckets."""

    def merge(parts: Iterator[list[np.ndarray]]) -> list[np.ndarray]:
        sums, kinds, u, total = zip(*parts, strict=True)
        return [np.sum(sums, axis=0), np.sum(kinds, axis=0), *_top(np.concatenate(u), np.concatenate(total), vocabulary)]

    return merge


TREE_SQL = "slot long, payload binary"
_TREE = pa.schema([("slot", pa.int64()), ("payload", pa.binary())])


def tree(parts: DataFrame, n: int, merge: Callable[[Iterator[list[np.ndarray]]], list[np.ndarray]], fan: int = TREE) -> list[np.ndarray] | None:
    """Payloads of the slots 0 to n - 1 merged ``fan`` at a time, in their order; only the last one comes to the driver."""

    def level(key: tuple, got: pa.Table) -> pa.Table:
        own = got.take(pc.sort_indices(got, [("slot", "ascending")]))
        return table(_TREE, [(key[0].as_py(), pack(*merge(unpack(row["payload"]) for row in rows(own))))])

    while True:
        parts = parts.groupBy(F.floor(F.col("slot") / fan).cast("long").alias("up")).applyInArrow(level, TREE_SQL)
        n = -(-n // fan)
        if n <= 1:
            got = parts.collect()
            return unpack(got[0]["payload"]) if got else None


def _by_group(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bincount(group, x, minlength=GROUPS).astype(np.int64)


# ---------------------------------------------------------------- the model


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of the frequent tokens, sorted
    rank: np.ndarray  # their outcomes: places in order of frequency
    p: np.ndarray  # of each outcome; after the frequent tokens come the groups
    n: int
    v: int
    other: np.ndarray  # for each group: the sum over its tokens of count + 1, and 1

    @classmethod
    def of(cls, u: np.ndarray, total: np.ndarray, sums: np.ndarray, kinds: np.ndarray) -> Vocabulary:
        """``u, total``: the frequent tokens, most frequent first; sums and different tokens by group, the frequent ones included."""
        n, v = int(sums.sum()), int(kinds.sum())
        group = (u & _LOW).astype(np.int64)
        sums, kinds = sums - _by_group(group, total), kinds - np.bincount(group, minlength=GROUPS)
        order = np.argsort(u)
        p = np.concatenate([total, sums]) + 0.5
        return cls(u[order], order, p / p.sum(), n, v, sums + kinds + 1.0)

    def outcomes(self, hashes: np.ndarray) -> np.ndarray:
        k = len(self.hashes)
        group = (hashes & _LOW).astype(np.int64) + k
        if not k:
            return group
        at = np.minimum(np.searchsorted(self.hashes, hashes), k - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], group)

    def examples(self, off: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Each token and those before it in its document (the nearest first, "start" where there is none) in one number."""
        start, key = len(self.p), w.astype(np.int64)
        place = np.arange(len(w)) - np.repeat(off[:-1], np.diff(off))
        for j in range(1, CONTEXT + 1):
            before = np.full(len(w), start, np.int64)
            before[j:] = w[: len(w) - j]
            before[place < j] = start
            key = key << _BITS | before
        return key


def _unpacked(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Outcomes and contexts, the nearest first."""
    mask = (1 << _BITS) - 1
    return key >> (_BITS * CONTEXT), [key >> (_BITS * (CONTEXT - j)) & mask for j in range(1, CONTEXT + 1)]


@dataclass
class LogBilinear:
    """Vectors ``r`` of contexts, ``q`` of outcomes and ``a`` of classes with biases ``b`` and ``d``, and place matrices ``c``."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    a: np.ndarray
    d: np.ndarray
    c: np.ndarray

    @classmethod
    def new(cls, p: np.ndarray, size: int, each: int = CLASS, seed: int = 5) -> LogBilinear:
        rng = np.random.default_rng(seed)
        n = len(p)
        of = np.bincount(np.arange(n) // each, p)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        place = np.stack([np.eye(size) * w for w in (1.0, 0.6, 0.4, *[0.3] * CONTEXT)[:CONTEXT]]).astype(np.float32)
        return cls(normal(0.3, n + 1, size), normal(0.1, n, size), np.log(p).astype(np.float32), normal(0.1, len(of), size), np.log(of).astype(np.float32), place)

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b, self.a, self.d, self.c]

    def tables(self) -> np.ndarray:
        return np.stack([self.r @ c for c in self.c])

    def log_probabilities(self, w: np.ndarray, contexts: list[np.ndarray], each: int = CLASS) -> np.ndarray:
        """Normalised natural logs of the outcomes' probabilities: of the class, and within it."""
        tables, out = self.tables(), np.empty(len(w), np.float64)
        norm = lambda x: float(np.sqrt((x * x).sum(axis=-1).max()))
        reach = sum(norm(t) for t in tables)
        # products that can't overflow need no greatest one taken off
        safe = reach * max(norm(self.a), norm(self.q)) + max(np.abs(self.b).max(), np.abs(self.d).max()) < 80
        picked = _picked if safe else _picked_safely
        one = lambda x, y: np.column_stack([x, y]).astype(np.float32)  # noqa: E731  biases as a last component
        classes, outcomes = one(self.a, self.d), one(self.q, self.b)
        order = np.argsort(w, kind="stable")
        for i in range(0, len(w), 1 << 14):
            at = order[i : i + (1 << 14)]
            own = w[at]
            h = np.ones((len(at), self.a.shape[1] + 1), np.float32)
            h[:, :-1] = sum(t[c[at]] for t, c in zip(tables, contexts, strict=True))
            cls = own // each
            s = picked(h, classes, cls)
            for x, y in stretches(cls):
                first = int(cls[x]) * each
                s[x:y] += picked(h[x:y], outcomes[first : first + each], own[x:y] - first)
            out[at] = s
        return out


def _picked(h: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row's products at one place."""
    s = h @ vectors.T
    own = s[np.arange(len(s)), at]
    return own - np.log(np.exp(s, out=s).sum(axis=1))


def _picked_safely(h: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    s = h @ vectors.T
    s -= s.max(axis=1, keepdims=True)
    return s[np.arange(len(s)), at] - np.log(np.exp(s).sum(axis=1))


def _summed(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different places, and the sum of what belongs to each."""
    order = np.argsort(at, kind="stable")
    s = at[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    return s[first], np.add.reduceat(x[order], first)


class Learner:
    """Noise-contrastive estimation with adaptive steps, of classes against noise classes and of tokens against others of their class."""

    def __init__(self, model: LogBilinear, p: np.ndarray, each: int = CLASS, rate: float = 0.2, seed: int = 11, steps: list[np.ndarray] | None = None):
        """``steps``: the squares that an earlier learner summed up, which its step sizes go on from."""
        self.m, self.each, self.rate = model, each, rate
        self.sum = [np.full(len(x), 1e-6, np.float32) for x in model.parameters()] if steps is None else [x.copy() for x in steps]
        self.rng = np.random.default_rng(seed)
        of = np.bincount(np.arange(len(p)) // each, p)
        self.p, self.of = p, of
        self.cdf, self.class_cdf = np.append(0, np.cumsum(p)), np.cumsum(of)
        self.log_of = np.log(NOISE * of).astype(np.float32)
        self.log_own = np.log(OWN_NOISE * p / of[np.arange(len(p)) // each]).astype(np.float32)
        self.met = [np.zeros(len(x), np.float64) for x in model.parameters()]

    def learn(self, key: np.ndarray, weight: np.ndarray) -> None:
        order = self.rng.permutation(len(key))
        size = max(512, min(STEP, len(key) // STEPS))
        for i in range(0, len(order), size):
            at = order[i : i + size]
            w, contexts = _unpacked(key[at])
            self._step(w, contexts, weight[at].astype(np.float32))
        w, contexts = _unpacked(key)
        for k, places in [*((0, c) for c in contexts), (1, w), (3, w // self.each)]:
            self.met[k] += np.bincount(places, weight, len(self.met[k]))
        self.met[2], self.met[4] = self.met[1], self.met[3]
        self.met[5] += float(weight.sum())

    def _move(self, k: int, at: np.ndarray | None, g: np.ndarray) -> None:
        """A step of parameter ``k`` at some rows; a vector has one step size."""
        x, s = self.m.parameters()[k], self.sum[k]
        square = g * g if g.ndim == 1 else (g * g).reshape(len(g), -1).mean(axis=1)
        if at is None:
            s += square
            x -= self.rate * (g / np.sqrt(s).reshape(-1, *[1] * (g.ndim - 1)))
        else:
            s[at] += square
            x[at] -= self.rate * (g / np.sqrt(s[at]).reshape(-1, *[1] * (g.ndim - 1)))

    def _step(self, w: np.ndarray, contexts: list[np.ndarray], n: np.ndarray) -> None:
        order = np.argsort(w, kind="stable")
        w, contexts, n = w[order], [c[order] for c in contexts], n[order]
        m, cls, weight = self.m, w // self.each, n / n.mean()
        r = [m.r[c] for c in contexts]
        h = sum(x @ c for x, c in zip(r, m.c, strict=True))
        sigmoid = lambda x: 1 / (1 + np.exp(-x))  # noqa: E731  in single precision far values give 0 or 1
        # classes: the same noise for all examples of a step
        noise = np.minimum(np.searchsorted(self.class_cdf, self.rng.random(NOISE)), len(self.of) - 1)
        own = m.a[cls]
        gt = -weight * sigmoid(-(np.einsum("nd,nd->n", h, own) + (m.d - self.log_of)[cls]))
        an = m.a[noise]
        gn = sigmoid(h @ an.T + (m.d[noise] - self.log_of[noise]))
        gn *= weight[:, None]
        own *= gt[:, None]
        dh = gn @ an
        dh += own
        ga, gd = np.zeros_like(m.a), np.zeros_like(m.d)
        parts = stretches(cls)  # the examples are in order of class
        some = cls[[x for x, _ in parts]]
        ga[some], gd[some] = np.add.reduceat(gt[:, None] * h, [x for x, _ in parts]), np.add.reduceat(gt, [x for x, _ in parts])
        np.add.at(ga, noise, gn.T @ h)
        np.add.at(gd, noise, gn.sum(axis=0))
        # outcomes: the same noise for all examples of a class
        u = self.cdf[some * self.each][:, None] + self.rng.random((len(some), OWN_NOISE)) * self.of[some][:, None]
        last = np.minimum((some + 1) * self.each, len(self.p)) - 1
        other = np.clip(np.searchsorted(self.cdf, u, "right") - 1, (some * self.each)[:, None], last[:, None])
        own = m.q[w]
        xt = -weight * sigmoid(-(np.einsum("nd,nd->n", h, own) + (m.b - self.log_own)[w]))
        own *= xt[:, None]
        dh += own
        qn, bn = m.q[other], m.b[other] - self.log_own[other]
        e = np.empty((len(w), OWN_NOISE), np.float32)
        for i, (x, y) in enumerate(parts):
            np.matmul(h[x:y], qn[i].T, out=e[x:y])
        e += np.repeat(bn, [y - x for x, y in parts], axis=0)
        e = sigmoid(e)
        e *= weight[:, None]
        back = np.empty((len(parts), OWN_NOISE, h.shape[1] + 1), np.float32)
        back[:, :, -1] = np.add.reduceat(e, [x for x, _ in parts])
        for i, (x, y) in enumerate(parts):
            dh[x:y] += e[x:y] @ qn[i]
            np.matmul(e[x:y].T, h[x:y], out=back[i, :, :-1])
        scale = np.float32(1 / len(w))
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))  # in order already
        own = np.add.reduceat(np.column_stack([xt[:, None] * h, xt]), first)
        at, g = _summed(np.append(w[first], other.ravel()), np.concatenate([own, back.reshape(-1, back.shape[2])]) * scale)
        self._move(1, at, g[:, :-1])
        self._move(2, at, g[:, -1])
        self._move(3, None, ga * scale)
        self._move(4, None, gd * scale)
        at, g = _summed(np.concatenate(contexts), np.concatenate([dh @ c.T for c in m.c]) * scale)
        gc = np.stack([x.T @ dh for x in r]) * scale
        self._move(0, at, g)
        self._move(5, None, gc)


def _weighted(learner: Learner) -> list[np.ndarray]:
    """Each parameter times how often it was met, and that; then the sums of squares."""
    return [y for x, n in zip(learner.m.parameters(), learner.met, strict=True) for y in ((x * n.reshape(-1, *[1] * (x.ndim - 1))).astype(np.float32).ravel(), n.astype(np.float32))] + learner.sum


def _added(parts: Iterator[list[np.ndarray]]) -> list[np.ndarray]:
    total = [x.astype(np.float64) for x in next(parts)]
    for p in parts:
        for t, x in zip(total, p, strict=True):
            t += x
    return [t.astype(np.float32) for t in total]


def _averaged(start: LogBilinear, sums: list[np.ndarray]) -> LogBilinear:
    """The mean of what was learnt; what no group met stays at the start."""
    out = []
    k = 2 * len(start.parameters())
    for x, s, n in zip(start.parameters(), sums[0:k:2], sums[1:k:2], strict=True):
        n = n.reshape(-1, *[1] * (x.ndim - 1))
        out.append(np.where(n > 0, s.reshape(x.shape) / np.where(n > 0, n, 1), x).astype(np.float32))
    return LogBilinear(*out)


LEARN = pa.schema([("grp", pa.int64()), ("payload", pa.binary())])


def _outcomes(shared, groups: int):
    """Each training document as outcomes, with its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for b in batches:
            for row in rows(b):
                t = TokenBlock.from_blob(row["payload"])
                w = vocab.outcomes(t.u).astype(np.uint16)[t.place]
                found = [(int(t.spread[d]) % groups, w[t.off[d] : t.off[d + 1]].tobytes()) for d in np.flatnonzero(t.learn).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else ([], []), LEARN, strict=True)], schema=LEARN)

    return run


def _learn_group(shared, rounds: int):
    def run(key: tuple, got: pa.Table) -> pa.Table:
        vocab, model, steps = shared.value
        offsets, data = text_buffers(got.column("payload"))
        each, n = np.unique(vocab.examples(offsets // 2, data.copy().view(np.uint16)), return_counts=True)
        give_back()
        learner = Learner(LogBilinear(*[x.copy() for x in model.parameters()]), vocab.p, seed=11 + key[0].as_py(), steps=steps)
        with np.errstate(over="ignore"):
            for _ in range(rounds):
                learner.learn(each, n)
        return table(_TREE, [(key[0].as_py(), pack(*_weighted(learner)))])

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
RESULT_SQL = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score_block(shared, buckets: int, fan: int):
    def score(key: tuple, got: pa.Table) -> pa.Table:
        vocab, model = shared.value
        t, answers = None, {}
        for row in rows(got):
            if row["kind"] == TEXT:
                t = TokenBlock.from_blob(row["payload"])
            else:
                answers[row["bucket"]] = row["payload"]
        if t is None:
            return table(RESULT, [])
        u, order = t.by_bucket(buckets)
        count = np.zeros(len(u), np.int64)
        at, told = answers_at(bounds_of(u >> U64(6), buckets, fan), answers)
        if len(at):
            count[order[at]] = told[0]
        w = vocab.outcomes(t.u)
        smooth = np.log10(count + 1.0)
        outside = w >= len(vocab.hashes)
        inside = np.where(outside, smooth - np.log10(vocab.other)[np.where(outside, w - len(vocab.hashes), 0)], 0.0)  # of each token within its outcome
        each, back = np.unique(vocab.examples(t.off, w[t.place]), return_inverse=True)
        s = (model.log_probabilities(*_unpacked(each)) / np.log(10))[back.reshape(-1)] + inside[t.place]
        first = t.off[:-1]
        add = lambda v: np.add.reduceat(v[t.place], first)  # noqa: E731  each document has its end, so none is empty
        columns = [np.diff(t.off), add((count > 0).astype(np.int64)), add(smooth - np.log10(vocab.n + vocab.v + 1.0)), np.add.reduceat(s, first)]
        return pa.Table.from_arrays([pa.array(t.ids, mask=~t.has_id), *map(pa.array, columns)], schema=RESULT)

    return score


def fitted(blocks: DataFrame, told: DataFrame, total: int, buckets: int, vocabulary: int = VOCABULARY, dimensions: int = DIMENSIONS, group_bytes: int = GROUP_BYTES) -> tuple[Vocabulary, LogBilinear]:
    """The vocabulary from the buckets' summaries, and the model learnt on all training documents."""
    none = [np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)]
    summaries = told.where(F.col("kind") == SUMMARY).select(F.col("bucket").alias("slot"), "payload")
    sums, kinds, u, count = tree(summaries, buckets, _merged(vocabulary)) or none
    vocab = Vocabulary.of(u, count, sums, kinds)
    model = LogBilinear.new(vocab.p, dimensions)
    sc = blocks.sparkSession.sparkContext
    groups = max(1, -(-total // group_bytes))
    learn = durable(blocks.mapInArrow(_outcomes(sc.broadcast(vocab), groups), "grp long, payload binary"))
    steps = None
    for some, n, rounds in ((learn.where("grp = 0"), 1, START_ROUNDS), (learn, groups, 1)):
        got = tree(some.groupBy("grp").applyInArrow(_learn_group(sc.broadcast((vocab, model, steps)), rounds), TREE_SQL), n, _added)
        if got:
            model, steps = _averaged(model, got), got[2 * len(model.parameters()) :]
    return vocab, model


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, parts: int = 7, part: int = 2, vocabulary: int = VOCABULARY, dimensions: int = DIMENSIONS, group_bytes: int = GROUP_BYTES, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from all documents whose ``crc32(doc_id) % parts`` isn't ``part``. A null text is the empty text, which is
    its end alone; a document with a null id is scored, never learnt from and not counted as held out; equal texts
    get equal scores; an empty table gives an empty result; without training documents all tokens are unknown.
    Extra columns are ignored; texts are learnt and scored whole, however long. ``vocabulary`` is 32,000 at most.
    """
    if vocabulary + GROUPS + 1 > 1 << _BITS:
        raise ValueError("the vocabulary is too large")
    blocks = _token_blocks(docs, doc_id, text, parts, part, block_bytes)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = bucket_count(total)
    told = exchanged(blocks, _count_keys(buckets), _add_up(vocabulary), buckets, fan, summaries=True)
    vocab, model = fitted(blocks, told, total, buckets, vocabulary, dimensions, group_bytes)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))
    texts = blocks.select(F.lit(-1).cast("long").alias("bucket"), "block", F.lit(TEXT).alias("kind"), "payload")
    scored = texts.unionByName(told.where(F.col("kind") == ANSWER)).groupBy("block").applyInArrow(_score_block(shared, buckets, fan), RESULT_SQL)
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
