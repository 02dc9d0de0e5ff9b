"""Removal of repeated byte passages by a hash-compared suffix sort.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id.

1. Every ``length``-byte window chooses its *anchor*, the least of its ``k``-gram hashes (leftmost on
   ties), so equal windows choose equal anchors at equal places.  Neighbouring windows with one
   anchor form a run, whose text is a *fragment*.  Blocks send (anchor, fragment hash, least
   document) to buckets by anchor.
2. A bucket finds the least document of each fragment: equal fragments in a larger document go
   whole.  Where one anchor has several fragments, the text of each different one is asked for, once, and
   with it all its places in that document.
3. Those fragments are sorted by what follows the anchor: a mergesort whose comparisons find the
   common extension by binary search over prefix polynomial hashes (logarithmic, not linear in the
   length).  Neighbours' common extensions to the right, and prefix hashes to the left, give the
   windows that agree; the bytes of each pair are then compared, so a collision in the sort removes nothing.
4. Each block unites its spans and cuts them out.

*Hot grams.*  A string that stands in very many documents, each time among other words, would be the anchor of as many
different fragments, all in one bucket.  Such grams are found beforehand on a sample of whole documents (of equal
texts all or none) and rank after all others, so they are anchors only of windows that have nothing else: those lie
within a common passage, and their fragments are the same everywhere.  Which grams count as hot changes no result.

*What hashes decide.*  Whole equal fragments are taken as equal by 104 bits of hash (48 of the anchor, 56 of the
fragment) without comparing their bytes; at 100 TB, with some 6e12 fragments, two different ones agree with a chance
of about one in a million.  Data moved: about 13 bytes for each 16 bytes of text in (1), compressed text twice, and the
fragments at the edges of copies.  No step holds more than a block or a bucket.

Nulls: a null text is the empty text; a document with a null id counts as later than all others and
loses what any document with an id holds.  Documents with equal ids don't remove from each other.
An empty table gives an empty result; texts under ``length`` bytes are kept whole, very long ones are worked on in
overlapping stretches; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import BLOCK_BYTES, U64, Block, PrefixHash, bucket_count, carried_schema, documents, durable, mix, pack, read_others, restored, rows, table, to_blocks, unpack
from quern.llm.exchange import ANSWER, FAN, MESSAGES, MESSAGES_SQL, answers_at, bounds_of, bucket_of, exchanged, stretches

LENGTH = 50
GRAM = 20
_PIECE = 1 << 19
_POS_BITS = U64(24)
_POS_MASK = U64((1 << 24) - 1)
_F_MASK = U64((1 << 56) - 1)
_A_CUT = U64(16)
_HOT = U64(1 << 63)
#: A gram is hot if its different fragments would fill this share of a bucket; of them the sample should hold so many.
HOT_SHARE, HOT_HITS = 1 / 8, 64
#: Most hot grams (they are broadcast), and rounds in which more are looked for once those found give way to others.
MOST_HOT, HOT_ROUNDS = 1 << 16, 8
#: Kinds of messages beside those of the exchange: the block itself, fragments' texts, spans.
TEXT, FRAGMENTS, SPANS = -1, 3, 4


# ---------------------------------------------------------------- runs


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, document bounds within) of stretches of about half a MB; a longer document comes in overlapping stretches."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 8 * _PIECE:
            yield a, b, offsets[i : j + 1] - a
        else:
            for s in range(a, b, 4 * _PIECE):
                e = min(b, s + 4 * _PIECE + length - 1)
                yield s, e, np.array([0, e - s])
        i = j


class Hot:
    """A set of gram hashes, tested by a table of their first bits before the set itself."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams)
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.grams >> U64(44)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.some[(h >> U64(44)).astype(np.int64)])
        found = self.grams[np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)] == h[at]
        return at[found]


NONE_HOT = Hot(np.zeros(0, U64))


class Runs:
    """Runs of a block: anchor hash, fragment hash, document, first and last window start, anchor place."""

    def __init__(self, block: Block, length: int, gram: int, hot: Hot = NONE_HOT):
        w = length - gram + 1
        found = []
        for lo, hi, bounds in _pieces(block.offsets, length):
            n = hi - lo
            if n < length:
                continue
            ph = PrefixHash(block.data[lo:hi])
            hk = mix((ph.pre[gram:] - ph.pre[:-gram]) * ph.inv[: n - gram + 1])
            v = ((hk >> U64(1)) & ~_POS_MASK) | np.arange(len(hk), dtype=U64)
            v[hot.places(hk)] |= _HOT
            width = 1
            while 2 * width <= w:
                v = np.minimum(v[:-width], v[width:])
                width *= 2
            if width < w:
                v = np.minimum(v[: len(v) - (w - width)], v[w - width :])
            m = (v & _POS_MASK).astype(np.int32)
            lens = np.diff(bounds)
            ok = np.arange(length, n + 1) <= np.repeat(bounds[1:], lens)[: n - length + 1]
            change = np.ones(len(m) + 1, bool)
            np.not_equal(m[1:], m[:-1], out=change[1:-1])
            change[1:-1] |= ok[1:] != ok[:-1]
            s0 = np.flatnonzero(change[:-1] & ok)
            s1 = np.flatnonzero(change[1:] & ok)
            anchor = m[s0].astype(np.int64)
            size = s1 + length - s0
            f = mix(ph.of(s0, size) + U64(0x632BE59BD9B4E019) * (size * 4096 + anchor - s0).astype(U64)) & _F_MASK
            found.append((hk[anchor], f, s0 + lo, s1 + lo, anchor + lo))
        if found:
            self.gram, self.f, self.s0, self.s1, self.at = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            self.gram = self.f = np.zeros(0, U64)
            self.s0 = self.s1 = self.at = np.zeros(0, np.int64)
        self.a = mix(self.gram) >> _A_CUT
        self.doc = np.searchsorted(block.offsets, self.s0, "right") - 1
        self.ids = block.ids[self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def distinct(self, buckets: int, fan: int = FAN) -> None:
        """Orders by (bucket, anchor, fragment, document); ``first`` are the places where a new (anchor, fragment) begins."""
        bucket = bucket_of(self.a, buckets)
        self.order = np.lexsort((self.f, self.a, bucket))
        a, f = self.a[self.order], self.f[self.order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (f[1:] != f[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        ids = self.ids[self.order]
        last = np.append(self.first[1:], len(a)) - 1
        self.ua, self.uf, self.least = a[self.first], f[self.first], ids[self.first]
        self.several = ids[last] != self.least if len(ids) else np.zeros(0, bool)
        self.bounds = bounds_of(self.ua, buckets, fan)


def _sampled(modulo: int):
    """Blocks of the whole documents whose text falls into the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows(b):
                block = Block.from_blob(row["payload"])
                o, data = block.offsets.tolist(), block.data
                take = np.array([zlib.crc32(data[i:j]) % modulo == 0 for i, j in zip(o[:-1], o[1:], strict=True)], bool)
                size = np.diff(block.offsets)[take]
                own = Block(block.ids[take], block.has_id[take], block.has_text[take], np.concatenate([[0], np.cumsum(size)]), data[np.repeat(take, np.diff(block.offsets))])
                yield pa.RecordBatch.from_arrays([pa.array([own.blob()], pa.binary())], ["payload"])

    return run


def _grams(length: int, gram: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows(b):
                r = Runs(Block.from_blob(row["payload"]), length, gram, hot.value)
                each = np.unique(np.stack([r.gram, r.f], axis=1), axis=0) if len(r.f) else np.zeros((0, 2), U64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(each[:, i]).view(np.int64)) for i in (0, 1)], ["gram", "f"])

    return run


def hot_grams(blocks: DataFrame, length: int, gram: int, n_bytes: int, buckets: int) -> Hot:
    """Grams that would be the anchors of so many different fragments that they weigh on a bucket, as a sample tells.

    The rarer the sample, the larger a bucket is, so that a hot gram has about ``HOT_HITS`` fragments in it. What
    comes back to the driver is bounded by ``MOST_HOT``.
    """
    most = max(HOT_HITS, int(HOT_SHARE * n_bytes / (length - gram + 2) * 2 / buckets))
    modulo = max(1, most // HOT_HITS)
    sample = blocks.select("payload") if modulo == 1 else durable(blocks.select("payload").mapInArrow(_sampled(modulo), "payload binary"))
    found = np.zeros(0, U64)
    sc = blocks.sparkSession.sparkContext
    for _ in range(HOT_ROUNDS):
        each = sample.mapInArrow(_grams(length, gram, sc.broadcast(Hot(found))), "gram long, f long").distinct()
        many = each.groupBy("gram").count().where(F.col("count") >= most // modulo).orderBy(F.desc("count"), "gram").limit(MOST_HOT).collect()
        new = np.setdiff1d(np.array([r["gram"] for r in many], np.int64).view(U64), found)[: MOST_HOT - len(found)]
        if not len(new):
            break
        found = np.concatenate([found, new])
    return Hot(found)


def _keys_of(length: int, gram: int, buckets: int, fan: int, hot):
    def keys(b: pa.RecordBatch):
        for row in rows(b):
            r = Runs(Block.from_blob(row["payload"]), length, gram, hot.value)
            r.distinct(buckets, fan)
            yield row["block"], r.ua, [r.uf, r.least, r.several]

    return keys


def _answer_runs(a: np.ndarray, values: list[np.ndarray]):
    """Which fragments have a least document to tell, that document, and which fragments' text is asked for."""
    f, least, several = values
    order = np.lexsort((f, a))
    a, f, l, s = a[order], f[order], least[order], several[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_f = new_a.copy()
    new_f[1:] |= f[1:] != f[:-1]
    fa, ff = np.flatnonzero(new_a), np.flatnonzero(new_f)
    ga, gf = np.cumsum(new_a) - 1, np.cumsum(new_f) - 1
    of_f = np.minimum.reduceat(l, ff)[gf]
    shared = (np.minimum.reduceat(l, fa) != np.maximum.reduceat(l, fa)) | np.logical_or.reduceat(s, fa)
    mixed = (shared & (np.add.reduceat(new_f.astype(np.int64), fa) > 1))[ga]
    flags, g = np.empty(len(a), np.uint8), np.empty(len(a), np.int64)
    told = (of_f < l) | s
    flags[order] = told + 2 * (mixed & (l == of_f))
    g[order] = np.where(told, of_f, 0)
    return flags > 0, [flags, g], None


# ---------------------------------------------------------------- spans and fragments


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(covered.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.subtract.at(d, end, 1)
    return np.cumsum(d[:-1]) > 0


def _mark_block(length: int, gram: int, buckets: int, fan: int, hot):
    def mark(key: tuple, got: pa.Table) -> pa.Table:
        block, answers = None, {}
        for row in rows(got):
            if row["kind"] == TEXT:
                block = Block.from_blob(row["payload"])
            else:
                answers[row["bucket"]] = row["payload"]
        if block is None or not answers:
            return table(MESSAGES, [])
        r = Runs(block, length, gram, hot.value)
        r.distinct(buckets, fan)
        at, (flags, of) = answers_at(r.bounds, answers)
        told, g, found = np.zeros(len(r.first), bool), np.full(len(r.first), Block.NO_ID), []
        own = (flags & 1) > 0
        told[at[own]] = True
        g[at[own]] = of[own]
        asked = np.sort(at[(flags & 2) > 0])
        often = np.add.reduceat((r.ids[r.order] == r.least[r.group]).astype(np.int64), r.first)  # places in the least document, which stand first
        bucket = bucket_of(r.ua[asked], buckets)
        for i, j in stretches(bucket):
            u = asked[i:j]
            run = r.order[r.first[u]]
            s0, size = r.s0[run], r.s1[run] + length - r.s0[run]
            start = np.cumsum(size) - size
            text = block.data[np.repeat(s0 - start, size) + np.arange(size.sum())]
            n = often[u]
            places = r.s0[r.order[np.repeat(r.first[u] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
            found.append((int(bucket[i]), key[0].as_py(), FRAGMENTS, pack(r.ua[u], n.astype(np.int32), places, size.astype(np.int32), (r.at[run] - s0).astype(np.int32), r.ids[run], text)))
        u = r.group
        dup = told[u] & (g[u] < r.ids[r.order])
        run = r.order[dup]
        if len(run):
            covered = _cover(len(block.data), r.s0[run], r.s1[run] + length)
            found.append((-1, key[0].as_py(), SPANS, pack(*_spans(covered))))
        return table(MESSAGES, found)

    return mark


class SuffixOrder:
    """Suffixes of a byte string in order, each up to its own end, by mergesort with hashed common extensions."""

    def __init__(self, data: np.ndarray, group: np.ndarray, start: np.ndarray, room: np.ndarray, most: int, phase: np.ndarray | None = None):
        """``group`` is ascending; suffixes are sorted within a group. ``room``: bytes of each suffix, of which ``most`` count."""
        self.data, self.ph = data, PrefixHash(data, phase=phase)
        self.start, self.room, self.most = start, np.minimum(room, most), most
        n = len(start)
        self.order = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        self.new = new
        first = np.flatnonzero(new)
        base = first[np.cumsum(new) - 1] if n else first
        size = np.diff(np.append(first, n))
        end = base + size[np.cumsum(new) - 1] if n else base
        width, largest = 1, int(size.max(initial=0))
        while width < largest:
            self._merge(width, base, end)
            width *= 2

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y: binary search over equal prefix hashes."""
        px, py = self.start[x], self.start[y]
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.room[x], self.room[y])
        for _ in range(int(self.most).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.ph.of(px, mid) == self.ph.of(py, mid)
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        c = self.common(x, y)
        ex, ey = c >= self.room[x], c >= self.room[y]
        bx = self.data[np.minimum(self.start[x] + c, len(self.data) - 1)]
        by = self.data[np.minimum(self.start[y] + c, len(self.data) - 1)]
        return np.where(ex & ey, or_equal, np.where(ex, True, np.where(ey, False, bx < by)))

    def _merge(self, width: int, base: np.ndarray, end: np.ndarray) -> None:
        i = np.arange(len(self.order))
        run = (i - base) // width
        other = base + (run ^ 1) * width
        i = np.flatnonzero(other < end)
        i = i[np.minimum(end[i], base[i] + (run[i] | 1) * width + width) > base[i] + (run[i] | 1) * width]
        if not len(i):
            return
        own, lo = base[i] + run[i] * width, other[i]
        hi = np.minimum(end[i], lo + width)
        low, later = lo.copy(), (run[i] & 1) == 1
        x = self.order[i]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            before = self.less(self.order[mid], x[open_], later[open_])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        pair = base[i] + (run[i] & ~1) * width
        self.order[pair + (i - own) + (lo - low)] = x


def _answer_fragments(length: int, gram: int):
    def answer(key: tuple, got: pa.Table) -> pa.Table:
        parts, blocks = [], []
        for row in rows(got):
            p = unpack(row["payload"])
            parts.append(p)
            blocks.append(np.full(len(p[0]), row["block"]))
        a, n, places, size, off, ids, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        block = np.concatenate(blocks)
        n = n.astype(np.int64)
        place = np.cumsum(n) - n
        start = np.cumsum(size.astype(np.int64)) - size
        phase = np.ones(len(text), np.int32)  # each byte's place in its fragment
        phase[start] = 1 - np.append(1, size[:-1])
        phase = np.cumsum(phase, dtype=np.int32, out=phase)
        by = np.argsort(a, kind="stable")
        a, n, place, size, off, ids, block, start = (x[by] for x in (a, n, place, size, off, ids, block, start))
        so = SuffixOrder(text, a, start + off, size - off, length, phase)
        o = so.order
        lcp = np.zeros(len(o), np.int64)
        inner = np.flatnonzero(~so.new)
        lcp[inner] = so.common(o[inner - 1], o[inner])
        lcp[so.new] = -1
        at, room, left, doc = so.start[o], (size - off)[o], off[o], ids[o]
        # all windows of a fragment hold its anchor, so those that go make one span
        least, most = np.full(len(o), length), np.full(len(o), -1)
        for l in range(length - gram + 1):
            fit = np.flatnonzero((left >= l) & (room >= length - l))
            if len(fit) < 2:
                continue
            seg = np.cumsum(lcp < length - l)[fit]
            again = np.zeros(len(fit), bool)
            again[1:] = seg[1:] == seg[:-1]
            again[:-1] |= again[1:].copy()
            fit, seg = fit[again], seg[again]
            if not len(fit):
                continue
            h = so.ph.of(at[fit] - l, l)
            order = np.lexsort((doc[fit], h, seg))
            fit, seg, h = fit[order], seg[order], h[order]
            new = np.ones(len(fit), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (h[1:] != h[:-1])
            lead = fit[np.flatnonzero(new)][np.cumsum(new) - 1]
            dup = doc[lead] < doc[fit]
            fit, lead = fit[dup], lead[dup]
            for i in range(0, len(fit), 1 << 16):  # the bytes decide
                x, y = fit[i : i + (1 << 16)], lead[i : i + (1 << 16)]
                span = np.arange(length)
                same = (text[(at[x] - l)[:, None] + span] == text[(at[y] - l)[:, None] + span]).all(axis=1)
                x = o[x[same]]
                least[x], most[x] = np.minimum(least[x], l), l
        hit = np.flatnonzero(most >= 0)
        if not len(hit):
            return table(MESSAGES, [])
        n, first = n[hit], place[hit]
        s0 = places[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]  # every place of the fragment
        b, s, e = np.repeat(block[hit], n), s0 + np.repeat(off[hit] - most[hit], n), s0 + np.repeat(off[hit] - least[hit] + length, n)
        order = np.lexsort((s, b))
        b, s, e = b[order], s[order], e[order]
        found = []
        for i, j in stretches(b):
            x, y = s[i:j], np.maximum.accumulate(e[i:j])
            f = np.flatnonzero(np.append(True, x[1:] > y[:-1]))
            found.append((-1, int(b[i]), SPANS, pack(x[f], np.append(y[f[1:] - 1], y[-1]))))
        return table(MESSAGES, found)

    return answer


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64()))])
RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"


def _gathered(got: pa.Table) -> tuple[Block | None, np.ndarray, bytes | None]:
    """A block, which of its bytes go, and its other columns."""
    block, others, spans = None, None, []
    for row in rows(got):
        if row["kind"] == TEXT:
            block, others = Block.from_blob(row["payload"]), row["others"]
        else:
            spans.append(unpack(row["payload"]))
    start, end = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 2
    return block, _cover(len(block.data) if block else 0, start, end), others


def _describe_block(key: tuple, got: pa.Table) -> pa.Table:
    block, gone, _ = _gathered(got)
    found = []
    for i, d in enumerate(block.ids):
        lo, hi = int(block.offsets[i]), int(block.offsets[i + 1])
        cover, data = gone[lo:hi], block.data[lo:hi]
        s, e = _spans(cover)
        kept = (data[~cover] if len(s) else data).tobytes()
        found.append((int(d) if block.has_id[i] else None, hi - lo, int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), s.tolist(), e.tolist()))
    return table(RESULT, found)


def _cut_block(key: tuple, got: pa.Table) -> pa.Table:
    """The documents without what goes; a character goes if all its bytes do."""
    block, gone, raw = _gathered(got)
    others = read_others(raw)
    head = (block.data & 0xC0) != 0x80
    first = np.flatnonzero(head)
    if len(first):
        whole = np.minimum.reduceat(gone, first)
        gone = np.repeat(whole, np.diff(np.append(first, len(gone))))
    kept = np.concatenate([[0], np.cumsum(~gone)])[block.offsets]
    data = block.data[~gone]
    columns = [pa.array(block.ids, mask=~block.has_id), block.texts(kept, data), *(c.combine_chunks() for c in others.columns)]
    return pa.Table.from_arrays(columns, ["doc_id", "text", *others.schema.names])


def _resolved(blocks: DataFrame, length: int, gram: int, fan: int) -> DataFrame:
    """Rows (``block, kind, payload, others``) of each block and of the spans that go."""
    if not 0 < gram < length:
        raise ValueError("gram must lie between 0 and length")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = bucket_count(total)
    hot = blocks.sparkSession.sparkContext.broadcast(hot_grams(blocks, length, gram, total, buckets))
    told = exchanged(blocks, _keys_of(length, gram, buckets, fan, hot), _answer_runs, buckets, fan)
    texts = blocks.select(F.lit(-1).cast("long").alias("bucket"), "block", F.lit(TEXT).alias("kind"), "payload")
    marked = durable(texts.unionByName(told.where(F.col("kind") == ANSWER)).groupBy("block").applyInArrow(_mark_block(length, gram, buckets, fan, hot), MESSAGES_SQL))
    edges = marked.where(F.col("kind") == FRAGMENTS).groupBy("bucket").applyInArrow(_answer_fragments(length, gram), MESSAGES_SQL)
    spans = marked.where(F.col("kind") == SPANS).unionByName(edges).select("block", "kind", "payload", F.lit(None).cast("binary").alias("others"))
    return blocks.select("block", F.lit(TEXT).alias("kind"), "payload", "others").unionByName(spans)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """Per document: ``n_bytes, n_removed, n_spans, kept_sha256`` and the removed spans (byte offsets).

    ``gram`` (under ``length``) sets how dense anchors are: about one in ``(length - gram + 2) / 2`` bytes; ``fan``
    is the most messages a block sends (:mod:`quern.llm.exchange`).
    """
    return _resolved(to_blocks(docs, doc_id, text, block_bytes), length, gram, fan).groupBy("block").applyInArrow(_describe_block, RESULT_SQL)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """The documents with repeated passages cut out of their text; rows, null texts and all other columns stay.

    Characters go as a whole: one of which only some bytes are repeated stays.
    """
    out = _resolved(to_blocks(docs, doc_id, text, block_bytes, carry=True), length, gram, fan).groupBy("block").applyInArrow(_cut_block, carried_schema(docs, doc_id, text))
    return restored(out, docs, doc_id, text)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
