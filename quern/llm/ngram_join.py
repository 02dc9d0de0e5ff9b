"""Exact Jaccard self-join of word-shingle sets and its connected components (adaptive multi-match prefixes).

1. Documents become blocks; each document's set of ``k``-word shingles gets a 128-bit fingerprint, and
   documents with equal sets form a class with one representative.  Only representatives are compared.
2. Blocks send their distinct shingles to buckets; a bucket adds up global frequencies and tells each block
   which of its shingles another document may share.  A set of n shingles needs t = ceil(0.75 n) in common
   with any partner, so a document with fewer shared shingles is out.
3. The rest order their shared shingles by (frequency, hash).  Partners must share one of the first n - t + 1, and
   at the first that they share their sizes and places must leave room for enough (length and positional filter).
   Documents at a prefix shingle stand in order of size and are chained, never paired; the chain is cut wherever
   no two documents on both sides pass the filters.  That gives coarse components.
4. Each coarse component is solved in memory with adaptive prefixes: a document lengthens its prefix to
   n - t + l as long as the estimated cost (postings read plus candidates to verify) falls, and then
   verifies only documents that share l prefix shingles with it.  Pairs that are already connected aren't
   verified, so a group of near copies costs about one verification a document, and loses no component.
5. A coarse component above ``big`` shingles is dealt out over chunks, each with the same few pivot
   documents, which connect its largest family.  The others are then compared by prefix shingle: a task has the
   documents that hold one of its shingles, so a document goes to as many tasks as its prefix has shingles at most, however
   large the component is.  Shingles that alone are too many for a task (those of a large family) are the exception:
   what remains apart and holds one is held against chunks of the documents that hold one, too.
6. Where links are to be counted, every pair that shares a prefix shingle is verified, connected or not, once: where its
   first common prefix shingle is.  That is within the task of its coarse component, for a large one in the task of the
   shingle, or for a shingle too common for a task in one for each pair of chunks.  Only sums leave a task.
   A family of f documents that all link takes f^2 / 2 verifications, each a look at one set's shared shingles.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import BLOCK_BYTES, U64, Block, bucket_count, carried_schema, documents, durable, mix, pack, read_others, restored, rows, table, to_blocks, unpack
from quern.llm.components import components
from quern.llm.exchange import ANSWER, FAN, answers_at, bounds_of, bucket_of, exchanged, joined, scattered, stride
from quern.llm.words import shingles

WORDS = 5
PERCENT = 75
MOST_MATCHES = 4
GROUP_TOKENS = 2_000_000
_CUT = U64(16)

MESSAGES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()), ("idx", pa.list_(pa.int32()))])
TEXT, CHOSEN = -1, 3
#: A document is known by its place: the block's number and its rank there.
_RANK = 20


def _place(block: int) -> int:
    return ((block >> 32) << 40) + ((block & 0xFFFFFFFF) << _RANK)


def _fingerprints(off: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(s)])
    other = np.concatenate([np.zeros(1, U64), np.cumsum(mix(s ^ U64(0x5851F42D4C957F2D)))])
    return total[off[1:]] - total[off[:-1]], other[off[1:]] - other[off[:-1]]


def _describe(k: int):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows(b):
                block = Block.from_blob(row["payload"])
                off, s = shingles(block.offsets, block.data, k)
                f1, f2 = _fingerprints(off, s)
                n = len(block.ids)
                uid = _place(row["block"]) + np.arange(n)
                ids = pa.array(block.ids, mask=~block.has_id)
                yield pa.RecordBatch.from_arrays([pa.array(uid), ids, pa.array(np.diff(off)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))], schema=schema)

    return describe, "uid long, doc_id long, n long, f1 long, f2 long"


def _distinct_in_block(block: Block, k: int, buckets: int):
    """Shingles by document, the distinct ones of the block cut to fewer bits and in order of bucket, and the document's places among them."""
    off, s = shingles(block.offsets, block.data, k)
    cut = s >> _CUT
    order = np.lexsort((cut, bucket_of(cut, buckets)))
    c = cut[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    place = np.empty(len(c), np.int64)
    place[order] = np.cumsum(new) - 1
    return off, s, place, c[new]


def _shingle_keys(k: int, buckets: int):
    def keys(b: pa.RecordBatch):
        for row in rows(b):
            off, s, place, u = _distinct_in_block(Block.from_blob(row["payload"]), k, buckets)
            f1, f2 = _fingerprints(off, s)
            _, first = np.unique(np.stack([f1, f2], axis=1), axis=0, return_index=True)  # equal sets count once
            once = np.zeros(len(f1), bool)
            once[first] = True
            yield row["block"], u, [np.bincount(place[np.repeat(once, np.diff(off))], minlength=len(u)).astype(np.uint32)]

    return keys


def _add_up(h: np.ndarray, values: list[np.ndarray]):
    """Global frequencies: which shingles occur elsewhere too, and how often."""
    order = np.argsort(h, kind="stable")
    g = h[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    df = np.empty(len(g), np.int64)
    df[order] = np.add.reduceat(values[0][order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    return df > 1, [np.minimum(df, 0xFFFFFFFF).astype(np.uint32)], None


ALIVE = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("copies", pa.int64()), ("payload", pa.binary())])
ALIVE_SQL = "uid long, n long, m long, copies long, payload binary"


def _required(n, percent: int):
    return (percent * n + 99) // 100


def _prefix(n: int, m: int, percent: int) -> int:
    """How many of its ``m`` shared shingles a set of ``n`` must look at to meet any partner."""
    return max(0, m - _required(n, percent) + 1)


def _alive(k: int, buckets: int, percent: int, fan: int):
    def alive(key: tuple, got: pa.Table) -> pa.Table:
        block, answers, chosen, copies = None, {}, [], []
        for row in rows(got):
            if row["kind"] == TEXT:
                block = Block.from_blob(row["payload"])
            elif row["kind"] == ANSWER:
                answers[row["bucket"]] = row["payload"]
            else:
                chosen += row["idx"][0::2]
                copies += row["idx"][1::2]
        if block is None or not chosen:
            return table(ALIVE, [])
        off, s, place, u = _distinct_in_block(block, k, buckets)
        df = np.ones(len(u), np.int64)
        at, told = answers_at(bounds_of(u, buckets, fan), answers)
        if len(at):
            df[at] = told[0]
        found = []
        for d, c in zip(chosen, copies, strict=True):
            lo, hi = int(off[d]), int(off[d + 1])
            f = df[place[lo:hi]]
            keep = f > 1
            n, m = hi - lo, int(keep.sum())
            if m and m >= _required(n, percent):
                h, f = s[lo:hi][keep], f[keep]
                order = np.lexsort((h, h >> _CUT, f))
                found.append((_place(key[0].as_py()) + d, n, m, c, pack(h[order], f[order].astype(np.uint32))))
        return table(ALIVE, found)

    return alive


def _prefix_keys(percent: int, buckets: int):
    """Prefix shingles of a batch of documents, with the document, its size, and how many shared shingles it has from there on."""

    def keys(b: pa.RecordBatch):
        hs, us, ns, left = [], [], [], []
        for row in rows(b):
            h, _ = unpack(row["payload"])
            p = _prefix(row["n"], row["m"], percent)
            hs.append(h[:p])
            us.append(np.full(p, row["uid"]))
            ns.append(np.full(p, row["n"], np.uint32))
            left.append(np.arange(row["m"], row["m"] - p, -1).astype(np.uint32))
        if hs:
            h, u, n, l = (np.concatenate(x) for x in (hs, us, ns, left))
            order = np.lexsort((u, h, bucket_of(h, buckets)))
            yield 0, h[order], [u[order], n[order], l[order]]

    return keys


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Links that connect, and rows (uid, uid, number of links with other sets, each as often as it has copies).
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
LINKS_SQL = "a long, b long, links long"


def chained(h: np.ndarray, u: np.ndarray, n: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all documents that may link at a shingle: each with the least of its stretch of the chain.

    Two sets link with at least ``percent / (100 + percent)`` of the sum of their sizes in common. At their first common
    prefix shingle neither has more than ``left`` to share.
    """
    n, left = n.astype(np.int64), left.astype(np.int64)
    top = np.minimum(100 * n // percent, (100 + percent) * left // percent - n)  # the largest partner
    low = _required(n, percent)  # the smallest
    some = top >= low
    h, u, n, top, low = (x[some] for x in (h, u, n, top, low))
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((u, n, h))
    h, u, n, top, low = (x[order] for x in (h, u, n, top, low))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new)
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(top + group * far) - group * far  # the largest partner of any so far
    down = -np.maximum.accumulate((-low - group * far)[::-1])[::-1] - group * far  # the smallest partner of any from here on
    cut = new.copy()
    cut[1:] |= (reach[:-1] < n[1:]) | (down[1:] > n[:-1])
    run = np.cumsum(cut) - 1
    least = np.minimum.reduceat(u, np.flatnonzero(cut))[run]
    e = np.unique(np.stack([u[u != least], least[u != least]], axis=1), axis=0)
    return e[:, 0], e[:, 1]


def _chains(percent: int, relayed: bool):
    def chains(key: tuple, got: pa.Table) -> pa.Table:
        _, _, (h, *values) = joined(got)
        a, b = chained(h, *(values[2:] if relayed else values), percent)
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=EDGES)

    return chains


# ---------------------------------------------------------------- in memory


class _Doc:
    __slots__ = ("uid", "n", "m", "t", "tokens", "df", "ordered", "copies")

    def __init__(self, uid: int, n: int, blob: bytes, percent: int, copies: int = 1):
        self.tokens, self.df = unpack(blob)
        self.uid, self.n, self.m, self.t, self.copies = uid, n, len(self.tokens), _required(n, percent), copies
        self.ordered = np.sort(self.tokens)


def _linked(x: _Doc, y: _Doc, percent: int) -> bool:
    if 100 * min(x.n, y.n) < percent * max(x.n, y.n):
        return False
    at = np.searchsorted(y.ordered, x.ordered)
    at[at == len(y.ordered)] = 0
    common = int((y.ordered[at] == x.ordered).sum())
    return 100 * common >= percent * (x.n + y.n - common)


def _matches_wanted(x: _Doc) -> int:
    """How many prefix shingles a candidate must share with ``x``: as many as make the estimated cost least."""
    best, least = 1, None
    reach = np.cumsum(x.df.astype(np.int64) - 1)
    for l in range(1, min(MOST_MATCHES, x.t) + 1):
        p = min(x.m, x.m - x.t + l)
        if p <= 0:
            continue
        postings = int(reach[p - 1])
        cost = postings + postings / l**2 * (8 + x.m / 16)
        if least is None or cost < least:
            best, least = l, cost
    return best


def solve(docs: list[_Doc], percent: int, labels: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the join connects among ``docs``; ``labels``: of documents that are connected already."""
    docs = sorted(docs, key=lambda d: (d.n, d.uid))
    parent = list(range(len(docs)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = [1] * len(docs)
    links: list[tuple[int, int]] = []

    def union(i: int, j: int) -> int:
        i, j = find(i), find(j)
        if size[i] < size[j]:
            i, j = j, i
        parent[j] = i
        size[i] += size[j]
        return i

    if labels:
        seen: dict[int, int] = {}
        for i, d in enumerate(docs):
            label = labels.get(d.uid)
            if label is not None:
                union(seen.setdefault(label, i), i)
    index: list[dict] = [defaultdict(dict) for _ in range(MOST_MATCHES)]
    hubs: list[int] = []
    for i, x in enumerate(docs):
        for hub in hubs:
            if find(hub) != find(i) and _linked(x, docs[hub], percent):
                union(i, hub)
                links.append((x.uid, docs[hub].uid))
                break
        l = _matches_wanted(x)
        own = find(i)
        hits: dict[int, int] = defaultdict(int)
        for token in x.tokens[: max(0, min(x.m, x.m - x.t + l))].tolist():
            for level in index[:l]:
                entry = level.get(token)
                if not entry:
                    continue
                for r in list(entry):
                    now = find(r)
                    if now != r:
                        entry.setdefault(now, []).extend(entry.pop(r))
                for r, members in entry.items():
                    if r != own:
                        for j in members:
                            hits[j] += 1
        for j, count in sorted(hits.items(), key=lambda z: -z[1]):
            if count >= l and find(j) != find(i) and _linked(x, docs[j], percent):
                union(i, j)
                links.append((x.uid, docs[j].uid))
        own = find(i)
        if size[own] >= 8 and len(hubs) < 4 and all(find(h) != own for h in hubs):
            hubs.append(i)
        for q, token in enumerate(x.tokens[: max(0, min(x.m, x.m - x.t + MOST_MATCHES))].tolist()):
            index[max(0, q - (x.m - x.t))][token].setdefault(own, []).append(i)
    return links


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def count_links(docs: list[_Doc], percent: int, sides: np.ndarray | None = None, here: list[np.ndarray] | None = None) -> np.ndarray:
    """For each document the copies of all that link with it; with ``sides`` only of those on another side.

    With ``here`` (for each document some places of its prefix) a pair counts only if its first common prefix shingle is among them.
    """
    n, m, t, copies = (np.array([getattr(d, c) for d in docs], np.int64) for c in ("n", "m", "t", "copies"))
    degree = np.zeros(len(docs), np.int64)
    off = np.cumsum(m) - m
    _, token = np.unique(np.concatenate([d.tokens for d in docs]), return_inverse=True)
    head = np.maximum(m - t + 1, 0)
    if here is None:
        here = [np.arange(x) for x in head]
    size = np.array([len(x) for x in here], np.int64)
    at = np.concatenate([o + x for o, x in zip(off, here, strict=True)])
    owner = np.repeat(np.arange(len(docs)), size)[np.argsort(token[at], kind="stable")]
    end = np.cumsum(np.bincount(token[at], minlength=int(token.max(initial=-1)) + 1))
    start = np.append(0, end[:-1])
    mine = np.zeros(len(end), bool)
    place = np.full(len(end), -1)
    for i in range(len(docs)):
        first = token[off[i] + here[i]]
        start[first] += 1  # postings are in order of documents, so what is left are later ones
        j = np.unique(owner[_places(start[first], end[first] - start[first])])
        j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
        if sides is not None:
            j = j[sides[j] != sides[i]]
        if not len(j):
            continue
        if size[i] < head[i]:  # not all of the prefix: the pair's first common shingle must be here
            prefix = token[off[i] : off[i] + head[i]]
            place[prefix] = np.arange(head[i])
            seen = place[token[_places(off[j], head[j])]]
            least = np.minimum.reduceat(np.where(seen < 0, head[i], seen), np.cumsum(head[j]) - head[j])
            place[prefix] = -1
            j = j[np.isin(least, here[i])]
            if not len(j):
                continue
        own = token[off[i] : off[i] + m[i]]
        mine[own] = True
        common = np.add.reduceat(mine[token[_places(off[j], m[j])]].astype(np.int64), np.cumsum(m[j]) - m[j])
        mine[own] = False
        j = j[100 * common >= percent * (n[i] + n[j] - common)]
        degree[i] += copies[j].sum()
        degree[j] += copies[i]
    return degree


def _count_pairs(percent: int):
    """Links between two chunks of the documents that hold too common shingles, or within one, at those shingles."""

    def counted(key: tuple, got: pa.Table) -> pa.Table:
        docs, sides, here = [], [], []
        for row in rows(got):
            docs.append(_Doc(row["uid"], row["n"], row["payload"], percent, row["copies"]))
            sides.append(row["chunk"])
            here.append(np.array(row["places"], np.int64))
        degree = count_links(docs, percent, None if key[1].as_py() == key[2].as_py() else np.array(sides), here)
        return table(LINKS, [(d.uid, d.uid, x) for d, x in zip(docs, degree.tolist(), strict=True) if x])

    return counted


def _solve_shards(percent: int, count: bool):
    """Documents of a large component that hold some shingles: links that connect, and the links whose first common shingle is here."""

    def solved(key: tuple, got: pa.Table) -> pa.Table:
        docs, here, labels = [], [], {}
        for row in rows(got):
            docs.append(_Doc(row["uid"], row["n"], row["payload"], percent, row["copies"]))
            here.append(np.array(row["places"], np.int64))
            labels[row["uid"]] = row["label"]
        found = [(a, b, None) for a, b in solve(docs, percent, labels)] if len(set(labels.values())) > 1 else []
        if count:
            found += [(d.uid, d.uid, x) for d, x in zip(docs, count_links(docs, percent, here=here).tolist(), strict=True) if x]
        return table(LINKS, found)

    return solved


def _prefix_tokens(percent: int):
    schema = pa.schema([("component", pa.int64()), ("uid", pa.int64()), ("m", pa.int64()), ("apart", pa.bool_()), ("token", pa.int64()), ("place", pa.int32())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows(b):
                h, _ = unpack(row["payload"])
                h = h[: _prefix(row["n"], row["m"], percent)]
                one = [pa.array([row[c]], schema.field(c).type).take(pa.array(np.zeros(len(h), np.int64))) for c in ("component", "uid", "m", "apart")]
                yield pa.RecordBatch.from_arrays([*one, pa.array(h.view(np.int64)), pa.array(np.arange(len(h), dtype=np.int32))], schema=schema)

    return tokens, "component long, uid long, m long, apart boolean, token long, place int"


def _solve_groups(percent: int, count: bool = False):
    def solved(key: tuple, got: pa.Table) -> pa.Table:
        groups: dict[int, dict[int, _Doc]] = defaultdict(dict)
        labels: dict[int, int] = {}
        for row in rows(got):
            groups[row["component"]][row["uid"]] = _Doc(row["uid"], row["n"], row["payload"], percent, row["copies"])
            if row["label"] is not None:
                labels[row["uid"]] = row["label"]
        found = [(a, b, None) for docs in groups.values() for a, b in solve(list(docs.values()), percent, labels)]
        if count:
            docs = [d for x in groups.values() for d in x.values()]
            found += [(d.uid, d.uid, x) for d, x in zip(docs, count_links(docs, percent).tolist(), strict=True) if x]
        return table(LINKS, found)

    return solved


def _links(alive: DataFrame, coarse: DataFrame, percent: int, big: int, group_tokens: int, count: bool) -> DataFrame:
    """Links that connect all coarse components, and with ``count`` each document's number of links."""
    solved = _solve_groups(percent)
    docs = alive.join(coarse.withColumnRenamed("node", "uid"), "uid")
    weights = docs.groupBy("component").agg(F.sum("m").alias("weight"))
    large = durable(weights.where(F.col("weight") > big).select("component", F.ceil(F.col("weight") / group_tokens).cast("long").alias("chunks")))
    total = alive.agg(F.sum("m")).first()[0] or 0
    groups = max(16, -(-total // group_tokens))
    none = F.lit(None).cast("long").alias("label")
    small = docs.join(large, "component", "left_anti").select(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("gid"), "component", "uid", "n", "copies", "payload", none)
    links = small.groupBy("gid").applyInArrow(_solve_groups(percent, count), LINKS_SQL)
    if large.isEmpty():
        return links
    links = durable(links)
    zero = F.lit(0).cast("long")
    # the largest family, by pivots
    parts = durable(docs.join(large, "component").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks"))))
    pivots = parts.groupBy("component", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(64)).alias("p")).agg(F.min("uid").alias("uid")).select("component", "uid")
    spread = parts.join(pivots, ["component", "uid"], "left_semi").withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    columns = ["component", "chunk", "uid", "n", "copies", "payload"]
    first = parts.select(columns).unionByName(spread.select(columns)).withColumn("label", F.lit(None).cast("long"))
    near = durable(first.groupBy("component", "chunk").applyInArrow(solved, LINKS_SQL))
    label = durable(components(near)).withColumnsRenamed({"node": "uid", "component": "label"})
    named = parts.join(label, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    most = named.groupBy("component", "label").count().groupBy("component").agg(F.max_by("label", F.struct("count", F.negative("label"))).alias("main"))
    named = durable(named.join(most, "component").withColumn("apart", F.col("label") != F.col("main")).drop("main"))
    # the others, by prefix shingle; to count, all
    tokens, kinds = _prefix_tokens(percent)
    each = durable(named.select("component", "uid", "n", "m", "apart", "payload").mapInArrow(tokens, kinds))
    weight = each.groupBy("component", "token").agg(F.sum("m").alias("weight"), F.max("apart").alias("apart"), F.count(F.lit(1)).alias("docs"))
    some = weight.where(F.col("docs") > 1) if count else weight.where((F.col("docs") > 1) & F.col("apart"))
    some = durable(some.select("component", "token", "weight", (F.col("weight") > group_tokens).alias("common")))
    shards = some.where("NOT common").groupBy("component").agg(F.ceil(F.sum("weight") / group_tokens).cast("long").alias("shards"))
    placed = durable(each.join(some, ["component", "token"]).join(shards, "component", "left").withColumn("shard", F.when(F.col("common"), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("token"), F.col("shards")))).groupBy("component", "uid", "shard").agg(F.array_sort(F.collect_list("place")).alias("places")))
    held = placed.join(named.select("uid", "n", "copies", "payload", "label", "apart"), "uid")
    links = links.unionByName(near).unionByName(held.where("shard >= 0").drop("apart").groupBy("component", "shard").applyInArrow(_solve_shards(percent, count), LINKS_SQL))
    common = durable(held.where("shard = -1"))
    if common.isEmpty():
        return links
    chunks = common.join(named.select("uid", "m"), "uid").groupBy("component").agg(F.ceil(F.sum("m") / group_tokens).cast("long").alias("chunks"))
    dealt = common.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")))
    if count:
        pairs = dealt.withColumn("k", F.explode(F.sequence(zero, F.col("chunks") - 1)))
        pairs = pairs.select("component", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk", "uid", "n", "copies", "payload", "places")
        links = links.unionByName(pairs.groupBy("component", "i", "j").applyInArrow(_count_pairs(percent), LINKS_SQL))
    apart = dealt.where("apart")
    own = apart.groupBy("component").agg(F.ceil(F.sum("n") / group_tokens).cast("long").alias("shares"))
    columns = ["component", "share", "chunk", "uid", "n", "copies", "payload", "label"]
    mine = apart.join(own, "component").withColumn("share", F.pmod(F.xxhash64("uid", F.lit(2)), F.col("shares"))).withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1))).select(columns)
    every = dealt.join(own, "component").withColumn("share", F.explode(F.sequence(zero, F.col("shares") - 1))).select(columns)
    return links.unionByName(mine.unionByName(every).groupBy("component", "share", "chunk").applyInArrow(solved, LINKS_SQL))


def _joined(blocks: DataFrame, words: int, percent: int, big: int, group_tokens: int, fan: int, count: bool) -> tuple[DataFrame, DataFrame]:
    """Documents (``uid, doc_id, n, f1, f2``) and classes with shingles (``f1, f2, first, copies``, and with ``count`` also ``n_links``)."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = bucket_count(total)
    describe, kinds = _describe(words)
    each = durable(blocks.mapInArrow(describe, kinds))
    # the least id leads a class; a row without an id only leads a class without ids
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("head")
    classes = durable(each.where("n > 0").groupBy("f1", "f2").agg(head, F.count(F.lit(1)).alias("copies")).withColumn("uid", F.col("head.uid")))
    place = F.shiftright("uid", 40) * F.lit(1 << 32) + F.shiftright(F.col("uid").bitwiseAND((1 << 40) - 1), _RANK)
    chosen = classes.groupBy(place.alias("block")).agg(F.flatten(F.collect_list(F.array(F.col("uid").bitwiseAND((1 << _RANK) - 1).cast("int"), F.col("copies").cast("int")))).alias("idx"))
    told = exchanged(blocks, _shingle_keys(words, buckets), _add_up, buckets, fan).where(F.col("kind") == ANSWER).select("*", F.lit(None).cast("array<int>").alias("idx"))
    zero = F.lit(-1).cast("long").alias("bucket")
    texts = blocks.select(zero, "block", F.lit(TEXT).alias("kind"), "payload", F.lit(None).cast("array<int>").alias("idx"))
    flags = chosen.select(zero, "block", F.lit(CHOSEN).alias("kind"), F.lit(None).cast("binary").alias("payload"), "idx")
    alive = durable(texts.unionByName(told).unionByName(flags).groupBy("block").applyInArrow(_alive(words, buckets, percent, fan), ALIVE_SQL))
    chains = scattered(alive, _prefix_keys(percent, buckets), buckets, fan).groupBy("bucket").applyInArrow(_chains(percent, stride(buckets, fan) > 1), "a long, b long")
    coarse = durable(components(chains))
    links = durable(_links(alive, coarse, percent, big, group_tokens, count))
    labels = components(links.where("links IS NULL"))
    named = classes.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    columns = ["f1", "f2", "first", "copies"]
    if count:
        degree = links.where("links IS NOT NULL").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("degree"))
        named = named.join(degree, "uid", "left")
        columns.append((F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("component").agg(F.min("head").alias("first"))
    return each, named.join(least, "component").select(*columns)


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = WORDS, percent: int = PERCENT, big: int = 2 * GROUP_TOKENS, group_tokens: int = GROUP_TOKENS, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, copies, n_links``.

    ``component_id`` is the least id reachable by links (Jaccard of at least ``percent``); ``copies``: documents with
    the very same set; ``n_links``: other documents that link with this one, its copies among them.

    Nulls and the like: a null or wordless text has no shingles and no links. A document with a null id takes part
    only as a copy or partner that others are linked through; its own component is that of its set, null if no id is
    known there. Rows with equal ids stand on their own. An empty table gives an empty result; extra columns are ignored;
    texts are taken whole, however long. ``big`` and ``group_tokens`` (shingles of a component and of a task) and ``fan``
    (:mod:`quern.llm.exchange`) change how the work is dealt out, never a row.
    """
    each, named = _joined(to_blocks(docs, doc_id, text, block_bytes), words, percent, big, group_tokens, fan, True)
    classes = named.select("f1", "f2", F.col("first.doc_id").alias("component_id"), "copies", "n_links")
    alone = each.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    return each.where("n > 0").join(classes, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "copies", "n_links").unionByName(alone)


def _keep_rows(key: tuple, got: pa.Table) -> pa.Table:
    block = others = None
    chosen: list[int] = []
    for row in rows(got):
        if row["payload"] is not None:
            block, others = Block.from_blob(row["payload"]), read_others(row["others"])
        else:
            chosen += row["idx"]
    at = pa.array(sorted(chosen), pa.int64())
    columns = [pa.array(block.ids, mask=~block.has_id).take(at), block.texts(block.offsets, block.data).take(at), *(c.combine_chunks().take(at) for c in others.columns)]
    return pa.Table.from_arrays(columns, ["doc_id", "text", *others.schema.names])


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = WORDS, percent: int = PERCENT, big: int = 2 * GROUP_TOKENS, group_tokens: int = GROUP_TOKENS, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """The documents, of each component only the first: the least id, of equal ids one row.

    Documents without shingles, null and empty texts among them, all stay. All columns are kept, and the text isn't
    joined: blocks carry the rows, and each is told which to let go.
    """
    blocks = to_blocks(docs, doc_id, text, block_bytes, carry=True)
    each, named = _joined(blocks, words, percent, big, group_tokens, fan, False)
    stay = named.select(F.col("first.uid").alias("uid")).distinct().unionByName(each.where("n = 0").select("uid"))
    place = F.shiftright("uid", 40) * F.lit(1 << 32) + F.shiftright(F.col("uid").bitwiseAND((1 << 40) - 1), _RANK)
    told = stay.groupBy(place.alias("block")).agg(F.collect_list(F.col("uid").bitwiseAND((1 << _RANK) - 1).cast("int")).alias("idx"))
    nothing = F.lit(None).cast("binary")
    both = blocks.select("block", "payload", "others", F.lit(None).cast("array<int>").alias("idx")).unionByName(told.select("block", nothing.alias("payload"), nothing.alias("others"), "idx"))
    return restored(both.groupBy("block").applyInArrow(_keep_rows, carried_schema(docs, doc_id, text)), docs, doc_id, text)


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))
