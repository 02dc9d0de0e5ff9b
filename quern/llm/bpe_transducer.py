"""Exact BPE encoding and decoding with a minimal acyclic transducer for frequent words.

The lexicon holds the words that the vocabulary itself has as whole words, and the frequent words of the corpus by counts
of all its texts, whatever number of tokens they take; it decides speed alone, never a result.  It is compiled into a minimal automaton with shared suffixes, whose
transitions carry numbers that add up to a word's rank; the ids of each rank lie in a table beside it.  Workers
map the file into memory and send all different words of a chunk through it at once, a byte at a time.
Words outside the lexicon are merged exactly, also all at once: in each round every word merges its pair of
least rank, all occurrences from the left, until none is left.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import documents, durable, slices

CHUNK_BYTES = 4 << 20
CACHE_WORDS = 250_000
#: Bounds of what enters the lexicon besides whole words of the vocabulary: words, bytes of all, and bytes of each (a state a byte).
LEXICON_WORDS, LEXICON_BYTES, WORD_BYTES = 50_000, 1 << 20, 64
#: Different words that a task counts before it hands their counts on.
COUNTED_WORDS = 250_000
#: White space of Unicode (property White_Space), which the tokenizer file's \\s stands for.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


# ---------------------------------------------------------------- the automaton


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of sorted different words, as arrays of transitions.

    ``key`` is state * 256 + byte, ascending; ``to`` the next state, ``add`` the words that sort before those
    through this transition and after its state, ``final`` marks states where a word ends.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[tuple] = []
    path: list[list] = [[False, []]]  # final, [(byte, state)]

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(node[0])
            edges.append(key[1])
        return state

    before = b""
    for word in words:
        common = os.path.commonprefix([before, word])
        for depth in range(len(before), len(common), -1):
            node = path.pop()
            path[-1][1].append((before[depth - 1], freeze(node)))
        path += [[False, []] for _ in word[len(common) :]]
        path[-1][0] = True
        before = word
    for depth in range(len(before), 0, -1):
        node = path.pop()
        path[-1][1].append((before[depth - 1], freeze(node)))
    root = freeze(path[0])
    count = [0] * len(finals)
    key, to, add = [], [], []
    for state, out in enumerate(edges):  # a state's successors come before it
        below = int(finals[state])
        for byte, target in out:
            key.append(state * 256 + byte)
            to.append(target)
            add.append(below)
            below += count[target]
        count[state] = below
    return {"key": np.array(key, np.int64), "to": np.array(to, np.int32), "add": np.array(add, np.int32), "final": np.array(finals, bool), "root": np.array([root], np.int64)}


class Lexicon:
    """The automaton and the ids of its words in one file that is mapped into memory."""

    @staticmethod
    def compiled(words: dict[bytes, list[int]]) -> bytes:
        ordered = sorted(words)
        parts = minimal_automaton(ordered)
        size = np.array([len(words[w]) for w in ordered], np.int64)
        parts |= {"at": np.concatenate([[0], np.cumsum(size)]).astype(np.int64), "ids": np.array([i for w in ordered for i in words[w]], np.uint32)}
        head = json.dumps({k: [a.dtype.str, len(a)] for k, a in parts.items()}).encode()
        out = [len(head).to_bytes(8, "little"), head + b" " * (-len(head) % 8)]
        for a in parts.values():
            raw = a.tobytes()
            out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    def __init__(self, compiled: bytes):
        with tempfile.NamedTemporaryFile(prefix="quern-lexicon-") as f:  # the mapping outlives the name
            f.write(compiled)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self._map[:8], "little")
        at = 8 + n + (-n % 8)
        for name, (dtype, size) in json.loads(self._map[8 : 8 + n]).items():
            a = np.frombuffer(self._map, np.dtype(dtype), size, at)
            setattr(self, name, a)
            at += a.nbytes + (-a.nbytes % 8)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank in the lexicon, or -1."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        rank, found = np.zeros(n, np.int64), np.full(n, -1)
        live, state = np.arange(n), np.full(n, self.root[0])
        depth = 0
        while len(live) and len(self.key):
            done = size[live] == depth
            end = live[done]
            found[end[self.final[state[done]]]] = rank[end[self.final[state[done]]]]
            live, state = live[~done], state[~done]
            key = state * 256 + data[start[live] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            live, at = live[hit], at[hit]
            rank[live] += self.add[at]
            state = self.to[at].astype(np.int64)
            depth += 1
        return found


# ---------------------------------------------------------------- merging


class Merges:
    """Exact BPE of many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        key = np.array([(vocab[a] << 20) + vocab[b] for a, b in pairs], np.int64)
        to = np.array([vocab[a + b] for a, b in pairs], np.int64)
        _, first = np.unique(key[::-1], return_index=True)  # of pairs named twice the last rank counts
        first = np.sort(len(key) - 1 - first)
        bits = max(4, (4 * len(key)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int64)
        self.rank, self.to = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for r, k, t in zip(first.tolist(), key[first].tolist(), to[first].tolist(), strict=True):
            h = int(self._hash(np.array([k]))[0])
            while self.table[h] >= 0:
                h = (h + 1) & self._mask
            self.table[h], self.rank[h], self.to[h] = k, r, t

    NONE = np.iinfo(np.int64).max

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where it isn't merged."""
        key = (a << 20) + b
        at = self._hash(key)
        got = self.table[at]
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self._mask
            g = self.table[at[open_]]
            open_ = open_[(g != key[open_]) & (g >= 0)]
        hit = self.table[at] == key
        return np.where(hit, self.rank[at], self.NONE), np.where(hit, self.to[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of words, none of them empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[data]
        end = np.cumsum(size)
        sym[end - 1] = self.last[data[end - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        rank, to = np.full(len(sym), self.NONE), np.full(len(sym), -1)
        todo = np.flatnonzero(word[1:] == word[:-1])
        while len(sym):
            rank[todo], to[todo] = self._find(sym[todo], sym[todo + 1])
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(sym)))
            live = np.repeat(least != self.NONE, span)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, to = sym[live], word[live], rank[live], to[live]
                keep = least != self.NONE
                least, span = least[keep], span[keep]
                if not len(sym):
                    break
            take = rank == np.repeat(least, span)
            if (take[1:] & take[:-1]).any():  # a pair that overlaps itself: every other one from the left
                at = np.flatnonzero(take)
                new = np.diff(at, prepend=-9) != 1
                lead = at[np.flatnonzero(new)][np.cumsum(new) - 1]
                take[at[(at - lead) % 2 == 1]] = False
            at = np.flatnonzero(take)
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            changed = place[at]
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            rank[changed] = self.NONE
            todo = np.unique(np.concatenate([changed, changed - 1]))
            todo = todo[(todo >= 0) & (todo + 1 < len(sym))]
            same = word[todo] == word[todo + 1]
            todo = todo[same]
        s = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        w = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(w, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(words)))]), s[order].astype(np.uint32)


# ---------------------------------------------------------------- the tokenizer


class Pieces:
    """The splitting of a tokenizer file: NFC, lower case, a pattern, special tokens."""

    def __init__(self, spec: dict):
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._pieces = regex.compile(pattern.replace(r"\s", SPACE))
        self._special = regex.compile("|".join(map(regex.escape, added))) if added else None

    def words(self, text: str) -> list[str]:
        """The pieces of a text; special tokens come with a space before them."""
        out: list[str] = []
        at = 0
        for m in self._special.finditer(text) if self._special and "<" in text else ():
            out += self._plain(text[at : m.start()])
            out.append(f" {m[0]}")
            at = m.end()
        return out + self._plain(text[at:]) if at else self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self._pieces.findall(text.lower())


class WordBpe:
    """A tokenizer file of the kind "words with ends": NFC, lower case, a splitting pattern, byte letters."""

    def __init__(self, spec: dict, compiled: bytes | None = None, extra_words: Iterable[str] = ()):
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.merges = Merges(self.vocab, model["merges"], self.suffix)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.token = [""] * size
        for t, i in [*self.vocab.items(), *self.added.items()]:
            self.token[i] = t
        self.pieces = Pieces(spec)
        self.lexicon = Lexicon(compiled or self.with_words(extra_words))
        self._cache: dict[str, int] = {}
        self._clear()

    def with_words(self, words: Iterable[str]) -> bytes:
        """The lexicon with more words, compiled."""
        return Lexicon.compiled(self._whole_words(words))

    def _whole_words(self, extra: Iterable[str]) -> dict[bytes, list[int]]:
        of = {c: b for b, c in enumerate(byte_letters())}
        words = {bytes(of[c] for c in t.removesuffix(self.suffix)) for t in self.vocab if t.endswith(self.suffix) and t != self.suffix}
        ordered = sorted(words | {w.encode() for w in extra if w})
        at, ids = self.merges.encode(ordered)
        return {w: ids[at[i] : at[i + 1]].tolist() for i, w in enumerate(ordered)}

    def _clear(self) -> None:
        self._cache.clear()
        self._ids: list[np.ndarray] = []
        self._text: list[str] = []
        for t, i in self.added.items():  # no piece of ordinary text equals these keys
            self._cache[f" {t}"] = len(self._ids)
            self._ids.append(np.array([i], np.uint32))
            self._text.append(t)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        rank = self.lexicon.ranks(raw)
        unseen = np.flatnonzero(rank < 0)
        at, ids = self.merges.encode([raw[i] for i in unseen]) if len(unseen) else (None, None)
        place = np.full(len(words), -1)
        place[unseen] = np.arange(len(unseen))
        lat, lids = self.lexicon.at, self.lexicon.ids
        for w, r, p in zip(words, rank.tolist(), place.tolist(), strict=True):
            x = lids[lat[r] : lat[r + 1]] if r >= 0 else ids[at[p] : at[p + 1]]
            self._cache[w] = len(self._ids)
            self._ids.append(x)
            self._text.append(" ".join([self.token[i] for i in x.tolist()]))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids and decoded text of each text."""
        split = [self.pieces.words(t) for t in texts]
        if len(self._cache) > CACHE_WORDS:
            self._clear()
        new = set()
        for w in split:
            new.update(w)
        new.difference_update(self._cache)
        if new:
            self._learn(list(new))
        for w in split:
            places = list(map(self._cache.__getitem__, w))
            ids = np.concatenate([self._ids[p] for p in places]) if places else np.zeros(0, np.uint32)
            yield ids, " ".join([self._text[p] for p in places])

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces; unknown ids vanish."""
        return " ".join(self.token[i] for i in ids if 0 <= i < len(self.token))


COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def word_counts(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``word, n``: how often each word of at most ``WORD_BYTES`` bytes occurs in all whole texts; special tokens are no words."""

    def counted(count: Counter) -> pa.RecordBatch:
        own = [w for w in count if not w.startswith(" ") and len(w.encode()) <= WORD_BYTES]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([count[w] for w in own], pa.int64())], schema=COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for piece in slices(b, 0, CHUNK_BYTES):
                for t in piece.column(0).to_pylist():
                    count.update(pieces.words(t))
                if len(count) > COUNTED_WORDS:
                    yield counted(count)
                    count.clear()
        yield counted(count)

    some = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    return some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, bpe: WordBpe, text: str = "text", *, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts that occur at least twice, ``most`` of them and ``LEXICON_BYTES`` at most, by falling count.

    Counts are those of :func:`word_counts`, levels of them a 256th of a power of two apart; a level goes in whole or not at all, so
    the words don't depend on how rows lie, and only levels and words that go in come to the driver.
    """
    level = F.floor(F.log2("n") * 256)
    counts = durable(word_counts(docs, bpe.pieces, text).where(F.col("n") > 1).withColumn("level", level))
    least, words, size = None, 0, 0
    for r in sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("size")).collect(), key=lambda r: -r["level"]):
        words, size = words + r["words"], size + r["size"]
        if words > most or size > LEXICON_BYTES:
            break
        least = r["level"]
    found = counts.where(F.col("level") >= least).select("word", "n").collect() if least is not None else []
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])
RESULT_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


_tokenizers: dict[str, WordBpe] = {}


def _opened(raw: str, lexicon: bytes) -> WordBpe:
    """The tokenizer of a worker, made once for all its tasks."""
    key = hashlib.sha256(raw.encode() + lexicon).hexdigest()
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordBpe(json.loads(raw), lexicon)
    return _tokenizers[key]


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def bpe_encode(docs: DataFrame, spec: dict, doc_id: str = "doc_id", text: str = "text", *, keep_ids: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_tokens``, digests of ids and of the decoded text, and the ids.

    All texts are read twice: to count their words, and to encode them. The driver compiles the lexicon once, with the most
    frequent words by these counts; file and lexicon (some MB, whatever the corpus) are broadcast. A null
    text is the empty text, which has no tokens; a null id stays null; equal rows give equal rows; an empty table
    an empty result. Extra columns are ignored. Texts are never cut; a chunk is one text at least.
    """
    sc = docs.sparkSession.sparkContext
    plain = WordBpe(spec, Lexicon.compiled({}))
    compiled = plain.with_words(frequent_words(docs, plain, text))
    shared = sc.broadcast((json.dumps(spec), compiled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _opened(*shared.value)
        for b in batches:
            for piece in slices(b, 1, CHUNK_BYTES):
                texts = piece.column(1).fill_null("").to_pylist()
                n, sha, back, kept = [], [], [], []
                for ids, decoded in bpe.encode(texts):
                    n.append(len(ids))
                    sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    kept.append(ids.astype(np.int32) if keep_ids else None)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(kept, pa.list_(pa.int32()))], schema=RESULT)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT_SQL)


def default_spec() -> dict:
    import public_tokenizers

    return load_spec(public_tokenizers.path("word_bpe_49k.json"))


def op9_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bpe_encode(docs, default_spec(), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
