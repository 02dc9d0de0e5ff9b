"""Token counts of fields and sections from one encoding of the whole text.

The whole text is encoded once.  Byte-level tokens lie end to end, so the running sum of their lengths gives each
token's span; the spans are joined with the spans of sections (or of the fields a text was put together from).  A
token that crosses a boundary goes to sections by an explicit rule:

* ``start``: the section in which it begins; * ``end``: that of its last byte;
* ``most``: the one with most of its bytes, the earlier one on a tie.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import documents, slices

RULES = ("start", "end", "most")
CHUNK_BYTES = 2 << 20
RESULT = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("first_char", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
RESULT_SQL = "doc_id long, section int, first_char long, n_chars long, n_tokens long, n_crossing long"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("whole-text", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets at which the tokens of the text begin and end."""
        end = np.cumsum(self.length[np.asarray(self.encoding.encode_ordinary(text), np.int64)])
        return np.concatenate([[0], end[:-1]]) if len(end) else end, end


_encoders: dict[str, Encoder] = {}


def _encoder(raw: str, pattern: str) -> Encoder:
    """The encoder of a worker, made once for all its tasks."""
    key = hashlib.sha256((pattern + raw).encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder({base64.b64decode(k): v for k, v in json.loads(raw)}, pattern)
    return _encoders[key]


def attribute(start: np.ndarray, end: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary; ``cuts``: where sections begin, from 0."""
    first = np.searchsorted(cuts, start, "right") - 1
    last = np.searchsorted(cuts, end - 1, "right") - 1
    cross = first != last
    owner = first.copy()
    if rule == "end":
        owner = last
    elif rule == "most":
        bounds = np.append(cuts, end[-1] if len(end) else 0)
        for i in np.flatnonzero(cross):
            own = np.arange(first[i], last[i] + 1)
            part = np.minimum(bounds[own + 1], end[i]) - np.maximum(bounds[own], start[i])
            owner[i] = own[part.argmax()]
    n = len(cuts)
    return np.bincount(owner, minlength=n), np.bincount(owner[cross], minlength=n)


def section_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which sections begin: the text's beginning and whatever follows a line feed."""
    at = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], at[at < len(data)]])


def _rows(encoder: Encoder, text: str, raw: bytes, cuts: np.ndarray, rule: str):
    data = np.frombuffer(raw, np.uint8)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n, cross = attribute(*encoder.spans(text), cuts, rule)
    at = chars[cuts]
    return at, np.diff(np.append(at, chars[-1])), n, cross


def _counter(docs: DataFrame, ranks: dict[bytes, int], pattern: str, rule: str, fields: int):
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast((json.dumps([[base64.b64encode(k).decode(), v] for k, v in ranks.items()]), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value)
        for b in batches:
            for piece in slices(b, 1, CHUNK_BYTES):
                ids, texts, out, count = piece.column(0).to_pylist(), piece.column(1).fill_null("").to_pylist(), [], []
                sizes = piece.column(2).to_pylist() if fields else None
                for i, text in enumerate(texts):
                    bytes_ = text.encode()
                    cuts = np.concatenate([[0], np.cumsum(sizes[i])[:-1]]).astype(np.int64) if fields else section_starts(np.frombuffer(bytes_, np.uint8))
                    found = _rows(encoder, text, bytes_, cuts, rule)
                    out.append(found)
                    count.append(len(cuts))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                sections = np.concatenate([np.arange(c, dtype=np.int32) for c in count])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), count))), pa.array(sections), *(pa.array(c, pa.int64()) for c in columns)], schema=RESULT)

    return run


def section_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", *, rule: str = "start") -> DataFrame:
    """One row per section (line with its line feed): ``doc_id, section, first_char, n_chars, n_tokens, n_crossing``.

    The tokens of a document's sections add up to those of its whole text. A null or empty text is one empty section
    without tokens; a null id is kept; equal rows give equal rows; an empty table an empty result. Extra columns are
    ignored; texts are never cut, however long.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_counter(docs, ranks, pattern, rule, 0), RESULT_SQL)


def field_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, fields: list[str], doc_id: str = "doc_id", *, separator: str = "\n", rule: str = "start") -> DataFrame:
    """The same for text columns put together with a separator (which belongs to the field before it); ``section`` counts the fields."""
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat(*parts).alias("text"), F.array(*[F.octet_length(p).cast("long") for p in parts]).alias("sizes"))
    return own.mapInArrow(_counter(docs, ranks, pattern, rule, len(fields)), RESULT_SQL)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return section_tokens(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
