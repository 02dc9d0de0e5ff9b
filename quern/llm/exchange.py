"""Keys of many senders to buckets by hash, and the buckets' answers back, in messages whose number is linear in the bytes.

A sender (a block of documents) gives sorted keys with values beside them, and one message holds those for one
destination.  As long as there are at most ``fan`` buckets a message is for one bucket and has the size of a sender by
``fan`` at least.  With more, keys go in two hops: a message is for a run of buckets, a *relay* takes those of as many
senders as make up a bucket's size, sorts them anew and sends a message to each bucket of the run, with the sender and
place of each key; answers come back over the same relay.  Either way nobody sends more than ``fan`` messages for what
fits into a block or bucket, and ``fan ** 2`` buckets can be reached.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import U64, batch, durable, pack, rows, table, unpack

#: Most messages of a sender, and buckets that are reached in one hop.
FAN = 4096

MESSAGES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
MESSAGES_SQL = "bucket long, block long, kind int, payload binary"
#: Kinds of messages: keys, answers, a bucket's summary.
KEYS, ANSWER, SUMMARY = 0, 1, 2

_SHARE = 1 << 24


def stride(buckets: int, fan: int = FAN) -> int:
    """How many buckets a sender's message is for."""
    return 1 if buckets <= fan else math.isqrt(buckets - 1) + 1


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys % U64(buckets)).astype(np.int64)


def bounds_of(keys: np.ndarray, buckets: int, fan: int = FAN) -> np.ndarray:
    """Where each destination's keys begin among keys in order of bucket."""
    each = stride(buckets, fan)
    return np.searchsorted(bucket_of(keys, buckets) // each, np.arange(-(-buckets // each) + 1))


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(x)], strict=True))


KeysOf = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, list[np.ndarray]]]]


def _send(keys_of: KeysOf, buckets: int, fan: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sender, u, values in keys_of(b):
                at = bounds_of(u, buckets, fan)
                some = np.flatnonzero(at[1:] > at[:-1]).tolist()
                yield batch(MESSAGES, [(k, sender, KEYS, pack(np.diff(u[at[k] : at[k + 1]], prepend=U64(0)), *(v[at[k] : at[k + 1]] for v in values))) for k in some])

    return send


def joined(got: pa.Table) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """Senders and numbers of keys of messages, and their keys and values one after the other."""
    senders, sizes, parts = [], [], []
    for row in rows(got):
        d, *values = unpack(row["payload"])
        senders.append(row["block"])
        sizes.append(len(d))
        parts.append((np.cumsum(d, dtype=U64), *values))
    return np.array(senders, np.int64), sizes, [np.concatenate(x) for x in zip(*parts, strict=True)]


def _relay(buckets: int):
    def relay(key: tuple, got: pa.Table) -> pa.Table:
        senders, sizes, (u, *values) = joined(got)
        sender = np.repeat(senders, sizes)
        place = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        bucket = bucket_of(u, buckets)
        order = np.lexsort((u, bucket))
        bucket, columns = bucket[order], [x[order] for x in (u, sender, place, *values)]
        number = key[0].as_py() * _SHARE + key[1].as_py()
        found = []
        for i, j in stretches(bucket):
            own, *rest = (x[i:j] for x in columns)
            found.append((int(bucket[i]), number, KEYS, pack(np.diff(own, prepend=U64(0)), *rest)))
        return table(MESSAGES, found)

    return relay


def scattered(senders: DataFrame, keys_of: KeysOf, buckets: int, fan: int = FAN) -> DataFrame:
    """Messages by ``bucket``: keys and their values, after two hops with the senders and places between them.

    ``keys_of`` yields ``(sender, keys, values)`` of a batch of rows; keys are in order of (bucket, key).
    """
    sent = senders.mapInArrow(_send(keys_of, buckets, fan), MESSAGES_SQL)
    each = stride(buckets, fan)
    if each == 1:
        return sent
    if each > _SHARE:
        raise ValueError("too many buckets")
    share = F.pmod(F.xxhash64("block"), F.lit(each)).alias("share")  # as many relays as there are buckets
    return sent.select("*", share).groupBy("bucket", "share").applyInArrow(_relay(buckets), MESSAGES_SQL)


Answer = Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, list[np.ndarray], bytes | None]]


def _answer(answer: Answer, relayed: bool):
    def run(key: tuple, got: pa.Table) -> pa.Table:
        senders, sizes, (u, *values) = joined(got)
        via, values = (values[:2], values[2:]) if relayed else ([], values)
        mask, answers, summary = answer(u, values)
        bucket = key[0].as_py()
        found = [] if summary is None else [(bucket, -1, SUMMARY, summary)]
        at = 0
        for s, n in zip(senders.tolist(), sizes, strict=True):
            some = at + np.flatnonzero(mask[at : at + n])
            if len(some):
                places = [x[some] for x in via] if relayed else [np.diff(some - at, prepend=0).astype(np.uint32)]
                found.append((bucket, s, ANSWER, pack(*places, *(x[some] for x in answers))))
            at += n
        return table(MESSAGES, found)

    return run


def _back(key: tuple, got: pa.Table) -> pa.Table:
    """A relay's answers, dealt out to its senders."""
    parts = [unpack(row["payload"]) for row in rows(got)]
    block, place, *answers = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, block))
    block, place, answers = block[order], place[order].astype(np.int64), [x[order] for x in answers]
    found = []
    for i, j in stretches(block):
        found.append((key[0].as_py() // _SHARE, int(block[i]), ANSWER, pack(np.diff(place[i:j], prepend=0).astype(np.uint32), *(x[i:j] for x in answers))))
    return table(MESSAGES, found)


def exchanged(senders: DataFrame, keys_of: KeysOf, answer: Answer, buckets: int, fan: int = FAN, summaries: bool = False) -> DataFrame:
    """Messages to the senders: answers by destination, and with ``summaries`` the summary of each bucket (then the table is kept).

    ``answer`` gets all keys of a bucket with their values and gives a mask of those that get an answer, arrays of
    answers beside the keys, and a summary or None.
    """
    relayed = stride(buckets, fan) > 1
    told = scattered(senders, keys_of, buckets, fan).groupBy("bucket").applyInArrow(_answer(answer, relayed), MESSAGES_SQL)
    if summaries:
        told = durable(told)
    if not relayed:
        return told
    back = told.where(F.col("kind") == ANSWER).groupBy("block").applyInArrow(_back, MESSAGES_SQL)
    return back.unionByName(told.where(F.col("kind") == SUMMARY)) if summaries else back


def answers_at(bounds: np.ndarray, payloads: dict[int, bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places among a sender's keys that got an answer, and the answers."""
    places, parts = [], []
    for k, blob in payloads.items():
        gaps, *values = unpack(blob)
        places.append(bounds[k] + np.cumsum(gaps, dtype=np.int64))
        parts.append(values)
    if not places:
        return np.zeros(0, np.int64), []
    return np.concatenate(places), [np.concatenate(x) for x in zip(*parts, strict=True)]
