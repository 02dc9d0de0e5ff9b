"""Token batches from a stream, with the tail of each shard carried from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "shard string, chunk long, inputs array<int>, targets array<int>"
STATE = "next long, tail array<int>"


def stream_chunks(df: DataFrame, shard: str, order: str, tokens: str, rows: int, length: int, carry_tail: bool = True) -> DataFrame:
    """``shard, chunk, inputs, targets`` of a stream: within a shard, chunk c has tokens [c BL, c BL + BL) and successors.

    The state of a shard is its tail (``rows * length + 1`` tokens at most between batches) and the number of its next
    chunk, so a restart from the checkpoint goes on where it stopped. Without ``carry_tail`` every micro-batch begins anew.
    """
    size = rows * length

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, tail = state.get if state.exists else (0, [])
        whole = pd.concat(list(batches)).sort_values(order)
        stream = np.concatenate([np.asarray(tail if carry_tail else [], np.int32), *(np.asarray(x, np.int32) for x in whole[tokens])])
        ready = max(0, (len(stream) - 2) // size)  # a chunk takes its successor and waits for one more
        out = [(key[0], number + i, stream[i * size : (i + 1) * size], stream[i * size + 1 : (i + 1) * size + 1]) for i in range(ready)]
        state.update((number + ready, stream[ready * size :].tolist()))
        yield pd.DataFrame(out, columns=["shard", "chunk", "inputs", "targets"])

    return df.groupBy(shard).applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there into Parquet, then stop; called again with the same checkpoint it goes on from there."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
