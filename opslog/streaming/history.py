"""Block history in a stream, with a bounded state per block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opslog.operators.explore import mentions, with_block
from opslog.functions import sequence as seq
from opslog.operators.sequences import with_history
from opslog.operators.skew import SPLIT_ROWS, skew_join
from opslog.schema import HISTORY_CAP
from opslog.sources.tables import write_batch

SEEN = "block_id string, micros long, id long, template_id long"
STATE = "micros array<bigint>, ids array<bigint>, templates array<bigint>"
FIRSTS = f"first_block string, {STATE}"
NO_TEMPLATE = -1
#: The default trigger: work off what is there, then end.
AVAILABLE = {"availableNow": True}


def _earliest(frame: pd.DataFrame, cap: int) -> pd.DataFrame:
    return frame.sort_values(["micros", "id"]).groupby("block_id", sort=False).head(cap)


def block_firsts(logs: DataFrame, cap: int = HISTORY_CAP, idle_ms: int | None = None) -> DataFrame:
    """Stream of each touched block with its earliest ``cap`` templated mentions so far.

    Only the earliest ``cap`` mentions of a batch can enter the state, so each
    Arrow batch is cut to them before the shuffle, and a hot block's task holds
    no more than the cap at a time. The state holds the earliest of old and new
    entries together, so a late log takes the place that its time gives it, as
    in a batch. With ``idle_ms``, a block without news for so long is forgotten; by default none ever is.
    """
    seen = mentions(logs).select(
        "block_id", F.unix_micros("timestamp").alias("micros"), "id",
        F.coalesce("template_id", F.lit(NO_TEMPLATE)).alias("template_id"),
    )

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf["template_id"] != NO_TEMPLATE
            # A block without a template still needs a row, or it would not be touched.
            bare = pdf[~known].drop_duplicates("block_id")
            yield pd.concat([_earliest(pdf[known], cap), bare])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = [np.asarray(a, dtype=np.int64) for a in state.get] if state.exists else [np.empty(0, np.int64)] * 3
        for pdf in batches:
            new = [pdf[c].to_numpy(dtype=np.int64) for c in ["micros", "id", "template_id"]]
            kept = [np.concatenate(pair) for pair in zip(kept, [c[new[2] != NO_TEMPLATE] for c in new])]
            order = np.lexsort((kept[1], kept[0]))[:cap]
            kept = [c[order] for c in kept]
        lists = tuple(c.tolist() for c in kept)
        state.update(lists)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({
            "first_block": [key[0]], "micros": [lists[0]], "ids": [lists[1]], "templates": [lists[2]],
        })

    return seen.mapInPandas(reduce, SEEN).groupBy("block_id").applyInPandasWithState(
        update, FIRSTS, STATE, "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
    )


def history_batches(logs: DataFrame, on_history: Callable[[DataFrame, int], None], scratch: str,
                    checkpoint: str, cap: int = HISTORY_CAP, split_rows: int = SPLIT_ROWS,
                    idle_ms: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Give every log its block's earlier templates and hand each batch to ``on_history``.

    The logs themselves do not pass through the keyed state; they travel beside
    it and meet the touched blocks in the batch, where hot blocks are split.
    ``scratch`` holds each batch while it is worked on; old batches there may be
    deleted.
    """
    both = logs.unionByName(block_firsts(logs, cap, idle_ms), allowMissingColumns=True)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, scratch, batch_id)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{scratch}/batch_id={batch_id}")
        entries = F.transform(
            F.arrays_zip("micros", "ids", "templates"),
            lambda e: F.struct(
                F.timestamp_micros(e["micros"]).alias("timestamp"), e["ids"].alias("id"),
                e["templates"].alias("template_id"), seq.template_token(e["templates"]).alias("token"),
            ),
        )
        firsts = stored.where(F.col("first_block").isNotNull()).select(
            F.col("first_block").alias("block_id"), entries.alias("first")
        )
        rows = with_block(stored.where(F.col("first_block").isNull()).select(*logs.columns))
        on_history(with_history(skew_join(rows, firsts, "block_id", "id", "left", split_rows)), batch_id)

    return (
        both.writeStream.foreachBatch(on_batch).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE)).start()
    )


def stream_block_state(logs: DataFrame, path: str, scratch: str, checkpoint: str,
                       cap: int = HISTORY_CAP, trigger: dict | None = None) -> StreamingQuery:
    """Store each log with the tokens of its history."""
    return history_batches(logs, lambda rows, batch_id: write_batch(rows, path, batch_id), scratch, checkpoint, cap,
                           trigger=trigger)
