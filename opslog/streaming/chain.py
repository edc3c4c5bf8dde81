"""From request to incident in one stream: store, template, look back, score, raise.

Two keyed operators stand beside the logs. One is keyed by template leaf and holds the catalogue: the
different masked messages of a batch pass through it, are matched or become leaders, and come out with
their template. The other is keyed by block and holds each block's earliest mentions, to which a batch
appends. The logs themselves pass through neither; they meet both results in the batch, where hot messages and hot
blocks are split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from opslog.functions import sequence as seq
from opslog.functions.text import mask_template
from opslog.operators.explore import mentions, with_block, with_blocks
from opslog.operators.scoring import load_scorer, score_histories
from opslog.operators.sequences import with_history
from opslog.operators.skew import SPLIT_ROWS, skew_join
from opslog.operators.templates import DEPTH, SIM_THRESHOLD, coded, leaf_key, masked_tokens
from opslog.operators.validate import validate_logs
from opslog.schema import HISTORY_CAP
from opslog.session import rocksdb_state
from opslog.sources.models import Model
from opslog.sources.tables import append_logs, load_table, write_batch
from opslog.streaming.history import AVAILABLE
from opslog.streaming.jobs import incident_rows

#: Ids of learned templates have this bit, so they never meet those of the model.
LEARNED = 1 << 61
#: Tasks that a block's mentions of a batch are first cut in.
GROUPS = 16

KNOWN = "masked string, template_id long, template string, learned boolean"
SEEN = "block_id string, micros long, id long, mask string"
ENTRIES = "micros array<bigint>, ids array<bigint>, masks array<string>"
FIRSTS = f"first_block string, {ENTRIES}"
CATALOG = "masked string, template_id long, template string"


def learned_id(leader: str) -> int:
    """The id of a template that the stream has found: a hash of its leader, so that it does not depend on batches."""
    return LEARNED | int.from_bytes(hashlib.blake2b(leader.encode(), digest_size=8).digest(), "little") >> 4


class Catalogue(StatefulProcessor):
    """The templates of a leaf: its leaders in order, and the template of every masked message met."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "masked string", "template_id long, template string")
        self.leaders = handle.getListState("leaders", "template_id long, template string, leader string")

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:
        """The model's catalogue; its leaders keep the order of their ids."""
        for r in rows.sort_values("template_id").itertuples(index=False):
            self.known.updateValue((r.masked,), (int(r.template_id), r.template))
            if r.masked == r.leader:
                self.leaders.appendValue((int(r.template_id), r.template, r.leader))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[int, int]] = {}
        for pdf in rows:
            for masked, micros, at in zip(pdf["masked"], pdf["micros"].tolist(), pdf["id"].tolist()):
                seen[masked] = min(seen.get(masked, (micros, at)), (micros, at))
        leaders, out = None, []
        for masked in sorted(seen, key=seen.get):
            if self.known.containsKey((masked,)):
                template_id, template = self.known.getValue((masked,))
                out.append((masked, int(template_id), template, False))
                continue
            leaders = [tuple(x) for x in self.leaders.get()] if leaders is None else leaders
            found = self._similar(masked, leaders)
            if found is None:
                found = (learned_id(masked), masked, masked)
                leaders.append(found)
                self.leaders.appendValue(found)
            self.known.updateValue((masked,), (int(found[0]), found[1]))
            out.append((masked, int(found[0]), found[1], True))
        yield pd.DataFrame(out, columns=["masked", "template_id", "template", "learned"])

    def _similar(self, masked: str, leaders: list[tuple]) -> tuple | None:
        """The earliest leader that is similar enough; all have as many tokens."""
        if not leaders:
            return None
        own, heads = coded([masked_tokens(masked)], [masked_tokens(x[2]) for x in leaders])
        hit = np.flatnonzero((heads == own[0]).sum(axis=1) >= self.threshold * own.shape[1])
        return leaders[hit[0]] if len(hit) else None

    def close(self) -> None:
        pass


class Firsts(StatefulProcessor):
    """A block's earliest mentions in order. What is later than all of them is appended, only a latecomer rewrites the list."""

    def __init__(self, cap: int, idle_ms: int | None):
        self.cap, self.idle_ms = cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "micros long, id long, mask string")
        self.last = handle.getValueState("last", "n int, micros long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, *last = self.last.get() if self.last.exists() else (0, -(1 << 62), 0)
        new = sorted(((int(a), int(b), c) for pdf in rows for a, b, c in zip(pdf["micros"], pdf["id"], pdf["mask"])), key=lambda x: x[:2])
        late = [x for x in new if list(x[:2]) <= last]
        if late:
            new = sorted([*(tuple(x) for x in self.entries.get()), *new], key=lambda x: x[:2])[:self.cap]
            self.entries.put(new)
        else:
            new = new[:self.cap - n]
            if new:
                self.entries.appendList(new)
        if new:
            self.last.update((len(new) if late else n + len(new), *new[-1][:2]))
        if self.idle_ms:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        held = [tuple(x) for x in self.entries.get()]
        yield pd.DataFrame({"first_block": [key[0]], "micros": [[x[0] for x in held]], "ids": [[x[1] for x in held]],
                            "masks": [[x[2] for x in held]]})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        """Forget a block without news for so long."""
        self.entries.clear()
        self.last.clear()
        yield pd.DataFrame({"first_block": [], "micros": [], "ids": [], "masks": []})

    def close(self) -> None:
        pass


def earliest(cap: int) -> Callable:
    """Cut the rows of a task to the earliest ``cap`` of each block."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows > 50_000:
                held = [_first(pd.concat(held), cap)]
                rows = len(held[0])
                if rows > 25_000:  # many blocks: pass them on, the next step cuts again
                    yield held.pop()
                    rows = 0
        if held:
            yield _first(pd.concat(held), cap)

    return cut


def _first(pdf: pd.DataFrame, cap: int) -> pd.DataFrame:
    return pdf.sort_values(["micros", "id"]).groupby("block_id", sort=False).head(cap)


def known_masks(logs: DataFrame, templates: DataFrame, depth: int = DEPTH, threshold: float = SIM_THRESHOLD) -> DataFrame:
    """Stream of the batch's masked messages with their templates, which the leaves' state knows or learns."""
    masked = logs.select(mask_template(F.col("raw_message")).alias("masked"), F.unix_micros("timestamp").alias("micros"), "id")

    def different(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(["micros", "id"]).drop_duplicates("masked")

    leaf = leaf_key(F.col("masked"), depth).alias("leaf")
    first = templates.select(leaf, "masked", "template_id", "template", "leader").groupBy("leaf")
    return masked.mapInPandas(different, "masked string, micros long, id long").select("*", leaf).groupBy(
        "leaf").transformWithStateInPandas(Catalogue(threshold), KNOWN, "append", "none", initialState=first)


def block_firsts(logs: DataFrame, cap: int = HISTORY_CAP, idle_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Stream of the touched blocks with their earliest ``cap`` mentions.

    Mentions are cut in the tasks that read them and once more in ``groups`` tasks a block, so a block's state
    is handed at most ``cap * groups`` rows, however hot the block is.
    """
    seen = mentions(logs).select("block_id", F.unix_micros("timestamp").alias("micros"), "id",
                                 F.md5(mask_template(F.col("raw_message"))).alias("mask"))
    near = seen.mapInPandas(earliest(cap), SEEN).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)))
    cut = near.repartition("block_id", "part").drop("part").mapInPandas(earliest(cap), SEEN)
    return cut.groupBy("block_id").transformWithStateInPandas(
        Firsts(cap, idle_ms), FIRSTS, "append", "processingTime" if idle_ms else "none")


def request_chain(requests: DataFrame, model: Model, paths: dict[str, str], checkpoint: str, cap: int = HISTORY_CAP,
                  split_rows: int = SPLIT_ROWS, idle_ms: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Store, template, look back, score and raise incidents, batch by batch.

    ``requests`` has id, timestamp, source_host, log_level and raw_message. ``paths`` names the tables: ``valid`` and
    ``rejected`` logs, learned ``catalog``, ``scored`` logs, ``incidents``, and ``scratch``, whose old batches may be deleted. A
    log's history is what has arrived and is earlier; a late log takes its place for all logs to come. Known
    messages have the ids of the model's own catalogue. Every sink stores a batch under its number, so a repeated
    batch replaces itself.
    """
    scorer = load_scorer(model)
    columns = ["id", "timestamp", "source_host", "log_level", "raw_message"]
    valid, rejected = validate_logs(requests.select(*columns))
    both = valid.withColumn("reason", F.lit("")).unionByName(rejected)
    for more in (known_masks(valid, model.templates), block_firsts(valid, cap, idle_ms)):
        both = both.unionByName(more, allowMissingColumns=True)
    known = model.templates.select(*(x.split()[0] for x in CATALOG.split(", ")))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(batch, paths["scratch"], batch_id)
        rows = spark.read.schema(batch.schema).parquet(f"{paths['scratch']}/batch_id={batch_id}")
        logs = rows.where(F.col("reason") == "").select(*columns)
        append_logs(logs, paths["valid"], batch_id)
        write_batch(rows.where(F.col("reason") != "").select(*columns, "reason"), paths["rejected"], batch_id)
        masks = rows.where(F.col("masked").isNotNull()).select("masked", "template_id", "template", "learned")
        write_batch(masks.where("learned").drop("learned"), paths["catalog"], batch_id)

        own = masks.select("masked", "template_id", F.col("template").alias("parsed_template"))
        enriched = skew_join(logs.withColumn("masked", mask_template(F.col("raw_message"))), own, "masked", "id", "left", split_rows)
        learned = load_table(spark, paths["catalog"], spark.createDataFrame([], CATALOG + ", batch_id int").schema)
        every = known.unionByName(learned.where(F.col("batch_id") <= batch_id).drop("batch_id")).select(
            F.md5("masked").alias("mask"), "template_id")
        entries = rows.where(F.col("first_block").isNotNull()).select(
            F.col("first_block").alias("block_id"), F.explode(F.arrays_zip("micros", "ids", "masks")).alias("e")).select(
            "block_id", F.timestamp_micros("e.micros").alias("timestamp"), F.col("e.ids").alias("id"), F.col("e.masks").alias("mask"))
        entry = F.struct("timestamp", "id", "template_id", seq.template_token(F.col("template_id")).alias("token"))
        firsts = skew_join(entries, every, "mask", "id", "inner", split_rows).groupBy("block_id").agg(
            F.sort_array(F.collect_list(entry)).alias("first"))
        owned = with_block(with_blocks(enriched.drop("masked")))
        scored = score_histories(with_history(skew_join(owned, firsts, "block_id", "id", "left", split_rows)), scorer)
        write_batch(scored.drop("blocks"), paths["scored"], batch_id)
        done = spark.read.parquet(f"{paths['scored']}/batch_id={batch_id}")
        write_batch(incident_rows(done, F.col("timestamp")), paths["incidents"], batch_id)

    writer = both.writeStream.foreachBatch(on_batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(
        **(trigger or AVAILABLE))
    with rocksdb_state(requests.sparkSession):
        return writer.start()
