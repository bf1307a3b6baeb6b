"""Streams: presence with expiry, throttled touches, debounced bursts, pull echoes and operation logs.

Each has a batch form in ``operators.logs`` with the same answer on the same events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.model import DEBOUNCE_MS, MAX_FRAME, PRESENCE_MS, TOUCH_MS

#: Most subscriptions that every task gets whole.
MOST_TOLD = 1_000_000
#: Messages of a block, and subscribers that each of them is told to before the next block comes; multiples of 8, so that
#: the packed bits of Parquet's dictionary repeat by whole bytes.
BLOCK, TILE = 64, 64
FRAME = "vault string, device string, name string, file string, state string, updated_ms long"


class PresenceProcessor(StatefulProcessor):
    """Each (vault, device) holds its last frame; a timer turns it offline when nothing refreshes it in time."""

    def __init__(self, ttl_ms: int = PRESENCE_MS) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "name string, file string, state string, updated_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        frames = pd.concat([r for r in rows], ignore_index=True).sort_values(["updated_ms", "seq"], kind="stable")
        newest = frames.iloc[-1]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        file = None if newest["file"] is None or newest["file"] != newest["file"] else str(newest["file"])
        if newest["state"] == "offline":
            self.last.clear()
        else:
            self.last.update((str(newest["name"]), file, str(newest["state"]), int(newest["updated_ms"])))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield pd.DataFrame([(key[0], key[1], newest["name"], file, newest["state"], int(newest["updated_ms"]))], columns=["vault", "device", "name", "file", "state", "updated_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        held = self.last.get()
        rows = [(key[0], key[1], held[0], None, "offline", held[3])] if held else []
        self.last.clear()
        yield pd.DataFrame(rows, columns=["vault", "device", "name", "file", "state", "updated_ms"])

    def close(self) -> None:
        pass


def presence_stream(events: DataFrame, ttl_ms: int = PRESENCE_MS) -> DataFrame:
    """Frames to send: each micro-batch's last frame of a device, and offline when its time is over."""
    return events.groupBy("vault", "device").transformWithStateInPandas(statefulProcessor=PresenceProcessor(ttl_ms), outputStructType=FRAME, outputMode="Update", timeMode="ProcessingTime")


def touch_stream(events: DataFrame, every_ms: int = TOUCH_MS) -> DataFrame:
    """(device_id, ts_ms) of the touches that pass the throttle."""

    def passed(key: tuple, rows: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last, out = (state.get[0] if state.exists else None), []
        for t in sorted(int(x) for part in rows for x in part["ts_ms"]):
            if last is None or t - last >= every_ms:
                out.append((key[0], t))
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["device_id", "ts_ms"])

    return events.groupBy("device_id").applyInPandasWithState(passed, "device_id string, ts_ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def debounce_stream(events: DataFrame, key: str, ts: str, late: str = "10 seconds", gap: str = f"{DEBOUNCE_MS // 1000} seconds") -> DataFrame:
    """One row a burst of changes, when no event can join it any more."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(key, F.session_window("__ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fired"), "events")


def once_stream(events: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Each key once within a time: what a pull wrote isn't taken for a local change."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def frames(messages: DataFrame, me: str) -> DataFrame:
    """Presence and root frames of other devices, decoded from JSON text in ``value``."""
    fields = "t string, vault string, device string, name string, file string, state string, root string"
    rows = messages.select(F.from_json(F.col("value").cast("string"), fields).alias("m")).select("m.*")
    return rows.where(F.col("t").isin("root", "presence") & ((F.col("device") != me) | F.col("device").isNull()))


def sized(updates: DataFrame) -> DataFrame:
    """Updates that an operation log takes; ``oversized`` has the larger ones, and empty ones say nothing."""
    return updates.where((F.octet_length("update") > 0) & (F.octet_length("update") <= MAX_FRAME))


def oversized(updates: DataFrame) -> DataFrame:
    return updates.where(F.octet_length("update") > MAX_FRAME)


def presence_frames(live: DataFrame) -> DataFrame:
    """vault, device and value: each presence row as the JSON that subscribers get, device ids cut to twelve characters."""
    told = F.struct(F.lit(1).alias("v"), F.lit("presence").alias("t"), "vault", F.substring("device", 1, 12).alias("device"), "name", "file", "state")
    return live.select("vault", F.col("device").cast("string").alias("device"), F.to_json(told, {"ignoreNullFields": "false"}).alias("value"))


def _blocks(messages: DataFrame) -> DataFrame:
    """__vault and sent: the messages (__vault, __device, value), up to ``BLOCK`` of a vault as one array. A block's messages
    come from one Arrow batch of a task, so this moves nothing."""

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            code = part.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            runs = np.diff(first, append=len(order))
            starts = np.flatnonzero((np.arange(len(order)) - np.repeat(first, runs)) % BLOCK == 0)
            rows = part.take(pa.array(order))
            sent = pa.StructArray.from_arrays([rows.column(1), rows.column(2)], names=["__device", "value"])
            ends = pa.array(np.append(starts, len(order)), pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(starts)), pa.ListArray.from_arrays(ends, sent)], names=["__vault", "sent"])

    vault, device, value = (messages.schema[c].dataType for c in ("__vault", "__device", "value"))
    sent = T.ArrayType(T.StructType().add("__device", device).add("value", value))
    return messages.mapInArrow(gather, T.StructType().add("__vault", vault).add("sent", sent))


def fan_out(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """subscriber and value: each message (vault, device, value) for everyone who follows its vault (vault, subscriber),
    but a device's own presence not for itself. None is lost, however slow a subscriber is.

    A few vaults may have most of the messages and of the subscribers, so the messages are dealt evenly over the tasks, and
    all subscriptions go to each task; above ``MOST_TOLD`` of them the vaults are parted by lots, each with all that
    follow it.

    The rows may be far more than all that is read, so up to ``MOST_TOLD`` they come in an order that files hold in few
    bytes: a block's messages, one after another, to the same few subscribers, then to the next ones."""
    spark = messages.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = messages.select(F.col("vault").alias("__vault"), F.col("device").alias("__device"), "value").where("__vault IS NOT NULL")
    told, same = subscribers.select("vault", "subscriber"), F.col("vault") == F.col("__vault")
    if told.limit(MOST_TOLD + 1).count() <= MOST_TOLD:
        every = told.groupBy("vault").agg(F.collect_list(F.struct("subscriber")).alias("told"))  # bare ones would lose nulls
        tiles = every.select("vault", F.explode(F.transform(F.sequence(F.lit(1), F.size("told"), F.lit(TILE)), lambda i: F.slice("told", i, TILE))).alias("told"))
        tiles = tiles.select("vault", F.transform("told", lambda t: t["subscriber"]).alias("told"))
        cells = _blocks(own.repartition(parts)).join(F.broadcast(tiles), same).select("vault", "sent", "told")
        # compiled into one loop with the join, a task would hold all rows of a block; this parts the two and moves nothing
        met = cells.coalesce(8 * parts).select("vault", "told", F.inline("sent")).select("vault", "__device", "value", F.explode("told").alias("subscriber"))
    else:
        own = own.withColumn("__lot", F.pmod(F.xxhash64("__device", "value"), F.lit(8 * parts)))
        told = told.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8 * parts - 1).cast("long"))))
        met = told.join(own, same & (F.col("lot") == F.col("__lot")))
    return met.where(~F.col("subscriber").eqNullSafe(F.col("__device"))).select("subscriber", "vault", "value")


def presence_snapshot(live: DataFrame, subscribers: DataFrame) -> DataFrame:
    """What a fresh subscriber learns at once: who else is in its vaults."""
    return fan_out(presence_frames(live), subscribers)


def fan_out_stream(messages: DataFrame, subscribers: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands each micro-batch's messages for each subscriber to ``write``, with the batch's number; the
    subscribers are asked for anew with every batch."""
    return messages.writeStream.foreachBatch(lambda batch, n: write(fan_out(batch, subscribers()), n))


def log_stream(updates: DataFrame, path: str) -> DataStreamWriter:
    """A writer of the operation log: accepted updates below ``path``/updates, refused ones below ``path``/refused, a
    folder a micro-batch. A batch that is run again replaces its folders, so nothing is written twice."""

    def put(batch: DataFrame, n: int) -> None:
        for name, rows in (("updates", sized(batch)), ("refused", oversized(batch))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")

    return updates.writeStream.foreachBatch(put)


def root_changes(pointers: DataFrame) -> DataFrame:
    """A frame for each move of a vault's current version, from rows (vault, root_hash, seq)."""
    return pointers.select(F.to_json(F.struct(F.lit("root").alias("t"), "vault", F.col("root_hash").alias("root"))).alias("value"))
