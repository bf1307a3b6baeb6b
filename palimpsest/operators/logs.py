"""Event logs in batch form: presence, debounced bursts, throttled touches, repeated lines, framed operation logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import DEBOUNCE_MS, JOURNAL_CAP, MAX_FRAME, PRESENCE_MS, TOUCH_MS
from palimpsest.operators import ranges


def presence(events: DataFrame, now_ms: int, ttl_ms: int = PRESENCE_MS) -> DataFrame:
    """The live rows at ``now_ms``: the last event of each (vault, device) unless it is offline or too old."""
    last = events.groupBy("vault", "device").agg(F.max_by(F.struct("name", "file", "state", "updated_ms"), F.struct("updated_ms", "seq")).alias("e"))
    return last.select("vault", "device", "e.*").where((F.col("state") != "offline") & (F.lit(now_ms) - F.col("updated_ms") < ttl_ms))


def active_peers(live: DataFrame, me: str) -> DataFrame:
    """Per vault the number of other devices that are active; devices are compared by their whole ids."""
    return live.where((F.col("device") != me) & (F.col("state") == "active")).groupBy("vault").agg(F.count_distinct("device").alias("peers"))


def suppress_echoes(frames: DataFrame, me: str) -> DataFrame:
    return frames.where(F.col("device") != me)


def debounce(events: DataFrame, key: str, ts: str, gap: str = f"{DEBOUNCE_MS // 1000} seconds") -> DataFrame:
    """One row a burst (events less than ``gap`` apart): key, started, fired (the last event plus the gap), events."""
    rows = events.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return rows.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fired"), "events")


def throttle(events: DataFrame, key: str, ts_ms: str, every_ms: int = TOUCH_MS) -> DataFrame:
    """(key, ts_ms) of the events that pass: at least ``every_ms`` after the last one that passed, not the last one.

    Events stream through their task by key and time; only the last passed time of one key is held, so a key of any
    size needs no memory of its own. Each answer depends on the one before, so a key's events take one task.
    """
    kinds = dict(events.select(key, ts_ms).dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), 0
        for part in parts:
            keep = []
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                passed = k != now or t - last >= every_ms
                if passed:
                    now, last = k, t
                keep.append(passed)
            yield part.filter(pa.array(keep))

    rows = events.select(key, F.col(ts_ms)).where(F.col(ts_ms).isNotNull())
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, ts_ms).mapInArrow(run, f"{key} {kinds[key]}, {ts_ms} {kinds[ts_ms]}")


def collapse_runs(lines: DataFrame, stream: str, order: list[str], value: str, cells: int | None = None) -> DataFrame:
    """Per stream, runs of equal lines in order: stream, run (from 0), value, and how often it was repeated after that.

    A stream is ranked cell by cell, ranges of its first order column, so one of any length is dealt over many tasks; a
    cell learns the line before it and the runs before it from one row a cell.
    """
    own = lines.select(F.col(stream).alias("s"), F.col(value).alias("v"), F.struct(*order).alias("o"), F.col(order[0]).alias("first"))
    own = own.withColumn("cell", ranges.cell_of(own, "first", cells))
    inside, between = Window.partitionBy("s", "cell").orderBy("o"), Window.partitionBy("s").orderBy("cell")
    ends = own.groupBy("s", "cell").agg(F.max_by(F.struct("v"), "o").alias("end")).select("s", "cell", F.lag("end").over(between).alias("lead"))
    near = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    met = own.alias("l").join(ends.alias("e"), near("l.s", "e.s") & near("l.cell", "e.cell")).select("l.*", "e.lead")
    before = F.when(F.row_number().over(inside) == 1, F.col("lead")).otherwise(F.lag(F.struct("v")).over(inside))
    marked = met.withColumn("new", F.when(before.isNotNull() & before["v"].eqNullSafe(F.col("v")), 0).otherwise(1).cast("long"))
    counts = marked.groupBy("s", "cell").agg(F.sum("new").alias("c")).select("s", "cell", (F.sum("c").over(between) - F.col("c")).alias("runs"))
    ranked = marked.withColumn("local", F.sum("new").over(inside)).alias("l").join(counts.alias("c"), near("l.s", "c.s") & near("l.cell", "c.cell"))
    rows = ranked.select(F.col("l.s").alias(stream), (F.col("c.runs") + F.col("l.local") - 1).alias("run"), F.col("l.v").alias(value))
    return rows.groupBy(stream, "run", value).agg((F.count(F.lit(1)) - 1).alias("repeats"))


def journal_tail(journal: DataFrame, cap: int = JOURNAL_CAP) -> DataFrame:
    """The last ``cap`` rows by time, in order."""
    return journal.orderBy(F.desc("ts"), F.desc("path")).limit(cap).orderBy("ts", "path")


# --- framed operation logs ---------------------------------------------------------------------------------------------


def frame(update: Column) -> Column:
    """An update behind its length, four bytes, least first."""
    size = F.lpad(F.hex(F.octet_length(update)), 8, "0")
    little = F.concat(*[F.substring(size, 7 - 2 * k, 2) for k in range(4)])
    return F.concat(F.unhex(little), update)


def accepted(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates that a log takes, and those too large for it; empty ones are neither."""
    size = F.octet_length("update")
    return updates.where((size > 0) & (size <= MAX_FRAME)), updates.where(size > MAX_FRAME)


def _joined(value: str) -> Column:
    """A group's binary values behind each other, in order of seq."""
    return F.expr(f"listagg({value}) WITHIN GROUP (ORDER BY seq)")


def encode_log(updates: DataFrame) -> DataFrame:
    """vault, note_key, log: each note's updates in order of seq, framed; an update that is too large for a log is an
    error, so part them by ``accepted`` first. Empty updates leave no frame."""
    size = F.octet_length("update") > MAX_FRAME
    told = F.when(size, F.raise_error(F.lit("an update is too large for a frame")).cast("binary")).otherwise(frame(F.col("update")))
    rows = updates.where(F.octet_length("update") > 0).select("vault", "note_key", "seq", told.alias("f"))
    return rows.groupBy("vault", "note_key").agg(_joined("f").alias("log"))


def split_frames(log: bytes) -> list[bytes]:
    """The updates of a log; a tail that is cut off is ignored."""
    out, at = [], 0
    while at + 4 <= len(log):
        size = int.from_bytes(log[at : at + 4], "little")
        if at + 4 + size > len(log):
            break
        out.append(log[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def decode_log(logs: DataFrame) -> DataFrame:
    """vault, note_key, seq, update of each frame."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for vault, note, log in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                frames = split_frames(log or b"")
                yield pa.RecordBatch.from_arrays([pa.array([vault] * len(frames), pa.string()), pa.array([note] * len(frames), pa.string()), pa.array(range(len(frames)), pa.int64()), pa.array(frames, pa.binary())], names=["vault", "note_key", "seq", "update"])

    return logs.select("vault", "note_key", "log").mapInArrow(split, "vault string, note_key string, seq long, update binary")


def compact_log(snapshots: DataFrame) -> DataFrame:
    """Logs of one frame, from (vault, note_key, snapshot); a snapshot that is too large is an error."""
    size = F.octet_length("snapshot") > MAX_FRAME
    good = F.when(size, F.raise_error(F.lit("the snapshot is too large for a frame"))).otherwise(frame(F.col("snapshot")))
    return snapshots.select("vault", "note_key", good.alias("log"))


def compact_notes(updates: DataFrame) -> DataFrame:
    """vault, note_key, frames, bytes, refused, log: each note's updates in order of seq as one frame.

    A note above ``MAX_FRAME`` bytes is refused: it keeps the frames it has, ``frames`` says how many, and its row has no
    log. Sizes are summed first, so the contents of a
    refused note are never gathered; there is at most one refused note for each ``MAX_FRAME`` bytes of the table.
    """
    key = ["vault", "note_key"]
    sizes = updates.groupBy(*key).agg(F.sum(F.octet_length("update")).cast("long").alias("bytes"), F.count_if(F.octet_length("update") > 0).alias("frames")).where(F.col("bytes") > MAX_FRAME)
    met = F.col("u.vault").eqNullSafe(F.col("r.vault")) & F.col("u.note_key").eqNullSafe(F.col("r.note_key"))
    small = updates.alias("u").join(F.broadcast(sizes.select(*key).alias("r")), met, "left_anti")
    snapshots = small.groupBy(*key).agg(F.coalesce(_joined("`update`"), F.lit(b"")).alias("snapshot"))
    good = compact_log(snapshots).select(*key, F.lit(1).cast("long").alias("frames"), (F.octet_length("log") - 4).cast("long").alias("bytes"), F.lit(False).alias("refused"), "log")
    return good.unionByName(sizes.select(*key, "frames", "bytes", F.lit(True).alias("refused"), F.lit(None).cast("binary").alias("log")))
