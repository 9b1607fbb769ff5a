"""Camera sessions as streams: packet parsing, session state, settings, transfers, debounce and throttle.

Every operator works on batch and streaming DataFrames alike unless it says otherwise. Event times are cast to TIMESTAMP, which
watermarks need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Packet types and the states of a session.
COMMAND, DATA, RESPONSE, EVENT = 1, 2, 3, 4
STATES = ("disconnected", "connecting", "connected", "transferring", "processing", "ready")


def little_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned number in a binary column; at counts from 1."""
    parts = [F.hex(F.substring(data, at + i, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def parse_packets(df: DataFrame, data: str = "packet") -> DataFrame:
    """Length, type, code, transaction and payload bytes; packets shorter than a header or than their length are dropped."""
    c = F.col(data)
    out = df.where(F.length(c) >= 12).withColumns({"length": little_endian(c, 1, 4), "type": little_endian(c, 5, 2), "code": little_endian(c, 7, 2), "tx": little_endian(c, 9, 4)})
    return out.where((F.col("length") <= F.length(c)) & (F.col("length") >= 12)).withColumn("payload_bytes", F.col("length") - 12).drop(data)


def next_state(state: Column, event: Column) -> Column:
    """One step of the session: an event moves a fitting state on, a disconnect ends it from anywhere."""
    step = F.when(event == "disconnect", "disconnected")
    for i, e in enumerate(("connect", "opened", "transfer", "received", "developed")):
        step = step.when((event == e) & ((state == STATES[i]) if i != 2 else state.isin("connected", "ready")), STATES[i + 1])
    return step.otherwise(state)


def _move(state: str, event: str) -> str:
    if event == "disconnect":
        return "disconnected"
    order = ("connect", "opened", "transfer", "received", "developed")
    if event in order:
        i = order.index(event)
        if state == STATES[i] or (i == 2 and state == "ready"):
            return STATES[i + 1]
    return state


def sessions(events: DataFrame) -> DataFrame:
    """X2 on a batch (device, ts, event): the state after each event, in one pass for each device."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "event"])
        state, out = "disconnected", []
        for e in part["event"]:
            state = _move(state, e)
            out.append(state)
        return part.assign(state=out)[["device", "ts", "event", "state"]]

    return events.groupBy("device").applyInPandas(run, "device string, ts timestamp, event string, state string")


def session_stream(events: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """X2 on a stream: the state after each event; a device's state goes when nothing came for ``idle`` of processing time."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = held.get[0] if held.exists else "disconnected"
        for part in parts:
            part = part.sort_values(["ts", "event"])
            out = []
            for e in part["event"]:
                state = _move(state, e)
                out.append(state)
            yield part.assign(state=out)[["device", "ts", "event", "state"]]
        held.update((state,))
        held.setTimeoutDuration(ms)

    return events.groupBy("device").applyInPandasWithState(run, "device string, ts timestamp, event string, state string", "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_settings(changes: DataFrame, keys: tuple[str, ...] = ("device", "name")) -> DataFrame:
    """The last value of each setting; an aggregate, so a stream can keep it in update mode. Ties: the larger value."""
    return changes.groupBy(*keys).agg(F.max(F.struct("ts", "value")).alias("last")).select(*keys, "last.value", F.col("last.ts").alias("ts"))


def transfers(events: DataFrame) -> DataFrame:
    """Turnaround of each transfer: (device, tx, started, finished, seconds, payload_bytes) of those that ended."""
    done = events.groupBy("device", "tx").agg(F.min(F.when(F.col("event") == "transfer", F.col("ts"))).alias("started"), F.max(F.when(F.col("event") == "developed", F.col("ts"))).alias("finished"), F.max("payload_bytes").alias("payload_bytes"))
    return done.where("started IS NOT NULL AND finished IS NOT NULL").withColumn("seconds", F.col("finished").cast("double") - F.col("started").cast("double"))


def on_batch(stream: DataFrame, hook: Callable[[DataFrame, int], None], checkpoint: str, trigger_once: bool = True):
    """Calls a hook with each micro-batch (progress, transfers, settings, live view)."""
    w = stream.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_once else w).start()


def debounced(writes: DataFrame, gap: str = "300 milliseconds", keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """The last write of each burst of a key, bursts being parted by more than gap: (keys, start, end, value, n).

    A stream needs a watermark on ts.
    """
    return writes.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.max(F.struct("ts", "value")).alias("last"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "last.value", "n")


def throttled(ticks: DataFrame, gap_ms: float = 22.0, key: str = "device") -> DataFrame:
    """Ticks (key, ts_ms) that pass: the first, then each that comes gap_ms or more after the last that passed. In order, so one pass for each key."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        last, keep = None, []
        part = part.sort_values("ts_ms")
        for t in part["ts_ms"]:
            keep.append(last is None or t - last >= gap_ms)
            if keep[-1]:
                last = t
        return part[keep][[key, "ts_ms"]]

    kind = ticks.schema[key].dataType.simpleString()
    return ticks.select(key, F.col("ts_ms").cast("double").alias("ts_ms")).groupBy(key).applyInPandas(run, f"{key} {kind}, ts_ms double")


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "10 minutes", kind: str = "event_type") -> DataFrame:
    """Counts of events in windows of event time; in a stream, windows come out once the watermark has passed them."""
    if isinstance(events.schema["ts"].dataType, T.TimestampNTZType):
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def progress(tiles: DataFrame) -> DataFrame:
    """Part of each frame that is done after each tile (frame_id, tile)."""
    w = W.partitionBy("frame_id")
    return tiles.withColumn("done", F.row_number().over(w.orderBy("tile")) / F.count(F.lit(1)).over(w))
