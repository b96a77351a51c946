"""Stateful streams: the table registry, codec profiles, and a sink that may be tried again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from colsync.operators import events
from colsync.operators.blocks import Cutter
from colsync.plans.profile import LEAST_BYTES, THRESHOLD

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROFILE = "column_name string, codec int, gain double, bw double, epoch long"
REGISTRY = "table_id long, file string, packet_no long, data string"
CUT = "file string, packet_no long, block_no long, offset long, packet_len long, class boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstDefinition(StatefulProcessor):
    """Keeps the first TABLE_MAP of each table id for good, and emits it once.

    First is the least by file and packet number, as in ``rows.registry_of``,
    among those of the batch that brings the table; a definition is not taken
    back when a later batch brings an earlier file.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getValueState("first", StructType([StructField("file", StringType()), StructField("packet_no", LongType()), StructField("data", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if self._kept.exists():
            for _ in rows:
                pass
            return
        first = None
        for part in rows:
            row = part.sort_values(["file", "packet_no"]).iloc[0]
            found = str(row["file"]), int(row["packet_no"]), row["data"]
            first = found if first is None else min(first, found)
        if first is not None:
            self._kept.update(first)
            yield pd.DataFrame({"table_id": [key[0]], "file": [first[0]], "packet_no": [first[1]], "data": [first[2]]})

    def close(self) -> None:
        pass


class OpenBlock(StatefulProcessor):
    """Cuts a file as it comes in: the open block, its start and its class are carried from batch to batch.

    Packets that come before those in front of them wait in the state.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", StructType([StructField(n, LongType()) for n in ("number", "start", "kind", "next_packet", "next_offset")]))
        self._early = handle.getListState("early", StructType([StructField(n, LongType()) for n in ("packet_no", "offset", "packet_len", "kind")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        names = ["packet_no", "offset", "packet_len", "kind"]
        early = pd.DataFrame([tuple(r) for r in self._early.get()] if self._early.exists() else [], columns=names).astype("int64")
        # what has been cut is not cut again
        number, start, kind, next_packet, next_offset = self._open.get() if self._open.exists() else (-1, 0, 0, 0, 0)
        held = pd.concat([early, *(r[names].astype("int64") for r in rows)]).sort_values("packet_no").drop_duplicates("packet_no")
        held = held[held["packet_no"] >= next_packet]
        places = held["packet_no"].to_numpy()
        ready = int((places == next_packet + np.arange(len(places))).argmin()) if (places != next_packet + np.arange(len(places))).any() else len(places)
        cut, wait = held.iloc[:ready], held.iloc[ready:]
        if ready:
            ends = cut["offset"].to_numpy() + cut["packet_len"].to_numpy()
            if cut["offset"].iloc[0] != next_offset or (cut["offset"].to_numpy()[1:] != ends[:-1]).any():
                raise ValueError(f"packets of {key[0]} don't follow one another at {next_offset}")
            cutter = Cutter(self.size)
            cutter.number, cutter.start, cutter.kind = number, start, kind
            block = cutter.cut(cut["offset"].to_numpy(), cut["kind"].to_numpy())
            self._open.update((int(cutter.number), int(cutter.start), int(cutter.kind), int(next_packet + ready), int(ends[-1])))
            told = cut["kind"].map({0: False, 1: True, -1: None}).astype("boolean")
            yield pd.DataFrame({"file": key[0], "packet_no": cut["packet_no"], "block_no": block, "offset": cut["offset"], "packet_len": cut["packet_len"], "class": told})
        if len(wait) or len(early):
            self._early.clear()
        if len(wait):
            self._early.put([tuple(int(x) for x in r) for r in wait.itertuples(index=False)])

    def close(self) -> None:
        pass


class Profile(StatefulProcessor):
    """Keeps gain and speed of a column and codec, and changes them when a measurement is off enough."""

    def __init__(self, threshold: float = THRESHOLD, least: int = LEAST_BYTES):
        self.threshold, self.least = threshold, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getValueState("profile", StructType([StructField("gain", DoubleType()), StructField("bw", DoubleType()), StructField("epoch", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows)).sort_values("seq_no")
        kept = self._kept.get() if self._kept.exists() else None
        for row in parts.itertuples(index=False):
            if row.ori_len < self.least:
                continue
            gain, bw = row.ori_len / max(row.cmpr_len, 1), row.ori_len / max(row.seconds, 1e-9)
            if kept is None or abs(gain - kept[0]) > self.threshold * abs(kept[0]) or abs(bw - kept[1]) > self.threshold * abs(kept[1]):
                kept = (gain, bw, int(row.seq_no))
        if kept is not None:
            self._kept.update(tuple(kept))
            yield pd.DataFrame({"column_name": [key[0]], "codec": [key[1]], "gain": [kept[0]], "bw": [kept[1]], "epoch": [int(kept[2])]})

    def close(self) -> None:
        pass


class Bandwidth(StatefulProcessor):
    """The bandwidth of the last send that counts; a link that is idle falls back by a timer of processing time."""

    def __init__(self, start: float, least: int, idle: float):
        self.start, self.least, self.idle = start, least, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._known = handle.getValueState("known", StructType([StructField("bandwidth", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows))
        big = parts[(parts["n_bytes"] >= self.least) & (parts["seconds"] > 0)].sort_values("at")
        if len(big):
            last = big.iloc[-1]
            self._known.update((float(last["n_bytes"] / last["seconds"]),))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(self.idle * 1000)))
        yield self._row(key, self._known.get()[0] if self._known.exists() else self.start, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._known.clear()
        yield self._row(key, self.start, True)

    def _row(self, key, bandwidth: float, idle: bool) -> pd.DataFrame:
        return pd.DataFrame({"link": [key[0]], "bandwidth": [bandwidth], "idle": [idle]})

    def close(self) -> None:
        pass


def bandwidth_stream(sends: DataFrame, by: list[str], start: float, least: int = 0, idle: float = 5.0) -> DataFrame:
    """``link, bandwidth, idle`` after each batch of a link's sends (``at, n_bytes, seconds``), and when it has been idle for ``idle`` seconds.

    Sends of under ``least`` bytes don't count; ``start`` holds before the first
    and after a pause.  A link is one column, its name a string.  Its timers keep
    a stream going, so its trigger is an interval: with ``availableNow`` it never ends.
    """
    return sends.groupBy(*by).transformWithStateInPandas(Bandwidth(start, least, idle), "link string, bandwidth double, idle boolean", "Update", "ProcessingTime")


def observed(rows: DataFrame, name: str, size: str) -> DataFrame:
    """The rows, with their number and the sum of ``size`` told to whoever listens under this name (see ``report``)."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


class _Report(StreamingQueryListener):
    def __init__(self, name: str, hook: Callable[[int, dict], None]):
        self.name, self.hook = name, hook

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.hook(event.progress.batchId, found.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def report(spark: SparkSession, name: str, hook: Callable[[int, dict], None]) -> StreamingQueryListener:
    """Call ``hook(batch, values)`` with what ``observed`` counts under a name in each batch of a stream; ``removeListener`` ends it."""
    listener = _Report(name, hook)
    spark.streams.addListener(listener)
    return listener


def registry_stream(packets: DataFrame) -> DataFrame:
    """The first definition of each table as it comes in: ``table_id, file, packet_no, data`` (hex)."""
    maps = events.view(events.headers(packets), "TABLE_MAP").selectExpr("table_id", "file", "packet_no", "hex(data) AS data")
    return maps.groupBy("table_id").transformWithStateInPandas(FirstDefinition(), REGISTRY, "Append", "None")


def block_stream(index: DataFrame, size: int) -> DataFrame:
    """The block of each packet of a stream, as ``blocks.bound_blocks`` gives them: ``file, packet_no, block_no, offset, packet_len, class``.

    ``index`` has all but the block.  Packets may come in any batches and any
    order; each goes out as soon as all in front of it have come.  What a file has
    in one batch is held by one task, so the rate of the source bounds it.
    """
    rows = index.select("file", "packet_no", "offset", "packet_len", F.coalesce(F.col("class").cast("int"), F.lit(-1)).alias("kind"))
    return rows.groupBy("file").transformWithStateInPandas(OpenBlock(size), CUT, "Append", "None")


def profile_stream(measured: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_BYTES) -> DataFrame:
    """The profile after each batch: ``column_name, codec, gain, bw, epoch`` of the pairs that it measured.

    ``measured`` has ``seq_no, column_name, codec, ori_len, cmpr_len, seconds``.
    """
    return measured.groupBy("column_name", "codec").transformWithStateInPandas(Profile(threshold, least), PROFILE, "Update", "None")


def package_sink(packages: DataFrame, path: str, checkpoint: str, timeout: int | None = None, **trigger) -> StreamingQuery:
    """Write what there is to a folder by batch; a batch that is tried again replaces itself.

    ``timeout`` waits so many seconds for the end and raises if it isn't reached.
    Unless a trigger is given, the stream takes what is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = packages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    if timeout is not None and not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout} seconds")
    return query


def event_counts_stream(packets: DataFrame) -> DataFrame:
    """Running counts of events by kind."""
    return events.event_counts(events.headers(packets))
