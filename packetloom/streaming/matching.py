"""Two-sided alert match on streams: packets wait until every alert that counts for them has arrived.

A packet's alerts are those of the last ``window`` seconds before it, whenever they arrive. Packets are
held by key (address pair and both addresses) until the watermark passes them; with two feeds it follows
the slower one. All keys of a packet release it in the same micro-batch, where its best alert is chosen.

What a key holds lies in chunks, each the rows of one arriving frame as one value of a map: appending
never touches what is held already, and a value is no larger than a frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from packetloom.operators.fusion import as_events
from packetloom.streaming.jobs import batch_table, run_batches

PACKET = ["src_ip", "dst_ip", "sport", "dport", "proto", "length"]
SPREAD = 2  # parts of a key: packets are dealt over them, alerts go to each
CHUNK = "number long, first long, last long"  # place and earliest and latest ``at`` of its rows
ALERTS = pa.schema([("at", pa.int64()), ("ts_s", pa.float64()), ("row_no", pa.int64()), ("up", pa.bool_()), ("signature", pa.string()), ("severity", pa.int32())])
WAITING = pa.schema([("at", pa.int64()), ("ts_s", pa.float64()), ("row_no", pa.int64()), ("up", pa.bool_()), ("src_ip", pa.string()), ("dst_ip", pa.string()),
                     ("sport", pa.int32()), ("dport", pa.int32()), ("proto", pa.int32()), ("length", pa.int32())])
FOUND = "pkt_id long, ts_s double, tier int, alert_ts double, event_no long, signature string, severity int, " \
        "src_ip string, dst_ip string, sport int, dport int, proto int, length int"


class _Chunks:
    """Rows of one schema in a map of the state store, a chunk per value."""

    def __init__(self, handle, name: str, schema: pa.Schema):
        self.schema, self.map = schema, handle.getMapState(name, CHUNK, "rows binary")

    def keys(self) -> list[tuple[int, int, int]]:
        return sorted(tuple(key) for key in self.map.keys())

    def put(self, number: int, rows: pa.Table) -> None:
        at = rows["at"].to_numpy()
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, self.schema) as writer:
                writer.write_table(rows)
            self.map.updateValue((number, int(at.min()), int(at.max())), (sink.getvalue().to_pybytes(),))

    def add(self, number: int, frame: pd.DataFrame) -> None:
        # whole numbers that share a column with nulls come as floats
        self.put(number, pa.Table.from_pandas(frame[self.schema.names], schema=self.schema, preserve_index=False))

    def get(self, key: tuple[int, int, int]) -> pa.Table:
        with pa.ipc.open_stream(bytes(self.map.getValue(key)[0])) as reader:
            return reader.read_all()

    def remove(self, key: tuple[int, int, int]) -> None:
        self.map.removeKey(key)


class AlertMatch(StatefulProcessor):
    """Waiting packets and recent alerts of one key, in chunks of the state store."""

    def __init__(self, window: float):
        self.window = window

    def init(self, handle) -> None:
        self.handle = handle
        self.alerts = _Chunks(handle, "alerts", ALERTS)
        self.waiting = _Chunks(handle, "waiting", WAITING)
        self.number = handle.getValueState("number", "next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, number = None, (self.number.get() or (0,))[0]
        for frame in rows:
            packets, alerts = frame[frame["is_packet"]], frame[~frame["is_packet"]]
            for held, some in ((self.alerts, alerts), (self.waiting, packets)):
                if len(some):
                    held.add(number, some)
                    number += 1
            # packets are due at their time, alerts are of no use a window later
            due = int(min([packets["at"].min()] * (len(packets) > 0) + [alerts["at"].min() + int(self.window * 1000) + 1] * (len(alerts) > 0)))
            first = due if first is None else min(first, due)
        self.number.update((number,))
        self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, chunks = self.alerts.keys(), self.waiting.keys()
        due = [c for c in chunks if c[1] <= now]
        alerts = self._sides(key[1], [self.alerts.get(a) for a in held]) if due else None
        waits = [c[1] for c in chunks if c[1] > now]
        for chunk in due:
            rows = self.waiting.get(chunk)
            self.waiting.remove(chunk)
            at = rows["at"].to_numpy()
            if chunk[2] > now:
                rest = rows.filter(pa.array(at > now))
                self.waiting.put(chunk[0], rest)
                waits.append(int(rest["at"].to_numpy().min()))
                rows = rows.filter(pa.array(at <= now))
            yield self._best(key[1], rows, alerts)
        # later packets come after the watermark, those that wait do already
        edge = min([now, *waits]) - (self.window + 1) * 1000
        for old in [a for a in held if a[2] < edge]:
            self.alerts.remove(old)
        ahead = waits + [int(a[2] + (self.window + 2) * 1000) for a in held if a[2] >= edge]
        if ahead:  # a timer of this very moment would be dropped with the one that fired
            self.handle.registerTimer(max(min(ahead), now + 1))

    def _sides(self, is_pair: bool, chunks: list[pa.Table]) -> dict:
        """Alerts by time, then number; those of a pair by direction."""
        frame = pa.concat_tables([ALERTS.empty_table(), *chunks]).to_pandas(types_mapper={pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}.get)
        frame = frame.sort_values(["ts_s", "row_no"], kind="stable")
        up = frame["up"].to_numpy(dtype=bool)
        return {True: frame[up], False: frame[~up]} if is_pair else {None: frame}

    def _best(self, is_pair: bool, due: pa.Table, alerts: dict) -> pd.DataFrame:
        """One row per packet, with the best alert of this key or none."""
        ts, up = due["ts_s"].to_numpy(), due["up"].to_numpy(zero_copy_only=False)
        tier, parts = np.zeros(len(ts), dtype=np.int32), []
        for side, of in alerts.items():
            times = of["ts_s"].to_numpy(dtype=float)
            at = np.searchsorted(times, ts, side="right") - 1
            hit = at >= 0
            hit[hit] = ts[hit] - times[at[hit]] <= self.window
            own = np.where(up == side, 1, 2) if is_pair else np.full(len(ts), 3)
            better = hit & ((tier == 0) | (own < tier))
            tier[better] = own[better]
            parts.append((of, at, own))
        out = due.to_pandas(types_mapper={pa.int32(): pd.Int32Dtype()}.get).rename(columns={"row_no": "pkt_id"})
        out["tier"] = pd.array(tier, dtype="Int32")
        out.loc[tier == 0, "tier"] = pd.NA
        columns = {"alert_ts": "ts_s", "event_no": "row_no", "signature": "signature", "severity": "severity"}
        types = {"alert_ts": "Float64", "event_no": "Int64", "signature": object, "severity": "Int32"}
        for name, column in columns.items():
            out[name] = pd.Series([None] * len(out), dtype=types[name])
            for of, at, own in parts:
                chosen = tier == own
                if chosen.any():
                    out.loc[chosen, name] = of[column].take(at[chosen]).astype(types[name]).to_numpy(dtype=object, na_value=None)
        return out[[f.split()[0] for f in FOUND.split(", ")]]

    def close(self) -> None:
        pass


def match_stream(packets: DataFrame, alerts: DataFrame, window: float = 30.0, spread: int = SPREAD, origin: float = 0.0) -> DataFrame:
    """Rows (``FOUND``) of every packet, one per key it belongs to, once the watermark has passed it.

    Both streams carry ``ts_s`` and the event time ``ts`` with a watermark; ``origin`` is the epoch time of
    second 0. Packets of one key are dealt over ``spread`` parts, so that a busy address is no single state.
    """
    ends = lambda a, b: F.array_distinct(F.array(F.col(a), F.col(b)))
    pair = lambda a, b: F.concat_ws("|", F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b)))
    blank = [F.lit(None).cast(t).alias(c) for c, t in zip(PACKET, ["string", "string", "int", "int", "int", "int"])]

    def keyed(df: DataFrame, a: str, b: str, parts) -> DataFrame:
        entries = F.concat(F.array(F.struct(pair(a, b).alias("k"), F.lit(True).alias("is_pair"))),
                           F.transform(ends(a, b), lambda ip: F.struct(ip.alias("k"), F.lit(False).alias("is_pair"))))
        named = df.withColumn("up", F.col(a) <= F.col(b)).select("*", F.explode(entries).alias("e")).select("*", F.explode(parts).alias("part"))
        return named.select("e.k", "e.is_pair", F.lit(float(origin)).alias("origin"), "part", F.floor((F.unix_micros("ts") + 999) / 1000).alias("at"), "ts", "ts_s", "row_no", "up",
                            "is_packet", "signature", "severity", *PACKET)

    p = packets.select("ts", "ts_s", F.col("pkt_id").alias("row_no"), F.lit(True).alias("is_packet"), F.lit(None).cast("string").alias("signature"),
                       F.lit(None).cast("int").alias("severity"), *PACKET)
    a = alerts.select("ts", "ts_s", F.col("event_no").alias("row_no"), F.lit(False).alias("is_packet"), "signature", "severity",
                      F.col("src_ip").alias("a_ip"), F.col("dest_ip").alias("b_ip"), *blank)
    both = keyed(p, "src_ip", "dst_ip", F.array(F.pmod(F.col("row_no"), F.lit(spread)).cast("int"))).unionByName(
        keyed(a, "a_ip", "b_ip", F.array(*[F.lit(i) for i in range(spread)])))
    return both.groupBy("k", "is_pair", "origin", "part").transformWithStateInPandas(AlertMatch(window), FOUND, "Append", "EventTime")


def best_events(found: DataFrame) -> DataFrame:
    """One packet event per packet of a micro-batch: its best tier, then the newest alert."""
    hit = F.when(F.col("tier").isNotNull(), F.struct((-F.col("tier")).alias("tier"), "alert_ts", "event_no", "signature", "severity"))
    best = found.groupBy("pkt_id").agg(F.max(hit).alias("best"), F.max(F.struct("ts_s", *PACKET)).alias("p")).select(
        "pkt_id", "p.*", (-F.col("best.tier")).alias("tier"), "best.signature", "best.severity")
    return as_events(best)


def events_to_table(packets: DataFrame, alerts: DataFrame, path: str, checkpoint: str, window: float = 30.0, origin: float = 0.0) -> None:
    """Match what has landed of both feeds and append the released packet events to a table."""
    run_batches(match_stream(packets, alerts, window, origin=origin), checkpoint, lambda df, i: batch_table(best_events(df), path, i))
