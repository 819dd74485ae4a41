"""Keyed state for rules that built-in streaming aggregates cannot express.

A micro-batch bounds what one key brings to a task at a time; between batches a key keeps only
the small state named in each schema. Rows of a batch are put in event order before they are
applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.functions.packets import is_common_port
from packetloom.operators.flows import FIVE_TUPLE
from packetloom.operators.greedy import admit_step, reset_step

EVENT_TIME = GroupStateTimeout.EventTimeTimeout


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable").reset_index(drop=True)


def _expire(state: GroupState, at_s: float) -> None:
    """Forget the key once the watermark passes ``at_s``."""
    state.setTimeoutTimestamp(int(max(at_s * 1000, state.getCurrentWatermarkMs() + 1)))


def _parts(ts: np.ndarray, last: float, idle: float) -> list[tuple[int, int, bool]]:
    """Runs of ordered times with no pause longer than ``idle``: (begin, end, starts afresh).

    A pause ends the state whether or not a time-out fired in between, so results do not depend on
    where a micro-batch ends; the time-out only frees memory.
    """
    before = np.concatenate([[last], ts[:-1]])
    fresh = ~(ts - before <= idle)  # nan: nothing came before
    begins = np.unique(np.concatenate([[0], np.flatnonzero(fresh)]))
    return [(int(a), int(b), bool(fresh[a])) for a, b in zip(begins, [*begins[1:], len(ts)])]


def _firsts(part: np.ndarray, values: np.ndarray) -> np.ndarray:
    """1 where a value shows up for the first time in its part, else 0."""
    codes, names = pd.factorize(values.astype(object))
    flags = np.zeros(len(values), dtype=np.int64)
    flags[np.unique(part * max(1, len(names)) + codes, return_index=True)[1]] = 1
    return flags


class ScanState(StatefulProcessor):
    """Ports and targets a source has met since it was last idle, spread over the buckets of two maps.

    However many targets a source has, a value of the store holds those of one bucket, and a micro-batch
    reads and writes only the buckets its own new values fall into. What a micro-batch begins and ends
    between two pauses never reaches the store: it holds the values of the last one.
    """

    BUCKETS = 1024

    def __init__(self, idle: float, origin: float):
        self.idle, self.origin = idle, origin

    def init(self, handle) -> None:
        self.handle = handle
        self.met = {"dport": handle.getMapState("ports", "bucket int", "members array<string>"),
                    "dst_ip": handle.getMapState("targets", "bucket int", "members array<string>")}
        self.total = handle.getValueState("total", "n_ports long, n_targets long, last double")

    def _new(self, column: str, values: np.ndarray, keep: bool = True) -> np.ndarray:
        """Which rows bring a value the source has not met; with ``keep`` they are remembered."""
        names, first = np.unique(values, return_index=True)
        buckets = np.array([zlib.crc32(n.encode()) % self.BUCKETS for n in names])
        flags, met = np.zeros(len(values), dtype=np.int64), self.met[column]
        for bucket in np.unique(buckets).tolist():
            here = np.flatnonzero(buckets == bucket)
            held = met.getValue((bucket,))
            members = set(held[0]) if held else set()
            fresh = [i for i in here.tolist() if names[i] not in members]
            if fresh and keep:
                met.updateValue((bucket,), (sorted(members | {str(names[i]) for i in fresh}),))
            flags[first[fresh]] = 1
        return flags

    def _forget(self) -> None:
        for met in self.met.values():
            met.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["ts_s", "pkt_id"])
        ts = pdf["ts_s"].to_numpy(dtype=float)
        n_ports, n_targets, last = self.total.get() or (0, 0, np.nan)
        parts = _parts(ts, last, self.idle)
        begins, sizes = np.array([p[0] for p in parts]), np.array([p[1] - p[0] for p in parts])
        part, held = np.repeat(np.arange(len(parts)), sizes), (n_ports, n_targets)
        goes_on, last_begin = not parts[0][2], parts[-1][0]
        values = {"dport": pdf["dport"].astype(str).to_numpy(dtype=str), "dst_ip": pdf["dst_ip"].to_numpy(dtype=str)}
        counts = []
        for (column, names), before in zip(values.items(), held):
            flags = _firsts(part, names)
            if goes_on:
                flags[:sizes[0]] = self._new(column, names[:sizes[0]], keep=len(parts) == 1)
            total = np.cumsum(flags)
            total -= np.repeat(total[begins] - flags[begins], sizes)
            if goes_on:
                total[:sizes[0]] += before
            counts.append(total)
        if parts[-1][2]:
            if n_ports:
                self._forget()
            for column, names in values.items():
                self._new(column, names[last_begin:])
        self.total.update((int(counts[0][-1]), int(counts[1][-1]), float(ts[-1])))
        self.handle.registerTimer(self._ends(float(ts[-1])))
        out = pdf.assign(src_ip=key[0], n_ports=counts[0], n_targets=counts[1])
        yield out[["pkt_id", "ts_s", "src_ip", "dst_ip", "dport", "n_ports", "n_targets"]]

    def _ends(self, last: float) -> int:
        return int((last + self.origin + self.idle) * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total = self.total.get()
        if total and self._ends(total[2]) <= timerValues.getCurrentWatermarkInMs():  # no later packet has come
            self._forget()
            self.total.clear()
        return iter(())

    def close(self) -> None:
        pass


def scan_state_stream(packets: DataFrame, idle: float = 60.0, origin: float = 0.0) -> DataFrame:
    """Running distinct ports and targets per source since it was last idle longer than ``idle``.

    ``origin`` is the epoch time of second 0.
    """
    return packets.select("pkt_id", "ts_s", "src_ip", "dst_ip", "dport", "ts").groupBy("src_ip").transformWithStateInPandas(
        ScanState(idle, origin), "pkt_id long, ts_s double, src_ip string, dst_ip string, dport int, n_ports long, n_targets long", "Append", "EventTime")


def running_flow_stream(packets: DataFrame, keys: list[str] = FIVE_TUPLE, limit: float = 60.0, idle: float = 300.0) -> DataFrame:
    """Running flow counts, duration and inter-arrival time, and the counts with the restart.

    A flow that pauses longer than ``idle`` seconds starts anew.
    """
    key_types = ", ".join(f"{k} {packets.schema[k].dataType.simpleString()}" for k in keys)
    restart = reset_step(limit)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = _in_order(frames, ["ts_s", "pkt_id"])
        ts = pdf["ts_s"].to_numpy(dtype=float)
        n, size, first, last, carried = state.get if state.exists else (0, 0, np.nan, np.nan, [])
        parts = []
        for begin, end, fresh in _parts(ts, last, idle):
            if fresh:
                n, size, first, last, carried = 0, 0, float(ts[begin]), np.nan, []
            at, out = ts[begin:end], pdf.iloc[begin:end].assign(**dict(zip(keys, key)))
            counts, segment = restart(at, np.asarray(carried, dtype=float))
            out["flow_packets"] = n + np.arange(1, len(at) + 1)
            out["flow_bytes"] = size + out["length"].to_numpy(dtype=np.int64).cumsum()
            out["flow_duration"] = at - first
            out["iat"] = np.diff(at, prepend=last)
            out["segment_packets"] = counts["flow_packet_count"]
            out["segment_duration"] = at - counts["segment_start"]
            n, size, last, carried = int(out["flow_packets"].iloc[-1]), int(out["flow_bytes"].iloc[-1]), float(at[-1]), segment.tolist()
            parts.append(out)
        state.update((n, size, float(first), last, carried))
        _expire(state, last + idle)
        yield pd.concat(parts)[["pkt_id", "ts_s", *keys, "flow_packets", "flow_bytes", "flow_duration", "iat", "segment_packets", "segment_duration"]]

    return packets.select("pkt_id", "ts_s", *keys, "length", "ts").groupBy(*keys).applyInPandasWithState(
        step, f"pkt_id long, ts_s double, {key_types}, flow_packets long, flow_bytes long, flow_duration double, iat double, "
              "segment_packets long, segment_duration double",
        "n long, size long, first double, last double, segment array<double>", "append", EVENT_TIME)


def rate_limit_stream(events: DataFrame, keys: list[str], row_id: str, max_events: int = 100, window: float = 60.0) -> DataFrame:
    """Admission per key; the state holds the admitted times still inside the window."""
    key_types = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    admit = admit_step(max_events, window)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = _in_order(frames, ["ts_s", row_id])
        out, recent = admit(pdf["ts_s"].to_numpy(dtype=float), np.asarray(state.get[0] if state.exists else []))
        state.update((recent.tolist(),))
        _expire(state, float(pdf["ts_s"].iloc[-1]) + window)
        yield pdf.assign(**dict(zip(keys, key)), **out)[[*keys, "ts_s", row_id, "admitted"]]

    return events.select(*keys, "ts_s", row_id, "ts").groupBy(*keys).applyInPandasWithState(
        step, f"{key_types}, ts_s double, {row_id} long, admitted boolean", "recent array<double>", "append", EVENT_TIME)


def decision_stream(packets: DataFrame, keep: float = 3600.0) -> DataFrame:
    """Decision memory of flows on everyday ports: the first packet decides, later ones are
    dropped as known benign until the flow was silent for ``keep`` seconds."""
    key_types = ", ".join(f"{k} {packets.schema[k].dataType.simpleString()}" for k in FIVE_TUPLE)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = _in_order(frames, ["ts_s", "pkt_id"])
        ts = pdf["ts_s"].to_numpy(dtype=float)
        decision = np.full(len(pdf), "cached_benign", dtype=object)
        for begin, _, fresh in _parts(ts, state.get[0] if state.exists else np.nan, keep):
            if fresh:
                decision[begin] = "common_port"
        state.update((float(ts[-1]),))
        _expire(state, float(ts[-1]) + keep)
        yield pdf.assign(**dict(zip(FIVE_TUPLE, key)), decision=decision)[["pkt_id", *FIVE_TUPLE, "decision"]]

    fast = packets.where(is_common_port(F.col("sport")) | is_common_port(F.col("dport")))
    return fast.select("pkt_id", "ts_s", *FIVE_TUPLE, "ts").groupBy(*FIVE_TUPLE).applyInPandasWithState(
        step, f"pkt_id long, {key_types}, decision string", "last double", "append", EVENT_TIME)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Best tier, then newest alert, of each packet that has one; used per micro-batch."""
    candidates = candidates.where("tier is not null")
    rank = F.struct((-F.col("tier")).alias("t"), F.col("alert_ts"), F.col("event_no"))
    return candidates.groupBy("pkt_id").agg(F.max(rank).alias("b")).select(
        "pkt_id", (-F.col("b.t")).alias("tier"), F.col("b.event_no").alias("event_no"))


Scorer = Callable[[DataFrame], DataFrame]
