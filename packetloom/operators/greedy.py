"""Rules whose outcome for one row depends on what was decided for the rows before it.

The 60-second flow restart and the rate limit walk a key's rows in time order with a small state; a
task streams many keys. A key with more rows than one task should walk is cut into chunks of time:

* the flow restart knows the state at the start of every chunk beforehand. Where a chunk's last segment
  starts depends on the entering segment only through the first row past its limit, so a chunk is a
  short step function (``transfer``), functions of neighbouring chunks compose to one, and the states
  come back down the same tree. All chunks are then walked at the same time;
* the rate limit walks every busy period as a key of its own. Only a single period beyond the bound is
  walked chunk after chunk, each reading its own rows and the times still inside the window.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.timeline import cut_points, session_cells, with_chunk
from packetloom.session import materialise

SLICE_ROWS_CONF = "packetloom.sliceRows"
DEFAULT_SLICE_ROWS = 5_000_000
FAN = 8  # neighbouring chunks composed by one task

# (timestamps in order, carried state) -> (one output column per name, new state)
Step = Callable[[np.ndarray, np.ndarray], tuple[dict[str, np.ndarray], np.ndarray]]


def _slice_rows(df: DataFrame, slice_rows: int | None) -> int:
    return slice_rows or int(df.sparkSession.conf.get(SLICE_ROWS_CONF, str(DEFAULT_SLICE_ROWS)))


def _key_runs(pdf: pd.DataFrame, keys: list[str]) -> list[int]:
    """Start positions of the runs of equal keys in sorted rows."""
    changed = np.zeros(len(pdf), dtype=bool)
    changed[0] = True
    for k in keys:
        values = pdf[k].where(pdf[k].notna(), None).to_numpy(dtype=object)
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed).tolist()


def _same_key(a: tuple, b: tuple) -> bool:
    return all((pd.isna(x) and pd.isna(y)) or x == y for x, y in zip(a, b))


def _folder(keys: list[str], ts: str, out_names: list[str], columns: list[str], step: Step, keep_state: bool):
    """Partition function: walk sorted rows batch by batch, one state at a time.

    A row with ``_state`` and no id carries a key's state in and sorts first among its rows; with
    ``keep_state`` the same kind of row carries it out.
    """
    def state_row(key: tuple, state: np.ndarray) -> dict:
        return {**dict(zip(keys, key)), "_state": state.tolist()}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, np.empty(0)
        for pdf in batches:
            if not len(pdf):
                continue
            starts = _key_runs(pdf, keys)
            times, carried = pdf[ts].to_numpy(dtype=float), pdf["_state"].to_numpy(dtype=object)
            key_values = list(zip(*[pdf[k].iloc[starts] for k in keys])) if keys else [()]
            parts: dict[str, list[np.ndarray]] = {n: [] for n in out_names}
            real, states = [], []
            for this, start, stop in zip(key_values, starts, [*starts[1:], len(pdf)]):
                if key is None or not _same_key(this, key):
                    if key is not None and keep_state:
                        states.append(state_row(key, state))
                    key, state = this, np.empty(0)
                if carried[start] is not None:
                    state = np.asarray(carried[start], dtype=float)
                    start += 1
                if start == stop:
                    continue
                out, state = step(times[start:stop], state)
                for n in out_names:
                    parts[n].append(out[n])
                real.append(np.arange(start, stop))
            if real:
                rows = pdf.iloc[np.concatenate(real)].drop(columns="_state")
                yield rows.assign(_state=None, **{n: np.concatenate(v) for n, v in parts.items()})[columns]
            if states:
                yield pd.DataFrame(states).reindex(columns=columns)
        if key is not None and keep_state:
            yield pd.DataFrame([state_row(key, state)]).reindex(columns=columns)

    return fold


def _folded(rows: DataFrame, keys: list[str], ts: str, row_id: str, out_types: dict[str, T.DataType], step: Step,
            carried: DataFrame | None = None, keep_state: bool = False) -> DataFrame:
    """Run ``step`` over every key's rows in (ts, id) order, from the state ``carried`` has for it.

    Spark shuffles by key and sorts; a task then streams its keys through Arrow batches, so a
    task's memory does not depend on how many rows a key has. With ``keep_state`` rows without an id
    hold the last state of every key in ``_state``.
    """
    base = rows.select(*keys, ts, row_id)
    state_type = T.ArrayType(T.DoubleType())
    part = base.withColumn("_state", F.lit(None).cast(state_type))
    if carried is not None:
        part = part.unionByName(carried.select(*keys, "_state"), allowMissingColumns=True)
    schema = T.StructType([
        *[base.schema[k] for k in keys], T.StructField(ts, T.DoubleType()), base.schema[row_id], T.StructField("_state", state_type),
        *[T.StructField(n, t) for n, t in out_types.items()]])
    for f in schema.fields:
        f.nullable = True
    fold = _folder(keys, ts, list(out_types), schema.names, step, keep_state)
    order = [*keys, F.col("_state").isNull(), ts, row_id]
    folded = part.repartition(*keys).sortWithinPartitions(*order).mapInPandas(fold, schema)
    return folded if keep_state else folded.drop("_state")


def _parted(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``most`` rows, and those of the others (None: there are none)."""
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    large = large.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_large"))
    if not large.limit(1).count():
        return rows, None
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    marked = rows.join(large, same, "left").drop(*[f"_{k}" for k in keys])
    return marked.where("_large is null").drop("_large"), marked.where("_large").drop("_large")


def reset_step(limit: float) -> Step:
    """Flow restarts after the first row more than ``limit`` seconds past its start."""

    def step(ts: np.ndarray, state: np.ndarray):
        start_at = np.empty(len(ts))
        count = np.empty(len(ts), dtype=np.int64)
        i = 0
        origin, seen = (state[0], int(state[1])) if len(state) else (np.nan, 0)
        while i < len(ts):
            if seen == 0:
                origin = ts[i]
            # the segment ends with its first row past the limit, found without visiting the rest
            end = int(np.searchsorted(ts[i:] - origin, limit, side="right")) + i
            stop = min(end + 1, len(ts))
            start_at[i:stop] = origin
            count[i:stop] = np.arange(seen + 1, seen + 1 + stop - i)
            seen = 0 if end < len(ts) else seen + stop - i
            i = stop
        carried = np.array([origin, seen]) if seen else np.empty(0)
        return {"segment_start": start_at, "flow_packet_count": count}, carried

    return step


def _first_past(times: np.ndarray, origins: np.ndarray, limit: float) -> np.ndarray:
    """For every origin the first of the ordered times with ``time - origin > limit``."""
    at = np.searchsorted(times, origins + limit, side="right")
    padded = np.concatenate([[-np.inf], times, [np.inf]])  # time i stands at i + 1
    while True:  # the sum above may round to the other side of a time
        back = padded[at] - origins > limit
        ahead = ~back & ~(padded[at + 1] - origins > limit)
        if not (back.any() or ahead.any()):
            return at
        at = at - back + ahead


class Transfer:
    """What a chunk does to the segment open at its start: (origin, rows seen) in, the same out.

    Nothing open (origin nan) leads to ``origin[0], seen[0]``. Else the first bound more than the limit
    past the origin selects the outcome; without one the segment runs through and sees ``n`` more.
    """

    def __init__(self, bound: np.ndarray, origin: np.ndarray, seen: np.ndarray, n: int, start: float):
        self.bound, self.origin, self.seen, self.n, self.start = bound, origin, seen, n, start

    @classmethod
    def of(cls, ts: np.ndarray, limit: float) -> "Transfer":
        """The transfer of ordered times."""
        n = len(ts)
        past = _first_past(ts, ts, limit)
        # the last segment that a segment starting at a row leads to; n: the chunk ends between two
        leads = np.append(np.where(past < n, past + 1, np.arange(n)), n)
        while True:
            further = leads[leads]
            if np.array_equal(further, leads):
                break
            leads = further
        origin = np.append(ts, np.nan)[leads]
        seen = np.where(leads < n, n - leads, 0)
        last = min(int(past[0]), n - 1)  # no origin lies past the first row
        return cls(np.concatenate([[-np.inf], ts[:last + 1]]), origin[:last + 2], seen[:last + 2], n, float(ts[0])).merged()

    def merged(self) -> "Transfer":
        """Neighbouring bounds with one outcome as one."""
        last = np.ones(len(self.bound), bool)
        last[1:-1] = (self.seen[1:-1] != self.seen[2:]) | (self.origin[1:-1] != self.origin[2:])
        last[1:-1] &= ~(np.isnan(self.origin[1:-1]) & np.isnan(self.origin[2:]))
        return Transfer(self.bound[last], self.origin[last], self.seen[last], self.n, self.start)

    def apply(self, origin: np.ndarray, seen: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.isnan(origin)
        at = np.where(fresh, 0, 1 + _first_past(self.bound[1:], np.where(fresh, 0, origin), limit))
        through = at == len(self.bound)
        at = np.where(through, 0, at)
        return np.where(through, origin, self.origin[at]), np.where(through, seen + self.n, self.seen[at])

    def then(self, other: "Transfer", limit: float) -> "Transfer":
        """Both one after the other."""
        origin, seen = other.apply(self.origin, self.seen, limit)
        bound = np.concatenate([self.bound, other.bound[1:]])
        origin, seen = np.concatenate([origin, other.origin[1:]]), np.concatenate([seen, other.seen[1:]])
        needed = 1 + min(len(bound) - 1, int(np.argmax(np.append(bound - self.start > limit, True))))
        return Transfer(bound[:needed], origin[:needed], seen[:needed], self.n + other.n, self.start).merged()


def _chunk_states(rows: DataFrame, keys: list[str], ts: str, limit: float, chunks: int) -> DataFrame:
    """(keys, _chunk, _state) at the start of every chunk of a key; no state: nothing open.

    Transfers are composed in groups of ``FAN`` neighbours until one group is left, which starts with
    nothing open; the states then go down level by level. A task holds ``FAN`` transfers of a key, each
    with at most the rows of one limit-long span.
    """
    key_types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    table = f"{key_types}, _chunk int, bound double, origin double, seen long, n long, start double"

    def named(key: tuple, chunk: int, t: Transfer) -> pa.Table:
        size = len(t.bound)
        columns = {k: pa.array([v.as_py()] * size, v.type) for k, v in zip(keys, key)}
        return pa.table({**columns, "_chunk": pa.array([chunk] * size, pa.int32()), "bound": t.bound, "origin": t.origin,
                         "seen": pa.array(t.seen, pa.int64()), "n": pa.array([t.n] * size, pa.int64()), "start": [t.start] * size})

    def children(group: pa.Table) -> Iterator[tuple[int, Transfer]]:
        group = group.sort_by([("_chunk", "ascending"), ("bound", "ascending")])
        chunk = group.column("_chunk").to_numpy()
        bound, origin, seen, n, start = (group.column(c).to_numpy() for c in ("bound", "origin", "seen", "n", "start"))
        cuts = np.flatnonzero(np.diff(chunk, prepend=-2))
        for a, b in zip(cuts, [*cuts[1:], len(chunk)]):
            yield int(chunk[a]), Transfer(bound[a:b], origin[a:b], seen[a:b], int(n[a]), float(start[a]))

    def first(key: tuple, group: pa.Table) -> pa.Table:
        return named(key[:-1], key[-1].as_py(), Transfer.of(np.sort(group.column(ts).to_numpy()), limit))

    def composed(key: tuple, group: pa.Table) -> pa.Table:
        return named(key[:-1], key[-1].as_py(), functools.reduce(lambda a, b: a.then(b, limit), [t for _, t in children(group)]))

    def entered(key: tuple, group: pa.Table) -> pa.Table:
        state, found = (np.array([np.nan]), np.array([0])), []
        for chunk, t in children(group):
            if chunk < 0:  # the state the group starts with
                state = t.origin, t.seen
                continue
            found.append((chunk, float(state[0][0]), int(state[1][0])))
            state = t.apply(*state, limit)
        columns = {k: pa.array([v.as_py()] * len(found), v.type) for k, v in zip(keys, key)}
        chunk, origin, seen = zip(*found)
        return pa.table({**columns, "_chunk": pa.array(chunk, pa.int32()), "origin": pa.array(origin), "seen": pa.array(seen, pa.int64())})

    up = F.floor(F.col("_chunk") / FAN).cast("int").alias("_up")
    levels = [materialise(rows.select(*keys, "_chunk", ts).groupBy(*keys, "_chunk").applyInArrow(first, table), "transfers")]
    while chunks > FAN:
        chunks = -(-chunks // FAN)
        levels.append(materialise(levels[-1].groupBy(*keys, up).applyInArrow(composed, table), "transfers"))
    states = None
    for level in reversed(levels):
        grouped = level.select("*", up)
        if states is not None:
            begin = states.select(*keys, F.col("_chunk").alias("_up"), "origin", "seen").select(
                "*", F.lit(-1).alias("_chunk"), F.lit(float("-inf")).alias("bound"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("start"))
            grouped = grouped.unionByName(begin)
        states = grouped.groupBy(*keys, "_up").applyInArrow(entered, f"{key_types}, _chunk int, origin double, seen long")
    kept = F.when(F.isnan("origin"), F.array().cast("array<double>")).otherwise(F.array("origin", F.col("seen").cast("double")))
    return states.select(*keys, "_chunk", kept.alias("_state"))


def flow_reset(packets: DataFrame, keys: list[str], limit: float = 60.0, slice_rows: int | None = None) -> DataFrame:
    """Running packet count, duration and rate per flow with the ``limit``-second restart.

    A flow with more than ``slice_rows`` packets is cut into chunks that are walked at the same time.
    """
    out = {"segment_start": T.DoubleType(), "flow_packet_count": T.LongType()}
    most, step = _slice_rows(packets, slice_rows), reset_step(limit)
    few, many = _parted(packets.select("pkt_id", *keys, "ts_s"), keys, most)
    folded = _folded(few, keys, "ts_s", "pkt_id", out, step)
    if many is not None:
        cuts = cut_points(many, "ts_s", most)
        chunked = with_chunk(many, cuts)
        states = _chunk_states(chunked, keys, "ts_s", limit, len(cuts.points) + 1)
        folded = folded.unionByName(_folded(chunked, [*keys, "_chunk"], "ts_s", "pkt_id", out, step, states).drop("_chunk"))
    duration = F.col("ts_s") - F.col("segment_start")
    return folded.select(
        "pkt_id", *keys, "ts_s", "flow_packet_count", duration.alias("flow_duration"),
        F.when(duration > 0, F.col("flow_packet_count") / duration).otherwise(F.lit(0.0)).alias("packet_rate"))


def admit_step(max_events: int, window: float) -> Step:
    """Admit while fewer than ``max_events`` admitted events are younger than ``window``.

    The event admitted ``max_events`` after another is the first that is ``window`` later, or the one
    behind the last admitted. So the ring of the last admissions yields the next ring at once: the first
    events past each member, moved on where several members name the same one.
    """
    place = np.arange(max_events)

    def step(ts: np.ndarray, state: np.ndarray):
        admitted = np.zeros(len(ts), dtype=bool)
        ring = np.concatenate([np.full(max_events - len(state), -np.inf), np.asarray(state, dtype=float)])
        last, reach = -1, np.nextafter(window, -np.inf)  # an age above ``reach`` is one of at least ``window``
        while True:
            next_up = np.where(np.isinf(ring), 0, _first_past(ts, np.where(np.isinf(ring), 0, ring), reach))
            chosen = np.maximum(np.maximum.accumulate(next_up - place), last + 1) + place
            inside = chosen[chosen < len(ts)]
            admitted[inside] = True
            ring = np.concatenate([ring[len(inside):], ts[inside]])
            if len(inside) < max_events:
                break
            last = int(inside[-1])
        if len(ts):  # what left the window by the last event never counts again
            ring = ring[ts[-1] - ring < window]
        return {"admitted": admitted}, ring[~np.isinf(ring)]

    return step


def rate_limit(events: DataFrame, keys: list[str], ts: str, row_id: str, max_events: int = 100,
               window: float = 60.0, slice_rows: int | None = None) -> DataFrame:
    """Admission per (event type, id): rejected events do not use up the limit.

    A pause of ``window`` empties the state. Busy periods with at most ``max_events`` events are
    admitted whole, from counts alone; fuller ones are walked, each on its own.
    """
    most, out, step = _slice_rows(events, slice_rows), {"admitted": T.BooleanType()}, admit_step(max_events, window)
    cells = session_cells(events, keys, ts, window, F.count(F.lit(1)).alias("n"), inclusive=True)
    per_period = Window.partitionBy(*keys, "_session")
    full = cells.withColumn("period_n", F.sum("n").over(per_period)).where(F.col("period_n") > max_events).select(
        *keys, F.col("_cell").alias("slot"), F.col("_session").alias("period"), "period_n")
    slotted = events.select(*keys, ts, row_id).withColumn("slot", F.floor(F.col(ts) / F.lit(float(window))))
    marked = slotted.join(full, [*keys, "slot"], "left").drop("slot")
    named = [*keys, ts, row_id, "admitted"]
    result = marked.where("period is null").withColumn("admitted", F.lit(True)).select(named)
    walked = marked.where("period is not null")
    result = result.unionByName(
        _folded(walked.where(F.col("period_n") <= most), [*keys, "period"], ts, row_id, out, step).select(named))
    if not full.where(F.col("period_n") > most).limit(1).count():
        return result
    return result.unionByName(_walked_in_turn(
        walked.where(F.col("period_n") > most), [*keys, "period"], ts, row_id, out, step, most).select(named))


def _walked_in_turn(rows: DataFrame, keys: list[str], ts: str, row_id: str, out: dict[str, T.DataType], step: Step, most: int) -> DataFrame:
    """Walk chunk after chunk. Rows are written once by chunk, so that each is read by its own turn."""
    cuts = cut_points(rows, ts, most)
    salt = F.pmod(F.xxhash64(row_id), F.lit(16))
    chunked = with_chunk(rows.select(*keys, ts, row_id), cuts).repartition("_chunk", salt)
    chunked, done, carried = materialise(chunked, "periods", by="_chunk"), None, None
    for i in range(len(cuts.points) + 1):
        part = materialise(_folded(chunked.where(F.col("_chunk") == i), keys, ts, row_id, out, step, carried, True), "turn")
        carried = part.where(F.col("_state").isNotNull())
        decided = part.where(F.col("_state").isNull()).drop("_state")
        done = decided if done is None else done.unionByName(decided)
    return done
