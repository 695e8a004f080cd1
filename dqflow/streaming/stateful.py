"""Keyed stream operators whose result does not depend on how a feed is cut into micro-batches.

Rows wait in state until the watermark has passed them, then they are handled in
event-time order together with their key's memory.  Keys are dealt to buckets by
hash and a bucket shares one state and one timer, so a call handles many keys at
once.  The timer on the earliest waiting row wakes a bucket when no new row
arrives, and otherwise drops memory that has expired.  State holds at most the
rows of one watermark delay.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from dqflow.operators.alerts import QUIET
from dqflow.streaming.windows import event_time

# Python workers get the functions below by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "waiting binary, memory binary"
#: Buckets that keys are dealt to.  A checkpoint belongs to one number of buckets.
BUCKETS = 1024


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().to_pandas()


def _millis(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64") // 1000


def _in_parts(keys: list, rows: pd.DataFrame, ts: str, order: list, longest: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by key and order, where each part begins, whether it is its key's first one, and every row's part.

    A pause longer than the memory lasts splits the rows of a key, whether or not a timer has come between them.
    """
    number = rows.groupby(keys, dropna=False, sort=False).ngroup()
    rows = rows.assign(_key=number).sort_values(["_key", *order], kind="stable")
    other = (rows.pop("_key").diff() != 0).to_numpy()
    new = other | (_millis(rows[ts]).diff() > longest).to_numpy()
    begins = np.flatnonzero(new)
    return rows, begins, other[begins], new.cumsum() - 1


def in_event_order(stream: DataFrame, keys, ts: str, order: list, delay: str, fold: Callable, output: str, keep_ms: int,
                   buckets: int = BUCKETS) -> DataFrame:
    """``fold(rows, part, memory)`` over the rows of many keys, each row exactly once and in order of ``order`` within its key.

    ``part`` numbers the key of every row (rows of a key follow each other; a long pause makes it another part) and
    ``memory`` has one value or None for each part: what ``fold`` returned for the key before.  It returns the output
    rows and the values to remember.  These are needed until ``keep_ms`` after the key's last row.
    Rows later than the watermark are dropped by it; rows it has not passed yet stay in state.  Rows with a
    NULL time never become due and are dropped as well.
    """
    keys, columns = list(keys), stream.columns

    def handle(bucket, frames, state):
        mark = state.getCurrentWatermarkMs()
        waiting, memory = state.get if state.exists else (None, None)
        memory = _unpacked(memory) if memory else pd.DataFrame(columns=[*keys, "value", "until"])
        parts = [*([_unpacked(waiting)] if waiting else []), *[f[columns] for f in frames if len(f)]]
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
        if len(rows):
            rows = rows[rows[ts].notna()]
            due = _millis(rows[ts]) < mark
            ready, rows = rows[due], rows[~due]
            if len(ready):
                ready, begins, first, part = _in_parts(keys, ready, ts, order, keep_ms)
                times, ends = _millis(ready[ts]).to_numpy(), np.append(begins[1:], len(ready)) - 1
                owners = ready[keys].iloc[begins].reset_index(drop=True)
                known = owners.merge(memory.astype({"value": object}), "left", keys) if len(memory) else owners.assign(value=None, until=None)
                live = first & (pd.to_numeric(known["until"]).to_numpy(dtype=float) >= times[begins])
                out, values = fold(ready, part, [v if ok else None for v, ok in zip(known["value"], live)])
                fresh = owners.assign(value=pd.Series(values, dtype=object), until=times[ends] + keep_ms)
                fresh = fresh[np.append(first[1:], True)]
                memory = pd.concat([fresh, memory.astype({"value": object})]).drop_duplicates(keys) if len(memory) else fresh
                yield out
        memory = memory[memory["value"].notna() & (memory["until"] >= mark)]
        if len(rows) or len(memory):
            state.update((_packed(rows) if len(rows) else None, _packed(memory) if len(memory) else None))
            state.setTimeoutTimestamp(max(mark, int(_millis(rows[ts]).min())) if len(rows) else int(memory["until"].min()))
        elif state.exists:
            state.remove()

    marked = event_time(stream, ts, delay).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return marked.groupBy("_bucket").applyInPandasWithState(handle, output, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def suppress_stream(alerts: DataFrame, keys, ts: str, event: str, delay: str, minutes: int = 60) -> DataFrame:
    """The suppression of ``alerts.suppress`` as a stream: keys, event, time, ``suppressed`` and ``quiet_hours``.

    An alert is suppressed when the one before it under the same key is at most ``minutes`` older.
    """
    keys = list(keys)
    quiet = QUIET

    def fold(rows, part, memory):
        times = rows[ts].astype("datetime64[us]")
        micros = times.astype("int64").to_numpy()
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        known = np.array([m is not None for m in memory])
        gap = np.diff(micros, prepend=0)
        gap[begins] = [t - m if m is not None else 0 for t, m in zip(micros[begins], memory)]
        seen = np.ones(len(rows), bool)
        seen[begins] = known
        hour = times.dt.hour.to_numpy()
        out = pd.DataFrame({
            **{k: rows[k].to_numpy() for k in keys}, event: rows[event].to_numpy(), ts: rows[ts].to_numpy(),
            "suppressed": seen & (gap <= minutes * 60_000_000), "quiet_hours": (hour >= quiet[0]) | (hour < quiet[1])})
        return out, micros[np.append(begins[1:], len(rows)) - 1].tolist()

    kinds = dict(alerts.dtypes)
    output = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{event} {kinds[event]}", f"{ts} timestamp", "suppressed boolean", "quiet_hours boolean"])
    slim = alerts.select(*keys, event, ts)
    return in_event_order(slim, keys, ts, [ts, event], delay, fold, output, minutes * 60_000)


def lifecycle_stream(events: DataFrame, delay: str, keep_hours: int = 48) -> DataFrame:
    """Legal transitions of each alert: alert_id, status, at, event_id.

    The first trigger opens an alert, the first acknowledgement of an open one and the first resolution follow; all
    other events are illegal and ignored.  An alert without events for ``keep_hours`` leaves the state.
    """
    after = {(None, "trigger"): "triggered", ("triggered", "acknowledge"): "acknowledged",
             ("triggered", "resolve"): "resolved", ("acknowledged", "resolve"): "resolved"}

    def fold(rows, part, memory):
        status, at, said = list(memory), [], []
        for i, (p, action) in enumerate(zip(part.tolist(), rows["action"])):
            reached = after.get((status[p], action))
            if reached:
                status[p] = reached
                at.append(i)
                said.append(reached)
        legal = rows.iloc[at]
        out = pd.DataFrame({"alert_id": legal["alert_id"].to_numpy(), "status": said, "at": legal["timestamp"].to_numpy(), "event_id": legal["event_id"].to_numpy()})
        return out, status

    kinds = dict(events.dtypes)
    slim = events.select("alert_id", "action", "timestamp", "event_id")
    return in_event_order(slim, ["alert_id"], "timestamp", ["timestamp", "event_id"], delay, fold,
                          f"alert_id string, status string, at timestamp, event_id {kinds['event_id']}", keep_hours * 3_600_000)


def latest_transition(transitions: DataFrame) -> DataFrame:
    """State of every alert from the stream's transitions."""
    at = {s: F.max(F.when(F.col("status") == s, F.col("at"))).alias(f"{s}_at") for s in ("triggered", "acknowledged", "resolved")}
    out = transitions.groupBy("alert_id").agg(*at.values())
    status = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise("triggered")
    return out.withColumn("status", status)
