"""Streaming counterparts of the log operators."""
from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalar as S

EVENT_OUT = "cell_id string, event_type string, event_start_s double, event_end_s double, source_rows long, max_gap_s double, quality_flags string"
EVENT_STATE = "event_type string, start_s double, end_s double, rows long, gap double, end_ms long, held string"
VIOLATION_OUT = "cell_id string, timestamp_s double, timestamp_drop_s double, efc_drop double, violation_type string"


def released(held: list, batches: Iterator[pd.DataFrame] | None, columns: list[str], watermark_ms: int) -> tuple[list, list]:
    """Rows (ts in ms, values of ``columns``) that no earlier row can precede any more, in order, and the rest.

    Rows wait until the watermark has passed them, so rows out of order within it are folded in order;
    what waits is bounded by the allowed lateness.
    """
    for rows in batches or ():
        ms = rows["ts"].astype("int64") // 10 ** 6 if str(rows["ts"].dtype).startswith("datetime64[ns") else rows["ts"].map(lambda x: int(x.timestamp() * 1000))
        held += map(list, zip(ms.tolist(), *(rows[c].tolist() for c in columns)))
    ready = sorted((r for r in held if r[0] <= watermark_ms), key=lambda r: r[:2])
    return ready, [r for r in held if r[0] > watermark_ms]


def live_events(log: DataFrame, *, max_gap_s: float = 300.0, rest: float = S.REST_CURRENT_A, late: str = "10 minutes") -> DataFrame:
    """Run events per cell from a stream with columns ts, cell_id, timestamp_s, i_raw_A.

    State is the one open event of a cell and the rows the watermark has not passed.  An event is emitted
    when the state changes, after a long gap, or when event time passes its end by the gap limit; rows
    later than the watermark are dropped.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cell, done = key[0], []
        *cur, held = state.get if state.exists else (None, "[]")
        cur: list[Any] | None = cur if cur and cur[0] is not None else None

        def close(flag: str) -> None:
            flags = [f for f in (flag, "zero_duration" if cur[2] <= cur[1] else "") if f]
            done.append((cell, cur[0], cur[1], cur[2], cur[3], cur[4], ";".join(flags)))

        watermark = state.getCurrentWatermarkMs()
        ready, waiting = released(json.loads(held), None if state.hasTimedOut else batches, ["timestamp_s", "state"], watermark)
        for ms, t, kind in ready:
            gap = 0.0 if cur is None else t - cur[2]
            if cur is not None and (kind != cur[0] or gap > max_gap_s):
                close("gap_gt_300s" if gap > max_gap_s else "")
                cur = None
            if cur is None:
                cur = [kind, t, t, 0, gap, ms]
            cur[2], cur[3], cur[4], cur[5] = t, cur[3] + 1, max(cur[4], gap), ms
        ends = int(max_gap_s * 1000)
        if cur is not None and not waiting and watermark > cur[5] + ends:
            close("")
            cur = None
        if cur is None and not waiting:
            state.remove()
        else:
            state.update((*(cur or [None, 0.0, 0.0, 0, 0.0, 0]), json.dumps(waiting)))
            state.setTimeoutTimestamp(max(min(r[0] for r in waiting) if waiting else cur[5] + ends, watermark + 1))
        yield pd.DataFrame(done, columns=["cell_id", "event_type", "event_start_s", "event_end_s", "source_rows", "max_gap_s", "quality_flags"])

    d = log.withWatermark("ts", late).withColumn("state", S.current_state(F.col("i_raw_A"), rest)).select("cell_id", "ts", "timestamp_s", "state")
    return d.groupBy("cell_id").applyInPandasWithState(run, EVENT_OUT, EVENT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_violations(log: DataFrame, *, time_eps: float = 0.0, efc_eps: float = 1e-9) -> DataFrame:
    """Rows whose time or EFC drops below the previous stored row of the cell (order: seq)."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        t, e = rows["timestamp_s"], rows["EFC"]
        pt, pe = t.shift(), e.shift()
        if state.exists:
            pt.iloc[0], pe.iloc[0] = state.get
        td, ed = (pt - t).clip(lower=0).fillna(0.0), (pe - e).clip(lower=0).fillna(0.0)
        tb, eb = td > time_eps, ed > efc_eps
        kind = pd.Series("efc_decrease", index=rows.index).mask(tb, "timestamp_decrease").mask(tb & eb, "both")
        state.update((float(t.iloc[-1]), float(e.iloc[-1])))
        out = pd.DataFrame({"cell_id": key[0], "timestamp_s": t, "timestamp_drop_s": td, "efc_drop": ed, "violation_type": kind})
        yield out[tb | eb]

    d = log.select("cell_id", "seq", "timestamp_s", "EFC")
    return d.groupBy("cell_id").applyInPandasWithState(run, VIOLATION_OUT, "t double, e double", "append", GroupStateTimeout.NoTimeout)


def live_dwell(samples: DataFrame, *, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Hours per current state and tumbling window from samples with ts, dt_h, i_raw_A."""
    d = samples.withWatermark("ts", late).withColumn("state", S.current_state(F.col("i_raw_A")))
    g = d.groupBy(F.window("ts", window).alias("w"), "cell_id", "state").agg(F.sum("dt_h").alias("hours"), F.count(F.lit(1)).alias("samples"))
    return g.select(F.col("w.start").alias("window_start"), "cell_id", "state", "hours", "samples")


def with_steps(log: DataFrame, *, max_gap_s: float = 300.0, late: str = "10 minutes") -> DataFrame:
    """Stream samples with ``dt_h`` since the previous sample of the cell.

    A sample is emitted once the watermark has passed it; state is the time of the last one emitted and
    the samples that wait.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, "[]")
        watermark = state.getCurrentWatermarkMs()
        ready, waiting = released(json.loads(held), None if state.hasTimedOut else batches, ["timestamp_s", "i_raw_A"], watermark)
        out = []
        for ms, t, current in ready:
            out.append((key[0], pd.Timestamp(ms, unit="ms"), current, 0.0 if last is None else min(t - last, max_gap_s) / 3600.0))
            last = t
        state.update((last, json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(r[0] for r in waiting), watermark + 1))
        yield pd.DataFrame(out, columns=["cell_id", "ts", "i_raw_A", "dt_h"])

    d = log.withWatermark("ts", late).select("cell_id", "ts", "timestamp_s", "i_raw_A")
    return d.groupBy("cell_id").applyInPandasWithState(run, "cell_id string, ts timestamp, i_raw_A double, dt_h double", "t double, held string", "append",
                                                       GroupStateTimeout.EventTimeTimeout)
