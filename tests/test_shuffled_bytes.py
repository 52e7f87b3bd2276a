"""Steps that many queries share: right rows, and plans that read and shuffle their input only a few times."""
import random

from pyspark.sql import functions as F

from panelloom.functions.lineage import cut
from panelloom.operators import events as ev, intervals as iv, sequences as sq, uncertainty as un

LOG = ("cell_id string, seq long, timestamp_s double, v_raw_V double, i_raw_A double, t_cell_degC double, soc_est double, "
       "delta_q_Ah double, EFC double")
SPINE = "cell_id string, checkup_k int, checkup_k_next int, window_start_s double, window_end_s double, parameter_set int, replicate_id int"


def panel(spark, seed=3):
    """A log with ties, null values, long gaps and chunks without samples; two cells of three intervals."""
    r = random.Random(seed)
    log, spine = [], []
    for c in ("a", "b"):
        t = 0.0
        for i in range(120):
            t += r.choice([0.0, 5.0, 20.0, 400.0])
            log.append((c, i, t, r.choice([None, 3.5, 4.2]), r.choice([None, 0.0, 2.0, 2.0, 2.0, -5.0]), r.uniform(0, 40), None if i % 9 == 0 else float(i),
                        None if i % 4 == 0 else float(i), float("nan") if i % 5 == 0 else i / 6))
        bounds = [-1.0, t / 3, t / 2, t]
        spine += [(c, k, k + 1, bounds[k], bounds[k + 1], 7, 1) for k in range(3)]
    return spark.createDataFrame(log, LOG), spark.createDataFrame(spine, SPINE), log, spine


def expected(log, spine, limit):
    """Rows of one event after another, by a plain loop."""
    out = []
    for c, k, _, lo, hi, *_ in spine:
        index, last = -1, None
        for x in sorted((x for x in log if x[0] == c and lo < x[2] <= hi), key=lambda x: (x[2], x[1])):
            state = "unknown" if x[4] is None else "rest" if abs(x[4]) <= 0.05 else "charge" if x[4] > 0 else "discharge"
            gap = x[2] - last[0] if last else 0.0
            if last is None or state != last[1] or gap > limit:
                index += 1
                if out and out[-1]["at"][:2] == (c, k):
                    out[-1]["next"] = gap
                out.append({"at": (c, k, index), "type": state, "rows": [], "gap": gap, "next": None})
            out[-1]["rows"].append(x)
            out[-1]["gap"] = max(out[-1]["gap"], gap)
            last = (x[2], state)
    return out


def test_run_events_equal_a_plain_loop_over_chunk_borders(spark):
    log, spine, rows, intervals = panel(spark)
    ids = ["parameter_set", "replicate_id"]
    for chunk_s in (7.0, 300.0, 86400.0):
        lim = ev.EventLimits(chunk_s=chunk_s)
        want = expected(rows, intervals, lim.max_gap_s)
        bucketed = iv.range_join(log, spine, cols=ids, width=chunk_s, bucket="_chunk")
        frames = ev.run_events(bucketed, lim, chunk="_chunk", counted=True), ev.run_events(iv.range_join(log, spine, cols=ids), lim)
        assert frames[0].columns == [*frames[1].columns, "event_count"]
        for frame in frames:
            got = {(r["cell_id"], r["checkup_k"], r["event_index"]): r for r in frame.collect()}
            assert set(got) == {w["at"] for w in want} and len(got) == len(want)
            for w in want:
                r, xs = got[w["at"]], w["rows"]
                value = lambda j: [x[j] for x in xs if x[j] is not None and x[j] == x[j]]  # noqa: E731, B023
                assert (r["event_type"], r["source_rows"], r["event_start_s"], r["event_end_s"], r["max_gap_s"]) == (w["type"], len(xs), xs[0][2], xs[-1][2], w["gap"])
                assert r["min_voltage_V"] == min(value(3), default=None) and r["max_soc"] == max(value(6), default=None)
                assert r["delta_q_Ah"] == (value(7)[-1] - value(7)[0] if value(7) else None)
                assert r["delta_EFC"] == (value(8)[-1] - value(8)[0] if value(8) else None)
                assert ("gap_gt_300s" in r["quality_flags"]) == (w["next"] is not None and w["next"] > lim.max_gap_s)
                assert "event_count" not in frame.columns or r["event_count"] == sum(v["at"][:2] == w["at"][:2] for v in want)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_folded_runs_are_shuffled_once_and_vectors_not_at_all(spark):
    log, spine, _, _ = panel(spark)
    log, spine = cut(log), cut(spine)
    bucketed = iv.range_join(log, spine, cols=["parameter_set", "replicate_id"], width=86400.0, bucket="_chunk")
    events = ev.run_events(bucketed, chunk="_chunk", counted=True)
    wide = [x for x in plan(events).split("\n") if "Exchange hashpartitioning" in x]
    assert len(wide) <= 7, wide                 # twice the two sides of the join, chunk rows by interval and by chunk, folded runs
    assert "Exchange" not in plan(sq.event_vectors(cut(events), sq.TENSOR_V2))


def test_correlations_read_their_rows_a_few_times(spark):
    r = random.Random(5)
    rows = [(f"s{i % 2}", r.choice([0.1, 0.2, r.random()]), r.random(), r.getrandbits(48)) for i in range(300)]
    df = cut(spark.createDataFrame(rows, "scope string, x double, y double, row_id long"))
    found = un.correlations(df, ["scope"], "x", "y", "row_id")
    assert plan(found).count("FileScan parquet") <= 15
    for got in found.collect():
        mine = [x for x in rows if x[0] == got["scope"]]
        place = lambda j: {x: i for i, x in enumerate(sorted(mine, key=lambda x: (x[j], x[3])), 1)}  # noqa: E731, B023
        a, b, n = place(1), place(2), len(mine)
        assert got["n"] == n
        assert abs(got["spearman_ordinal"] - (1 - 6 * sum((a[x] - b[x]) ** 2 for x in mine) / (n * (n * n - 1)))) < 1e-9
