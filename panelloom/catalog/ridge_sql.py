"""SQL of the ridge arms: row-level encoding, normal equations and Gauss-Jordan steps in a recursive table.

``ridge_tables(prefix, source, targets, groups, arms)`` registers the tables of one panel; ``<prefix>_pred`` then
holds the predictions (split_name, heldout_fold, feature_group, target, arm, parameter_set, rid, y_true, y_pred).
"""
from __future__ import annotations

from ..operators.splits import SPLITS
from .base import table
from .state_queries import _case

RATE = _case("nominal_charge_C_rate", [(1.0, "<1C"), (1.5, "1C-1.5C"), (5.0 / 3.0, "1.5C-5over3C")], ">=5over3C")
MODEL = "split_name, heldout_fold, target"


def ridge_tables(prefix: str, source: str, targets: dict[str, str], groups: dict[str, tuple], alpha: float = 1.0, residuals: bool = False) -> None:
    """``targets`` maps names to SQL expressions over ``source``."""
    p = prefix
    numeric = list(dict.fromkeys(n for a, _ in groups.values() for n in a))
    categorical = list(dict.fromkeys(c for _, b in groups.values() for c in b))
    table(f"{p}_rows", f"SELECT row_number() OVER () AS rid, * FROM ({source})")
    wide = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in numeric)
    table(f"{p}_num", f"SELECT rid, f, x FROM (SELECT rid, {wide} FROM {p}_rows) UNPIVOT (x FOR f IN ({', '.join(numeric)})) WHERE isfinite(x)")
    cats = " UNION ALL ".join(f"SELECT rid, '{c}' AS col, '{c}=' || coalesce({c}::VARCHAR, 'unknown') AS f FROM {p}_rows" for c in categorical) or f"SELECT rid, '' AS col, '' AS f FROM {p}_rows WHERE false"
    table(f"{p}_cat", cats)
    table(f"{p}_y", " UNION ALL ".join(f"SELECT rid, '{t}' AS target, CAST({e} AS DOUBLE) AS y FROM {p}_rows WHERE ({e}) IS NOT NULL AND isfinite(CAST({e} AS DOUBLE))" for t, e in targets.items()))
    table(f"{p}_fold", " UNION ALL ".join(f"SELECT rid, '{s}' AS split_name, {s} AS fold FROM {p}_rows WHERE {s} IS NOT NULL" for s in SPLITS))
    table(f"{p}_held", f"SELECT DISTINCT split_name, fold AS heldout_fold FROM {p}_fold WHERE split_name = 'condition_fold' OR fold <> 0")
    table(f"{p}_train", f"SELECT h.split_name, h.heldout_fold, y.target, y.rid, y.y FROM {p}_held h JOIN {p}_fold s ON s.split_name = h.split_name AND s.fold <> h.heldout_fold JOIN {p}_y y ON y.rid = s.rid")
    table(f"{p}_gs", f"SELECT f, coalesce(nullif(stddev_pop(x), 0), 1.0) AS gs FROM {p}_num GROUP BY f")
    table(f"{p}_stat", f"SELECT {MODEL}, f, avg(x) AS m, CASE WHEN stddev_pop(x) > 3.2e-7 * max(gs) THEN stddev_pop(x) ELSE max(gs) END AS s FROM {p}_train JOIN {p}_num USING (rid) JOIN {p}_gs USING (f) GROUP BY ALL")
    table(f"{p}_z", f"""SELECT {MODEL}, rid, f, (x - m) / s AS z FROM {p}_train JOIN {p}_num USING (rid) JOIN {p}_stat USING ({MODEL}, f)
UNION ALL SELECT {MODEL}, rid, f, 1.0::DOUBLE FROM {p}_train JOIN {p}_cat USING (rid)""")
    table(f"{p}_n", f"SELECT {MODEL}, count(*) AS n, avg(y) AS my FROM {p}_train GROUP BY ALL")
    table(f"{p}_side", f"SELECT {MODEL}, f, sum(z) AS sz, sum(z * y) AS szy FROM {p}_z JOIN {p}_train USING ({MODEL}, rid) GROUP BY ALL")
    table(f"{p}_gram", f"SELECT a.split_name, a.heldout_fold, a.target, a.f, b.f AS g, sum(a.z * b.z) AS v FROM {p}_z a JOIN {p}_z b ON a.split_name = b.split_name AND a.heldout_fold = b.heldout_fold AND a.target = b.target AND a.rid = b.rid GROUP BY ALL")
    member = [f"SELECT '{g}' AS feature_group, '{n}' AS f" for g, (a, _) in groups.items() for n in a]
    member += [f"SELECT DISTINCT '{g}' AS feature_group, f FROM {p}_cat WHERE col = '{c}'" for g, (_, b) in groups.items() for c in b]
    table(f"{p}_member", " UNION ALL ".join(member))
    key = f"{MODEL}, feature_group"
    table(f"{p}_feature", f"SELECT {key}, f, sz, szy, row_number() OVER (PARTITION BY {key} ORDER BY f) AS i, count(*) OVER (PARTITION BY {key}) AS p FROM {p}_side JOIN {p}_member USING (f)")
    table(f"{p}_system", f"""SELECT {', '.join('a.' + c for c in key.split(', '))}, a.p, a.i, b.i AS j, coalesce(g.v, 0) - a.sz * b.sz / n + CASE WHEN a.i = b.i THEN {alpha}::DOUBLE ELSE 0 END AS v
FROM {p}_feature a JOIN {p}_feature b USING ({key}) JOIN {p}_n USING ({MODEL}) LEFT JOIN {p}_gram g ON g.split_name = a.split_name AND g.heldout_fold = a.heldout_fold AND g.target = a.target AND g.f = a.f AND g.g = b.f
UNION ALL SELECT {key}, p, i, 0, szy - sz * my FROM {p}_feature JOIN {p}_n USING ({MODEL})""")
    table(f"{p}_solved", f"""WITH RECURSIVE gj AS (SELECT 0 AS k, {key}, p, i, j, v FROM {p}_system
UNION ALL SELECT k + 1, {key}, p, i, j, CASE WHEN i = k + 1 THEN v / vkk ELSE v - vik * vkj / vkk END FROM (SELECT *,
max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY {key}, i) AS vik, max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY {key}, j) AS vkj,
max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER (PARTITION BY {key}) AS vkk FROM gj WHERE k < p))
SELECT {key}, i, v AS beta FROM gj WHERE k = p AND j = 0""")
    table(f"{p}_coef", f"SELECT {key}, f, beta, sz FROM {p}_feature JOIN {p}_solved USING ({key}, i)")
    table(f"{p}_base", f"SELECT {key}, max(my) - sum(beta * sz) / max(n) AS b0 FROM {p}_coef JOIN {p}_n USING ({MODEL}) GROUP BY ALL")
    table(f"{p}_test", f"SELECT h.split_name, h.heldout_fold, y.target, y.rid, y.y FROM {p}_held h JOIN {p}_fold s ON s.split_name = h.split_name AND s.fold = h.heldout_fold JOIN {p}_y y ON y.rid = s.rid")
    table(f"{p}_zt", f"""SELECT {MODEL}, rid, f, (x - m) / s AS z FROM {p}_test JOIN {p}_num USING (rid) JOIN {p}_stat USING ({MODEL}, f)
UNION ALL SELECT {MODEL}, rid, f, 1.0::DOUBLE FROM {p}_test JOIN {p}_cat USING (rid)""")
    fit = lambda z, side: (f"SELECT {key}, rid, y, b0 + coalesce(q, 0) AS y_pred FROM {side} JOIN {p}_base USING ({MODEL}) "  # noqa: E731
                           f"LEFT JOIN (SELECT {key}, rid, sum(beta * z) AS q FROM {z} JOIN {p}_coef USING ({MODEL}, f) GROUP BY ALL) USING ({key}, rid)")
    table(f"{p}_fit", fit(f"{p}_zt", f"{p}_test"))
    attributes = f"SELECT rid, parameter_set, nominal_temperature_C AS t, {RATE} AS r, voltage_window_family AS w, profile_label AS l, aging_mode AS a FROM {p}_rows"
    table(f"{p}_att", attributes)
    if residuals:
        table(f"{p}_res", f"SELECT {key}, rid, y - y_pred AS e FROM ({fit(f'{p}_z', f'{p}_train')})")
        table(f"{p}_glob", f"SELECT {key}, avg(e) AS ge FROM {p}_res GROUP BY ALL")
        table(f"{p}_bias", f"SELECT {key}, t, w, r, avg(e) AS be FROM {p}_res JOIN {p}_att USING (rid) GROUP BY ALL")
        pools = " UNION ALL ".join(f"SELECT rid, '{c}' AS pool, coalesce({c}::VARCHAR, 'unknown') AS value FROM {p}_att" for c in "trwla")
        table(f"{p}_pools", pools)
        table(f"{p}_pooled", f"SELECT {key}, pool, value, sum(e) / (count(*) + 5.0::DOUBLE) AS o FROM {p}_res JOIN {p}_pools USING (rid) GROUP BY ALL HAVING count(*) >= 3")
        table(f"{p}_offset", f"SELECT {key}, rid, avg(o) AS o FROM {p}_fit JOIN {p}_pools USING (rid) JOIN {p}_pooled USING ({key}, pool, value) GROUP BY ALL")
        table(f"{p}_pred", f"""WITH f AS (SELECT {key}, rid, y, y_pred, ge, be, o, my FROM {p}_fit JOIN {p}_att USING (rid) JOIN {p}_glob USING ({key}) JOIN {p}_n USING ({MODEL}) LEFT JOIN {p}_offset USING ({key}, rid)
LEFT JOIN {p}_bias b USING ({key}, t, w, r))
SELECT {key}, arm, parameter_set, rid, y AS y_true, p AS y_pred, p - y AS e FROM (SELECT {key}, rid, y, 'plain' AS arm, y_pred AS p FROM f UNION ALL SELECT {key}, rid, y, 'bias', y_pred + coalesce(be, ge) FROM f
UNION ALL SELECT {key}, rid, y, 'pooled', y_pred + coalesce(o, ge) FROM f UNION ALL SELECT {key}, rid, y, 'mean', my FROM f) JOIN {p}_att USING (rid)""")
    else:
        table(f"{p}_pred", f"SELECT {key}, 'plain' AS arm, parameter_set, rid, y AS y_true, y_pred, y_pred - y AS e FROM {p}_fit JOIN {p}_att USING (rid)")


def metrics_sql(prefix: str, names: dict[str, str]) -> str:
    """Metrics of the arms; ``names`` maps arms to model levels."""
    k = "split_name, heldout_fold, model_level, feature_group, target"
    level = "CASE arm " + " ".join(f"WHEN '{a}' THEN '{m}'" for a, m in names.items()) + " END"
    pred = f"SELECT *, {level} AS model_level FROM {prefix}_pred WHERE arm IN ({', '.join(repr(a) for a in names)})"
    return f"""SELECT * FROM (SELECT {k}, count(*) AS test_rows, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM ({pred}) GROUP BY ALL)
JOIN (SELECT {k}, avg(c) AS condition_mean_mae, max(c) AS worst_condition_mae FROM (SELECT {k}, parameter_set, avg(abs(e)) AS c FROM ({pred}) GROUP BY ALL) GROUP BY ALL) USING ({k})"""


def board_sql(metrics: str) -> str:
    return (f"SELECT split_name, model_level, feature_group, target, count(*) AS fold_count, avg(condition_mean_mae) AS condition_mean_mae, max(worst_condition_mae) AS worst_condition_mae "
            f"FROM ({metrics}) GROUP BY ALL")


def gain_sql(board: str, candidate: str, reference: str, by: str, same_group: bool = True) -> str:
    """Candidate against reference arms of one board; ``by`` joins them."""
    on = " AND ".join(f"c.{x} = r.{x}" for x in by.split(", "))
    group = " AND c.feature_group = r.feature_group" if same_group else ""
    keys = ", ".join(f"c.{x}" for x in by.split(", "))
    return f"""SELECT {keys}, c.model_level AS candidate_model_level, c.feature_group AS candidate_feature_group, r.model_level AS reference_model_level, r.feature_group AS reference_feature_group,
r.condition_mean_mae - c.condition_mean_mae AS gain, CASE WHEN abs(r.condition_mean_mae) > 1e-12 THEN (r.condition_mean_mae - c.condition_mean_mae) / r.condition_mean_mae END AS relative_gain,
r.condition_mean_mae - c.condition_mean_mae > 1e-12::DOUBLE AS beats_reference FROM ({board}) c JOIN ({board}) r ON {on}{group} WHERE c.model_level = '{candidate}' AND r.model_level = '{reference}'"""


def _fit_tables(p: str, key: str, rows: str, num: str, cat: str, sums: dict[str, str], alpha: float = 1.0) -> None:
    """Tables ``<p>_coef`` and ``<p>_base`` of one ridge for each ``key`` and weighting: ``rows`` (key, rid, y, weights), ``num``
    (key or part of it, rid, f, x, gs) and ``cat`` (rid, f) give the encoding; ``sums`` maps weightings to row weights."""
    join = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key.split(", "))
    table(f"{p}_stat", f"SELECT {key}, f, avg(x) AS m, CASE WHEN stddev_pop(x) > 3.2e-7 * max(gs) THEN stddev_pop(x) ELSE max(gs) END AS s FROM {rows} JOIN {num} USING ({_shared(num, key)}) GROUP BY ALL")
    weights = ", ".join(f"{e} AS w_{n}" for n, e in sums.items())
    table(f"{p}_z", f"""SELECT {key}, rid, y, f, (x - m) / s AS z, {weights} FROM {rows} JOIN {num} USING ({_shared(num, key)}) JOIN {p}_stat USING ({key}, f)
UNION ALL SELECT {key}, rid, y, f, 1.0::DOUBLE, {weights} FROM {rows} JOIN {cat} USING (rid)""")
    table(f"{p}_n", " UNION ALL ".join(f"SELECT {key}, '{n}' AS fit, sum({e}) AS n, sum({e} * y) / sum({e}) AS my FROM {rows} GROUP BY ALL" for n, e in sums.items()))
    table(f"{p}_side", " UNION ALL ".join(f"SELECT {key}, '{n}' AS fit, f, sum(w_{n} * z) AS sz, sum(w_{n} * z * y) AS szy FROM {p}_z GROUP BY ALL" for n in sums))
    products = ", ".join(f"sum(a.w_{n} * a.z * b.z) AS v_{n}" for n in sums)
    table(f"{p}_gram", f"SELECT {', '.join('a.' + c for c in key.split(', '))}, a.f, b.f AS g, {products} FROM {p}_z a JOIN {p}_z b ON {join('a', 'b')} AND a.rid = b.rid GROUP BY ALL")
    table(f"{p}_feature", f"SELECT {key}, fit, f, sz, szy, row_number() OVER (PARTITION BY {key}, fit ORDER BY f) AS i, count(*) OVER (PARTITION BY {key}, fit) AS p FROM {p}_side")
    value = "CASE a.fit " + " ".join(f"WHEN '{n}' THEN g.v_{n}" for n in sums) + " END"
    table(f"{p}_system", f"""SELECT {', '.join('a.' + c for c in key.split(', '))}, a.fit, a.p, a.i, b.i AS j, coalesce({value}, 0) - a.sz * b.sz / n + CASE WHEN a.i = b.i THEN {alpha}::DOUBLE ELSE 0 END AS v
FROM {p}_feature a JOIN {p}_feature b USING ({key}, fit) JOIN {p}_n USING ({key}, fit) LEFT JOIN {p}_gram g ON {join('g', 'a')} AND g.f = a.f AND g.g = b.f
UNION ALL SELECT {key}, fit, p, i, 0, szy - sz * my FROM {p}_feature JOIN {p}_n USING ({key}, fit)""")
    k = f"{key}, fit"
    table(f"{p}_solved", f"""WITH RECURSIVE gj AS (SELECT 0 AS k, {k}, p, i, j, v FROM {p}_system
UNION ALL SELECT k + 1, {k}, p, i, j, CASE WHEN i = k + 1 THEN v / vkk ELSE v - vik * vkj / vkk END FROM (SELECT *,
max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY {k}, i) AS vik, max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY {k}, j) AS vkj,
max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER (PARTITION BY {k}) AS vkk FROM gj WHERE k < p))
SELECT {k}, i, v AS beta FROM gj WHERE k = p AND j = 0""")
    table(f"{p}_coef", f"SELECT {k}, f, beta, sz FROM {p}_feature JOIN {p}_solved USING ({k}, i)")
    table(f"{p}_base", f"SELECT {k}, max(my) - sum(beta * sz) / max(n) AS b0 FROM {p}_coef JOIN {p}_n USING ({k}) GROUP BY ALL")


#: Columns by which a number table joins its rows.
_JOINS: dict[str, str] = {}


def _shared(num: str, key: str) -> str:
    return _JOINS.get(num, "rid")


def _applied(p: str, key: str, rows: str, num: str, cat: str) -> str:
    """Predictions (key, fit, rid, y, y_pred) of the fits ``p`` on ``rows`` (key, rid, y)."""
    z = f"""SELECT {key}, rid, f, (x - m) / s AS z FROM {rows} JOIN {num} USING ({_shared(num, key)}) JOIN {p}_stat USING ({key}, f) UNION ALL SELECT {key}, rid, f, 1.0::DOUBLE FROM {rows} JOIN {cat} USING (rid)"""
    return f"""SELECT {key}, fit, rid, y, b0 + coalesce(q, 0) AS y_pred FROM {rows} JOIN {p}_base USING ({key}) LEFT JOIN (SELECT {key}, fit, rid, sum(beta * z) AS q FROM ({z}) JOIN {p}_coef USING ({key}, f) GROUP BY ALL) USING ({key}, fit, rid)"""


def _rank(seed, over: str) -> str:
    return f"row_number() OVER (PARTITION BY {over} ORDER BY ('0x' || substr(md5({seed} || '|' || parameter_set), 1, 12))::BIGINT, parameter_set::VARCHAR) - 1"


def nested_tables(p: str, base: str, keys: dict[str, str], settings, seeds, targets, inner: int = 3) -> None:
    """``<p>_scores``: mean and worst condition error of each setting over the inner folds, from the tables of panel ``base``.

    settings: (name, kind, strength); ``keys`` maps splits to the SQL of their stressor key."""
    key = f"{MODEL}, seed, inner_fold"
    names = ", ".join(f"'{t}'" for t in targets)
    stress = "CASE split_name " + " ".join(f"WHEN '{s}' THEN {e}" for s, e in keys.items()) + " END"
    table(f"{p}_unit", f"SELECT DISTINCT {MODEL}, parameter_set, seed FROM {base}_train JOIN {base}_att USING (rid), (VALUES {', '.join(f'({s})' for s in seeds)}) v(seed) WHERE target IN ({names})")
    table(f"{p}_inner", f"SELECT *, ({_rank('seed', f'{MODEL}, seed')}) % {inner} AS unit_fold FROM {p}_unit")
    table(f"{p}_all", f"""SELECT {MODEL}, seed, unit_fold, parameter_set, rid, y, {stress} AS stressor FROM {base}_train JOIN {base}_rows USING (rid) JOIN {p}_inner USING ({MODEL}, parameter_set)""")
    table(f"{p}_folds", f"SELECT DISTINCT {MODEL}, seed, unit_fold AS inner_fold FROM {p}_inner")
    over = f"PARTITION BY {key}"
    table(f"{p}_fit0", f"SELECT a.*, f.inner_fold FROM {p}_all a JOIN {p}_folds f USING ({MODEL}, seed) WHERE a.unit_fold <> f.inner_fold")
    table(f"{p}_size", f"SELECT {key}, count(*) AS n, count(DISTINCT parameter_set) AS units, count(DISTINCT stressor) AS keys FROM {p}_fit0 GROUP BY ALL")
    table(f"{p}_rows", f"""SELECT {key}, rid, y, n / (count(*) OVER ({over}, parameter_set) * units)::DOUBLE AS w1, n / (count(*) OVER ({over}, stressor) * keys)::DOUBLE AS w2
FROM {p}_fit0 JOIN {p}_size USING ({key})""")
    table(f"{p}_check", f"SELECT {MODEL}, seed, unit_fold AS inner_fold, parameter_set, rid, y FROM {p}_all")
    table(f"{p}_num", f"SELECT rid, f, x, gs FROM {base}_num JOIN {base}_gs USING (f)")
    weight = {"R0": "1.0::DOUBLE", "R1": "1 + {s}::DOUBLE * (w1 - 1)", "R2": "1 + {s}::DOUBLE * (w2 - 1)"}
    sums = {f"s{i}": f"({weight[kind].format(s=strength)})" for i, (_, kind, strength) in enumerate(settings)}
    _fit_tables(p, key, f"{p}_rows", f"{p}_num", f"{base}_cat", sums)
    name = "CASE fit " + " ".join(f"WHEN 's{i}' THEN '{n}'" for i, (n, _, _) in enumerate(settings)) + " END"
    pred = _applied(p, key, f"{p}_check", f"{p}_num", f"{base}_cat")
    table(f"{p}_byfold", f"""SELECT {key}, setting, avg(c) AS fold_mae, max(c) AS fold_worst FROM (SELECT {key}, {name} AS setting, parameter_set, avg(abs(y_pred - y)) AS c
FROM ({pred}) JOIN {base}_att USING (rid) GROUP BY ALL) GROUP BY ALL""")
    table(f"{p}_scores", f"SELECT {MODEL}, seed, setting, avg(fold_mae) AS mean_condition_mae, max(fold_worst) AS worst_condition_mae FROM {p}_byfold GROUP BY ALL")


def chosen_sql(p: str, policy: str, limit: float = 0.05, reference: str = "R0_reference") -> str:
    order = ("round(worst_condition_mae, 9), round(mean_condition_mae, 9), setting" if policy == "worst" else f"CASE WHEN worst_condition_mae <= ref * {1 + limit}::DOUBLE THEN 0 ELSE 1 END, round(mean_condition_mae, 9), setting")
    return f"""SELECT {MODEL}, seed, setting, mean_condition_mae, worst_condition_mae FROM (SELECT *, row_number() OVER (PARTITION BY {MODEL}, seed ORDER BY {order}) AS turn FROM (
SELECT *, max(CASE WHEN setting = '{reference}' THEN worst_condition_mae END) OVER (PARTITION BY {MODEL}, seed) AS ref FROM {p}_scores)) WHERE turn = 1"""


def adaptive_sql(p: str, limit: float = 0.02, reference: str = "R0_reference") -> str:
    """Both guarded policies over the settings of ``p``."""
    info = f"""SELECT c.split_name, c.heldout_fold, c.target, c.seed, c.setting, avg(r.fold_mae - c.fold_mae) AS mean_gain, max((c.fold_mae - r.fold_mae) / r.fold_mae) AS max_degradation
FROM {p}_byfold c JOIN {p}_byfold r USING ({MODEL}, seed, inner_fold) WHERE c.setting <> '{reference}' AND r.setting = '{reference}' GROUP BY ALL"""
    guarded = f"SELECT *, max_degradation <= {limit}::DOUBLE AND round(mean_gain, 9) > 0 AS guarded FROM ({info})"
    orders = {"max_gain_guarded": "CASE WHEN guarded THEN 0 ELSE 1 END, CASE WHEN guarded THEN -round(mean_gain, 9) ELSE round(max_degradation, 9) END, round(max_degradation, 9), setting",
              "conservative_guarded": "CASE WHEN guarded THEN 0 ELSE 1 END, setting, round(max_degradation, 9)"}
    return " UNION ALL ".join(f"SELECT {MODEL}, seed, '{q}' AS policy, setting, mean_gain, max_degradation, guarded FROM (SELECT *, row_number() OVER (PARTITION BY {MODEL}, seed ORDER BY {o}) AS turn FROM ({guarded})) WHERE turn = 1"
                              for q, o in orders.items())


def stacked_tables(p: str, base: str, aux: str, targets, inner: int = 3, seed: int = 42) -> None:
    """``<p>_pred``: ridges without and with an auxiliary state that is predicted out of fold; ``base`` has ``aux`` among its targets."""
    names = ", ".join(f"'{t}'" for t in targets)
    # inner folds of all conditions with the target, train or not
    table(f"{p}_inner", f"SELECT target, parameter_set, ({_rank(str(seed), 'target')}) % {inner} AS inner_fold FROM (SELECT DISTINCT target, parameter_set FROM {base}_y JOIN {base}_att USING (rid) WHERE target IN ({names}))")
    one = f"{MODEL}, inner_fold"
    stage = f"""SELECT t.split_name, t.heldout_fold, n.target, n.f AS inner_fold, t.rid, t.y, n.f = {inner} OR i.inner_fold IS DISTINCT FROM n.f AS used
FROM {base}_train t JOIN {base}_att USING (rid), (SELECT target, unnest(range({inner + 1})) AS f FROM (SELECT unnest([{names}]) AS target)) n LEFT JOIN {p}_inner i ON i.target = n.target AND i.parameter_set = {base}_att.parameter_set WHERE t.target = '{aux}'"""
    table(f"{p}_stage", f"SELECT *, bool_or(used) OVER (PARTITION BY {one}) AS any_used FROM ({stage})")
    table(f"{p}_rows1", f"SELECT {one}, rid, y FROM {p}_stage WHERE used OR NOT any_used")
    table(f"{p}_num1", f"SELECT rid, f, x, gs FROM {base}_num JOIN {base}_gs USING (f)")
    _fit_tables(f"{p}a", one, f"{p}_rows1", f"{p}_num1", f"{base}_cat", {"one": "1.0::DOUBLE"})
    table(f"{p}_ask", f"""SELECT {one}, rid, y FROM {base}_train JOIN {base}_att USING (rid) JOIN {p}_inner USING (target, parameter_set) WHERE target IN ({names})
UNION ALL SELECT {MODEL}, {inner}, rid, y FROM {base}_test WHERE target IN ({names})""")
    table(f"{p}_aux", f"SELECT {MODEL}, rid, y_pred AS aux FROM ({_applied(f'{p}a', one, f'{p}_ask', f'{p}_num1', f'{base}_cat')})")
    table(f"{p}_auxstat", f"SELECT coalesce(nullif(stddev_pop(aux), 0), 1.0) AS gs FROM {p}_aux")
    table(f"{p}_num2", f"""SELECT {MODEL}, rid, f, x, gs FROM {p}_ask JOIN {p}_num1 USING (rid) UNION ALL SELECT {MODEL}, rid, 'aux_prediction', aux, gs FROM {p}_aux, {p}_auxstat""")
    _JOINS[f"{p}_num2"] = f"{MODEL}, rid"
    table(f"{p}_rows2", f"SELECT {MODEL}, rid, y FROM {base}_train WHERE target IN ({names})")
    table(f"{p}_test2", f"SELECT {MODEL}, rid, y FROM {base}_test WHERE target IN ({names})")
    _fit_tables(f"{p}b", MODEL, f"{p}_rows2", f"{p}_num2", f"{base}_cat", {"one": "1.0::DOUBLE"})
    _fit_tables(f"{p}c", MODEL, f"{p}_rows2", f"{p}_num1", f"{base}_cat", {"one": "1.0::DOUBLE"})
    arms = [("with", f"{p}b", f"{p}_num2"), ("without", f"{p}c", f"{p}_num1")]
    both = " UNION ALL ".join(f"SELECT {MODEL}, 'F4_state_log_age_scalar' AS feature_group, '{a}' AS arm, rid, y, y_pred FROM ({_applied(q, MODEL, f'{p}_test2', num, f'{base}_cat')})" for a, q, num in arms)
    table(f"{p}_pred", f"SELECT {MODEL}, feature_group, arm, parameter_set, rid, y AS y_true, y_pred, y_pred - y AS e FROM ({both}) JOIN {base}_att USING (rid)")
