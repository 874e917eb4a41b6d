"""Lap geometry, comparison and style queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintline.catalog.registry import SHARED, query, r6
from stintline.functions.figures import rounded
from stintline.functions.lineage import materialised
from stintline.operators import compare as cp
from stintline.operators import geometry as gm
from stintline.operators import quality
from stintline.operators import telemetry as tl
from stintline.plans.survey import aero_survey

# The fixture laps carry about 0.6 g everywhere and few coasting samples, so the
# thresholds are set where both of their sides occur.
TURNS = {"g_threshold": 0.68, "min_length_m": 10.0, "merge_gap_m": 6.0}
COAST = {"min_speed_kph": 140.0, "max_lateral_g": 1.0}
DRAG = {"min_samples": 3, "min_span_kph": 4.0, "min_r2": 0.3}


def _rep(cols, digits=6):
    return "REPLACE (" + ", ".join(f"{r6(c, digits)} AS {c}" for c in cols) + ")"


def _r(df, cols, digits=6):
    return df.withColumns({c: rounded(c, digits) for c in cols})


def _line(v):
    return materialised(v.line)


def _trace(v):
    return materialised(gm.acceleration_trace(_line(v)))


def _half_m(speed: str) -> str:
    return f"greatest(16.0, 1.5 * ({speed} / 3.6 / 3.7))"


SHARED["laplen_o"] = "SELECT *, count(*) OVER (PARTITION BY lap_key) AS n, speed / 3.6 AS v FROM line_v"
SHARED["half_o"] = """
    SELECT *, CAST(least(floor((n - 1) / 2), greatest(8, floor(1.5 * (v / 3.7) / 2.0 + 0.5))) AS INT) AS h
    FROM laplen_o WHERE n >= 19"""
SHARED["window_o"] = """
    SELECT c.lap_key, c.idx, c.k, c.h, p.x - c.x AS dx, p.y - c.y AS dy
    FROM (SELECT *, unnest(range(-h, h + 1)) AS k FROM half_o) c
    JOIN line_v p ON p.lap_key = c.lap_key AND p.idx = (c.idx + c.k + 2 * c.n) % c.n"""
SHARED["chord_o"] = """
    SELECT lap_key, idx, cx / sqrt(cx * cx + cy * cy) AS tx, cy / sqrt(cx * cx + cy * cy) AS ty, sqrt(cx * cx + cy * cy) AS chord
    FROM (SELECT lap_key, idx, max(CASE WHEN k = h THEN dx END) - max(CASE WHEN k = -h THEN dx END) AS cx,
                 max(CASE WHEN k = h THEN dy END) - max(CASE WHEN k = -h THEN dy END) AS cy FROM window_o GROUP BY ALL) t"""
# The parabola by residual regression instead of a determinant.
SHARED["curve_o"] = """
    SELECT lap_key, idx, 2 * a / power(1 + b * b, 1.5) AS curvature FROM (
      SELECT lap_key, idx, a, regr_slope(u - a * t * t, t) AS b FROM (
        SELECT *, regr_slope(u, t * t - c0 - c1 * t) OVER p AS a FROM (
          SELECT *, regr_slope(t * t, t) OVER p AS c1, regr_intercept(t * t, t) OVER p AS c0 FROM (
            SELECT w.lap_key, w.idx, dx * tx + dy * ty AS t, dy * tx - dx * ty AS u
            FROM window_o w JOIN chord_o c ON c.lap_key = w.lap_key AND c.idx = w.idx) a0
          WINDOW p AS (PARTITION BY lap_key, idx)) a1 WINDOW p AS (PARTITION BY lap_key, idx)) a2
      GROUP BY lap_key, idx, a) f"""
SHARED["trace_o"] = """
    SELECT l.lap_key, l.idx, l.n, l.x, l.y, l.speed, l.throttle, l.brake, l.gear, c.curvature,
           l.v * l.v * c.curvature / 9.80665 AS lateral_g, l.v * ((f.v - b.v) / 16.0) / 9.80665 AS longitudinal_g,
           abs(nx.v * nx.v - l.v * l.v) / 4.0 / 9.80665 AS speed_step_g
    FROM half_o l JOIN curve_o c ON c.lap_key = l.lap_key AND c.idx = l.idx
    JOIN laplen_o f ON f.lap_key = l.lap_key AND f.idx = (l.idx + 4) % l.n
    JOIN laplen_o b ON b.lap_key = l.lap_key AND b.idx = (l.idx - 4 + l.n) % l.n
    JOIN laplen_o nx ON nx.lap_key = l.lap_key AND nx.idx = (l.idx + 1) % l.n"""
_TR = ["x", "y", "speed", "curvature", "lateral_g", "longitudinal_g", "speed_step_g"]


@query("acceleration_trace", f"SELECT * {_rep(_TR)} FROM trace_o")
def _(v):
    return _r(gm.acceleration_trace(_line(v)), _TR)


@query("curvature", f"SELECT lap_key, idx, {r6('curvature', 8)} AS curvature FROM trace_o")
def _(v):
    # Cells shorter than a window: the sums must not depend on where a lap is cut.
    return _r(gm.acceleration_trace(_line(v), cell=8).select("lap_key", "idx", "curvature"), ["curvature"], 8)


SHARED["resolution_o"] = f"""
    SELECT t.lap_key, t.idx, t.speed_step_g, CASE WHEN curvature = 0 THEN true WHEN speed <= 0 THEN false
           ELSE 1 / abs(curvature) >= {_half_m('speed')} END AS resolved,
           coalesce(EXISTS (SELECT 1 FROM trace_o s WHERE s.lap_key = t.lap_key AND s.speed_step_g > 10
                   AND least((s.idx - t.idx + t.n) % t.n, (t.idx - s.idx + t.n) % t.n)
                       <= greatest(1, floor({_half_m('t.speed')} / 2.0 + 0.5))), false) AS steps_near,
           power(speed / 3.6, 2) / ({_half_m('speed')} * 9.80665) AS ceiling_g FROM trace_o t"""


@query("curvature_resolution", f"SELECT * {_rep(['speed_step_g', 'ceiling_g'])} FROM resolution_o")
def _(v):
    return _r(gm.curvature_resolution(_trace(v)), ["speed_step_g", "ceiling_g"])


def _pick_sql(value: str, where: str, p: float) -> str:
    return (f"coalesce((SELECT list_sort(list({value}))[CAST(least(count(*) - 1, floor({p} * count(*))) AS INT) + 1] "
            f"FROM trace_o s WHERE s.lap_key = k.lap_key AND {where}), 0)")


@query("lateral_envelope", f"""
    SELECT lap_key, low + 10.0 AS speed_kph, {r6('vals[CAST(least(n - 1, floor(0.95 * n)) AS INT) + 1]')} AS lateral_g, n AS samples FROM (
      SELECT lap_key, floor(speed / 20) * 20 AS low, list_sort(list(abs(lateral_g))) AS vals, count(*) AS n
      FROM trace_o WHERE speed > 0 GROUP BY ALL) t WHERE n >= 8""")
def _(v):
    return _r(gm.lateral_envelope(gm.acceleration_trace(_line(v))), ["lateral_g"])


SHARED["peaks_o"] = f"""
    SELECT k.lap_key, {_pick_sql('abs(lateral_g)', 'true', 0.99)} AS peak_lateral_g,
           {_pick_sql('-longitudinal_g', 'longitudinal_g < 0', 0.99)} AS peak_braking_g,
           {_pick_sql('longitudinal_g', 'longitudinal_g >= 0', 0.99)} AS peak_accel_g, k.top AS top_speed_kph
    FROM (SELECT lap_key, max(speed) AS top FROM trace_o GROUP BY lap_key) k"""
_PK = ["peak_lateral_g", "peak_braking_g", "peak_accel_g"]


@query("lap_peaks", f"SELECT * {_rep(_PK)} FROM peaks_o")
def _(v):
    return _r(gm.lap_peaks(gm.acceleration_trace(_line(v))), _PK)


@query("smooth_magnitude", f"""
    SELECT lap_key, idx, {r6('s')} AS load FROM (
      SELECT l.lap_key, l.idx, avg(abs(p.speed)) AS s FROM (SELECT *, unnest(range(-5, 6)) AS k FROM laplen_o) l
      JOIN line_v p ON p.lap_key = l.lap_key AND p.idx = (l.idx + l.k + l.n) % l.n GROUP BY ALL) t""")
def _(v):
    return _r(gm.smooth_magnitude(tl.with_length(_line(v)), "speed").select("lap_key", "idx", "load"), ["load"])


SHARED["load_o"] = """
    SELECT t.*, load >= 0.68 AS over FROM (
      SELECT l.lap_key, l.idx, any_value(l.n) AS n, any_value(l.speed) AS speed, any_value(l.curvature) AS curvature,
             any_value(l.lateral_g) AS lateral_g, round(avg(abs(p.lateral_g)), 9) AS load
      FROM (SELECT *, unnest(range(-5, 6)) AS k FROM trace_o) l
      JOIN trace_o p ON p.lap_key = l.lap_key AND p.idx = (l.idx + l.k + l.n) % l.n GROUP BY l.lap_key, l.idx) t"""
SHARED["opened_o"] = """
    SELECT l.*, s.start, (l.idx - s.start + l.n) % l.n AS q FROM load_o l
    JOIN (SELECT lap_key, min(idx) AS start FROM load_o WHERE NOT over GROUP BY lap_key) s USING (lap_key)"""
SHARED["runs_o"] = """
    SELECT lap_key, min(q) AS a, max(q) AS b FROM (
      SELECT lap_key, q, over, q - row_number() OVER (PARTITION BY lap_key, over ORDER BY q) AS island FROM opened_o) t
    WHERE over GROUP BY lap_key, island"""
SHARED["turnspan_o"] = """
    SELECT *, row_number() OVER (PARTITION BY lap_key ORDER BY a) AS number FROM (
      SELECT lap_key, min(a) AS a, max(b) AS b FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY lap_key ORDER BY a) AS turn FROM (
          SELECT *, CASE WHEN (a - lag(b) OVER (PARTITION BY lap_key ORDER BY a) - 1) * 2.0 <= 6 THEN 0 ELSE 1 END AS fresh
          FROM runs_o) x) y GROUP BY lap_key, turn HAVING (max(b) - min(a) + 1) * 2.0 >= 10) z"""
SHARED["turns_o"] = """
    SELECT g.lap_key, g.number, (g.a + g.start) % g.n AS start_index, (g.b + g.start) % g.n AS end_index, g.apex_index,
           (g.b - g.a + 1) * 2e0 AS length_m, CASE WHEN why IS NULL THEN sustained END AS sustained_lateral_g,
           CASE WHEN why IS NOT NULL THEN sustained END AS unresolved_lateral_g, why AS withheld_reason,
           min_speed_kph, entry_speed_kph, exit_speed_kph, CASE WHEN apex_lat >= 0 THEN 'left' ELSE 'right' END AS direction,
           sustained_curvature, g.n
    FROM (SELECT h.*, CASE WHEN r.steps_near THEN 'speed_step_near'
                           WHEN NOT r.resolved THEN 'radius_below_window' END AS why
          FROM (SELECT s.lap_key, s.number, s.a, s.b, o.n, o.start, arg_max(o.idx, {'l': o.load, 'q': -o.q}) AS apex_index,
                       arg_max(o.lateral_g, {'l': o.load, 'q': -o.q}) AS apex_lat, min(o.speed) AS min_speed_kph,
                       max(CASE WHEN o.q = s.a THEN o.speed END) AS entry_speed_kph, max(CASE WHEN o.q = s.b THEN o.speed END) AS exit_speed_kph,
                       list_sort(list(o.load))[CAST(least(count(*) - 1, floor(0.9 * count(*))) AS INT) + 1] AS sustained,
                       list_sort(list(abs(o.curvature)))[CAST(least(count(*) - 1, floor(0.9 * count(*))) AS INT) + 1] AS sustained_curvature
                FROM turnspan_o s JOIN opened_o o ON o.lap_key = s.lap_key AND o.q BETWEEN s.a AND s.b GROUP BY ALL) h
          JOIN resolution_o r ON r.lap_key = h.lap_key AND r.idx = h.apex_index) g"""
_TU = ["sustained_lateral_g", "unresolved_lateral_g", "min_speed_kph", "entry_speed_kph", "exit_speed_kph", "sustained_curvature"]


@query("detect_turns", f"SELECT * {_rep(_TU)} FROM turns_o")
def _(v):
    return _r(gm.detect_turns(_trace(v), **TURNS), _TU)


@query("sustained_curvature", f"SELECT lap_key, number, {r6('sustained_curvature', 8)} AS sustained_curvature FROM turns_o")
def _(v):
    turns = gm.detect_turns(_trace(v), **TURNS)
    return _r(turns.select("lap_key", "number", "sustained_curvature"), ["sustained_curvature"], 8)


# Onsets laid twice, one lap apart; the last one at or before a turn's start.
SHARED["onset_o"] = """
    SELECT lap_key, idx + shift * n AS pos FROM (
      SELECT lap_key, idx, n, brake > 0 AND coalesce(lag(brake) OVER w, first_value(brake) OVER (PARTITION BY lap_key ORDER BY idx DESC)) = 0 AS went_on
      FROM laplen_o WINDOW w AS (PARTITION BY lap_key ORDER BY idx)) s CROSS JOIN (SELECT unnest([-1, 0]) AS shift) z WHERE went_on"""


@query("turn_details", """
    SELECT t.lap_key, t.number, t.apex_index * 2e0 AS apex_distance_m, l.gear AS gear_at_apex,
           (t.start_index - back + t.n) % t.n AS braking_index, back * 2e0 AS braking_distance_m
    FROM (SELECT t.*, CASE WHEN t.start_index - o.pos < 4 THEN t.start_index - o.pos END AS back
          FROM turns_o t ASOF LEFT JOIN onset_o o ON o.lap_key = t.lap_key AND t.start_index >= o.pos) t
    JOIN line_v l ON l.lap_key = t.lap_key AND l.idx = t.apex_index""")
def _(v):
    trace = _trace(v)
    return gm.turn_details(materialised(gm.detect_turns(trace, **TURNS)), trace, lookback_m=8.0)


SHARED["clock_o"] = """
    SELECT lap_key, idx, coalesce(sum(dt) OVER (PARTITION BY lap_key ORDER BY idx), 0) AS t FROM (
      SELECT lap_key, idx, 2.0 / ((greatest(speed, 1) + lag(greatest(speed, 1)) OVER (PARTITION BY lap_key ORDER BY idx)) / 2 / 3.6) AS dt
      FROM line_v) s"""
SHARED["refpairs_o"] = """
    SELECT r.ref_key, k.lap_key FROM (SELECT DISTINCT lap_key FROM line_v) k
    JOIN (SELECT lap_key // 100 AS s, min(lap_key) AS ref_key FROM line_v GROUP BY ALL) r ON r.s = k.lap_key // 100
    WHERE k.lap_key <> r.ref_key"""
SHARED["delta_o"] = """
    SELECT p.ref_key, p.lap_key, a.idx, a.t - b.t AS delta_s FROM refpairs_o p JOIN clock_o a ON a.lap_key = p.lap_key
    JOIN clock_o b ON b.lap_key = p.ref_key AND b.idx = a.idx"""


def _clock(v):
    return materialised(cp.lap_clock(_line(v)))


def _ref_pairs(line):
    keys = line.select("lap_key").distinct().withColumn("s", F.floor(F.col("lap_key") / 100))
    ref = keys.groupBy("s").agg(F.min("lap_key").alias("ref_key"))
    return keys.join(ref, "s").where("lap_key <> ref_key").select("ref_key", "lap_key")


@query("lap_clock", f"SELECT lap_key, idx, {r6('t')} AS t FROM clock_o")
def _(v):
    return _r(cp.lap_clock(_line(v)), ["t"])


@query("delta_trace", f"SELECT ref_key, lap_key, idx, {r6('delta_s')} AS delta_s FROM delta_o")
def _(v):
    clock = _clock(v)
    return _r(cp.delta_trace(clock, _ref_pairs(clock)), ["delta_s"])


@query("integrated_lap_time", f"SELECT lap_key, {r6('max(t)')} AS lap_time_s FROM clock_o GROUP BY lap_key")
def _(v):
    return _r(cp.integrated_lap_time(cp.lap_clock(_line(v))), ["lap_time_s"])


@query("turn_deltas", f"""
    SELECT ref_key, number, lap_key, {r6('delta_s')} AS delta_s, {r6('worst_s')} AS worst_s,
           dense_rank() OVER (PARTITION BY ref_key ORDER BY worst_s DESC, number) AS shown_at
    FROM (SELECT *, max(abs(delta_s)) OVER (PARTITION BY ref_key, number) AS worst_s FROM (
      SELECT t.lap_key AS ref_key, t.number, a.lap_key,
             round(b.delta_s + CASE WHEN t.end_index < t.start_index THEN z.delta_s ELSE 0 END - a.delta_s, 9) AS delta_s
      FROM turns_o t JOIN delta_o a ON a.ref_key = t.lap_key AND a.idx = t.start_index
      JOIN delta_o b ON b.ref_key = t.lap_key AND b.lap_key = a.lap_key AND b.idx = t.end_index
      JOIN (SELECT ref_key, lap_key, arg_max(delta_s, idx) AS delta_s FROM delta_o GROUP BY ALL) z
        ON z.ref_key = t.lap_key AND z.lap_key = a.lap_key) d) e""")
def _(v):
    line = _line(v)
    clock = materialised(cp.lap_clock(line))
    turns = materialised(gm.detect_turns(materialised(gm.acceleration_trace(line)), **TURNS))
    return _r(gm.turn_deltas(turns, cp.delta_trace(clock, _ref_pairs(clock))), ["delta_s", "worst_s"])


def _sectors_sql(count: int) -> str:
    return f"""
    SELECT b.lap_key, b.s + 1 AS sector, e.t - a.t AS time_s FROM (
      SELECT lap_key, n, unnest(range(0, {count})) AS s FROM (SELECT lap_key, count(*) AS n FROM line_v GROUP BY lap_key) l) b
    JOIN clock_o a ON a.lap_key = b.lap_key AND a.idx = floor(b.s / {count}.0::DOUBLE * (b.n - 1) + 0.5)
    JOIN clock_o e ON e.lap_key = b.lap_key AND e.idx = floor((b.s + 1) / {count}.0::DOUBLE * (b.n - 1) + 0.5)"""


SHARED["sectors_o"] = _sectors_sql(24)
SHARED["costsectors_o"] = _sectors_sql(12)
SHARED["winners_o"] = """
    SELECT session_id, sector, max(CASE WHEN rn = 1 THEN lap_key END) AS fastest,
           max(CASE WHEN rn = 2 THEN time_s END) - max(CASE WHEN rn = 1 THEN time_s END) AS margin_s
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, sector ORDER BY time_s, lap_key) AS rn
          FROM (SELECT lap_key // 100 AS session_id, lap_key, sector, round(time_s, 9) AS time_s FROM sectors_o) a) b GROUP BY ALL"""


def _selection(line):
    return line.select("lap_key").distinct().withColumns({
        "session_id": F.floor(F.col("lap_key") / 100).cast("int"), "pick": F.col("lap_key") % 100})


@query("mini_sectors", f"SELECT lap_key, sector, {r6('time_s')} AS time_s FROM sectors_o")
def _(v):
    return _r(cp.mini_sectors(_clock(v)), ["time_s"])


@query("sector_winners", f"SELECT session_id, sector, fastest, {r6('margin_s')} AS margin_s FROM winners_o")
def _(v):
    clock = _clock(v)
    return _r(cp.sector_winners(cp.mini_sectors(clock), _selection(clock)), ["margin_s"])


@query("winner_by_sample", """
    SELECT w.session_id, l.lap_key, l.idx, w.sector, w.fastest
    FROM (SELECT *, lap_key // 100 AS session_id, CAST(least(23, floor(idx / greatest(1, n - 1) * 24)) AS INT) + 1 AS sector FROM laplen_o) l
    JOIN winners_o w USING (session_id, sector)""")
def _(v):
    clock = _clock(v)
    chosen = _selection(clock)
    return cp.winner_by_sample(clock, cp.sector_winners(cp.mini_sectors(clock), chosen), chosen)


@query("sector_tally", """
    SELECT k.lap_key // 100 AS session_id, k.lap_key, count(w.sector) AS won
    FROM (SELECT DISTINCT lap_key FROM line_v) k LEFT JOIN winners_o w ON w.fastest = k.lap_key AND w.session_id = k.lap_key // 100 GROUP BY ALL""")
def _(v):
    clock = _clock(v)
    chosen = _selection(clock)
    return cp.sector_tally(cp.sector_winners(cp.mini_sectors(clock), chosen), chosen)


# A car's lap of one season stands for qualifying, the next season's for the race.
SHARED["qrpairs_o"] = """
    SELECT q.lap_key AS q_key, r.lap_key AS r_key FROM (SELECT DISTINCT lap_key FROM line_v) q
    JOIN (SELECT DISTINCT lap_key FROM line_v) r ON r.lap_key = q.lap_key + 100000"""


def _qr(line):
    keys = line.select("lap_key").distinct()
    q = keys.withColumns({"car": F.col("lap_key") % 100000, "season": F.floor(F.col("lap_key") / 100000)})
    return cp.session_pair(q, q.withColumn("season", F.col("season") - 1), ["car", "season"]).select("q_key", "r_key")


@query("session_pair", "SELECT * FROM qrpairs_o")
def _(v):
    return _qr(v.line)


SHARED["qrcost_o"] = """
    SELECT p.q_key, p.r_key, q.sector, q.time_s AS qualifying_s, r.time_s AS race_s, round(r.time_s - q.time_s, 9) AS cost_s
    FROM qrpairs_o p JOIN costsectors_o q ON q.lap_key = p.q_key JOIN costsectors_o r ON r.lap_key = p.r_key AND r.sector = q.sector"""


@query("session_cost_sectors", f"SELECT * {_rep(['qualifying_s', 'race_s', 'cost_s'])} FROM qrcost_o")
def _(v):
    clock = _clock(v)
    return _r(cp.session_cost_sectors(clock, _qr(clock)), ["qualifying_s", "race_s", "cost_s"])


_OFFICIAL = "SELECT session_id * 100 + driver_id AS lap_key, min(time_s) AS official_s FROM laps_v GROUP BY session_id, driver_id"
_COST = ["q_s", "r_s", "integrated_cost_s", "official_cost_s", "top_speed_cost_kph", "worst_cost_s"]


@query("session_cost", f"""
    SELECT p.q_key, p.r_key, {r6('q.t')} AS q_s, {r6('r.t')} AS r_s, {r6('r.t - q.t')} AS integrated_cost_s,
           {r6('ro.official_s - qo.official_s')} AS official_cost_s, {r6('r.top - q.top')} AS top_speed_cost_kph,
           w.sector AS worst_sector, {r6('w.cost_s')} AS worst_cost_s
    FROM qrpairs_o p
    JOIN (SELECT lap_key, max(t) AS t, max(speed) AS top FROM clock_o JOIN line_v USING (lap_key, idx) GROUP BY lap_key) q ON q.lap_key = p.q_key
    JOIN (SELECT lap_key, max(t) AS t, max(speed) AS top FROM clock_o JOIN line_v USING (lap_key, idx) GROUP BY lap_key) r ON r.lap_key = p.r_key
    JOIN ({_OFFICIAL}) qo ON qo.lap_key = p.q_key JOIN ({_OFFICIAL}) ro ON ro.lap_key = p.r_key
    JOIN (SELECT *, row_number() OVER (PARTITION BY q_key, r_key ORDER BY cost_s DESC, sector) AS rn FROM qrcost_o) w
      ON w.q_key = p.q_key AND w.r_key = p.r_key AND w.rn = 1""")
def _(v):
    line = _line(v)
    clock = materialised(cp.lap_clock(line))
    return _r(cp.session_cost(clock, line, _qr(clock), v.sql(_OFFICIAL)), _COST)


SHARED["grip_o"] = """
    SELECT lap_key, median(power(min_speed_kph / 3.6, 2) * sustained_curvature / 9.80665) AS grip_g
    FROM turns_o WHERE sustained_curvature > 0 GROUP BY lap_key"""
SHARED["model_o"] = """
    SELECT lap_key, number, direction, radius_m, min_speed_kph AS measured_kph, geometry_kph, model_kph,
           (min_speed_kph - model_kph) / model_kph * 100 AS delta_pct, power_limited,
           coalesce(abs((min_speed_kph - model_kph) / model_kph * 100) <= 2, false) AS grip_limited
    FROM (SELECT *, geometry_kph > top AS power_limited, CASE WHEN geometry_kph <= top THEN geometry_kph END AS model_kph FROM (
      SELECT t.*, 1 / nullif(sustained_curvature, 0) AS radius_m, p.top,
             sqrt(g.grip_g * 9.80665 / nullif(sustained_curvature, 0)) * 3.6 AS geometry_kph
      FROM turns_o t JOIN grip_o g USING (lap_key) JOIN (SELECT lap_key, max(speed) AS top FROM trace_o GROUP BY lap_key) p USING (lap_key)) a) b"""
_MO = ["radius_m", "measured_kph", "geometry_kph", "model_kph", "delta_pct"]


def _model(v):
    trace = _trace(v)
    turns = materialised(gm.detect_turns(trace, **TURNS))
    return gm.corner_model(turns, gm.implied_grip(turns), gm.lap_peaks(trace), 2.0)


@query("implied_grip", f"SELECT lap_key, {r6('grip_g')} AS grip_g FROM grip_o")
def _(v):
    return _r(gm.implied_grip(gm.detect_turns(_trace(v), **TURNS)), ["grip_g"])


@query("corner_model", f"SELECT * {_rep(_MO, 5)} FROM model_o")
def _(v):
    return _r(_model(v), _MO, 5)


@query("corner_model_summary", f"""
    SELECT lap_key, count(delta_pct) AS turns_modelled, count(*) FILTER (WHERE power_limited) AS turns_power_limited,
           count(*) FILTER (WHERE grip_limited) AS turns_grip_limited, {r6('median(abs(delta_pct))', 5)} AS median_abs_error_pct
    FROM model_o GROUP BY lap_key""")
def _(v):
    return _r(gm.corner_model_summary(_model(v)), ["median_abs_error_pct"], 5)


SHARED["coast_o"] = """
    SELECT * FROM trace_o WHERE throttle <= 5 AND brake = 0 AND speed >= 140 AND abs(lateral_g) <= 1 AND longitudinal_g < 0"""


@query("coasting_samples", f"SELECT lap_key, idx, speed, {r6('longitudinal_g')} AS longitudinal_g FROM coast_o")
def _(v):
    coast = gm.coasting_samples(gm.acceleration_trace(_line(v)), **COAST)
    return _r(coast.select("lap_key", "idx", "speed", "longitudinal_g"), ["longitudinal_g"])


SHARED["drag_o"] = """
    SELECT lap_key, coalesce(n, 0) AS samples, lo AS low_kph, hi AS high_kph, CASE WHEN reason IS NULL THEN k END AS k, CASE WHEN reason IS NULL THEN c END AS constant_decel,
           CASE WHEN reason IS NULL OR reason = 'r_squared_low' THEN r2 END AS r2,
           CASE WHEN reason IS NULL THEN CASE WHEN c > 0 THEN sqrt(c / k) * 3.6 ELSE 0 END END AS crossover_kph, reason
    FROM (SELECT *, CASE WHEN coalesce(n, 0) < 3 THEN 'samples_low' WHEN hi - lo < 4 THEN 'speed_span_low'
                    WHEN k IS NULL THEN 'fit_missing' WHEN k <= 0 THEN 'drag_not_positive'
                    WHEN r2 < 0.3 THEN 'r_squared_low' END AS reason
          FROM (SELECT DISTINCT lap_key FROM trace_o) l LEFT JOIN (
            SELECT lap_key, count(*) AS n, min(speed) AS lo, max(speed) AS hi, regr_slope(y, x) AS k, regr_intercept(y, x) AS c, regr_r2(y, x) AS r2
            FROM (SELECT lap_key, speed, power(speed / 3.6, 2) AS x, -longitudinal_g * 9.80665 AS y FROM coast_o) s GROUP BY lap_key) f USING (lap_key)) d"""
_DR = ["k", "constant_decel", "r2", "crossover_kph", "low_kph", "high_kph"]


@query("apparent_drag", f"SELECT * {_rep(_DR, 5)} FROM drag_o")
def _(v):
    trace = _trace(v)
    return _r(gm.apparent_drag(trace, gm.coasting_samples(trace, **COAST), **DRAG), _DR, 5)


SHARED["style_o"] = """
    SELECT p.*, coalesce(c.turns, 0) AS turns, c.mean_corner_min_kph, c.mean_pickup_m, coalesce(c.pickups, 0) AS pickups
    FROM (SELECT lap_key, count(*) * 2e0 AS lap_distance_m, avg((throttle >= 98)::INT) AS full_throttle_share, avg((brake > 0)::INT) AS braking_share,
                 avg((brake = 0 AND throttle <= 5)::INT) AS coasting_share,
                 count(*) FILTER (WHERE gear <> prev) AS gear_changes, max(speed) AS top_speed_kph
          FROM (SELECT *, lag(gear) OVER (PARTITION BY lap_key ORDER BY idx) AS prev FROM trace_o) t GROUP BY lap_key) p
    LEFT JOIN (SELECT lap_key, count(*) AS turns, avg(min_speed_kph) AS mean_corner_min_kph, avg(m) AS mean_pickup_m, count(m) AS pickups FROM (
        SELECT t.lap_key, t.number, any_value(t.min_speed_kph) AS min_speed_kph,
               min((s.idx - t.apex_index + t.n) % t.n) FILTER (WHERE (s.idx - t.apex_index + t.n) % t.n < 300) * 2.0 AS m
        FROM turns_o t LEFT JOIN trace_o s ON s.lap_key = t.lap_key AND s.throttle >= 98 GROUP BY t.lap_key, t.number) u GROUP BY lap_key) c USING (lap_key)"""
_ST = ["full_throttle_share", "braking_share", "coasting_share", "mean_corner_min_kph", "mean_pickup_m"]


@query("driving_style", f"SELECT * {_rep(_ST)} FROM style_o")
def _(v):
    trace = _trace(v)
    return _r(gm.driving_style(trace, materialised(gm.detect_turns(trace, **TURNS))), _ST)


SHARED["survey_o"] = """
    SELECT s.lap_key, CAST(s.lap_key // 100 AS INT) AS session_id, k.top_speed_kph, k.peak_lateral_g, k.peak_braking_g, g.grip_g AS implied_grip_g,
           s.turns, t.slowest AS slowest_corner_kph, s.full_throttle_share, s.braking_share, d.samples AS coast_samples, d.k AS drag_k,
           coalesce(m.turns_modelled, 0) AS turns_modelled, m.err AS median_abs_error_pct, c.t AS lap_time_s
    FROM style_o s JOIN peaks_o k USING (lap_key) LEFT JOIN grip_o g USING (lap_key)
    LEFT JOIN (SELECT lap_key, min(min_speed_kph) AS slowest FROM turns_o GROUP BY lap_key) t USING (lap_key)
    LEFT JOIN drag_o d USING (lap_key) JOIN (SELECT lap_key, max(t) AS t FROM clock_o GROUP BY lap_key) c USING (lap_key)
    LEFT JOIN (SELECT lap_key, count(delta_pct) AS turns_modelled, median(abs(delta_pct)) AS err FROM model_o GROUP BY lap_key) m USING (lap_key)"""
_SU = ["top_speed_kph", "peak_lateral_g", "peak_braking_g", "implied_grip_g", "slowest_corner_kph", "full_throttle_share",
       "braking_share", "drag_k", "median_abs_error_pct", "lap_time_s"]


def _survey(v):
    return aero_survey(_line(v), TURNS, COAST, DRAG, 2.0)


@query("aero_survey", f"SELECT * {_rep(_SU, 4)} FROM survey_o")
def _(v):
    return _r(_survey(v), _SU, 4)


def _band(c, edges):
    return "CASE " + " ".join(f"WHEN abs({c}) >= {e} THEN {i}" for i, e in reversed(list(enumerate(edges, 1)))) + f" ELSE 0 END AS {c}_band"


@query("channel_bands", "SELECT lap_key, idx, " + ", ".join(_band(c, e) for c, e in gm.BAND_EDGES.items()) + " FROM line_v")
def _(v):
    return gm.channel_bands(v.line)


_SURVEYED = """
    SELECT session_id, session_id * 100 + driver_id AS lap_key, CAST(driver_id % 10 AS INT) AS team_id, min(time_s) AS lap_time_s
    FROM laps_v WHERE driver_id % 10 <> 4 GROUP BY session_id, driver_id"""


@query("session_lap_board", f"SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY lap_time_s, lap_key) AS place FROM ({_SURVEYED}) s")
def _(v):
    return cp.session_lap_board(v.sql(_SURVEYED))


@query("laps_by_team", f"""
    SELECT t.session_id, t.team_id, s.lap_key, s.lap_time_s, CASE WHEN s.lap_key IS NOT NULL THEN row_number() OVER (
             PARTITION BY t.session_id, t.team_id ORDER BY s.lap_time_s, s.lap_key) END AS place
    FROM (SELECT DISTINCT session_id, team_id FROM results_v) t LEFT JOIN ({_SURVEYED}) s ON s.session_id = t.session_id AND s.team_id = t.team_id""")
def _(v):
    return cp.laps_by_team(v.sql(_SURVEYED), v.results)


_INDEX = """
    SELECT CAST(floor(session_id / 1000) AS INT) AS season, CAST(session_id % 1000 + 1 AS INT) AS round,
           CASE WHEN driver_id % 2 = 0 THEN 'Q' ELSE 'R' END AS session, count(DISTINCT CASE WHEN lap % 9 = driver_id % 9 OR session_id % 3 = 0 THEN lap END) AS n_drivers,
           CASE WHEN session_id % 4 = 1 THEN NULL ELSE session_id % 5 <> 2 END AS elevation_usable
    FROM laps_v WHERE NOT (session_id % 7 = 2 AND driver_id % 2 = 0) GROUP BY session_id, CASE WHEN driver_id % 2 = 0 THEN 'Q' ELSE 'R' END"""


@query("newest_with_lines", f"""
    SELECT season, round, session FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY session, round DESC) AS rn
      FROM ({_INDEX}) i WHERE n_drivers > 0) t WHERE rn = 1""")
def _(v):
    return cp.newest_with_lines(v.sql(_INDEX))


@query("elevation_board", f"""
    SELECT i.season, i.round, c.circuit_id, r.refused FROM ({_INDEX}) i JOIN calendar_v c USING (season, round)
    JOIN (SELECT season, count(*) FILTER (WHERE NOT elevation_usable) AS refused FROM ({_INDEX}) k WHERE n_drivers > 0 AND session = 'Q' GROUP BY season) r USING (season)
    WHERE i.elevation_usable AND i.n_drivers > 0 AND i.session = 'Q'""")
def _(v):
    return cp.elevation_board(v.sql(_INDEX).where("session = 'Q'"), v.calendar)


@query("stale_survey", f"""
    SELECT lap_key, CASE WHEN lap_key % 5 = 0 THEN 'gained' WHEN lap_key % 7 = 0 THEN 'lost' ELSE 'changed' END AS change
    FROM ({_SURVEYED}) s WHERE (lap_key % 5 = 0) <> (lap_key % 7 = 0) OR (lap_key % 5 <> 0 AND lap_key % 7 <> 0 AND lap_key % 3 = 0)""")
def _(v):
    survey = v.sql(_SURVEYED).withColumn("generated_at", F.current_timestamp())
    stored = survey.where("lap_key % 5 <> 0").withColumn("generated_at", F.lit("earlier"))
    fresh = survey.where("lap_key % 7 <> 0").withColumn(
        "lap_time_s", F.col("lap_time_s") + F.when(F.col("lap_key") % 3 == 0, 0.25).otherwise(0.0))
    return quality.stale_survey(stored, fresh, ["lap_key"])
