"""Telemetry capture and line-format queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintline.catalog.registry import SHARED, query, r6
from stintline.functions.figures import rounded
from stintline.functions.lineage import materialised
from stintline.operators import quality
from stintline.operators import telemetry as tl
from stintline.plans.lines import racing_lines
from stintline.sources.views import VIEWS

# The fixture laps have about 86 samples, so the capture limits are lowered to suit.
MIN_SAMPLES = 80


def _rep(cols, digits=6):
    return "REPLACE (" + ", ".join(f"{r6(c, digits)} AS {c}" for c in cols) + ")"


def _r(df, cols, digits=6):
    return df.withColumns({c: rounded(c, digits) for c in cols})


SHARED["fastest_o"] = """
    SELECT session_id, driver_id, lap, time_s, start_ts FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, driver_id ORDER BY time_s, lap) AS rn
      FROM timing_laps_v WHERE NOT is_pit_out AND time_s > 0) t WHERE rn = 1"""
SHARED["picked_o"] = """
    SELECT *, session_id * 100 + driver_id AS lap_key FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_s, driver_id) AS pace_rank FROM fastest_o) t"""


def _picked(v):
    return tl.top_n_laps(tl.fastest_laps(v.timing_laps), 20).withColumn(
        "lap_key", F.col("session_id") * 100 + F.col("driver_id"))


@query("fastest_laps", "SELECT * FROM fastest_o")
def _(v):
    return tl.fastest_laps(v.timing_laps)


@query("top_n_laps", "SELECT * EXCLUDE (lap_key) FROM picked_o WHERE pace_rank <= 4")
def _(v):
    return tl.top_n_laps(tl.fastest_laps(v.timing_laps))


SHARED["windows_o"] = """
    SELECT session_id, driver_id, lap, start_ts - INTERVAL 1500 MILLISECOND AS begin_ts,
           start_ts + to_microseconds(CAST(round(time_s * 1e6) AS BIGINT)) + INTERVAL 1500 MILLISECOND AS end_ts
    FROM timing_laps_v WHERE time_s > 0"""
_SAMPLES = """
    SELECT session_id, driver_id, start_ts + (lap * 7 % 110 - 5) * INTERVAL '1' SECOND AS ts, lap * 1.5 AS x, driver_id * 2.5 AS y
    FROM timing_laps_v
    UNION ALL SELECT session_id, driver_id, start_ts + (driver_id * 13 % 40) * INTERVAL '1' SECOND, lap * 2.5, driver_id * 1.5 FROM timing_laps_v"""
_RETURNED = """
    SELECT session_id, driver_id, lap, start_ts AS ts FROM timing_laps_v
    UNION ALL SELECT session_id, driver_id, lap,
           start_ts + CASE WHEN lap % 10 = 0 THEN INTERVAL '600' SECOND ELSE INTERVAL '95' SECOND END FROM timing_laps_v"""


@query("lap_window", "SELECT * FROM windows_o")
def _(v):
    return tl.lap_window(v.timing_laps)


@query("samples_in_lap", f"""
    SELECT s.session_id, s.driver_id, s.ts, CAST(s.x AS DOUBLE) AS x, CAST(s.y AS DOUBLE) AS y, w.lap FROM ({_SAMPLES}) s
    JOIN windows_o w ON w.session_id = s.session_id AND w.driver_id = s.driver_id AND s.ts > w.begin_ts AND s.ts < w.end_ts""")
def _(v):
    samples = v.sql(_SAMPLES).withColumns({c: F.col(c).cast("double") for c in "xy"})
    return tl.samples_in_lap(samples, tl.lap_window(v.timing_laps))


@query("window_honoured", f"""
    SELECT session_id, driver_id, lap, span_s, {r6('2 * (time_s + 6)')} AS allowed_s, span_s <= 2 * (time_s + 6) AS honoured
    FROM (SELECT session_id, driver_id, lap, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span_s FROM ({_RETURNED}) r GROUP BY ALL) s
    JOIN timing_laps_v USING (session_id, driver_id, lap) WHERE time_s > 0""")
def _(v):
    return _r(tl.window_honoured(v.sql(_RETURNED), v.timing_laps), ["allowed_s"])


def _lerp(channel: str, n: str) -> str:
    return f"""CASE WHEN {n} >= 2 THEN CASE WHEN {channel}a.t IS NULL THEN {channel}b.{channel}
        WHEN {channel}b.t IS NULL OR {channel}a.t = p.t THEN {channel}a.{channel}
        ELSE {channel}a.{channel} + ({channel}b.{channel} - {channel}a.{channel}) / ({channel}b.t - {channel}a.t) * (p.t - {channel}a.t) END END AS {channel}"""


SHARED["aligned_o"] = f"""
    SELECT p.lap_key, p.t, p.x, p.y, p.z, {_lerp('speed', 'ns')}, {_lerp('throttle', 'nt')},
           CASE WHEN coalesce(g.brake, f.brake) > 0 THEN 1.0 ELSE 0.0 END AS brake,
           CAST(coalesce(g.gear, f.gear) AS DOUBLE) AS gear
    FROM pos_v p
    ASOF LEFT JOIN (SELECT * FROM car_v WHERE speed IS NOT NULL) speeda ON speeda.lap_key = p.lap_key AND p.t >= speeda.t
    ASOF LEFT JOIN (SELECT * FROM car_v WHERE speed IS NOT NULL) speedb ON speedb.lap_key = p.lap_key AND p.t <= speedb.t
    ASOF LEFT JOIN (SELECT * FROM car_v WHERE throttle IS NOT NULL) throttlea ON throttlea.lap_key = p.lap_key AND p.t >= throttlea.t
    ASOF LEFT JOIN (SELECT * FROM car_v WHERE throttle IS NOT NULL) throttleb ON throttleb.lap_key = p.lap_key AND p.t <= throttleb.t
    ASOF LEFT JOIN car_v g ON g.lap_key = p.lap_key AND p.t >= g.t
    JOIN (SELECT lap_key, arg_min(brake, t) AS brake, arg_min(gear, t) AS gear, count(speed) AS ns, count(throttle) AS nt
          FROM car_v GROUP BY lap_key) f ON f.lap_key = p.lap_key"""
_CH = ["x", "y", "z", "speed", "throttle", "brake", "gear"]


def _feeds(v):
    """Position and car samples, from one reading of the lines they are made of."""
    line = materialised(v.line)
    return [v.spark.sql(VIEWS[name].replace("line_v", "{line}"), line=line) for name in ("pos_v", "car_v")]


def _aligned(v):
    return materialised(tl.align_channels(*_feeds(v), steps=True))


@query("align_channels", f"SELECT * {_rep(_CH)} FROM aligned_o")
def _(v):
    return _r(tl.align_channels(*_feeds(v)), _CH)


SHARED["steps_o"] = """
    SELECT *, t - lag(t) OVER w AS dt, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step
    FROM aligned_o WINDOW w AS (PARTITION BY lap_key ORDER BY t)"""
SHARED["scale_o"] = f"""
    SELECT lap_key, raw / metres AS units_per_metre, moving AS sample_size FROM (
      SELECT lap_key, count(*) AS n, count(*) FILTER (WHERE speed >= 50 AND dt IS NOT NULL) AS moving,
             sum(speed / 3.6 * dt) FILTER (WHERE speed >= 50) AS metres, sum(step) FILTER (WHERE speed >= 50) AS raw
      FROM steps_o GROUP BY lap_key) s WHERE n >= {MIN_SAMPLES} AND moving >= 20 AND metres > 0 AND raw > 0"""
SHARED["sessionscale_o"] = """
    SELECT session_id, arg_min(units_per_metre, pace_rank) AS units_per_metre, arg_min(sample_size, pace_rank) AS sample_size,
           min(pace_rank) AS measured_on FROM picked_o JOIN scale_o USING (lap_key) GROUP BY session_id"""
SHARED["usable_o"] = """
    SELECT p.session_id, p.driver_id, p.lap_key, p.pace_rank, s.units_per_metre FROM picked_o p JOIN sessionscale_o s
      ON s.session_id = p.session_id AND p.pace_rank >= s.measured_on"""
SHARED["driven_o"] = f"""
    SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY lap_key) AS kept,
                          coalesce(sum(step) OVER (PARTITION BY lap_key ORDER BY t), 0) AS distance_m FROM (
      SELECT lap_key, t, x / u AS x, y / u AS y, z / u AS z, speed, throttle, brake, gear, step / u AS step
      FROM (SELECT s.*, u.units_per_metre AS u FROM steps_o s JOIN usable_o u USING (lap_key)) a
      WHERE step IS NULL OR step > 0) b) c WHERE kept >= {MIN_SAMPLES}"""
_GRID = ", ".join(f"CASE WHEN pd IS NULL THEN {c} ELSE p{c} + ({c} - p{c}) * (k * 2.0 - pd) / (distance_m - pd) END AS {c}" for c in _CH)
SHARED["lines_o"] = f"""
    SELECT lap_key, CAST(k AS INT) AS idx, {_GRID} FROM (
      SELECT *, unnest(CASE WHEN pd IS NULL THEN range(0, 1)
                       ELSE range(CAST(floor(pd / 2.0) AS BIGINT) + 1, CAST(floor(distance_m / 2.0) AS BIGINT) + 1) END) AS k FROM (
        SELECT *, lag(distance_m) OVER w AS pd, {', '.join(f'lag({c}) OVER w AS p{c}' for c in _CH)}
        FROM driven_o WINDOW w AS (PARTITION BY lap_key ORDER BY t)) a) b"""
SHARED["capture_o"] = f"""
    SELECT lap_key, samples, advancing, CASE WHEN samples < {MIN_SAMPLES} THEN 'too few position samples'
           WHEN u IS NULL THEN 'no measured position unit'
           WHEN advancing < {MIN_SAMPLES} THEN 'the feed repeated the same coordinates' END AS reason
    FROM (SELECT lap_key, count(*) AS samples, count(*) FILTER (WHERE step > 0) + 1 AS advancing FROM steps_o GROUP BY lap_key) s
    LEFT JOIN (SELECT lap_key, units_per_metre AS u FROM usable_o) x USING (lap_key)"""


@query("position_scale", f"SELECT * {_rep(['units_per_metre'])} FROM scale_o")
def _(v):
    return _r(tl.position_scale(_aligned(v), MIN_SAMPLES), ["units_per_metre"])


@query("session_scale", f"SELECT * {_rep(['units_per_metre'])} FROM sessionscale_o")
def _(v):
    return _r(tl.session_scale(tl.position_scale(_aligned(v), MIN_SAMPLES), _picked(v)), ["units_per_metre"])


def _usable(v, aligned):
    picked = _picked(v)
    unit = tl.session_scale(tl.position_scale(aligned, MIN_SAMPLES), picked)
    return picked.join(unit, "session_id").where("pace_rank >= measured_on")


@query("capture_report", "SELECT * FROM capture_o")
def _(v):
    aligned = _aligned(v)
    return tl.capture_report(aligned, _usable(v, aligned), MIN_SAMPLES)


@query("driven_distance", f"SELECT lap_key, t, {r6('x')} AS x, {r6('y')} AS y, {r6('speed')} AS speed, {r6('distance_m')} AS distance_m FROM driven_o")
def _(v):
    v = v.keeping("laps")
    aligned = _aligned(v)
    driven = tl.driven_distance(aligned, _usable(v, aligned), MIN_SAMPLES)
    return _r(driven.select("lap_key", "t", "x", "y", "speed", "distance_m"), ["x", "y", "speed", "distance_m"])


_DRIVEN = "SELECT lap_key, idx * 7.3 + idx % 3 AS distance_m, x, y, z, speed, throttle, brake, CAST(gear AS DOUBLE) AS gear FROM line_v"


@query("resample_by_distance", f"""
    SELECT lap_key, CAST(k AS INT) AS idx, {', '.join(f"{r6('g.' + c, 4)} AS {c}" for c in _CH)} FROM (
      SELECT lap_key, k, {_GRID} FROM (
        SELECT *, unnest(CASE WHEN pd IS NULL THEN range(0, 1)
                 ELSE range(CAST(floor(pd / 2.0) AS BIGINT) + 1, CAST(floor(distance_m / 2.0) AS BIGINT) + 1) END) AS k FROM (
          SELECT *, lag(distance_m) OVER w AS pd, {', '.join(f'lag({c}) OVER w AS p{c}' for c in _CH)}
          FROM (SELECT * REPLACE (CAST(distance_m AS DOUBLE) AS distance_m) FROM ({_DRIVEN}) d0) d
          WINDOW w AS (PARTITION BY lap_key ORDER BY distance_m)) a) b) g""")
def _(v):
    driven = v.sql(_DRIVEN).withColumn("distance_m", F.col("distance_m").cast("double"))
    return _r(tl.resample_by_distance(driven), _CH, 4)


@query("racing_lines", f"""
    SELECT lap_key, idx, {', '.join(f"{r6('l.' + c, 4)} AS {c}" for c in _CH if c != 'z')},
           CASE WHEN usable THEN {r6('l.z', 4)} END AS z
    FROM (SELECT l.*, e.hi - e.lo >= 20.5 AS usable FROM lines_o l JOIN usable_o u USING (lap_key) JOIN (
            SELECT session_id, arg_min(hi, pace_rank) AS hi, arg_min(lo, pace_rank) AS lo FROM usable_o
            JOIN (SELECT lap_key, max(z) AS hi, min(z) AS lo FROM lines_o GROUP BY lap_key) z USING (lap_key)
            GROUP BY session_id) e ON e.session_id = u.session_id) l""")
def _(v):
    v = v.keeping("laps")
    lines, _refused = racing_lines(*_feeds(v), _picked(v), MIN_SAMPLES, 20.5)
    return _r(lines, _CH, 4)


@query("racing_lines_refused", """
    SELECT session_id, driver_id, lap_key, coalesce(reason, 'no position samples') AS reason FROM picked_o p
    LEFT JOIN (SELECT lap_key, reason FROM capture_o) c USING (lap_key)
    WHERE lap_key NOT IN (SELECT lap_key FROM lines_o)""")
def _(v):
    v = v.keeping("laps")
    return racing_lines(*_feeds(v), _picked(v), MIN_SAMPLES)[1]


@query("rotate_xy", f"""
    SELECT lap_key, idx, {r6('x * cos(radians(37)) - y * sin(radians(37))')} AS x,
           {r6('x * sin(radians(37)) + y * cos(radians(37))')} AS y FROM line_v""")
def _(v):
    return _r(tl.rotate_xy(v.line.select("lap_key", "idx", "x", "y"), 37), ["x", "y"])


@query("circuit_outline", """
    SELECT lap_key, idx, round(x, 1) AS x, round(y, 1) AS y FROM (
      SELECT *, count(*) OVER (PARTITION BY lap_key) AS n FROM line_v) t WHERE idx % greatest(1, ceil(n / 30.0)) = 0""")
def _(v):
    return tl.circuit_outline(v.line, 30)


_LAPS = """
    SELECT session_id % 1000 AS circuit_id, session_id * 100 + driver_id AS lap_key, min(time_s) AS time_s,
           CASE WHEN driver_id % 3 = 0 THEN 'Q' ELSE 'R' END AS session
    FROM laps_v GROUP BY session_id, driver_id"""


@query("outline_source", f"""
    SELECT circuit_id, lap_key, session FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id
      ORDER BY session, time_s, lap_key) AS rn FROM ({_LAPS}) l) t WHERE rn = 1""")
def _(v):
    return tl.outline_source(v.sql(_LAPS))


_ELEV = ("SELECT lap_key, idx, CASE WHEN lap_key % 4 = 0 THEN NULL WHEN lap_key % 4 = 1 AND idx > 0 THEN NULL "
         "WHEN lap_key % 4 = 2 THEN z / 10 ELSE z END AS z FROM line_v")


@query("elevation_verdict", f"""
    SELECT lap_key, reason IS NULL AS usable, CASE WHEN n >= 2 THEN round(hi - lo, 2) END AS range_m,
           CASE WHEN reason IS NULL THEN round(lo, 2) END AS min_m, CASE WHEN reason IS NULL THEN round(hi, 2) END AS max_m, reason
    FROM (SELECT *, CASE WHEN n = 0 THEN 'no elevation published' WHEN n < 2 THEN 'the elevation channel is empty'
                    WHEN hi - lo < 3 THEN 'the elevation channel does not vary enough' END AS reason
          FROM (SELECT lap_key, count(z) AS n, max(z) AS hi, min(z) AS lo FROM ({_ELEV}) e GROUP BY lap_key) a) b""")
def _(v):
    return tl.elevation_verdict(v.sql(_ELEV))


_CORNERS = ("SELECT lap_key, idx + 1 AS number, 300 * cos(2 * pi() * idx / 5 + 0.1) AS corner_x, "
            "300 * sin(2 * pi() * idx / 5 + 0.1) AS corner_y FROM line_v WHERE idx < 5")


@query("nearest_sample_corners", f"""
    SELECT m.lap_key, m.number, m.apex_idx, arg_min(s.speed, s.idx) AS entry_speed_kph, min(s.speed) AS min_speed_kph,
           max(CASE WHEN s.idx = apex_idx THEN s.idx * 2.0 END)::DOUBLE AS apex_distance_m, max(CASE WHEN s.idx = apex_idx THEN s.gear END) AS gear,
           min(CASE WHEN s.brake > 0 THEN s.idx * 2.0 END)::DOUBLE AS braking_point_m
    FROM (SELECT c.lap_key, c.number, arg_min(s.idx, {{'d': round(sqrt(power(s.x - corner_x, 2) + power(s.y - corner_y, 2)), 6), 'i': s.idx}}) AS apex_idx
          FROM ({_CORNERS}) c JOIN line_v s ON s.lap_key = c.lap_key GROUP BY c.lap_key, c.number) m
    JOIN line_v s ON s.lap_key = m.lap_key AND s.idx >= greatest(0, apex_idx - 20) AND s.idx < apex_idx + 20 GROUP BY ALL""")
def _(v):
    return tl.nearest_sample_corners(v.sql(_CORNERS), v.line.withColumn("distance_m", F.col("idx") * F.lit(2.0)), cell_m=2.0)


def _quant(c, k):
    return f"CAST(greatest(-32768, least(32767, round_even({c} * {k}, 0))) AS SMALLINT) AS {c}"


# Stretched so that some values pass the 16-bit range and are clipped.
SHARED["quant_o"] = "SELECT lap_key, idx, " + ", ".join(_quant(c, k) for c, k in tl.LINE_SCALE.items()) + \
    " FROM (SELECT * REPLACE (x * 12.5 AS x) FROM line_v) l"


def _quantised(v):
    return tl.quantise_lines(v.line.withColumn("x", F.col("x") * 12.5))


@query("quantise_lines", "SELECT * FROM quant_o")
def _(v):
    return _quantised(v)


@query("dequantise_lines", "SELECT lap_key, idx, " + ", ".join(
    f"CAST({c} AS DOUBLE) / {k if c != 'gear' else 1} AS {c}" for c, k in tl.LINE_SCALE.items()) + " FROM quant_o")
def _(v):
    return tl.dequantise_lines(_quantised(v), {c: k for c, k in tl.LINE_SCALE.items() if c != "gear"})


_ZLINE = "SELECT lap_key, idx, x, y, CASE WHEN lap_key % 3 = 0 THEN NULL ELSE z END AS z, speed, throttle, brake, gear FROM line_v"
SHARED["manifest_o"] = """
    SELECT lap_key, count(*) AS points, CASE WHEN lap_key % 3 = 0 THEN 'x,y,speed,throttle,brake,gear'
           ELSE 'x,y,z,speed,throttle,brake,gear' END AS channels FROM line_v GROUP BY lap_key"""


@query("line_manifest", "SELECT * FROM manifest_o")
def _(v):
    return tl.line_manifest(v.sql(_ZLINE))


_ATTEMPTS = """
    SELECT DISTINCT session_id, driver_id, session_id * 100 + driver_id AS lap_key, 'too few position samples' AS reason
    FROM laps_v WHERE session_id % 3 = 0 OR driver_id % 5 = 0"""


def _index_parts(v):
    worked = tl.line_manifest(v.line.where("floor(lap_key / 100) % 4 <> 1")).withColumns({
        "session_id": F.floor(F.col("lap_key") / 100).cast("int"), "driver_id": (F.col("lap_key") % 100).cast("int")})
    return worked, v.sql(_ATTEMPTS), tl.elevation_verdict(v.sql(_ELEV))


@query("unavailable_lines", f"SELECT session_id, driver_id, reason FROM ({_ATTEMPTS}) a WHERE session_id % 4 = 1")
def _(v):
    worked, attempts, _e = _index_parts(v)
    return tl.unavailable_lines(attempts, worked)


@query("telemetry_index", f"""
    SELECT session_id, coalesce(n, 0) AS n_drivers, coalesce(drivers, '') AS drivers, n IS NULL AS unavailable, elevation_usable
    FROM (SELECT DISTINCT session_id FROM ({_ATTEMPTS}) a) t FULL JOIN (
      SELECT CAST(floor(lap_key / 100) AS INT) AS session_id, count(*) AS n,
             string_agg(CAST(lap_key % 100 AS VARCHAR), ',' ORDER BY CAST(lap_key % 100 AS VARCHAR)) AS drivers,
             arg_min(usable, lap_key) AS elevation_usable
      FROM (SELECT lap_key, lap_key % 4 = 3 AND max(z) - min(z) >= 3 AS usable FROM line_v WHERE floor(lap_key / 100) % 4 <> 1 GROUP BY lap_key) k
      GROUP BY ALL) i USING (session_id)""")
def _(v):
    return tl.telemetry_index(*_index_parts(v))


_EXT = ["min_x", "max_x", "span_x", "min_y", "max_y", "span_y", "min_z", "max_z", "span_z"]


@query("lap_extent", "SELECT lap_key, " + ", ".join(
    f"{r6(e)} AS {a}_{c}" for c in "xyz" for a, e in (("min", f"min({c})"), ("max", f"max({c})"), ("span", f"max({c}) - min({c})")))
    + f" FROM ({_ZLINE}) z WHERE z IS NOT NULL GROUP BY lap_key")
def _(v):
    return _r(tl.lap_extent(v.sql(_ZLINE)), _EXT)


@query("check_line_counts", """
    SELECT lap_key, error FROM (SELECT lap_key, unnest([
        CASE WHEN lap_key % 7 = 1 AND lap_key % 11 <> 2 THEN 'declares no channels' END,
        CASE WHEN lap_key % 11 = 2 THEN 'stored but not listed' END,
        CASE WHEN lap_key % 5 = 3 AND lap_key % 11 <> 2 THEN 'point count' END,
        CASE WHEN lap_key % 7 = 1 AND lap_key % 11 <> 2 THEN 'channel list' END,
        CASE WHEN lap_key % 10 = 0 OR floor(lap_key / 100) % 3 = 0 AND false THEN 'unavailable lap has a line' END]) AS error
      FROM manifest_o) t WHERE error IS NOT NULL""")
def _(v):
    line = v.sql(_ZLINE)
    manifest = tl.line_manifest(line).where("lap_key % 11 <> 2").withColumns({
        "points": F.col("points") + (F.col("lap_key") % 5 == 3).cast("int"),
        "channels": F.when(F.col("lap_key") % 7 == 1, "").otherwise(F.col("channels"))})
    refused = v.sql("SELECT DISTINCT lap_key FROM line_v WHERE lap_key % 10 = 0")
    return quality.check_line_counts(manifest, line, refused)


@query("check_qualifying_sources", """
    SELECT f.session_id, f.driver_id, f.time_s, list_min([q1_s, q2_s, q3_s]) AS official_s,
           round(abs(f.time_s - list_min([q1_s, q2_s, q3_s])), 6) AS drift_s
    FROM fastest_o f JOIN qualifying_v q USING (session_id, driver_id)
    WHERE round(abs(f.time_s - list_min([q1_s, q2_s, q3_s])), 6) > 0.01""")
def _(v):
    return quality.check_qualifying_sources(tl.fastest_laps(v.timing_laps), v.qualifying)
