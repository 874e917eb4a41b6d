"""Race-record queries: control messages, slow laps, changes, radio, weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintline.catalog.registry import SHARED, query, r6
from stintline.functions.figures import rounded
from stintline.operators import quality
from stintline.operators import record as rec

DRIVERS = """
    SELECT DISTINCT session_id, driver_id, 'D' || CAST(driver_id AS VARCHAR(9)) AS code
    FROM results_v WHERE driver_id % 3 <> 1"""
SHARED["drivers_o"] = DRIVERS

SHARED["rcstate_o"] = """
    SELECT *, last_value(CASE WHEN kind IN ('open', 'close') THEN {'kind': kind, 'lap': lap} END IGNORE NULLS) OVER (
        PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT session_id, ts, seq, lap, CASE
            WHEN category = 'SafetyCar' AND (message LIKE '%ENDING%' OR message LIKE '%IN THIS LAP%') THEN 'close'
            WHEN category = 'SafetyCar' AND message LIKE '%DEPLOYED%' THEN 'open'
            WHEN category <> 'SafetyCar' AND message LIKE '%SAFETY CAR LIGHTS ON%' THEN 'lights'
            WHEN category <> 'SafetyCar' AND flag = 'RED' THEN 'red' END AS kind FROM race_control_v) t
    WHERE kind IS NOT NULL"""
SHARED["neutral_o"] = """
    SELECT DISTINCT session_id, CAST(unnest(range(a, b + 1)) AS INT) AS lap FROM (
      SELECT session_id, least(before.lap, lap) AS a, greatest(before.lap, lap) AS b FROM rcstate_o
        WHERE kind = 'close' AND before.kind = 'open'
      UNION ALL SELECT session_id, lap, lap + 5 FROM rcstate_o WHERE kind = 'lights' AND before.kind IS DISTINCT FROM 'open'
      UNION ALL SELECT session_id, lap, lap FROM rcstate_o WHERE kind = 'red'
      UNION ALL SELECT session_id, m.lap, m.lap + 5 FROM (
        SELECT session_id, arg_max({'kind': kind, 'lap': lap}, {'ts': ts, 'seq': seq}) AS m FROM rcstate_o
        WHERE kind IN ('open', 'close') GROUP BY session_id) l WHERE m.kind = 'open') s"""
SHARED["trackflags_o"] = """
    SELECT session_id, lap, seq, upper(flag) AS flag, sector, trim(message) AS message FROM race_control_v
    WHERE lap <> 0 AND flag IS NOT NULL AND coalesce(driver_id, 0) = 0
      AND flag NOT IN ('BLUE', 'BLACK AND WHITE', 'BLACK', 'BLACK AND ORANGE', 'GREEN', 'CLEAR', 'CHEQUERED')"""
SHARED["incidents_o"] = """
    SELECT m.session_id, m.driver_id, seq, lap, coalesce(d.code, CAST(m.driver_id AS VARCHAR)) AS code,
           CASE WHEN flag = 'BLUE' THEN 'informational' ELSE 'noted' END AS nature, category, flag, trim(message) AS message
    FROM race_control_v m LEFT JOIN drivers_o d ON d.session_id = m.session_id AND d.driver_id = m.driver_id
    WHERE coalesce(m.driver_id, 0) <> 0 AND category IN ('Flag', 'Other', 'CarEvent', 'Drs') AND trim(message) <> ''"""
SHARED["slow_o"] = """
    SELECT session_id, driver_id, lap, round(time_s, 3) AS lap_time_s, round(base, 3) AS baseline_s,
           round(time_s - base, 3) AS estimated_loss_s,
           CASE WHEN time_s - base >= 10 THEN 'major' WHEN time_s - base >= 4 THEN 'moderate' ELSE 'minor' END AS severity
    FROM (SELECT *, median(time_s) OVER (PARTITION BY session_id, driver_id) AS base,
                 count(*) OVER (PARTITION BY session_id, driver_id) AS green
          FROM (SELECT *, lead(is_pit_out, 1, false) OVER (PARTITION BY session_id, driver_id ORDER BY lap) AS box
                FROM timing_laps_v) t
          WHERE time_s IS NOT NULL AND NOT is_pit_out AND lap >= 2 AND NOT box
            AND NOT EXISTS (SELECT 1 FROM neutral_o n WHERE n.session_id = t.session_id AND n.lap = t.lap)) g
    WHERE green >= 5 AND time_s - base >= 2"""
SHARED["slowflags_o"] = """
    SELECT s.*, coalesce(f.n, 0) AS flag_messages, coalesce(f.flags, '') AS flags FROM slow_o s LEFT JOIN (
      SELECT session_id, lap, count(*) AS n, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags
      FROM trackflags_o GROUP BY ALL) f USING (session_id, lap)"""


def _drivers(v):
    return v.sql(DRIVERS)


def _slow(v):
    return rec.slow_laps(v.timing_laps, rec.neutralised_laps(v.race_control))


@query("neutralised_laps", "SELECT * FROM neutral_o")
def _(v):
    return rec.neutralised_laps(v.race_control)


@query("track_flags", "SELECT * FROM trackflags_o")
def _(v):
    return rec.track_flags(v.race_control)


@query("track_flags_on_laps", "SELECT * FROM slowflags_o")
def _(v):
    return rec.track_flags_on_laps(_slow(v), v.race_control)


@query("attributed_incidents", "SELECT * FROM incidents_o")
def _(v):
    return rec.attributed_incidents(v.race_control, _drivers(v))


@query("slow_laps", "SELECT * FROM slow_o")
def _(v):
    return _slow(v)


SHARED["review_o"] = """
    SELECT session_id, driver_id, lap, 'recorded' AS kind, nature AS label, message, CAST(NULL AS DOUBLE) AS estimated_loss_s,
           CAST(NULL AS VARCHAR) AS flags, CAST(NULL AS INT) AS severity_rank FROM incidents_o
    UNION ALL
    SELECT session_id, driver_id, lap, 'flagged', severity, NULL, estimated_loss_s, flags,
           CASE severity WHEN 'major' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END FROM slowflags_o"""


def _review(v):
    return rec.error_review(v.timing_laps, v.race_control, _drivers(v))


@query("error_review", "SELECT * FROM review_o")
def _(v):
    return _review(v)


_DISMISSED = "SELECT session_id, driver_id, lap FROM laps_v WHERE (driver_id + lap) % 3 = 0"


@query("split_dismissed", "SELECT *, kind = 'flagged' AND (driver_id + lap) % 3 = 0 AS hidden FROM review_o")
def _(v):
    return rec.split_dismissed(_review(v), v.sql(_DISMISSED))


@query("restore_all", f"SELECT * FROM ({_DISMISSED}) d WHERE driver_id % 2 = 1")
def _(v):
    return rec.restore_all(v.sql(_DISMISSED), v.laps.where("driver_id % 2 = 0"))


SHARED["net_o"] = """
    SELECT session_id, driver_id, CAST(sum(m) AS BIGINT) AS made, CAST(sum(s) AS BIGINT) AS suffered,
           CAST(sum(m) - sum(s) AS BIGINT) AS net
    FROM (SELECT session_id, gained_by AS driver_id, 1 AS m, 0 AS s FROM changes_v
          UNION ALL SELECT session_id, lost_by, 0, 1 FROM changes_v) t GROUP BY ALL"""
SHARED["residual_o"] = """
    SELECT r.session_id, r.driver_id, r.grid - r.position AS official_net, coalesce(n.net, 0) AS recorded_net,
           coalesce(n.net, 0) - (r.grid - r.position) AS residual
    FROM results_v r LEFT JOIN net_o n ON n.session_id = r.session_id AND n.driver_id = r.driver_id
    WHERE r.kind = 'race' AND r.grid <> 0 AND r.session_id IN (SELECT session_id FROM changes_v)"""
SHARED["complete_o"] = """
    SELECT session_id, count(*) AS drivers, median(abs(residual)) AS median_abs_residual,
           count(*) FILTER (WHERE residual = 0) AS exact FROM residual_o GROUP BY session_id"""


def _race(v):
    return v.results.where("kind = 'race'")


@query("position_change_net", "SELECT * FROM net_o")
def _(v):
    return rec.position_change_net(v.changes)


@query("change_residuals", "SELECT * FROM residual_o")
def _(v):
    return rec.change_residuals(rec.position_change_net(v.changes), _race(v))


@query("change_completeness", "SELECT * FROM complete_o")
def _(v):
    return rec.change_completeness(rec.position_change_net(v.changes), _race(v))


# The threshold is a parameter so that both sides of it show on these data.
@query("position_changes", """
    SELECT session_id, changes, changes >= 286 AS published, CASE WHEN changes >= 286 THEN drivers END AS drivers,
           CASE WHEN changes >= 286 THEN median_abs_residual END AS median_abs_residual,
           CASE WHEN changes >= 286 THEN exact END AS exact,
           CASE WHEN changes < 286 THEN 'too few changes: the feed did not cover the session' END AS withheld_reason
    FROM (SELECT session_id, count(*) AS changes FROM changes_v GROUP BY session_id) c LEFT JOIN complete_o USING (session_id)""")
def _(v):
    return rec.position_changes(v.changes, _race(v), 286)


SHARED["starts_o"] = "SELECT session_id, lap, min(start_ts) AS start_ts FROM timing_laps_v GROUP BY ALL"
SHARED["begun_o"] = """
    SELECT session_id, lap, max(start_ts) OVER (PARTITION BY session_id ORDER BY lap) AS ts FROM starts_o"""
SHARED["clips_o"] = """
    SELECT c.*, b.lap FROM radio_v c ASOF LEFT JOIN begun_o b ON b.session_id = c.session_id AND c.ts >= b.ts"""
SHARED["timeline_o"] = """
    SELECT c.*, d.code FROM clips_o c LEFT JOIN drivers_o d ON d.session_id = c.session_id AND d.driver_id = c.driver_id"""


@query("lap_starts", "SELECT * FROM starts_o")
def _(v):
    return rec.lap_starts(v.timing_laps)


def _late(v):
    return rec.lap_starts(v.timing_laps)


@query("lap_at", "SELECT * FROM clips_o")
def _(v):
    return rec.lap_at(v.radio, _late(v))


def _timeline(v):
    return rec.radio_timeline(v.radio, _late(v), _drivers(v))


@query("radio_timeline", "SELECT * FROM timeline_o")
def _(v):
    return _timeline(v)


@query("radio_counts",
       "SELECT session_id, driver_id, count(*) AS clips, max(code) AS code FROM timeline_o GROUP BY ALL")
def _(v):
    return rec.radio_counts(_timeline(v))


@query("radio_summary", """
    SELECT session_id, count(*) AS clips, count(*) >= 283 AS published, CASE WHEN count(*) >= 283 THEN count(lap) END AS with_lap,
           CASE WHEN count(*) < 283 THEN 'a handful of stray messages rather than a timeline' END AS withheld_reason
    FROM timeline_o GROUP BY session_id""")
def _(v):
    return rec.radio_summary(_timeline(v), 283)


@query("radio_for_driver", "SELECT * FROM timeline_o WHERE driver_id IN (1, 4, 9)")
def _(v):
    return rec.radio_for_driver(_timeline(v), [1, 4, 9])


WINDOWS = """
    SELECT session_id, min(ts) + INTERVAL '2' DAY AS start_ts,
           min(ts) + CASE WHEN session_id % 2000 = 0 THEN INTERVAL '20' DAY ELSE INTERVAL '1' DAY END AS end_ts
    FROM trackside_v GROUP BY session_id"""
SHARED["within_o"] = f"""
    SELECT a.* FROM archive_v a JOIN ({WINDOWS}) w USING (session_id)
    WHERE strftime(a.hour_ts, '%Y-%m-%dT%H') BETWEEN strftime(w.start_ts, '%Y-%m-%dT%H') AND strftime(w.end_ts, '%Y-%m-%dT%H')
       OR (w.end_ts < w.start_ts AND strftime(a.hour_ts, '%Y-%m-%dT%H') = strftime(w.start_ts, '%Y-%m-%dT%H'))"""
SHARED["trackside_o"] = """
    SELECT session_id, count(*) AS samples, median(air_c) AS air_c, min(air_c) AS air_min_c, max(air_c) AS air_max_c,
           median(track_c) AS track_c, min(track_c) AS track_min_c, max(track_c) AS track_max_c,
           count(*) FILTER (WHERE rainfall > 0) AS wet_samples,
           count(*) FILTER (WHERE rainfall > 0) / nullif(count(rainfall), 0) AS wet_share
    FROM trackside_v GROUP BY session_id"""
SHARED["archive_o"] = """
    SELECT session_id, count(*) AS hours, median(air_c) AS archive_air_c, coalesce(sum(precip_mm), 0) AS precip_mm
    FROM within_o GROUP BY session_id"""
SHARED["wcheck_o"] = """
    SELECT session_id, air_c, archive_air_c, archive_air_c IS NOT NULL AS compared,
           round(abs(air_c - archive_air_c), 9) AS delta_c, round(abs(air_c - archive_air_c), 9) <= 2.15 AS agrees
    FROM trackside_o LEFT JOIN archive_o USING (session_id)"""
_NUM = ["air_c", "air_min_c", "air_max_c", "track_c", "track_min_c", "track_max_c", "wet_share", "archive_air_c",
        "precip_mm", "delta_c"]


def _rep(cols):
    return "REPLACE (" + ", ".join(f"{r6(c)} AS {c}" for c in cols) + ")"


def _rounded(df):
    return df.withColumns({c: rounded(c) for c in _NUM if c in df.columns})


def _hours(v):
    return rec.hours_within(v.sql(WINDOWS), v.archive)


@query("hours_within", f"SELECT * {_rep(['air_c', 'precip_mm'])} FROM within_o")
def _(v):
    return _rounded(_hours(v))


@query("trackside_summary", f"SELECT * {_rep(_NUM[:7])} FROM trackside_o")
def _(v):
    return _rounded(rec.trackside_summary(v.trackside))


@query("archive_summary", f"SELECT * {_rep(['archive_air_c', 'precip_mm'])} FROM archive_o")
def _(v):
    return _rounded(rec.archive_summary(_hours(v)))


@query("weather_cross_check", f"SELECT * {_rep(['air_c', 'archive_air_c', 'delta_c'])} FROM wcheck_o")
def _(v):
    return _rounded(rec.weather_cross_check(
        rec.trackside_summary(v.trackside), rec.archive_summary(_hours(v)), 2.15))


SHARED["conditions_o"] = """
    SELECT session_id, samples, hours, withheld_reason, withheld_reason IS NULL AS published, """ + ", ".join(
        f"CASE WHEN samples >= 285 THEN {k} END AS {k}" for k in (
            "air_c", "air_min_c", "air_max_c", "track_c", "track_min_c", "track_max_c", "wet_samples", "wet_share", "archive_air_c", "precip_mm", "compared",
            "delta_c", "agrees")) + """ FROM (
      SELECT t.*, a.hours, a.archive_air_c, a.precip_mm, c.compared, c.delta_c, c.agrees,
             CASE WHEN samples < 285 THEN 'too few trackside readings'
                  WHEN compared AND NOT agrees THEN 'the two sources disagree on air temperature' END AS withheld_reason
      FROM trackside_o t LEFT JOIN archive_o a USING (session_id) LEFT JOIN wcheck_o c USING (session_id)) x"""


def _conditions(v):
    return rec.session_conditions(v.trackside, _hours(v), 285, 2.15)


@query("session_conditions", f"SELECT * {_rep(_NUM)} FROM conditions_o")
def _(v):
    return _rounded(_conditions(v))


@query("conditions_counts", """
    SELECT CAST(floor(session_id / 1000) AS INT) AS season, count(*) FILTER (WHERE published) AS published,
           count(*) FILTER (WHERE NOT published) AS withheld FROM conditions_o GROUP BY ALL""")
def _(v):
    return rec.conditions_counts(_conditions(v))


# The gates run on doctored copies, so that each of them has something to find.
@query("check_conditions", """
    SELECT session_id, unnest(list_filter([
             CASE WHEN published AND session_id % 5000 = 0 THEN 'compared flag' END,
             CASE WHEN published AND session_id % 5000 <> 0 AND session_id % 3000 = 0 THEN 'gap between the sources' END,
             CASE WHEN NOT published AND session_id % 4000 = 0 THEN 'withheld without a reason' END],
             lambda e: e IS NOT NULL)) AS error
    FROM conditions_o""")
def _(v):
    doctored = _conditions(v).withColumns({
        "compared": F.when(F.col("session_id") % 5000 == 0, ~F.col("compared")).otherwise(F.col("compared")),
        "delta_c": F.when(F.col("session_id") % 3000 == 0, F.col("delta_c") + 1).otherwise(F.col("delta_c")),
        "withheld_reason": F.when(F.col("session_id") % 4000 != 0, F.col("withheld_reason"))})
    return quality.check_conditions(doctored, 2.15)


@query("check_changes", """
    SELECT session_id, NULL AS driver_id, 'made and suffered differ' AS error FROM (SELECT session_id FROM net_o
      GROUP BY session_id HAVING count(*) FILTER (WHERE driver_id = 3 AND session_id % 2000 = 0) > 0)
    UNION ALL SELECT session_id, driver_id, 'net is not made minus suffered' FROM net_o
      WHERE driver_id = 3 AND session_id % 2000 = 0
    UNION ALL SELECT session_id, driver_id, 'residual is not recorded minus official' FROM residual_o
      WHERE driver_id = 5""")
def _(v):
    net = rec.position_change_net(v.changes)
    residuals = rec.change_residuals(net, _race(v)).withColumn(
        "residual", F.col("residual") + (F.col("driver_id") == 5).cast("int"))
    doctored = net.withColumn(
        "made", F.col("made") + F.when((F.col("driver_id") == 3) & (F.col("session_id") % 2000 == 0), 1).otherwise(0))
    return quality.check_changes(doctored, residuals)


@query("check_radio", """
    SELECT session_id, clip_id, 'clip without a link' AS error FROM radio_v WHERE clip_id % 7 = 0
    UNION ALL SELECT session_id, clip_id, 'carries a ''tone'' column' FROM radio_v""")
def _(v):
    doctored = v.radio.withColumns({
        "link": F.when(F.col("clip_id") % 7 != 0, F.col("link")), "tone": F.lit("calm")})
    return quality.check_radio(doctored)
