"""Strategy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintline.catalog.registry import SHARED, query, r6
from stintline.functions.figures import rounded
from stintline.operators import strategy as st
from stintline.plans.race import race_document

DRIVERS = [0, 3, 4, 11, 17]
CHOSEN = "(" + ", ".join(map(str, DRIVERS)) + ")"

SHARED["stints_o"] = """
    SELECT session_id, driver_id, stint, start_lap, end_lap, end_lap - start_lap + 1 AS laps FROM (
      SELECT *, row_number() OVER w AS stint, greatest(1, coalesce(lag(end_lap) OVER w, 0) + 1) AS start_lap
      FROM (SELECT session_id, driver_id, lap AS end_lap, 0 AS fin FROM stops_v
            UNION ALL SELECT session_id, driver_id, max(lap), 1 FROM laps_v GROUP BY ALL) b
      WINDOW w AS (PARTITION BY session_id, driver_id ORDER BY fin, end_lap)) s
    WHERE end_lap >= start_lap"""
SHARED["elapsed_o"] = """
    SELECT session_id, driver_id, lap, round(s, 6) AS elapsed_s FROM (
      SELECT session_id, driver_id, lap,
             sum(time_s) OVER w AS s, max(CASE WHEN time_s IS NULL THEN 1 ELSE 0 END) OVER w AS broken
      FROM laps_v WINDOW w AS (PARTITION BY session_id, driver_id ORDER BY lap
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t
    WHERE broken = 0"""
SHARED["lapmedian_o"] = """
    SELECT session_id, lap, max(time_s) FILTER (WHERE rn = n // 2 + 1) AS median_s FROM (
      SELECT session_id, lap, time_s, row_number() OVER (PARTITION BY session_id, lap ORDER BY time_s) AS rn,
             count(*) OVER (PARTITION BY session_id, lap) AS n
      FROM laps_v WHERE time_s IS NOT NULL) t GROUP BY ALL"""
SHARED["racemedian_o"] = """
    SELECT session_id, max(median_s) FILTER (WHERE rn = n // 2 + 1) AS race_median_s FROM (
      SELECT session_id, median_s, row_number() OVER (PARTITION BY session_id ORDER BY median_s) AS rn,
             count(*) OVER (PARTITION BY session_id) AS n FROM lapmedian_o) t GROUP BY ALL"""
# The rule as a plain pair scan: every stop against every rival of the session.
SHARED["pairs_o"] = """
    SELECT *, CASE WHEN after_lap - before_lap > 10 THEN 'window_too_long'
                   WHEN others > 0 THEN 'another_stop_in_window'
                   WHEN gap_after IS NULL THEN 'incomplete_lap_data'
                   WHEN abs(round(gap_after - gap_before, 6)) > 120 THEN 'implausible_net' END AS reason
    FROM (SELECT q.*, eb.elapsed_s - ea.elapsed_s AS gap_before, fb.elapsed_s - fa.elapsed_s AS gap_after,
                 (SELECT count(*) FROM stops_v o WHERE o.session_id = q.session_id
                     AND o.driver_id IN (q.driver_id, q.rival_id) AND o.lap > q.before_lap AND o.lap <= q.after_lap
                     AND o.lap NOT IN (q.stop_lap, q.rival_stop_lap)) AS others
          FROM (SELECT a.session_id, a.driver_id, a.stop, a.lap AS stop_lap, a.lap - 1 AS before_lap,
                       b.driver_id AS rival_id, min(b.lap) FILTER (WHERE b.lap > a.lap) AS rival_stop_lap,
                       min(b.lap) FILTER (WHERE b.lap > a.lap) + 1 AS after_lap
                FROM stops_v a JOIN stops_v b ON a.session_id = b.session_id AND a.driver_id <> b.driver_id
                WHERE a.lap >= 2 GROUP BY ALL
                HAVING count(*) FILTER (WHERE b.lap <= a.lap - 1) = 0 AND count(*) FILTER (WHERE b.lap > a.lap) > 0) q
          JOIN elapsed_o ea ON ea.session_id = q.session_id AND ea.driver_id = q.driver_id AND ea.lap = q.before_lap
          JOIN elapsed_o eb ON eb.session_id = q.session_id AND eb.driver_id = q.rival_id AND eb.lap = q.before_lap
          LEFT JOIN elapsed_o fa ON fa.session_id = q.session_id AND fa.driver_id = q.driver_id AND fa.lap = q.after_lap
          LEFT JOIN elapsed_o fb ON fb.session_id = q.session_id AND fb.driver_id = q.rival_id AND fb.lap = q.after_lap
          WHERE abs(round(eb.elapsed_s - ea.elapsed_s, 6)) <= 30) p"""
SHARED["ledger_o"] = """
    SELECT p.session_id, driver_id, stop, stop_lap, rival_id, rival_stop_lap, after_lap - before_lap AS compared_laps,
           round(gap_before, 3) AS gap_before_s, round(gap_after, 3) AS gap_after_s,
           round(gap_after - gap_before, 3) AS net_s, round(gap_before, 6) > 0 AS ahead_before,
           round(gap_after, 6) > 0 AS ahead_after,
           coalesce((SELECT max(m.median_s) FILTER (WHERE m.rn = m.n // 2 + 1) FROM (
               SELECT l.median_s, row_number() OVER (ORDER BY l.median_s) AS rn, count(*) OVER () AS n
               FROM lapmedian_o l WHERE l.session_id = p.session_id AND l.lap BETWEEN p.before_lap AND p.after_lap) m)
             > r.race_median_s * 1.15, false) AS neutralised_window
    FROM pairs_o p JOIN racemedian_o r ON r.session_id = p.session_id WHERE reason IS NULL"""
SHARED["compounds_o"] = """
    SELECT s.*, CASE WHEN o.overlap * 1.0 / s.laps >= 0.6 THEN upper(trim(o.compound)) END AS compound,
           CASE WHEN o.overlap * 1.0 / s.laps >= 0.6 THEN 'matched' ELSE 'unmatched' END AS compound_source
    FROM stints_o s LEFT JOIN (
      SELECT * FROM (
        SELECT s.session_id, s.driver_id, s.stint, f.compound, least(s.end_lap, f.lap_end) - greatest(s.start_lap, f.lap_start) + 1 AS overlap,
               row_number() OVER (PARTITION BY s.session_id, s.driver_id, s.stint
                   ORDER BY least(s.end_lap, f.lap_end) - greatest(s.start_lap, f.lap_start) DESC, f.feed_stint) AS rn
        FROM stints_o s JOIN stint_feed_v f ON f.session_id = s.session_id AND f.driver_id = s.driver_id
          AND f.lap_start <= s.end_lap AND f.lap_end >= s.start_lap) t WHERE rn = 1) o
    ON o.session_id = s.session_id AND o.driver_id = s.driver_id AND o.stint = s.stint"""
SHARED["trendrows_o"] = """
    SELECT * FROM (
      SELECT *, count(*) OVER p AS trimmed, max(CASE WHEN rn = n // 2 + 1 THEN time_s END) OVER p AS mid FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, driver_id, stint ORDER BY time_s) AS rn,
               count(*) OVER (PARTITION BY session_id, driver_id, stint) AS n FROM (
          SELECT s.session_id, s.driver_id, s.stint, l.time_s,
                 CAST(row_number() OVER w AS DOUBLE) AS life, count(l.time_s) OVER w AS seen,
                 count(l.time_s) OVER (PARTITION BY s.session_id, s.driver_id, s.stint) AS usable
          FROM stints_o s JOIN laps_v l ON l.session_id = s.session_id AND l.driver_id = s.driver_id
            AND l.lap BETWEEN s.start_lap AND s.end_lap
          WINDOW w AS (PARTITION BY s.session_id, s.driver_id, s.stint ORDER BY l.lap)) a
        WHERE time_s IS NOT NULL AND (usable < 5 OR (seen > 1 AND seen < usable))) b
      WINDOW p AS (PARTITION BY session_id, driver_id, stint)) c
    WHERE trimmed >= 3 AND time_s <= mid * 1.07"""
# Residual regression: the curvature is the slope of y on what x does not explain of x squared.
SHARED["trend_o"] = """
    SELECT session_id, driver_id, stint, n AS sample_count, excluded_laps,
           CASE WHEN curved THEN base_q ELSE base_l END AS base_s,
           CASE WHEN curved THEN slope_q ELSE slope_l END AS deg_rate_s_per_lap,
           CASE WHEN curved THEN qa END AS quadratic_term, CASE WHEN curved THEN r2q ELSE r2l END AS r_squared
    FROM (SELECT *, n >= 5 AND coalesce(r2q - r2l > 0.03, false) AS curved FROM (
      SELECT session_id, driver_id, stint, count(*) AS n, any_value(trimmed) - count(*) AS excluded_laps,
             any_value(slope_l) AS slope_l, any_value(base_l) AS base_l, any_value(qa) AS qa,
             regr_slope(time_s - qa * life * life, life) AS slope_q,
             regr_intercept(time_s - qa * life * life, life) AS base_q,
             CASE WHEN max(time_s) = min(time_s) THEN 0.0 ELSE any_value(r2l) END AS r2l,
             CASE WHEN max(time_s) = min(time_s) THEN 0.0
                  ELSE 1 - (regr_syy(time_s - qa * life * life, life)
                            - power(regr_sxy(time_s - qa * life * life, life), 2) / regr_sxx(time_s - qa * life * life, life))
                           / regr_syy(time_s, life) END AS r2q
      FROM (SELECT *, regr_slope(time_s, life * life - c0 - c1 * life) OVER p AS qa FROM (
        SELECT *, regr_slope(time_s, life) OVER p AS slope_l, regr_intercept(time_s, life) OVER p AS base_l,
               regr_r2(time_s, life) OVER p AS r2l, regr_slope(life * life, life) OVER p AS c1,
               regr_intercept(life * life, life) OVER p AS c0
        FROM trendrows_o WINDOW p AS (PARTITION BY session_id, driver_id, stint)) a
        WINDOW p AS (PARTITION BY session_id, driver_id, stint)) b
      GROUP BY session_id, driver_id, stint HAVING count(*) >= 3) d) e"""


@query("build_stints", "SELECT * FROM stints_o")
def _(v):
    return st.build_stints(v.laps, v.stops)


@query("cumulative_times", "SELECT * FROM elapsed_o")
def _(v):
    return st.cumulative_times(v.laps)


@query("field_median_by_lap", "SELECT * FROM lapmedian_o JOIN racemedian_o USING (session_id)")
def _(v):
    return st.field_median_by_lap(v.laps)


@query("undercut_ledger", "SELECT * FROM ledger_o")
def _(v):
    return st.undercut_ledger(v.laps, v.stops)


@query("undercut_exclusions",
       "SELECT session_id, reason, count(*) AS pairs FROM pairs_o WHERE reason IS NOT NULL GROUP BY ALL")
def _(v):
    return st.undercut_exclusions(v.laps, v.stops)


@query("undercut_filter", f"""
    SELECT session_id, count(*) FILTER (WHERE NOT neutralised_window) AS clean,
           count(*) FILTER (WHERE neutralised_window) AS neutralised
    FROM ledger_o WHERE driver_id IN {CHOSEN} OR rival_id IN {CHOSEN} GROUP BY session_id""")
def _(v):
    return st.undercut_filter(st.undercut_ledger(v.laps, v.stops), DRIVERS)


_TREND = ["base_s", "deg_rate_s_per_lap", "quadratic_term", "r_squared"]
_TREND_SQL = ", ".join(f"{r6(c)} AS {c}" for c in _TREND)


def _trend(v):
    return st.stint_trend(v.laps, st.build_stints(v.laps, v.stops))


def _shown(fits):
    return fits.withColumns({c: rounded(c) for c in _TREND})


@query("stint_trend",
       f"SELECT session_id, driver_id, stint, sample_count, excluded_laps, {_TREND_SQL} FROM trend_o")
def _(v):
    return _shown(_trend(v))


@query("fit_reliability", f"""
    SELECT session_id, driver_id, stint, sample_count, {r6('r_squared')} AS r_squared,
           sample_count >= 6 AND r_squared >= 0.3 AS reliable,
           CASE WHEN sample_count < 6 THEN 'samples_low'
                WHEN r_squared < 0.3 THEN 'r_squared_low' END AS withheld_reason
    FROM trend_o""")
def _(v):
    return st.fit_reliability(_trend(v)).select(
        *st.STINT, "sample_count", rounded("r_squared").alias("r_squared"), "reliable", "withheld_reason")


@query("fits_for_drivers",
       f"SELECT session_id, driver_id, stint, sample_count, excluded_laps, {_TREND_SQL} FROM trend_o WHERE driver_id IN {CHOSEN}")
def _(v):
    return st.fits_for_drivers(_shown(_trend(v)), DRIVERS)


@query("fuel_corrected", f"""
    SELECT session_id, driver_id, lap, {r6('c')} AS corrected_s FROM (
      SELECT *, time_s - 0.055 * (max(lap) OVER (PARTITION BY session_id) - lap) AS c FROM laps_v) t""")
def _(v):
    return st.fuel_corrected(v.laps, 0.055).withColumn("corrected_s", rounded("corrected_s"))


@query("session_pit_loss", f"""
    SELECT session_id, CASE WHEN g > 0 AND n > 0 THEN {r6('p - 2 * b')} END AS pit_loss_s,
           CASE WHEN g > 0 AND n > 0 THEN n ELSE 0 END AS sample_size,
           CASE WHEN g = 0 THEN 'green_laps_missing'
                WHEN n = 0 THEN 'stops_missing' END AS withheld_reason
    FROM (SELECT session_id, median(time_s) FILTER (WHERE ok) AS b, median(time_s) FILTER (WHERE box) AS p,
                 count(*) FILTER (WHERE ok) AS g, count(*) FILTER (WHERE box) AS n
          FROM (SELECT l.session_id, l.time_s, l.pit OR t.is_pit_out AS box,
                       NOT l.pit AND NOT t.is_pit_out AND l.time_s IS NOT NULL AND l.time_s < 110 AS ok
                FROM laps_v l JOIN timing_laps_v t USING (session_id, driver_id, lap)) a GROUP BY session_id) b""")
def _(v):
    timing = v.timing_laps.select("session_id", "driver_id", "lap", "is_pit_out")
    laps = v.laps.join(timing, ["session_id", "driver_id", "lap"]).select(
        "session_id", "time_s", F.col("pit").alias("is_in"), F.col("is_pit_out").alias("is_out"),
        (F.col("time_s").isNotNull() & ~F.col("pit") & ~F.col("is_pit_out")).alias("accurate"),
        (F.coalesce(F.col("time_s") < 110, F.lit(False))).alias("green"))
    return st.session_pit_loss(laps).withColumn("pit_loss_s", rounded("pit_loss_s"))


@query("session_best", """
    SELECT session_id, driver_id, lap, time_s FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_s, lap, driver_id) AS rn
      FROM laps_v WHERE time_s IS NOT NULL) t WHERE rn = 1""")
def _(v):
    return st.session_best(v.laps)


@query("lap_series", f"SELECT session_id, driver_id, lap, time_s FROM laps_v WHERE driver_id IN {CHOSEN}")
def _(v):
    return st.lap_series(v.laps, DRIVERS)


@query("lap_table", "SELECT session_id, lap, " + ", ".join(
    f"min(time_s) FILTER (WHERE driver_id = {d}) AS driver_{d}_s" for d in DRIVERS)
    + " FROM laps_v GROUP BY session_id, lap")
def _(v):
    return st.lap_table(v.laps, DRIVERS)


@query("compounds_run", """
    SELECT DISTINCT session_id, compound, CASE compound WHEN 'SOFT' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HARD' THEN 3
           WHEN 'INTERMEDIATE' THEN 4 WHEN 'WET' THEN 5 END AS position
    FROM compounds_o WHERE compound IS NOT NULL""")
def _(v):
    return st.compounds_run(_compounds(v))


@query("robust_range", f"""
    SELECT session_id, round(lo - pad, 6) AS y_min, round(hi + pad, 6) AS y_max,
           count(*) FILTER (WHERE time_s < round(lo - pad, 6) OR time_s > round(hi + pad, 6)) AS clipped, count(*) AS total
    FROM (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) * 0.12 END AS pad FROM (
      SELECT session_id, max(CASE WHEN rn = least(n - 1, floor(0.01 * n)) THEN time_s END) AS lo,
             max(CASE WHEN rn = least(n - 1, floor(0.93 * n)) THEN time_s END) AS hi
      FROM (SELECT session_id, time_s, row_number() OVER (PARTITION BY session_id ORDER BY time_s) - 1 AS rn,
                   count(*) OVER (PARTITION BY session_id) AS n FROM laps_v WHERE time_s IS NOT NULL) a
      GROUP BY session_id) b) c JOIN laps_v USING (session_id) WHERE time_s IS NOT NULL GROUP BY ALL""")
def _(v):
    return st.robust_range(v.laps)


def _compounds(v):
    return st.attach_compounds(st.build_stints(v.laps, v.stops), v.stint_feed)


@query("attach_compounds", "SELECT * FROM compounds_o")
def _(v):
    return _compounds(v)


SHARED["creport_o"] = """
    SELECT session_id, count(*) AS stints, count(compound) AS identified, count(compound) / count(*) AS share
    FROM compounds_o GROUP BY session_id"""


@query("compound_report", f"""
    SELECT session_id, stints, identified, {r6('share')} AS share, '' AS unknown_compounds FROM creport_o""")
def _(v):
    return st.compound_report(_compounds(v)).withColumn("share", rounded("share"))


@query("race_document", """
    SELECT session_id, total_laps, stints, identified, coalesce(undercuts, 0) AS undercuts,
           coalesce(undercuts_excluded, 0) AS undercuts_excluded, coalesce(fits, 0) AS fits,
           coalesce(reliable_fits, 0) AS reliable_fits
    FROM (SELECT session_id, max(lap) AS total_laps FROM laps_v GROUP BY session_id) l
    LEFT JOIN (SELECT session_id, stints, identified FROM creport_o) c USING (session_id)
    LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE reason IS NULL) AS undercuts,
                      count(reason) AS undercuts_excluded FROM pairs_o GROUP BY session_id) p USING (session_id)
    LEFT JOIN (SELECT session_id, count(*) AS fits,
                      count(*) FILTER (WHERE sample_count >= 6 AND r_squared >= 0.3) AS reliable_fits
               FROM trend_o GROUP BY session_id) t USING (session_id)""")
def _(v):
    v = v.keeping("laps")
    return race_document(v.laps, v.stops, v.stint_feed)
