"""Qualifying and sprint-weekend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintline.catalog.registry import SHARED, query, r6
from stintline.functions.figures import classified, rounded
from stintline.operators import quality
from stintline.operators import season as sn
from stintline.operators import weekend as wk

SHARED["pairs2_o"] = """
    SELECT a.session_id, a.constructor_id, a AS a, b AS b FROM qualifying_v a JOIN qualifying_v b
      ON a.session_id = b.session_id AND a.constructor_id = b.constructor_id AND a.position < b.position
    WHERE (SELECT count(*) FROM qualifying_v c WHERE c.session_id = a.session_id AND c.constructor_id = a.constructor_id) = 2"""
SHARED["h2h_o"] = """
    SELECT session_id, constructor_id, a.driver_id AS ahead, b.driver_id AS behind, segment, gap_s,
           CASE WHEN segment IS NOT NULL THEN CASE WHEN sa <= sb THEN a.driver_id ELSE b.driver_id END END AS ahead_by_segment
    FROM (SELECT *, round(abs(sa - sb), 3) AS gap_s FROM (
      SELECT *, CASE WHEN a.q3_s > 0 AND b.q3_s > 0 THEN 'Q3' WHEN a.q2_s > 0 AND b.q2_s > 0 THEN 'Q2'
                     WHEN a.q1_s > 0 AND b.q1_s > 0 THEN 'Q1' END AS segment,
             CASE segment WHEN 'Q3' THEN a.q3_s WHEN 'Q2' THEN a.q2_s WHEN 'Q1' THEN a.q1_s END AS sa,
             CASE segment WHEN 'Q3' THEN b.q3_s WHEN 'Q2' THEN b.q2_s WHEN 'Q1' THEN b.q1_s END AS sb FROM pairs2_o) t) u"""


@query("team_mate_pairs", "SELECT session_id, constructor_id, a.driver_id AS driver_a, b.driver_id AS driver_b FROM pairs2_o")
def _(v):
    return wk.team_mate_pairs(v.qualifying).select(
        "session_id", "constructor_id", F.col("a.driver_id").alias("driver_a"), F.col("b.driver_id").alias("driver_b"))


@query("head_to_head", "SELECT * FROM h2h_o")
def _(v):
    return wk.head_to_head(v.qualifying)


@query("head_to_head_season", """
    SELECT CAST(floor(session_id / 1000) AS INT) AS season, constructor_id, least(ahead, behind) AS driver_a,
           greatest(ahead, behind) AS driver_b, count(*) FILTER (WHERE ahead < behind) AS beats_a,
           count(*) FILTER (WHERE ahead > behind) AS beats_b, count(*) AS rounds_compared,
           count(gap_s) AS rounds_with_gap, round(median(gap_s), 3) AS median_gap_s FROM h2h_o GROUP BY ALL""")
def _(v):
    return wk.head_to_head_season(wk.head_to_head(v.qualifying))


@query("segment_bests", """
    SELECT session_id, driver_id, q1_s, q2_s, q3_s, """ + ", ".join(f"""
           CASE WHEN {s}_s = min({s}_s) OVER (PARTITION BY session_id) THEN 'session best'
                WHEN (q1_s IS NOT NULL)::INT + (q2_s IS NOT NULL)::INT + (q3_s IS NOT NULL)::INT > 1
                     AND {s}_s = list_min([q1_s, q2_s, q3_s]) THEN 'personal best' END AS {s}_mark""" for s in ("q1", "q2", "q3")) + """
    FROM qualifying_v""")
def _(v):
    return wk.segment_bests(v.qualifying)


_STATUSES = """
    SELECT season, driver_id, CASE (driver_id + round) % 9 WHEN 0 THEN '+1 Lap' WHEN 1 THEN '+12 Laps' WHEN 2 THEN 'Excluded'
           WHEN 3 THEN 'Disqualified' WHEN 4 THEN 'Lapse' WHEN 5 THEN NULL WHEN 6 THEN 'Withdrew' ELSE status END AS status
    FROM results_v"""


@query("classified", f"""
    SELECT season, driver_id, status, coalesce(status IN ('Finished', 'Lapped')
           OR (starts_with(status, '+') AND split_part(rtrim(status, '.'), ' ', -1) IN ('Lap', 'Laps')), false) AS classified
    FROM ({_STATUSES}) s""")
def _(v):
    return v.sql(_STATUSES).withColumn("classified", classified("status"))


@query("unrecognised_statuses", f"""
    SELECT DISTINCT season, status FROM ({_STATUSES}) s WHERE status NOT IN ('Finished', 'Lapped', 'Retired', 'Disqualified',
      'Did not start') AND NOT regexp_matches(status, '^[+][0-9]+ Laps?$')""")
def _(v):
    return wk.unrecognised_statuses(v.sql(_STATUSES))


def _ranks_sql(value: str, source: str) -> str:
    return (f"rank() OVER (PARTITION BY session_id ORDER BY {value}) + (count(*) OVER (PARTITION BY session_id, {value}) - 1) / 2.0")


@query("average_ranks", f"""
    SELECT session_id, driver_id, grid, CAST({_ranks_sql('grid', '')} AS DOUBLE) AS grid_rank
    FROM results_v WHERE kind = 'race'""")
def _(v):
    return wk.average_ranks(v.results.where("kind = 'race'").select("session_id", "driver_id", "grid"),
                            ["session_id"], "grid", "grid_rank")


@query("spearman", f"""
    SELECT session_id, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0
           THEN {r6('corr(rx, ry)')} END AS rho
    FROM (SELECT session_id, CAST({_ranks_sql('grid', '')} AS DOUBLE) AS rx, CAST({_ranks_sql('position', '')} AS DOUBLE) AS ry
          FROM results_v WHERE kind = 'race') t GROUP BY session_id""")
def _(v):
    return wk.spearman(v.results.where("kind = 'race'"), ["session_id"], "grid", "position").withColumn(
        "rho", rounded("rho"))


_OK = "coalesce({s}_status IN ('Finished', 'Lapped'), false)"
SHARED["weekend_o"] = f"""
    SELECT *, {_OK.format(s='sprint')} AS sprint_classified, {_OK.format(s='race')} AS race_classified FROM (
      SELECT season, round, driver_id, coalesce(s.team_id, r.team_id) AS team_id,
             s.grid AS sprint_grid, s.position AS sprint_finish, s.status AS sprint_status, s.points AS sprint_points, s.laps AS sprint_laps,
             r.grid AS race_grid, r.position AS race_finish, r.status AS race_status, r.points AS race_points, r.laps AS race_laps
      FROM (SELECT * FROM scored_o WHERE kind = 'sprint' AND driver_id % 7 <> 2) s
      FULL JOIN (SELECT * FROM scored_o WHERE kind = 'race' AND session_id % 2 = 0 AND driver_id % 7 <> 4) r
      USING (season, round, driver_id)) t"""


def _weekend(v):
    rows = sn.scored(v.results, sn.points_table(v.spark))
    return wk.sprint_weekend(rows.where("kind = 'sprint' AND driver_id % 7 <> 2"),
                             rows.where("kind = 'race' AND session_id % 2 = 0 AND driver_id % 7 <> 4"))


@query("sprint_weekend", "SELECT * FROM weekend_o")
def _(v):
    return _weekend(v)


def _moved_sql(side: str) -> str:
    ok = f"{side}_classified AND {side}_grid > 0 AND {side}_finish > 0"
    return f"""avg(abs({side}_finish - {side}_grid)) FILTER (WHERE {ok}) AS {side}_mean_places,
               count(*) FILTER (WHERE {ok}) AS {side}_sample,
               count(*) FILTER (WHERE NOT coalesce({ok}, false)) AS {side}_excluded"""


_RK = "rank() OVER (PARTITION BY season, round ORDER BY {c}_finish) + (count(*) OVER (PARTITION BY season, round, {c}_finish) - 1) / 2.0"
SHARED["sprintround_o"] = f"""
    SELECT t.*, coalesce(c.n, 0) AS n, c.rho,
           CASE WHEN c.rho IS NULL THEN 'too few drivers classified in both races' END AS withheld_reason
    FROM (SELECT season, round, coalesce(max(sprint_laps), 0) AS sprint_laps, coalesce(max(race_laps), 0) AS race_laps,
                 coalesce(sum(sprint_points), 0) AS sprint_points, coalesce(sum(race_points), 0) AS race_points,
                 {_moved_sql('sprint')}, {_moved_sql('race')} FROM weekend_o GROUP BY ALL) t
    LEFT JOIN (SELECT season, round, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0
                      THEN corr(x, y) END AS rho
               FROM (SELECT season, round, CAST({_RK.format(c='sprint')} AS DOUBLE) AS x, CAST({_RK.format(c='race')} AS DOUBLE) AS y
                     FROM weekend_o WHERE sprint_classified AND race_classified) k GROUP BY ALL) c USING (season, round)"""
_ROUND_NUM = ["sprint_mean_places", "race_mean_places", "rho"]
_ROUND_REP = "REPLACE (" + ", ".join(f"{r6(c)} AS {c}" for c in _ROUND_NUM) + ")"


def _rounds(v):
    return wk.sprint_round(_weekend(v))


@query("places_changed", f"SELECT season, round, {_moved_sql('race').replace('avg(', 'round(avg(').replace(') AS race_mean_places', ', 6) AS race_mean_places').replace('race_finish > 0, 6)', 'race_finish > 0), 6)')} FROM weekend_o GROUP BY ALL")
def _(v):
    return wk.places_changed(_weekend(v), ["season", "round"], "race").withColumn(
        "race_mean_places", rounded("race_mean_places"))


@query("sprint_round", f"SELECT * {_ROUND_REP} FROM sprintround_o")
def _(v):
    return _rounds(v).withColumns({c: rounded(c) for c in _ROUND_NUM})


SHARED["sprintseason_o"] = """
    SELECT season, count(*) AS rounds_run, median(rho) AS median_rho, count(rho) AS rho_rounds,
           avg(sprint_mean_places) AS sprint_mean_places, avg(race_mean_places) AS race_mean_places,
           least(count(sprint_mean_places), count(race_mean_places)) AS movement_rounds FROM sprintround_o GROUP BY season"""
_SEASON_NUM = ["median_rho", "sprint_mean_places", "race_mean_places"]


@query("sprint_season", "SELECT * REPLACE (" + ", ".join(f"{r6(c)} AS {c}" for c in _SEASON_NUM) + ") FROM sprintseason_o")
def _(v):
    return wk.sprint_season(_rounds(v)).withColumns({c: rounded(c) for c in _SEASON_NUM})


SHARED["sprintpoints_o"] = """
    SELECT season, driver_id, coalesce(sum(sprint_points), 0) AS sprint_points, coalesce(sum(race_points), 0) AS race_points,
           coalesce(sum(sprint_points), 0) + coalesce(sum(race_points), 0) AS weekend_points,
           coalesce(sum(sprint_points), 0) / (coalesce(sum(sprint_points), 0) + coalesce(sum(race_points), 0)) AS sprint_share
    FROM weekend_o GROUP BY season, driver_id HAVING coalesce(sum(sprint_points), 0) + coalesce(sum(race_points), 0) > 0"""


@query("sprint_points", f"SELECT * REPLACE ({r6('sprint_share')} AS sprint_share) FROM sprintpoints_o")
def _(v):
    return wk.sprint_points(_weekend(v)).withColumn("sprint_share", rounded("sprint_share"))


@query("weekend_order", """
    SELECT season, round, driver_id, race_finish, sprint_finish, row_number() OVER (PARTITION BY season, round
           ORDER BY coalesce(race_finish, 99), coalesce(sprint_finish, 99), driver_id) AS shown_at FROM weekend_o""")
def _(v):
    return wk.weekend_order(_weekend(v))


# Doctored documents: every gate has something to find.
@query("check_sprint", """
    SELECT season, round, error FROM (
      SELECT s.season, s.round, unnest([
        CASE WHEN c.season IS NULL THEN 'round is not on the calendar' END,
        CASE WHEN NOT c.sprint THEN 'calendar does not flag a sprint' END,
        CASE WHEN f.wrong > 0 THEN 'classification disagrees with the status' END,
        CASE WHEN s.season % 2 = 0 AND s.sprint_mean_places IS NOT NULL THEN 'sprint movement' END,
        CASE WHEN s.season % 3 = 0 THEN 'race sample' END,
        CASE WHEN s.season % 4 = 0 AND s.rho IS NOT NULL THEN 'rank agreement' END,
        CASE WHEN s.rho IS NULL AND s.season % 5 = 0 THEN 'withheld without a reason' END]) AS error
      FROM sprintround_o s
      LEFT JOIN (SELECT season, round, CASE WHEN season % 3 = 1 THEN false ELSE sprint END AS sprint
                 FROM calendar_v WHERE season % 7 <> 0) c USING (season, round)
      LEFT JOIN (SELECT season, round, 0 AS wrong FROM weekend_o GROUP BY ALL) f USING (season, round)) t
    WHERE error IS NOT NULL""")
def _(v):
    document = _rounds(v).withColumns({
        "sprint_mean_places": F.when(F.col("season") % 2 == 0, F.col("sprint_mean_places") + 0.5).otherwise(F.col("sprint_mean_places")),
        "race_sample": F.when(F.col("season") % 3 == 0, F.col("race_sample") + 1).otherwise(F.col("race_sample")),
        "rho": F.when(F.col("season") % 4 == 0, F.col("rho") - 0.1).otherwise(F.col("rho")),
        "withheld_reason": F.when(F.col("season") % 5 != 0, F.col("withheld_reason"))})
    calendar = v.calendar.where("season % 7 <> 0").withColumn(
        "sprint", F.when(F.col("season") % 3 == 1, False).otherwise(F.col("sprint")))
    return quality.check_sprint(document, _weekend(v), calendar)


@query("check_sprint_season", """
    SELECT season, error FROM (SELECT season, unnest([
        CASE WHEN season % 2 = 0 AND median_rho IS NOT NULL THEN 'season median_rho' END,
        CASE WHEN season % 3 = 0 THEN 'season race_mean_places' END]) AS error FROM sprintseason_o) t WHERE error IS NOT NULL""")
def _(v):
    rounds = _rounds(v)
    published = wk.sprint_season(rounds).withColumns({
        "median_rho": F.when(F.col("season") % 2 == 0, F.col("median_rho") / 2 - 2).otherwise(F.col("median_rho")),
        "race_mean_places": F.when(F.col("season") % 3 != 0, F.col("race_mean_places"))})
    return quality.check_sprint_season(published, rounds)


@query("check_sprint_points", """
    SELECT season, driver_id, error FROM (SELECT p.season, p.driver_id, unnest([
        CASE WHEN t.season IS NULL THEN 'not in the standings' END,
        CASE WHEN p.weekend_points > t.points THEN 'more points than the season' END]) AS error
      FROM sprintpoints_o p LEFT JOIN (SELECT season, driver_id, points / 2 AS points FROM standings_o
                                       WHERE driver_id % 6 <> 1) t USING (season, driver_id)) x WHERE error IS NOT NULL""")
def _(v):
    table = sn.standings(v.results, sn.points_table(v.spark)).where("driver_id % 6 <> 1").withColumn(
        "points", F.col("points") / 2)
    return quality.check_sprint_points(wk.sprint_points(_weekend(v)), table)
