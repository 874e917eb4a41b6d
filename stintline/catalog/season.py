"""Season ledger, calendar and standings-gate queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from stintline.catalog.registry import SHARED, query, r6
from stintline.functions.figures import rounded
from stintline.operators import calendar as cal
from stintline.operators import quality
from stintline.operators import season as sn

AS_OF = datetime.date(1998, 1, 10)
AS_OF_SQL = f"DATE '{AS_OF}'"

_RP = "CASE position " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(sn.RACE_POINTS, 1)) + " ELSE 0 END"
_SP = "CASE position " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(sn.SPRINT_POINTS, 1)) + " ELSE 0 END"
SHARED["scored_o"] = f"""
    SELECT *, CAST(CASE kind WHEN 'race' THEN {_RP} ELSE {_SP} END AS DOUBLE) AS points FROM results_v"""


def _places(kind: str) -> str:
    return "[" + ", ".join(f"count(*) FILTER (WHERE kind = '{kind}' AND position = {p})" for p in range(1, 31)) + "]"


def _standings_sql(source: str) -> str:
    return f"""
    SELECT season, driver_id, team_id, points, wins, row_number() OVER (PARTITION BY season
           ORDER BY points DESC, rp DESC, sp DESC, first_seen, driver_id) AS position
    FROM (SELECT season, driver_id, max_by(team_id, round * 1000 + CASE kind WHEN 'race' THEN 500 ELSE 0 END) AS team_id,
                 sum(points) AS points, count(*) FILTER (WHERE kind = 'race' AND position = 1) AS wins,
                 {_places('race')} AS rp, {_places('sprint')} AS sp,
                 min(round * 1000 + CASE kind WHEN 'race' THEN 500 ELSE 0 END + position) AS first_seen
          FROM {source} GROUP BY season, driver_id) t"""


SHARED["standings_o"] = _standings_sql("scored_o")
SHARED["official_o"] = """
    SELECT season, driver_id, points + CASE WHEN driver_id % 7 = 3 THEN 1 ELSE 0 END AS points, position
    FROM standings_o WHERE driver_id % 11 <> 5"""
SHARED["progression_o"] = """
    SELECT r.season, r.driver_id, r.round, sum(s.points) AS points
    FROM (SELECT d.season, d.driver_id, c.round FROM (SELECT season, driver_id, min(round) AS debut FROM results_v
            GROUP BY ALL) d JOIN (SELECT DISTINCT season, round FROM results_v) c
            ON c.season = d.season AND c.round >= d.debut) r
    JOIN scored_o s ON s.season = r.season AND s.driver_id = r.driver_id AND s.round <= r.round GROUP BY ALL"""


def _points(v):
    return sn.points_table(v.spark)


def _standings(v):
    return sn.standings(v.results, _points(v))


def _official(table):
    return table.where("driver_id % 11 <> 5").withColumn(
        "points", F.col("points") + F.when(F.col("driver_id") % 7 == 3, 1.0).otherwise(0.0))


@query("standings", "SELECT * FROM standings_o")
def _(v):
    return _standings(v)


SHARED["crosscheck_o"] = """
    SELECT c.season, c.driver_id, c.points, c.position, o.points AS official_points, o.position AS official_position,
           CASE WHEN o.driver_id IS NULL THEN 'missing' ELSE 'differs' END AS reason
    FROM standings_o c LEFT JOIN official_o o USING (season, driver_id)
    WHERE o.driver_id IS NULL OR o.points <> c.points OR o.position <> c.position"""


@query("standings_cross_check", "SELECT * FROM crosscheck_o")
def _(v):
    table = _standings(v)
    return sn.standings_cross_check(table, _official(table))


@query("points_progression", "SELECT * FROM progression_o")
def _(v):
    return sn.points_progression(v.results, _points(v))


@query("progression_consistency", """
    SELECT season, driver_id, p.points AS snapshot, o.points
    FROM (SELECT * FROM progression_o q WHERE round = (SELECT max(round) FROM progression_o m WHERE m.season = q.season)) p
    FULL JOIN official_o o USING (season, driver_id) WHERE p.points IS DISTINCT FROM o.points""")
def _(v):
    return sn.progression_consistency(sn.points_progression(v.results, _points(v)), _official(_standings(v)))


@query("elimination", f"""
    SELECT t.season, driver_id, coalesce(n, 0) AS remaining_rounds, t.points + coalesce(m, 0) AS max_possible,
           t.points + coalesce(m, 0) < l.points AS eliminated
    FROM ({_standings_sql("(SELECT * FROM scored_o SEMI JOIN (SELECT season, round FROM calendar_v WHERE date <= " + AS_OF_SQL + ") d USING (season, round))")}) t
    JOIN (SELECT season, max(points) AS points FROM (SELECT season, driver_id, sum(points) AS points FROM scored_o
          SEMI JOIN (SELECT season, round FROM calendar_v WHERE date <= {AS_OF_SQL}) d USING (season, round)
          GROUP BY ALL) x GROUP BY season) l ON l.season = t.season
    LEFT JOIN (SELECT season, count(*) AS n, 25.0 * count(*) + 8 * count(*) FILTER (WHERE sprint) AS m
               FROM calendar_v WHERE date > {AS_OF_SQL} GROUP BY season) c ON c.season = t.season""")
def _(v):
    due = cal.rounds_due(v.calendar, AS_OF).select("season", "round")
    table = sn.standings(v.results.join(due, ["season", "round"], "left_semi"), _points(v))
    return sn.elimination(table, cal.rounds_remaining(v.calendar, AS_OF))


@query("ledger_gaps", f"""
    SELECT season, driver_id, position, gap, CASE WHEN top > 0 THEN {r6('share')} ELSE 0.0 END AS share FROM (
      SELECT *, max(points) OVER (PARTITION BY season) AS top, max(points) OVER (PARTITION BY season) - points AS gap,
             points / nullif(max(points) OVER (PARTITION BY season), 0) AS share FROM standings_o) t""")
def _(v):
    return sn.ledger_gaps(_standings(v)).withColumn("share", rounded("share"))


def _stats_sql(results: str, stops: str, keys: str) -> str:
    on = f"USING ({keys})"
    return f"""
    SELECT {keys}, editions, coalesce(editions_with_stops, 0) AS editions_with_stops, starters, classified,
           median_places, places_n, winner_grid_median, winner_grid_best, winner_grid_worst, winner_grid_n,
           median_stops, coalesce(stops_n, 0) AS stops_n, classified / nullif(starters, 0) AS finish_share
    FROM (SELECT {keys}, count(DISTINCT year) AS editions,
                 count(*) FILTER (WHERE position_text NOT IN ('W', 'F')) AS starters,
                 count(*) FILTER (WHERE regexp_full_match(position_text, '[0-9]+')) AS classified,
                 median(abs(grid - position)) FILTER (WHERE regexp_full_match(position_text, '[0-9]+') AND grid > 0) AS median_places,
                 count(*) FILTER (WHERE regexp_full_match(position_text, '[0-9]+') AND grid > 0) AS places_n,
                 median(grid) FILTER (WHERE position = 1 AND grid > 0) AS winner_grid_median,
                 min(grid) FILTER (WHERE position = 1 AND grid > 0) AS winner_grid_best,
                 max(grid) FILTER (WHERE position = 1 AND grid > 0) AS winner_grid_worst,
                 count(*) FILTER (WHERE position = 1 AND grid > 0) AS winner_grid_n
          FROM {results} GROUP BY {keys}) a
    LEFT JOIN (SELECT {keys}, count(DISTINCT year) AS editions_with_stops FROM {stops} SEMI JOIN
               (SELECT {keys}, year FROM {results}) y USING ({keys}, year) GROUP BY {keys}) b {on}
    LEFT JOIN (SELECT {keys}, median(n) AS median_stops, count(*) AS stops_n FROM (
                 SELECT {keys}, year, driver_id, count(*) AS n FROM {stops} GROUP BY ALL) s
               SEMI JOIN (SELECT {keys}, year FROM {results}) y USING ({keys}, year) GROUP BY {keys}) c {on}"""


SHARED["priors_o"] = _stats_sql("editions_v", "edition_stops_v", "circuit_id")
SHARED["nextround_o"] = f"""
    SELECT season, n.round AS round, n.circuit_id AS circuit_id, n.date AS date,
           CASE WHEN n IS NULL THEN 'every round on the published calendar has been run' END AS reason
    FROM (SELECT season, min({{'date': date, 'round': round, 'circuit_id': circuit_id}})
                 FILTER (WHERE date > {AS_OF_SQL}) AS n FROM calendar_v GROUP BY season) t"""
SHARED["wanted_o"] = """
    SELECT n.season, n.circuit_id, y.year FROM nextround_o n JOIN (SELECT DISTINCT year FROM editions_v) y
      ON y.year BETWEEN n.season - 4 AND n.season - 1 WHERE n.reason IS NULL"""
SHARED["wantedres_o"] = "SELECT e.*, w.season FROM editions_v e JOIN wanted_o w USING (circuit_id, year)"
SHARED["wantedstops_o"] = "SELECT e.*, w.season FROM edition_stops_v e JOIN wanted_o w USING (circuit_id, year)"
SHARED["briefpriors_o"] = _stats_sql("wantedres_o", "wantedstops_o", "season, circuit_id")


@query("circuit_editions", """
    SELECT circuit_id, year, starters, classified, winner_grid, median_stops, median_stops IS NOT NULL AS stops_available
    FROM (SELECT circuit_id, year, count(*) FILTER (WHERE position_text NOT IN ('W', 'F')) AS starters,
                 count(*) FILTER (WHERE regexp_full_match(position_text, '[0-9]+')) AS classified,
                 max(grid) FILTER (WHERE position = 1 AND grid > 0) AS winner_grid FROM editions_v GROUP BY ALL) a
    LEFT JOIN (SELECT circuit_id, year, median(n) AS median_stops FROM (SELECT circuit_id, year, driver_id,
               count(*) AS n FROM edition_stops_v GROUP BY ALL) s GROUP BY ALL) b USING (circuit_id, year)""")
def _(v):
    return sn.circuit_editions(v.editions, v.edition_stops, ["circuit_id"])


@query("circuit_priors", f"SELECT * REPLACE ({r6('finish_share')} AS finish_share) FROM priors_o")
def _(v):
    return sn.circuit_priors(v.editions, v.edition_stops, ["circuit_id"]).withColumn(
        "finish_share", rounded("finish_share"))


@query("upcoming_brief", f"""
    SELECT n.* REPLACE (coalesce(n.reason, CASE WHEN p.season IS NULL
                          THEN 'no past edition of this circuit is on record' END) AS reason),
           p.* EXCLUDE (season, circuit_id) REPLACE ({r6('p.finish_share')} AS finish_share)
    FROM nextround_o n LEFT JOIN briefpriors_o p ON p.season = n.season AND p.circuit_id = n.circuit_id""")
def _(v):
    return sn.upcoming_brief(v.calendar, v.editions, v.edition_stops, AS_OF).withColumn(
        "finish_share", rounded("finish_share"))


@query("finishing_order", """
    SELECT session_id, driver_id, last_lap, row_number() OVER (PARTITION BY session_id
           ORDER BY last_lap DESC, (driver_id * 7) % 20, driver_id) AS finish
    FROM (SELECT session_id, driver_id, max(lap) AS last_lap FROM laps_v GROUP BY ALL) t""")
def _(v):
    return sn.finishing_order(v.laps.withColumn("position", (F.col("driver_id") * 7) % 20))


@query("rounds_due", f"SELECT * FROM calendar_v WHERE date <= {AS_OF_SQL}")
def _(v):
    return cal.rounds_due(v.calendar, AS_OF)


@query("next_round", "SELECT * FROM nextround_o")
def _(v):
    return cal.next_round(v.calendar, AS_OF)


_STAMPED = "SELECT *, 'Round ' || CAST(round AS VARCHAR(9)) AS race_name, 'stamp ' || CAST(session_id AS VARCHAR(9)) AS source_stamp FROM calendar_v"
_PUBLISHED = """
    SELECT season, round, 3 + CAST(session_id % 2 AS INT) AS schema_version,
           CASE WHEN (season + round) % 3 = 0 THEN 'X' ELSE 'Round ' || CAST(round AS VARCHAR(9)) END AS race_name,
           CASE WHEN (season + round) % 5 = 0 THEN 'old' ELSE 'stamp ' || CAST(session_id AS VARCHAR(9)) END AS source_stamp
    FROM calendar_v WHERE (season + round) % 4 <> 0"""


@query("stale_rounds", f"""
    SELECT * FROM (SELECT c.season, c.round, CASE WHEN p.season IS NULL THEN 'missing'
        WHEN p.schema_version <> 4 THEN 'schema version' WHEN p.race_name <> c.race_name THEN 'renamed'
        WHEN p.source_stamp <> c.source_stamp THEN 'source changed' END AS reason
      FROM ({_STAMPED}) c LEFT JOIN ({_PUBLISHED}) p USING (season, round)) t WHERE reason IS NOT NULL""")
def _(v):
    return cal.stale_rounds(v.sql(_STAMPED), v.sql(_PUBLISHED), 4)


_SESSIONS = """
    SELECT session_id AS session_key, CAST(date + CAST(CASE WHEN circuit_id % 4 = 3 THEN 3 ELSE circuit_id % 3 - 1 END AS INT) AS TIMESTAMP)
           + INTERVAL '13' HOUR AS date_start FROM calendar_v
    UNION ALL
    SELECT session_id + 500000, CAST(date AS TIMESTAMP) + INTERVAL '9' HOUR FROM calendar_v WHERE circuit_id % 5 = 1"""


def _match_sql(slack: int) -> str:
    return f"""
    SELECT season, round, m.k AS session_key, m.d AS date_start FROM (
      SELECT c.season, c.round, min({{'d': s.date_start, 'k': s.session_key}}) AS m
      FROM calendar_v c JOIN ({_SESSIONS}) s ON abs(date_diff('day', c.date, CAST(s.date_start AS DATE))) <= {slack}
      GROUP BY ALL) t"""


@query("match_sessions", _match_sql(1))
def _(v):
    return cal.match_sessions(v.calendar, v.sql(_SESSIONS), 1)


@query("match_sessions_qualifying", _match_sql(3))
def _(v):
    return cal.match_sessions(v.calendar, v.sql(_SESSIONS), 3)


@query("round_circuit", "SELECT season, round, circuit_id, sprint FROM calendar_v")
def _(v):
    return cal.round_circuit(v.calendar)


@query("latest_round_for_circuit",
       "SELECT season, circuit_id % 4 AS circuit_id, max(round) AS round FROM calendar_v GROUP BY ALL")
def _(v):
    return cal.latest_round_for_circuit(v.calendar.withColumn("circuit_id", F.col("circuit_id") % 4))


_KEYS = "SELECT DISTINCT 'car_' || CAST(driver_id AS VARCHAR(9)) || '_team' AS driver_key FROM results_v"
_ENTRIES = """
    SELECT DISTINCT 'car_' || CAST(driver_id AS VARCHAR(9)) || '_team' AS driver_key,
           CASE WHEN driver_id % 4 <> 1 THEN 'D' || CAST(driver_id AS VARCHAR(9)) END AS code,
           'Given' || CAST(driver_id AS VARCHAR(9)) AS given_name, 'Family' AS family_name
    FROM results_v WHERE driver_id % 3 <> 0"""
_PRETTY = "array_to_string(list_transform(string_split(driver_key, '_'), lambda p: upper(p[1]) || p[2:]), ' ')"


@query("driver_index", f"SELECT driver_key, code, given_name || ' ' || family_name AS name FROM ({_ENTRIES}) e")
def _(v):
    return cal.driver_index(v.sql(_ENTRIES))


@query("driver_label", f"""
    SELECT driver_key, coalesce(code, {_PRETTY}) AS code, coalesce(given_name || ' ' || family_name, {_PRETTY}) AS name
    FROM ({_KEYS}) k LEFT JOIN ({_ENTRIES}) e USING (driver_key)""")
def _(v):
    return cal.driver_label(v.sql(_KEYS), v.sql(_ENTRIES))


@query("complete_or_abort", f"""
    {_standings_sql("(SELECT * FROM scored_o WHERE NOT (season % 3 = 1 AND round = 1) AND season NOT IN (SELECT c.season FROM calendar_v c WHERE c.date <= " + AS_OF_SQL + " AND NOT EXISTS (SELECT 1 FROM results_v r WHERE r.season = c.season AND r.round = c.round AND r.kind = 'race' AND NOT (r.season % 3 = 1 AND r.round = 1))))")}""")
def _(v):
    landed = v.results.where("NOT (season % 3 = 1 AND round = 1)")
    return sn.complete_or_abort(v.calendar, landed, _points(v), AS_OF)


@query("missing_rounds", f"""
    SELECT season, round FROM calendar_v c WHERE date <= {AS_OF_SQL} AND NOT EXISTS (SELECT 1 FROM results_v r
      WHERE r.season = c.season AND r.round = c.round AND r.kind = 'race' AND NOT (r.season % 3 = 1 AND r.round = 1))""")
def _(v):
    return sn.missing_rounds(v.calendar, v.results.where("NOT (season % 3 = 1 AND round = 1)"), AS_OF)


@query("check_standings", """
    SELECT season, driver_id, reason AS error FROM crosscheck_o WHERE season % 3 <> 0
    UNION ALL SELECT DISTINCT season, CAST(NULL AS INT), 'cross-check did not run' FROM standings_o WHERE season % 3 = 0""")
def _(v):
    table = _standings(v)
    return quality.check_standings(table, _official(table).where("season % 3 <> 0"))


_DOCTORED = ("SELECT * REPLACE (editions + CASE WHEN circuit_id % 5 = 0 THEN 1 ELSE 0 END AS editions, "
             "starters + CASE WHEN circuit_id % 3 = 0 THEN 1 ELSE 0 END AS starters, "
             "places_n + CASE WHEN circuit_id % 4 = 1 THEN 500 ELSE 0 END AS places_n) FROM priors_o")


@query("check_brief", f"""
    SELECT circuit_id, error FROM (
      SELECT b.circuit_id, unnest([
        CASE WHEN b.editions <> e.n THEN 'edition count' END,
        CASE WHEN b.classified <> e.c OR b.starters <> e.s THEN 'finish rate does not sum' END,
        CASE WHEN e.bad > 0 THEN 'more finishers than starters' END,
        CASE WHEN b.places_n > e.c THEN 'sample exceeds classified finishes' END]) AS error
      FROM ({_DOCTORED}) b JOIN (
        SELECT circuit_id, count(*) AS n, sum(c) AS c, sum(s) AS s, count(*) FILTER (WHERE c > s) AS bad FROM (
          SELECT circuit_id, year, count(*) FILTER (WHERE position_text NOT IN ('W', 'F')) AS s,
                 count(*) FILTER (WHERE regexp_full_match(position_text, '[0-9]+')) AS c FROM editions_v GROUP BY ALL) y
        GROUP BY circuit_id) e USING (circuit_id)) t WHERE error IS NOT NULL""")
def _(v):
    brief = sn.circuit_priors(v.editions, v.edition_stops, ["circuit_id"]).withColumns({
        "editions": F.col("editions") + F.when(F.col("circuit_id") % 5 == 0, 1).otherwise(0),
        "starters": F.col("starters") + F.when(F.col("circuit_id") % 3 == 0, 1).otherwise(0),
        "places_n": F.col("places_n") + F.when(F.col("circuit_id") % 4 == 1, 500).otherwise(0)})
    return quality.check_brief(brief, sn.circuit_editions(v.editions, v.edition_stops, ["circuit_id"]), ["circuit_id"])
