"""Feed readers over JSON text that SQL spells from the fixture views; DuckDB takes the same text apart with its own functions."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.catalog.registry import query
from stintline.functions.figures import lap_time_seconds, same_number
from stintline.functions.lineage import shared_folder
from stintline.sources import feeds
from stintline.sources.sinks import write_table
from stintline.sources.views import VIEWS

AS_OF = datetime.datetime(1998, 6, 1)

# Spelling of one JSON object; nulls are the JSON null.
_QUOTE = "' || chr(92) || '\""  # an escaped quote; the engines read a backslash in a literal differently
_ID = "CAST(driver_id AS VARCHAR(9))"
_PERSON = (f"""'{{"driverId":"d' || {_ID} || '","code":' || CASE WHEN driver_id % 7 = 0 THEN 'null' ELSE '"C' || {_ID} || '"' END"""
           f""" || ',"givenName":"G {_QUOTE}' || {_ID} || '{_QUOTE}","familyName":"F}}' || {_ID} || '","permanentNumber":"' || {_ID} || '"}}'""")
_TEAM = """'{"constructorId":"t' || CAST(team_id AS VARCHAR(9)) || '","name":"Team ' || CAST(team_id AS VARCHAR(9)) || '"}'"""
_HEAD = ("""'"season":"' || CAST(floor(session_id / 1000) AS VARCHAR(9)) || '","round":"' || CAST(session_id % 1000 + 1 AS VARCHAR(9)) || '","raceName":"R","date":"bad","Circuit":{"circuitId":"c'"""
         """ || CAST(session_id % 1000 AS VARCHAR(9)) || '","circuitName":"C","Location":{"lat":"1","long":"2"}}'""").replace(
             "CAST(floor(session_id / 1000) AS VARCHAR(9))", "CAST(CAST(floor(session_id / 1000) AS INT) AS VARCHAR(9))")


def _page(table: str) -> str:
    return f"""'{{"MRData":{{"total":"30","{table}":{{'"""


def _num(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR(30)), 'null')"


def _text(c: str) -> str:
    return f"coalesce('\"' || CAST({c} AS VARCHAR(60)) || '\"', 'null')"


def _object(**fields: str) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items()) + " || '}'"


_MS = "CAST(round(time_s * 1000) AS BIGINT)"
_TIME = f"""CASE WHEN time_s IS NULL THEN 'no time' WHEN lap % 9 = 0 THEN CAST(CAST(floor(time_s) AS INT) AS VARCHAR(9)) || '.5'
    ELSE CAST(CAST(floor({_MS} / 60000.0) AS INT) AS VARCHAR(9)) || ':' || lpad(CAST(CAST(floor({_MS} % 60000 / 1000.0) AS INT) AS VARCHAR(9)), 2, '0') || '.'
         || lpad(CAST({_MS} % 1000 AS VARCHAR(9)), 3, '0') END"""
_RESULT = f"""'{{"position":' || CASE WHEN status = 'Retired' AND driver_id % 2 = 0 THEN '"R"' ELSE '"' || CAST(position AS VARCHAR(9)) || '"' END
    || ',"positionText":"' || CAST(position AS VARCHAR(9)) || '","grid":"' || CAST(grid AS VARCHAR(9)) || '","status":"' || status || '","points":"'
    || CAST(26 - position AS VARCHAR(9)) || '.5","laps":"' || CAST(laps AS VARCHAR(9)) || '","Driver":' || {_PERSON} || ',"Constructor":' || {_TEAM}
    || CASE WHEN driver_id % 3 = 0 THEN '' ELSE ',"FastestLap":{{"rank":"' || CAST(driver_id + 1 AS VARCHAR(9)) || '"}}' END || '}}'"""


def _results_page(kind: str, field: str) -> str:
    return f"""
        SELECT {_page('RaceTable')} || '"Races":[{{' || {_HEAD} || ',"{field}":[' || items || ']}}]}}}}}}' AS text
        FROM (SELECT session_id, @{{{_RESULT}}}@ AS items FROM results_v WHERE kind = '{kind}' GROUP BY session_id) t"""


VIEWS.update({
    "calendar_text_v": f"""
        SELECT {_page('RaceTable')} || '"Races":[' || @{{'{{"season":"' || CAST(season AS VARCHAR(9)) || '","round":"' || CAST(round AS VARCHAR(9)) || '","raceName":"Race '
            || CAST(round AS VARCHAR(9)) || '","date":"' || CAST(date AS VARCHAR(12)) || '","Circuit":{{"circuitId":"c' || CAST(circuit_id AS VARCHAR(9)) || '","circuitName":"Circuit","Location":{{"lat":"'
            || CAST(circuit_id AS VARCHAR(9)) || '.25","long":"' || CASE WHEN round % 3 = 0 THEN 'east' ELSE '-7.5' END || '"}}}}'
            || CASE WHEN sprint THEN ',"Sprint":{{"date":"x"}}' ELSE '' END || '}}'}}@ || ']}}}}}}' AS text
        FROM calendar_v GROUP BY season""",
    "entries_text_v": f"""
        SELECT {_page('DriverTable')} || '"season":"' || CAST(season AS VARCHAR(9)) || '","Drivers":[' || @{{{_PERSON}}}@ || ']}}}}}}' AS text
        FROM (SELECT DISTINCT season, driver_id, CAST(driver_id % 3 AS INT) AS page FROM results_v
              UNION ALL SELECT DISTINCT season, driver_id, 0 FROM results_v WHERE driver_id % 3 = 1) t GROUP BY season, page""",
    "standings_text_v": f"""
        SELECT {_page('StandingsTable')} || '"season":"' || CAST(CAST(floor(session_id / 1000) AS INT) AS VARCHAR(9)) || '","StandingsLists":[{{"round":"1","DriverStandings":[' || items
            || ']}},{{"round":"2","DriverStandings":[]}}]}}}}}}' AS text
        FROM (SELECT session_id, @{{'{{"position":"' || CAST(position AS VARCHAR(9)) || '","points":"' || CAST(laps AS VARCHAR(9)) || '.5","wins":"' || CASE WHEN position = 1 THEN '1' ELSE 'none' END
                || '","Driver":' || {_PERSON} || ',"Constructors":[' || CASE WHEN driver_id % 5 = 0 THEN '' ELSE {_TEAM} || ',{{}}' END || ']}}'}}@ AS items
              FROM results_v WHERE kind = 'race' GROUP BY session_id) t""",
    "results_text_v": _results_page("race", "Results"),
    "sprints_text_v": _results_page("sprint", "SprintResults"),
    "laps_text_v": f"""
        SELECT {_page('RaceTable')} || '"Races":[{{' || {_HEAD} || ',"Laps":[' || @{{'{{"number":"' || CAST(lap AS VARCHAR(9)) || '","Timings":[' || items || ']}}'}}@ || ']}}]}}}}}}' AS text
        FROM (SELECT session_id, lap, @{{'{{"driverId":"d' || {_ID} || '","position":"' || CAST(driver_id + 1 AS VARCHAR(9)) || '","time":"' || {_TIME} || '"}}'}}@ AS items
              FROM laps_v GROUP BY session_id, lap) t GROUP BY session_id""",
    "stops_text_v": f"""
        SELECT {_page('RaceTable')} || '"Races":[{{' || {_HEAD} || ',"PitStops":[' || @{{'{{"driverId":"d' || {_ID} || '","lap":"' || CAST(lap AS VARCHAR(9)) || '","stop":"' || CAST(stop AS VARCHAR(9))
            || '","duration":"' || CASE WHEN lap % 4 = 0 THEN '1:02.345' WHEN lap % 4 = 1 THEN '' ELSE '21.' || CAST(lap AS VARCHAR(9)) END || '"}}'}}@ || ']}}]}}}}}}' AS text
        FROM stops_v GROUP BY session_id""",
    "qualifying_text_v": f"""
        SELECT {_page('RaceTable')} || '"Races":[{{' || {_HEAD} || ',"QualifyingResults":[' || @{{'{{"position":"' || CAST(position AS VARCHAR(9)) || '","Driver":' || {_PERSON}
            || ',"Constructor":{{"constructorId":"k' || CAST(constructor_id AS VARCHAR(9)) || '","name":"K"}},"Q1":"1:' || CAST(10 + driver_id AS VARCHAR(9)) || '.5"'
            || CASE WHEN q2_s IS NULL THEN '' ELSE ',"Q2":"59.9"' END || ',"Q3":' || CASE WHEN q3_s IS NULL THEN 'null' ELSE '"x:1.0"' END || '}}'}}@ || ']}}]}}}}}}' AS text
        FROM qualifying_v GROUP BY session_id""",
    "sessions_text_v": f"""
        SELECT {_object(session_key=_num('session_id'), meeting_key=_num('round'), circuit_key=_num('circuit_id'), circuit_short_name=_text("'Ring'"), country_name="'null'", session_name=_text("'Race'"),
                        date_start="CASE WHEN round % 4 = 0 THEN 'null' WHEN round % 4 = 1 THEN '\"soon\"' ELSE '\"' || CAST(date AS VARCHAR(12)) || 'T13:00:00+00:00\"' END",
                        date_end=_text("date"), year=_num('season'))} AS text
        FROM calendar_v""",
    "drivers_text_v": f"""
        SELECT {_object(session_key=_num('session_id'), driver_number=_num('driver_id'), name_acronym=_text("CASE WHEN driver_id % 7 <> 0 THEN 'C' END"), full_name=_text(f"'A {{b}}, {_QUOTE}c{_QUOTE}'"),
                        team_name=_text('team_id'))} AS text
        FROM results_v WHERE kind = 'race'""",
    "timing_text_v": f"""
        SELECT {_object(session_key=_num('session_id'), driver_number=_num('driver_id'), lap_number=_num('lap'), lap_duration=_num('time_s'), date_start=_text('start_ts'),
                        is_pit_out_lap="CASE WHEN lap % 5 = 0 THEN 'null' WHEN is_pit_out THEN 'true' ELSE 'false' END", duration_sector_1=_num('lap'), duration_sector_2="'\"slow\"'",
                        segments_sector_1="'[2049,2051]'", st_speed=_num("CASE WHEN lap % 2 = 0 THEN 300 + lap END"))} AS text
        FROM timing_laps_v""",
    "stints_text_v": f"""
        SELECT {_object(session_key=_num('session_id'), driver_number=_num('driver_id'), stint_number=_num('feed_stint'), lap_start=_num('lap_start'), lap_end=_num('lap_end'),
                        compound=_text("CASE WHEN compound <> 'SOFT' THEN compound END"), tyre_age_at_start=_num('driver_id'))} AS text
        FROM stint_feed_v""",
    "control_text_v": f"""
        SELECT CAST(session_id AS VARCHAR(9)) || '.json' AS file, seq AS offset, {_object(session_key=_num('session_id'), date=_text('ts'), category=_text('category'), flag=_text('flag'),
            scope=_text("'Sector'"), lap_number=_num('lap'), sector=_num("CASE WHEN lap % 3 = 0 THEN lap END"), message=_text('message'), driver_number=_num('driver_id'))} AS text
        FROM race_control_v""",
    "changes_text_v": f"""
        SELECT {_object(session_key=_num('session_id'), date=_text('ts'), position=_num('gained_by'), overtaking_driver_number=_num('gained_by'),
                        overtaken_driver_number=_num("CASE WHEN lost_by % 5 <> 0 THEN lost_by END"))} AS text
        FROM changes_v""",
    "trackside_text_v": f"""
        SELECT {_object(session_key=_num('session_id'), date=_text('ts'), air_temperature=_num('air_c'), track_temperature=_num('track_c'), humidity=_num('40'), pressure="'\"high\"'",
                        rainfall=_num('rainfall'), wind_speed=_num('1.5'), wind_direction="'null'")} AS text
        FROM trackside_v""",
    "radio_text_v": f"""
        SELECT {_object(session_key=_num('session_id'), date=_text('ts'), driver_number=_num('driver_id'), recording_url=_text("clip_id"))} AS text
        FROM radio_v""",
    "archive_text_v": """
        SELECT '{"latitude":' || CAST(session_id AS VARCHAR(9)) || ',"longitude":2.5,"elevation":3.0,"hourly":{"time":[' || hours || '],"temperature_2m":[' || temperatures || '],"precipitation":[1.5,null]}}' AS text
        FROM (SELECT session_id, @{'"' || CAST(hour_ts AS VARCHAR(30)) || '"'}@ AS hours, @{CASE WHEN precip_mm > 0.02 THEN CAST(CAST(floor(air_c) AS INT) AS VARCHAR(9)) END}@ AS temperatures
              FROM archive_v GROUP BY session_id) t""",
    "position_text_v": f"""
        SELECT {_object(session_key=_num('CAST(floor(lap_key / 100) AS INT)'), driver_number=_num('lap_key % 100'), date=_text("CAST('2024-01-01 00:00:00' AS TIMESTAMP) + CAST(floor(t * 4) AS INT) * INTERVAL '1' SECOND"),
                        x=_num("CASE WHEN CAST(floor(t * 100) AS INT) % 7 <> 0 THEN x END"), y=_num('y'), z=_num('z'))} AS text
        FROM pos_v""",
    "car_text_v": f"""
        SELECT {_object(session_key=_num('CAST(floor(lap_key / 100) AS INT)'), driver_number=_num('lap_key % 100'), date=_text("CASE WHEN gear = 3 THEN 'late' ELSE '2024-01-01T00:00:00.250' END"),
                        speed=_num('speed'), throttle=_num('throttle'), brake=_num('brake'), n_gear=_num('gear'), drs="'\"open\"'", rpm=_num('gear * 1000'))} AS text
        FROM car_v""",
    "points_text_v": """
        SELECT '{"race_points_by_position":{' || @{'"' || CAST(position AS VARCHAR(9)) || '":' || CAST(26 - position AS VARCHAR(9))}@
            || '},"fastest_lap_point":{"points":1,"condition":"none"},"sprint_points_by_position":{"1":8,"x":7.5}}' AS text
        FROM (SELECT DISTINCT position FROM results_v WHERE kind = 'race') t""",
})


def _s(path: str, of: str = "j") -> str:
    return f"({of}->>'$.{path}')"


def _i(path: str, of: str = "j") -> str:
    return f"TRY_CAST({_s(path, of)} AS INT)"


def _d(path: str, of: str = "j") -> str:
    return f"TRY_CAST({_s(path, of)} AS DOUBLE)"


def _each(view: str, path: str, keep: str = "") -> str:
    return f"SELECT {keep}unnest(CAST(json_extract(text, '$.{path}') AS JSON[])) AS j, CAST(text AS JSON) AS page FROM {view}"


def _inner(view: str, field: str) -> str:
    """The items of a field of each race, with the race."""
    return f"SELECT r, unnest(CAST(json_extract(r, '$.{field}') AS JSON[])) AS j, unnest(range(0, json_array_length(r, '$.{field}')::BIGINT)) AS seq FROM (SELECT j AS r FROM ({_each(view, 'MRData.RaceTable.Races')}) a) b"


def _lap_time(c: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({c}), '^\\d{{1,6}}:') THEN CAST(split_part(trim({c}), ':', 1) AS DOUBLE) * 60 + TRY_CAST(substr(trim({c}), instr(trim({c}), ':') + 1) AS DOUBLE) "
            f"ELSE TRY_CAST(trim({c}) AS DOUBLE) END")


def _flat(view: str, columns: str, keep: str = "") -> str:
    return f"SELECT {columns} FROM (SELECT {keep}CAST(text AS JSON) AS j FROM {view}) t"


_RACE = f"{_i('season', 'r')} AS season, {_i('round', 'r')} AS round"
_NAME = f"concat_ws(' ', {_s('Driver.givenName')}, {_s('Driver.familyName')}) AS driver_name"
_KEYS = f"{_i('session_key')} AS session_id, {_i('driver_number')} AS driver_id"
_TS = f"TRY_CAST({_s('date')} AS TIMESTAMP) AS ts"


def _texts(v, view: str) -> DataFrame:
    return v.sql(f"SELECT * FROM {view}")


@query("read_calendar", f"""SELECT season, round, race_name, circuit_name, circuit_id, date, sprint, CASE WHEN both_known THEN lat END AS lat, CASE WHEN both_known THEN long END AS long
    FROM (SELECT {_i('season')} AS season, {_i('round')} AS round, {_s('raceName')} AS race_name, {_s('Circuit.circuitName')} AS circuit_name, {_s('Circuit.circuitId')} AS circuit_id,
          TRY_CAST({_s('date')} AS DATE) AS date, json_exists(j, '$.Sprint') AS sprint, {_d('Circuit.Location.lat')} AS lat, {_d('Circuit.Location.long')} AS long,
          lat IS NOT NULL AND long IS NOT NULL AS both_known FROM ({_each('calendar_text_v', 'MRData.RaceTable.Races')}) t) u""")
def _read_calendar(v):
    return feeds.calendar_rows(_texts(v, "calendar_text_v"))


_PERSON_OUT = f"{_s('code')} AS code, {_s('driverId')} AS driver_key, {_s('givenName')} AS given_name, {_s('familyName')} AS family_name, {_s('permanentNumber')} AS permanent_number"


@query("read_entry_list", f"SELECT DISTINCT {_i('MRData.DriverTable.season', 'page')} AS season, {_PERSON_OUT} FROM ({_each('entries_text_v', 'MRData.DriverTable.Drivers')}) t")
def _read_entry_list(v):
    return feeds.entry_list_rows(_texts(v, "entries_text_v"))


@query("truncated_pages", f"""SELECT season, max(total) AS total, sum(n)::BIGINT AS landed FROM (SELECT {_i('MRData.DriverTable.season')} AS season, {_i('MRData.total')} AS total,
    json_array_length(j, '$.MRData.DriverTable.Drivers') AS n FROM (SELECT CAST(text AS JSON) AS j FROM entries_text_v) t) u GROUP BY season HAVING sum(n) < max(total)""")
def _truncated_pages(v):
    return feeds.truncated_page_rows(_texts(v, "entries_text_v"))


@query("read_standings", f"""SELECT {_i('MRData.StandingsTable.season', 'page')} AS season, {_i('position')} AS position, {_d('points')} AS points, {_i('wins')} AS wins, {_s('Driver.code')} AS driver_code,
    {_NAME}, {_s('Constructors[0].name')} AS team FROM ({_each('standings_text_v', 'MRData.StandingsTable.StandingsLists[0].DriverStandings')}) t""")
def _read_standings(v):
    return feeds.standings_rows(_texts(v, "standings_text_v"))


def _results_sql(view: str, field: str, kind: str) -> str:
    return f"""SELECT {_RACE}, {_s('Circuit.circuitId', 'r')} AS circuit_id, '{kind}' AS kind, seq, {_s('position')} AS position_raw, {_i('position')} AS position, {_s('positionText')} AS position_text,
    {_i('grid')} AS grid, {_s('Driver.code')} AS driver_code, {_NAME}, {_s('Constructor.name')} AS team, {_s('status')} AS status, {_d('points')} AS points, {_i('laps')} AS laps,
    {_s('FastestLap.rank')} AS fastest_lap_rank FROM ({_inner(view, field)}) t"""


@query("read_race_results", _results_sql("results_text_v", "Results", "race"))
def _read_race_results(v):
    return feeds.race_results_rows(_texts(v, "results_text_v"))


@query("read_sprint_results", _results_sql("sprints_text_v", "SprintResults", "sprint"))
def _read_sprint_results(v):
    """Race pages too: they hold no sprint and give no row."""
    return feeds.sprint_results_rows(_texts(v, "sprints_text_v").unionByName(_texts(v, "results_text_v")))


@query("read_laps", f"""SELECT season, round, lap, {_s('driverId')} AS driver_key, {_i('position')} AS position, {_lap_time(_s('time'))} AS time_s
    FROM (SELECT {_RACE}, {_i('number')} AS lap, unnest(CAST(json_extract(j, '$.Timings') AS JSON[])) AS j FROM ({_inner('laps_text_v', 'Laps')}) t) u""")
def _read_laps(v):
    return feeds.laps_rows(_texts(v, "laps_text_v"))


_STOPS = f"SELECT {_RACE}, {_s('driverId')} AS driver_key, {_i('lap')} AS lap, {_i('stop')} AS stop, {_lap_time(_s('duration'))} AS duration_s FROM ({_inner('stops_text_v', 'PitStops')}) t"


@query("read_pitstops", _STOPS)
def _read_pitstops(v):
    return feeds.pitstops_rows(_texts(v, "stops_text_v"))


@query("read_qualifying", f"""SELECT {_RACE}, {_s('Driver.driverId')} AS driver_key, {_s('Driver.code')} AS code, {_s('Constructor.constructorId')} AS constructor_id,
    {_s('Constructor.name')} AS constructor_name, {_i('position')} AS position, {', '.join(f"{_lap_time(_s(q))} AS {q.lower()}_s" for q in ('Q1', 'Q2', 'Q3'))}
    FROM ({_inner('qualifying_text_v', 'QualifyingResults')}) t""")
def _read_qualifying(v):
    return feeds.qualifying_rows(_texts(v, "qualifying_text_v"))


@query("read_circuit_history", f"""SELECT k.circuit_id, k.season AS year, s.driver_key AS driver_id
    FROM (SELECT DISTINCT circuit_id, season, round FROM ({_results_sql('results_text_v', 'Results', 'race')}) t WHERE season IN (1995, 1996, 1998) AND round % 3 <> 0) k
    LEFT JOIN ({_STOPS}) s ON s.season = k.season AND s.round = k.round AND s.lap % 2 = 0""")
def _read_circuit_history(v):
    """Stops of the past editions the stop feed answered for; of these only some have any."""
    results = feeds.race_results_rows(_texts(v, "results_text_v"))
    answered = results.where("round % 3 <> 0").select("season", "round").distinct()
    return feeds.read_circuit_history(results, feeds.pitstops_rows(_texts(v, "stops_text_v")).where("lap % 2 = 0"), answered, [1995, 1996, 1998])[1]


@query("history_editions", f"SELECT * RENAME (season AS year) FROM ({_results_sql('results_text_v', 'Results', 'race')}) t WHERE season IN (1995, 1996, 1998)")
def _history_editions(v):
    results = feeds.race_results_rows(_texts(v, "results_text_v"))
    return feeds.read_circuit_history(results, feeds.pitstops_rows(_texts(v, "stops_text_v")), results.select("season", "round").distinct(), [1995, 1996, 1998])[0]


@query("lap_time_seconds", f"""SELECT time, {_lap_time('time')} AS time_s, count(*) AS n FROM (
    SELECT {_s('time')} AS time FROM (SELECT unnest(CAST(json_extract(j, '$.Timings') AS JSON[])) AS j FROM ({_inner('laps_text_v', 'Laps')}) t) u) w GROUP BY time""")
def _lap_time_seconds(v):
    laps = v.sql(f"SELECT {_TIME} AS time FROM laps_v")
    return laps.groupBy("time").agg(F.count("*").alias("n")).withColumn("time_s", lap_time_seconds("time"))


@query("read_sessions", f"""SELECT * FROM (SELECT {_i('session_key')} AS session_key, {_i('meeting_key')} AS meeting_key, {_i('circuit_key')} AS circuit_key, {_s('circuit_short_name')} AS circuit_short_name,
    {_s('country_name')} AS country_name, {_s('session_name')} AS session_name, CAST(TRY_CAST({_s('date_start')} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) AS date_start,
    TRY_CAST({_s('date_end')} AS TIMESTAMP) AS date_end, {_i('year')} AS year FROM (SELECT CAST(text AS JSON) AS j FROM sessions_text_v) t) u WHERE date_start < TIMESTAMP '{AS_OF}'""")
def _read_sessions(v):
    return feeds.sessions_rows(_texts(v, "sessions_text_v"), AS_OF)


@query("read_session_drivers", _flat("drivers_text_v", f"{_KEYS}, {_s('name_acronym')} AS code, {_s('full_name')} AS full_name, {_s('team_name')} AS team"))
def _read_session_drivers(v):
    return feeds.session_drivers_rows(_texts(v, "drivers_text_v"))


@query("read_timing_laps", _flat("timing_text_v", f"""{_KEYS}, {_i('lap_number')} AS lap, {_d('lap_duration')} AS time_s, TRY_CAST({_s('date_start')} AS TIMESTAMP) AS start_ts,
    coalesce(CAST({_s('is_pit_out_lap')} AS BOOLEAN), false) AS is_pit_out, {', '.join(f"{_d(f'duration_sector_{k}')} AS sector{k}_s" for k in (1, 2, 3))}, {_d('st_speed')} AS speed_trap_kph"""))
def _read_timing_laps(v):
    return feeds.timing_laps_rows(_texts(v, "timing_text_v"))


@query("read_stint_feed", _flat("stints_text_v", f"""{_KEYS}, {_i('stint_number')} AS feed_stint, {_i('lap_start')} AS lap_start, {_i('lap_end')} AS lap_end, {_s('compound')} AS compound,
    {_i('tyre_age_at_start')} AS tyre_age_at_start"""))
def _read_stint_feed(v):
    return feeds.stint_feed_rows(_texts(v, "stints_text_v"))


@query("read_race_control", _flat("control_text_v", f"""{_i('session_key')} AS session_id, file, "offset" AS seq, {_TS}, {_s('category')} AS category, {_s('flag')} AS flag, {_s('scope')} AS scope,
    {_i('lap_number')} AS lap, {_i('sector')} AS sector, {_s('message')} AS message, {_i('driver_number')} AS driver_id""", 'file, "offset", '))
def _read_race_control(v):
    return feeds.race_control_rows(_texts(v, "control_text_v"))


@query("read_position_changes", _flat("changes_text_v", f"""{_i('session_key')} AS session_id, {_TS}, {_i('position')} AS position, {_i('overtaking_driver_number')} AS gained_by,
    {_i('overtaken_driver_number')} AS lost_by"""))
def _read_position_changes(v):
    return feeds.position_changes_rows(_texts(v, "changes_text_v"))


@query("read_trackside_weather", _flat("trackside_text_v", f"""{_i('session_key')} AS session_id, {_TS}, {_d('air_temperature')} AS air_c, {_d('track_temperature')} AS track_c,
    {_d('humidity')} AS humidity_pct, {_d('pressure')} AS pressure_hpa, {_i('rainfall')} AS rainfall, {_d('wind_speed')} AS wind_ms, {_d('wind_direction')} AS wind_deg"""))
def _read_trackside_weather(v):
    return feeds.trackside_weather_rows(_texts(v, "trackside_text_v"))


@query("read_radio", _flat("radio_text_v", f"{_i('session_key')} AS session_id, {_TS}, {_i('driver_number')} AS driver_id, {_s('recording_url')} AS link"))
def _read_radio(v):
    return feeds.radio_rows(_texts(v, "radio_text_v"))


@query("read_weather_archive", f"""SELECT latitude, longitude, elevation, air_c, humidity_pct, precip_mm, wind_ms, hour_ts FROM (
    SELECT {_d('latitude')} AS latitude, {_d('longitude')} AS longitude, {_d('elevation')} AS elevation, TRY_CAST({_s('hourly.time[#-1]', 'x')} AS TIMESTAMP) AS unused, hour_ts,
      TRY_CAST(j->>('$.hourly.temperature_2m[' || k || ']') AS DOUBLE) AS air_c, NULL::DOUBLE AS humidity_pct, TRY_CAST(j->>('$.hourly.precipitation[' || k || ']') AS DOUBLE) AS precip_mm, NULL::DOUBLE AS wind_ms
    FROM (SELECT j, j AS x, k, TRY_CAST(j->>('$.hourly.time[' || k || ']') AS TIMESTAMP) AS hour_ts
          FROM (SELECT CAST(text AS JSON) AS j, unnest(range(0, json_array_length(text, '$.hourly.time')::BIGINT)) AS k FROM archive_text_v) a) b) c""")
def _read_weather_archive(v):
    return feeds.weather_archive_rows(_texts(v, "archive_text_v"))


@query("read_position_samples", f"SELECT * FROM ({_flat('position_text_v', f'{_KEYS}, {_TS}, {_d('x')} AS x, {_d('y')} AS y, {_d('z')} AS z')}) u WHERE x IS NOT NULL AND y IS NOT NULL")
def _read_position_samples(v):
    return feeds.position_samples_rows(_texts(v, "position_text_v"))


@query("read_car_samples", _flat("car_text_v", f"""{_KEYS}, {_TS}, {_d('speed')} AS speed, {_d('throttle')} AS throttle, {_d('brake')} AS brake, {_i('n_gear')} AS gear, {_i('drs')} AS drs,
    {_i('rpm')} AS rpm"""))
def _read_car_samples(v):
    return feeds.car_samples_rows(_texts(v, "car_text_v"))


@query("read_points_table", """SELECT kind, TRY_CAST(k AS INT) AS position, CAST(j->>k AS DOUBLE) AS points FROM (
        SELECT 'race' AS kind, unnest(json_keys(j)) AS k, j FROM (SELECT json_extract(text, '$.race_points_by_position') AS j FROM points_text_v) a
        UNION ALL SELECT 'sprint', unnest(json_keys(j)), j FROM (SELECT json_extract(text, '$.sprint_points_by_position') AS j FROM points_text_v) b) c
    UNION ALL SELECT 'fastest_lap', 1, CAST(json_extract(text, '$.fastest_lap_point.points') AS DOUBLE) FROM points_text_v""")
def _read_points_table(v):
    return feeds.points_table_rows(_texts(v, "points_text_v"))


@query("same_number", """SELECT session_id, driver_id, count(*) AS laps, count(*) FILTER (WHERE coalesce(abs(time_s - last_s) <= 0.02, time_s IS NULL AND last_s IS NULL)) AS same
    FROM (SELECT *, lag(time_s) OVER (PARTITION BY session_id, driver_id ORDER BY lap) AS last_s FROM laps_v) t GROUP BY session_id, driver_id""")
def _same_number(v):
    """Laps that repeat the time of the lap before; two laps without a time are the same too."""
    laps = v.sql("SELECT *, lag(time_s) OVER (PARTITION BY session_id, driver_id ORDER BY lap) AS last_s FROM laps_v")
    return laps.groupBy("session_id", "driver_id").agg(F.count("*").alias("laps"), F.count_if(same_number("time_s", "last_s", 0.02)).alias("same"))


@query("write_table", """SELECT session_id, season, driver_id, lap, CASE WHEN session_id % 2 = 0 THEN coalesce(time_s, 0) + 1 ELSE time_s END AS time_s,
    CASE WHEN session_id % 2 = 0 THEN 2 ELSE 1 END AS schema_version, CASE WHEN session_id % 2 = 0 THEN 'again' ELSE 'first' END AS source
    FROM (SELECT *, CAST(floor(session_id / 1000) AS INT) AS season FROM laps_v) t""")
def _write_table(v):
    """All laps written, then the sessions of even number once more: only their partitions are replaced."""
    laps = v.sql("SELECT session_id, CAST(floor(session_id / 1000) AS INT) AS season, driver_id, lap, time_s FROM laps_v")
    folder = f"{shared_folder(v.spark)}/stintline/{uuid.uuid4().hex}"
    write_table(laps, folder, "laps", 1, "first", order=["driver_id", "lap"])
    again = laps.where("session_id % 2 = 0").withColumn("time_s", F.coalesce("time_s", F.lit(0.0)) + 1)
    return v.spark.read.parquet(write_table(again, folder, "laps", 2, "again", order=["driver_id", "lap"])).drop("generated_at")
