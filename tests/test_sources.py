import datetime
import json

from stintline.sources import feeds
from stintline.sources.sinks import write_table

DRIVER = {"driverId": "a_b", "code": "AAB", "givenName": "A", "familyName": "B"}
RACE = {"season": "2024", "round": "3", "raceName": "R", "date": "2024-05-01",
        "Circuit": {"circuitId": "c", "circuitName": "C", "Location": {"lat": "1.5", "long": "x"}}}


def land(tmp_path, name, doc):
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(doc))
    return str(path)


def race(tmp_path, name, **inner):
    return land(tmp_path, name, {"MRData": {"total": "1", "RaceTable": {"Races": [{**RACE, **inner}]}}})


def test_calendar_keeps_no_half_coordinate(spark, tmp_path):
    row = feeds.read_calendar(spark, race(tmp_path, "cal", Sprint={"date": "2024-04-30"})).first()
    assert (row.season, row.round, row.sprint, row.lat, row.long) == (2024, 3, True, None, None)
    assert row.date == datetime.date(2024, 5, 1)


def test_laps_parse_or_stay_null(spark, tmp_path):
    timings = [{"driverId": d, "position": str(i), "time": t} for i, (d, t) in enumerate(
        [("a", "1:32.264"), ("b", "58.5"), ("c", "no time"), ("d", "x:1.0")], 1)]
    rows = feeds.read_laps(spark, race(tmp_path, "laps", Laps=[{"number": "1", "Timings": timings}])).collect()
    got = {r.driver_key: r.time_s for r in rows}
    assert abs(got["a"] - 92.264) < 1e-9 and got["b"] == 58.5 and got["c"] is None and got["d"] is None


def test_results_and_standings(spark, tmp_path):
    entry = {"position": "1", "positionText": "1", "grid": "0", "status": "Finished", "points": "25", "laps": "50",
             "Driver": DRIVER, "Constructor": {"constructorId": "t", "name": "T"}, "FastestLap": {"rank": "1"}}
    row = feeds.read_race_results(spark, race(tmp_path, "res", Results=[entry])).first()
    assert (row.position, row.grid, row.team, row.fastest_lap_rank, row.driver_name) == (1, 0, "T", "1", "A B")
    assert feeds.read_sprint_results(spark, race(tmp_path, "spr")).count() == 0
    table = {"MRData": {"StandingsTable": {"season": "2024", "StandingsLists": [
        {"round": "3", "DriverStandings": [{"position": "1", "points": "25.5", "wins": "1", "Driver": DRIVER, "Constructors": []}]}]}}}
    row = feeds.read_standings(spark, land(tmp_path, "st", table)).first()
    assert (row.points, row.team, row.driver_code) == (25.5, None, "AAB")


def test_entry_list_pages_and_truncation(spark, tmp_path):
    page = {"MRData": {"total": "2", "DriverTable": {"season": "2024", "Drivers": [DRIVER]}}}
    path = land(tmp_path, "entries", page)
    assert feeds.read_entry_list(spark, path).count() == 1
    assert feeds.truncated_pages(spark, path).first().landed == 1


def test_timing_feed_readers(spark, tmp_path):
    lap = {"session_key": 9, "driver_number": 4, "lap_number": 2, "lap_duration": 90.5, "date_start": "2024-05-01T13:00:00+00:00"}
    row = feeds.read_timing_laps(spark, land(tmp_path, "tl", [lap])).first()
    assert row.is_pit_out is False and row.start_ts == datetime.datetime(2024, 5, 1, 13)
    sessions = [{"session_key": k, "date_start": d} for k, d in ((1, "2024-05-02T00:00:00"), (2, "2030-01-01T00:00:00"), (3, None))]
    got = feeds.read_sessions(spark, land(tmp_path, "se", sessions), datetime.datetime(2025, 1, 1)).collect()
    assert [r.session_key for r in got] == [1]
    samples = [{"session_key": 9, "driver_number": 4, "date": "2024-05-01T13:00:00", "x": 1.0, "y": None}]
    assert feeds.read_position_samples(spark, land(tmp_path, "ps", samples)).count() == 0


def test_archive_pads_short_arrays(spark, tmp_path):
    doc = {"latitude": 1.0, "longitude": 2.0, "hourly": {"time": ["2024-05-01T13:00", "2024-05-01T14:00"], "temperature_2m": [20.0]}}
    rows = feeds.read_weather_archive(spark, land(tmp_path, "ar", doc)).orderBy("hour_ts").collect()
    assert [r.air_c for r in rows] == [20.0, None] and rows[0].hour_ts == datetime.datetime(2024, 5, 1, 13)


def test_points_table(spark, tmp_path):
    doc = {"race_points_by_position": {"1": 25, "2": 18}, "sprint_points_by_position": {"1": 8}}
    got = {(r.kind, r.position): r.points for r in feeds.read_points_table(spark, land(tmp_path, "pt", doc)).collect()}
    assert got == {("race", 1): 25.0, ("race", 2): 18.0, ("sprint", 1): 8.0}


def test_history_keeps_unanswered_apart(spark):
    results = spark.createDataFrame([(2023, 1, "c", 1), (2022, 5, "c", 1)], "season int, round int, circuit_id string, position int")
    stops = spark.createDataFrame([], "season int, round int, driver_key string")
    answered = spark.createDataFrame([(2023, 1)], "season int, round int")
    _editions, rows = feeds.read_circuit_history(results, stops, answered, [2022, 2023])
    assert [(r.year, r.driver_id) for r in rows.collect()] == [(2023, None)]


def test_write_table_replaces_only_its_partitions(spark, tmp_path):
    def rows(values):
        return spark.createDataFrame(values, "season int, session_id int, v int")

    write_table(rows([(1, 1, 1), (1, 2, 2)]), str(tmp_path), "t", 1, "test")
    path = write_table(rows([(1, 2, 9)]), str(tmp_path), "t", 2, "test")
    got = {(r.session_id, r.v, r.schema_version) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1, 1), (2, 9, 2)}
