"""Landed feeds to tables, each with an explicit schema.

Every feed is an operator ``*_rows`` over a table of JSON text (column ``text``), and a thin ``read_*`` that gets the text from
files: the results feed answers in pages that nest everything under MRData, read as whole documents; the timing feed answers in
long flat arrays, read as records by byte ranges (``landing.records``). A value that does not parse becomes null, never a guess,
and so does every field of a text that is no JSON; ``seq`` keeps the feed's order. Null text has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.functions.figures import lap_time_seconds
from stintline.sources.landing import documents, records

_PERSON = "driverId STRING, code STRING, givenName STRING, familyName STRING, permanentNumber STRING"
_TEAM = "constructorId STRING, name STRING"
_CIRCUIT = "circuitId STRING, circuitName STRING, Location STRUCT<lat: STRING, long: STRING>"
_RESULT = ("position STRING, positionText STRING, grid STRING, status STRING, points STRING, laps STRING, "
           f"Driver STRUCT<{_PERSON}>, Constructor STRUCT<{_TEAM}>, FastestLap STRUCT<rank: STRING>")
_RACE_HEAD = f"season STRING, round STRING, raceName STRING, date STRING, Circuit STRUCT<{_CIRCUIT}>"


def _parsed(texts: DataFrame, schema: str, *keep: str) -> DataFrame:
    return texts.where("text is not null").select(*keep, F.from_json("text", schema).alias("_d")).select(*keep, "_d.*")


def _races(texts: DataFrame, inner: str) -> DataFrame:
    schema = f"MRData STRUCT<total: STRING, RaceTable: STRUCT<Races: ARRAY<STRUCT<{_RACE_HEAD}, {inner}>>>>"
    return _parsed(texts, schema).select(F.inline("MRData.RaceTable.Races")).withColumns({
        "season": _int("season"), "round": _int("round")})


def _int(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("int")


def _name(driver: str) -> Column:
    return F.concat_ws(" ", f"{driver}.givenName", f"{driver}.familyName")


def calendar_rows(texts: DataFrame) -> DataFrame:
    """A row per round. Coordinates only if both parse; a sprint is a key being present."""
    lat, long = F.col("Circuit.Location.lat").try_cast("double"), F.col("Circuit.Location.long").try_cast("double")
    both = lat.isNotNull() & long.isNotNull()
    return _races(texts, "Sprint STRUCT<date: STRING>").select(
        "season", "round", F.col("raceName").alias("race_name"), F.col("Circuit.circuitName").alias("circuit_name"),
        F.col("Circuit.circuitId").alias("circuit_id"), F.to_date("date").alias("date"), F.col("Sprint").isNotNull().alias("sprint"),
        F.when(both, lat).alias("lat"), F.when(both, long).alias("long"))


def entry_list_rows(texts: DataFrame) -> DataFrame:
    """All pages' drivers together."""
    schema = f"MRData STRUCT<total: STRING, DriverTable: STRUCT<season: STRING, Drivers: ARRAY<STRUCT<{_PERSON}>>>>"
    return _parsed(texts, schema).select(
        _int("MRData.DriverTable.season").alias("season"), F.inline("MRData.DriverTable.Drivers")).select(
        "season", "code", F.col("driverId").alias("driver_key"), F.col("givenName").alias("given_name"),
        F.col("familyName").alias("family_name"), F.col("permanentNumber").alias("permanent_number")).distinct()


def truncated_page_rows(texts: DataFrame) -> DataFrame:
    """Entry lists that hold fewer drivers than their own total: a truncated page is an error."""
    schema = f"MRData STRUCT<total: STRING, DriverTable: STRUCT<season: STRING, Drivers: ARRAY<STRUCT<{_PERSON}>>>>"
    pages = _parsed(texts, schema).select(
        _int("MRData.DriverTable.season").alias("season"), _int("MRData.total").alias("total"),
        F.size("MRData.DriverTable.Drivers").alias("n"))
    return pages.groupBy("season").agg(F.max("total").alias("total"), F.sum("n").alias("landed")).where("landed < total")


def standings_rows(texts: DataFrame) -> DataFrame:
    """The first standings list of each file; the first constructor is the team."""
    row = f"position STRING, points STRING, wins STRING, Driver STRUCT<{_PERSON}>, Constructors ARRAY<STRUCT<{_TEAM}>>"
    schema = ("MRData STRUCT<StandingsTable: STRUCT<season: STRING, StandingsLists: ARRAY<STRUCT<round: STRING, "
              f"DriverStandings: ARRAY<STRUCT<{row}>>>>>>")
    return _parsed(texts, schema).select(
        _int("MRData.StandingsTable.season").alias("season"),
        F.inline(F.get("MRData.StandingsTable.StandingsLists", 0)["DriverStandings"])).select(
        "season", _int("position").alias("position"), F.col("points").try_cast("double").alias("points"), _int("wins").alias("wins"),
        F.col("Driver.code").alias("driver_code"), _name("Driver").alias("driver_name"), F.get("Constructors", 0)["name"].alias("team"))


def _results(texts: DataFrame, field: str, kind: str) -> DataFrame:
    races = _races(texts, f"{field} ARRAY<STRUCT<{_RESULT}>>")
    rows = races.select("season", "round", F.col("Circuit.circuitId").alias("circuit_id"), F.posexplode(field).alias("seq", "r"))
    return rows.select(
        "season", "round", "circuit_id", F.lit(kind).alias("kind"), "seq", F.col("r.position").alias("position_raw"),
        _int("r.position").alias("position"), F.col("r.positionText").alias("position_text"), _int("r.grid").alias("grid"),
        F.col("r.Driver.code").alias("driver_code"), _name("r.Driver").alias("driver_name"), F.col("r.Constructor.name").alias("team"),
        F.col("r.status").alias("status"), F.col("r.points").try_cast("double").alias("points"), _int("r.laps").alias("laps"),
        F.col("r.FastestLap.rank").alias("fastest_lap_rank"))


def race_results_rows(texts: DataFrame) -> DataFrame:
    return _results(texts, "Results", "race")


def sprint_results_rows(texts: DataFrame) -> DataFrame:
    """Empty for a round that had no sprint."""
    return _results(texts, "SprintResults", "sprint")


def laps_rows(texts: DataFrame) -> DataFrame:
    """Nested laps and timings to a row per driver and lap."""
    inner = "Laps ARRAY<STRUCT<number: STRING, Timings: ARRAY<STRUCT<driverId: STRING, position: STRING, time: STRING>>>>"
    laps = _races(texts, inner).select("season", "round", F.inline("Laps"))
    return laps.select("season", "round", _int("number").alias("lap"), F.inline("Timings")).select(
        "season", "round", "lap", F.col("driverId").alias("driver_key"), _int("position").alias("position"),
        lap_time_seconds("time").alias("time_s"))


def pitstops_rows(texts: DataFrame) -> DataFrame:
    inner = "PitStops ARRAY<STRUCT<driverId: STRING, lap: STRING, stop: STRING, duration: STRING>>"
    return _races(texts, inner).select("season", "round", F.inline("PitStops")).select(
        "season", "round", F.col("driverId").alias("driver_key"), _int("lap").alias("lap"), _int("stop").alias("stop"),
        lap_time_seconds("duration").alias("duration_s"))


def qualifying_rows(texts: DataFrame) -> DataFrame:
    """A segment without a time stays null."""
    inner = ("QualifyingResults ARRAY<STRUCT<position: STRING, "
             f"Driver: STRUCT<{_PERSON}>, Constructor: STRUCT<{_TEAM}>, Q1: STRING, Q2: STRING, Q3: STRING>>")
    return _races(texts, inner).select("season", "round", F.inline("QualifyingResults")).select(
        "season", "round", F.col("Driver.driverId").alias("driver_key"), F.col("Driver.code").alias("code"),
        F.col("Constructor.constructorId").alias("constructor_id"), F.col("Constructor.name").alias("constructor_name"),
        _int("position").alias("position"), *[lap_time_seconds(q).alias(f"{q.lower()}_s") for q in ("Q1", "Q2", "Q3")])


def read_circuit_history(results: DataFrame, stops: DataFrame, answered: DataFrame, years: list[int]) -> tuple[DataFrame, DataFrame]:
    """Past editions and their stops. ``answered`` lists the (season, round) the stop feed replied for.

    An answered edition with no stop keeps one row with a null driver, so that it
    stays apart from an edition the feed never answered.
    """
    editions = results.where(F.col("season").isin(years)).withColumnRenamed("season", "year")
    raced = editions.select("circuit_id", "year", "round").distinct()
    known = answered.withColumnRenamed("season", "year").join(raced, ["year", "round"])
    per_stop = known.join(stops.select(F.col("season").alias("year"), "round", F.col("driver_key").alias("driver_id")), ["year", "round"], "left")
    return editions, per_stop.select("circuit_id", "year", "driver_id")


def sessions_rows(texts: DataFrame, as_of) -> DataFrame:
    """Sessions that have started."""
    raw = _parsed(texts, "session_key INT, meeting_key INT, circuit_key INT, circuit_short_name STRING, country_name STRING, "
                             "session_name STRING, date_start STRING, date_end STRING, year INT")
    return raw.withColumns({"date_start": F.expr("try_to_timestamp(date_start)"), "date_end": F.expr("try_to_timestamp(date_end)")}).where(
        F.col("date_start") < F.lit(as_of))


def session_drivers_rows(texts: DataFrame) -> DataFrame:
    raw = _parsed(texts, "session_key INT, driver_number INT, name_acronym STRING, full_name STRING, team_name STRING")
    return raw.select(F.col("session_key").alias("session_id"), F.col("driver_number").alias("driver_id"),
                      F.col("name_acronym").alias("code"), "full_name", F.col("team_name").alias("team"))


def timing_laps_rows(texts: DataFrame) -> DataFrame:
    """Laps with their start; an out-lap flag that is missing means no out-lap."""
    raw = _parsed(texts, "session_key INT, driver_number INT, lap_number INT, lap_duration DOUBLE, date_start STRING, is_pit_out_lap BOOLEAN, "
                             "duration_sector_1 DOUBLE, duration_sector_2 DOUBLE, duration_sector_3 DOUBLE, st_speed DOUBLE")
    return raw.select(
        F.col("session_key").alias("session_id"), F.col("driver_number").alias("driver_id"), F.col("lap_number").alias("lap"),
        F.col("lap_duration").alias("time_s"), F.expr("try_to_timestamp(date_start)").alias("start_ts"),
        F.coalesce("is_pit_out_lap", F.lit(False)).alias("is_pit_out"),
        *[F.col(f"duration_sector_{i}").alias(f"sector{i}_s") for i in (1, 2, 3)], F.col("st_speed").alias("speed_trap_kph"))


def stint_feed_rows(texts: DataFrame) -> DataFrame:
    raw = _parsed(texts, "session_key INT, driver_number INT, stint_number INT, lap_start INT, lap_end INT, compound STRING, tyre_age_at_start INT")
    return raw.select(F.col("session_key").alias("session_id"), F.col("driver_number").alias("driver_id"),
                      F.col("stint_number").alias("feed_stint"), "lap_start", "lap_end", "compound", "tyre_age_at_start")


def race_control_rows(texts: DataFrame) -> DataFrame:
    """Messages. ``file`` and ``seq`` (the record's place in its file, column ``offset``) keep the feed's order however files are read."""
    raw = _parsed(texts, "session_key INT, date STRING, category STRING, flag STRING, scope STRING, lap_number INT, sector INT, message STRING, driver_number INT", "file", "offset")
    return raw.select(
        F.col("session_key").alias("session_id"), "file", F.col("offset").alias("seq"), F.expr("try_to_timestamp(date)").alias("ts"), "category", "flag", "scope",
        F.col("lap_number").alias("lap"), "sector", "message", F.col("driver_number").alias("driver_id"))


def position_changes_rows(texts: DataFrame) -> DataFrame:
    raw = _parsed(texts, "session_key INT, date STRING, position INT, overtaking_driver_number INT, overtaken_driver_number INT")
    return raw.select(F.col("session_key").alias("session_id"), F.expr("try_to_timestamp(date)").alias("ts"), "position",
                      F.col("overtaking_driver_number").alias("gained_by"), F.col("overtaken_driver_number").alias("lost_by"))


def trackside_weather_rows(texts: DataFrame) -> DataFrame:
    raw = _parsed(texts, "session_key INT, date STRING, air_temperature DOUBLE, track_temperature DOUBLE, humidity DOUBLE, pressure DOUBLE, "
                             "rainfall INT, wind_speed DOUBLE, wind_direction DOUBLE")
    return raw.select(
        F.col("session_key").alias("session_id"), F.expr("try_to_timestamp(date)").alias("ts"), F.col("air_temperature").alias("air_c"),
        F.col("track_temperature").alias("track_c"), F.col("humidity").alias("humidity_pct"), F.col("pressure").alias("pressure_hpa"),
        "rainfall", F.col("wind_speed").alias("wind_ms"), F.col("wind_direction").alias("wind_deg"))


def radio_rows(texts: DataFrame) -> DataFrame:
    raw = _parsed(texts, "session_key INT, date STRING, driver_number INT, recording_url STRING")
    return raw.select(F.col("session_key").alias("session_id"), F.expr("try_to_timestamp(date)").alias("ts"),
                      F.col("driver_number").alias("driver_id"), F.col("recording_url").alias("link"))


def weather_archive_rows(texts: DataFrame) -> DataFrame:
    """Parallel hourly arrays to rows; a short array is padded with nulls."""
    hourly = "time ARRAY<STRING>, temperature_2m ARRAY<DOUBLE>, relative_humidity_2m ARRAY<DOUBLE>, precipitation ARRAY<DOUBLE>, wind_speed_10m ARRAY<DOUBLE>"
    raw = _parsed(texts, f"latitude DOUBLE, longitude DOUBLE, elevation DOUBLE, hourly STRUCT<{hourly}>")
    names = ("temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m")
    # A variable the archive left out altogether pads like a short one.
    zipped = F.arrays_zip("hourly.time", *[F.coalesce(f"hourly.{c}", F.array().cast("array<double>")) for c in names])
    named = zipped.cast("array<struct<hour: string, air_c: double, humidity_pct: double, precip_mm: double, wind_ms: double>>")
    return raw.select("latitude", "longitude", "elevation", F.inline(named)).where("hour IS NOT NULL").withColumn(
        "hour_ts", F.expr("try_to_timestamp(hour)")).drop("hour")


def position_samples_rows(texts: DataFrame) -> DataFrame:
    """Position samples; one without x or y is dropped."""
    raw = _parsed(texts, "session_key INT, driver_number INT, date STRING, x DOUBLE, y DOUBLE, z DOUBLE")
    return raw.where("x IS NOT NULL AND y IS NOT NULL").select(
        F.col("session_key").alias("session_id"), F.col("driver_number").alias("driver_id"), F.expr("try_to_timestamp(date)").alias("ts"), "x", "y", "z")


def car_samples_rows(texts: DataFrame) -> DataFrame:
    raw = _parsed(texts, "session_key INT, driver_number INT, date STRING, speed DOUBLE, throttle DOUBLE, brake DOUBLE, n_gear INT, drs INT, rpm INT")
    return raw.select(F.col("session_key").alias("session_id"), F.col("driver_number").alias("driver_id"),
                      F.expr("try_to_timestamp(date)").alias("ts"), "speed", "throttle", "brake", F.col("n_gear").alias("gear"), "drs", "rpm")


def points_table_rows(texts: DataFrame) -> DataFrame:
    """(kind, position, points) for race and sprint; of kind fastest_lap the row of lap rank 1. Two dozen rows at most."""
    table = "MAP<STRING, DOUBLE>"
    raw = _parsed(texts, f"race_points_by_position {table}, sprint_points_by_position {table}, fastest_lap_point STRUCT<points: DOUBLE>")

    def rows(kind: str) -> DataFrame:
        return raw.select(F.explode(f"{kind}_points_by_position").alias("p", "points")).select(
            F.lit(kind).alias("kind"), _int("p").alias("position"), "points")

    fastest = raw.where("fastest_lap_point.points is not null").select(
        F.lit("fastest_lap").alias("kind"), F.lit(1).alias("position"), F.col("fastest_lap_point.points").alias("points"))
    return rows("race").unionByName(rows("sprint")).unionByName(fastest)


def _source(land, rows, name: str):
    def read(spark: SparkSession, path: str, *more) -> DataFrame:
        return rows(land(spark, path), *more)

    read.__name__, read.__doc__ = name, rows.__doc__
    return read


read_calendar, read_entry_list, truncated_pages, read_standings = (
    _source(documents, rows, name) for rows, name in ((calendar_rows, "read_calendar"), (entry_list_rows, "read_entry_list"),
                                                      (truncated_page_rows, "truncated_pages"), (standings_rows, "read_standings")))
read_race_results, read_sprint_results, read_laps, read_pitstops, read_qualifying = (
    _source(documents, rows, name) for rows, name in ((race_results_rows, "read_race_results"), (sprint_results_rows, "read_sprint_results"),
                                                      (laps_rows, "read_laps"), (pitstops_rows, "read_pitstops"), (qualifying_rows, "read_qualifying")))
read_weather_archive, read_points_table = _source(documents, weather_archive_rows, "read_weather_archive"), _source(documents, points_table_rows, "read_points_table")
read_sessions, read_session_drivers, read_timing_laps, read_stint_feed, read_race_control = (
    _source(records, rows, name) for rows, name in ((sessions_rows, "read_sessions"), (session_drivers_rows, "read_session_drivers"),
                                                    (timing_laps_rows, "read_timing_laps"), (stint_feed_rows, "read_stint_feed"), (race_control_rows, "read_race_control")))
read_position_changes, read_trackside_weather, read_radio, read_position_samples, read_car_samples = (
    _source(records, rows, name) for rows, name in ((position_changes_rows, "read_position_changes"), (trackside_weather_rows, "read_trackside_weather"),
                                                    (radio_rows, "read_radio"), (position_samples_rows, "read_position_samples"), (car_samples_rows, "read_car_samples")))
