"""Standings, points progression, elimination and circuit priors."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintline.functions.figures import classified_text, started_text, true_median
from stintline.functions.scans import int_block, running_total
from stintline.operators.calendar import next_round, rounds_due, rounds_remaining

# Points by finishing position, and the fastest-lap point.
RACE_POINTS = [25, 18, 15, 12, 10, 8, 6, 4, 2, 1]
SPRINT_POINTS = [8, 7, 6, 5, 4, 3, 2, 1]
FASTEST_LAP_POINTS = 0
COUNTBACK_DEPTH = 30
HISTORY_SEASONS = 4

DRIVER = ["season", "driver_id"]


def points_table(spark: SparkSession, race=RACE_POINTS, sprint=SPRINT_POINTS) -> DataFrame:
    rows = [("race", i, float(p)) for i, p in enumerate(race, 1)]
    rows += [("sprint", i, float(p)) for i, p in enumerate(sprint, 1)]
    return spark.createDataFrame(rows, "kind string, position int, points double")


def scored(results: DataFrame, points: DataFrame, fastest_lap: float = FASTEST_LAP_POINTS) -> DataFrame:
    """Results with the points each one takes. The points table has a fixed size."""
    out = results.join(F.broadcast(points), ["kind", "position"], "left")
    bonus = F.lit(0.0)
    if "fastest_lap_rank" in results.columns:
        bonus = F.when((F.col("kind") == "race") & (F.col("fastest_lap_rank") == "1") & (F.col("position") <= 10),
                       float(fastest_lap)).otherwise(0.0)
    return out.withColumn("points", F.coalesce("points", F.lit(0.0)) + bonus)


def standings(results: DataFrame, points: DataFrame) -> DataFrame:
    """Season table: points, then countback over race finishes, then sprint finishes.

    Counted per (driver, kind, position) first, so the second grouping sees at
    most a few dozen rows per driver however long the season is.
    """
    seq = F.struct("round", (F.col("kind") == "race").cast("int").alias("k"), "position")
    per_place = scored(results, points).groupBy(*DRIVER, "kind", "position").agg(
        F.count("*").alias("n"), F.sum("points").alias("points"),
        F.max(F.struct(seq.alias("s"), "team_id")).alias("last_team"), F.min(seq).alias("first_seen"))

    def places(kind: str):
        counted = F.map_from_entries(F.collect_list(
            F.when((F.col("kind") == kind) & F.col("position").between(1, COUNTBACK_DEPTH),
                   F.struct("position", "n"))))
        return F.transform(F.sequence(F.lit(1), F.lit(COUNTBACK_DEPTH)),
                           lambda p: F.coalesce(F.try_element_at(counted, p), F.lit(0)))

    table = per_place.groupBy(*DRIVER).agg(
        F.sum("points").alias("points"),
        F.coalesce(F.sum(F.when((F.col("kind") == "race") & (F.col("position") == 1), F.col("n"))), F.lit(0)).alias("wins"),
        F.max("last_team").alias("t"), F.min("first_seen").alias("first_seen"),
        places("race").alias("race_places"), places("sprint").alias("sprint_places"))
    order = Window.partitionBy("season").orderBy(
        F.desc("points"), F.desc("race_places"), F.desc("sprint_places"), "first_seen", "driver_id")
    return table.select(*DRIVER, F.col("t.team_id").alias("team_id"), "points", "wins",
                        F.row_number().over(order).alias("position"))


def standings_cross_check(computed: DataFrame, official: DataFrame) -> DataFrame:
    """Computed rows the official table lacks or disagrees with (never the reverse)."""
    o = official.select(*DRIVER, F.col("points").alias("official_points"),
                        F.col("position").alias("official_position"))
    reason = F.when(F.col("official_points").isNull() & F.col("official_position").isNull(), "missing").when(
        ~(F.col("official_points").eqNullSafe(F.col("points"))
          & F.col("official_position").eqNullSafe(F.col("position"))), "differs")
    return computed.join(o, DRIVER, "left").withColumn("reason", reason).where("reason IS NOT NULL").select(
        *DRIVER, "points", "position", "official_points", "official_position", "reason")


def points_progression(results: DataFrame, points: DataFrame) -> DataFrame:
    """Cumulative points after each round for every driver seen so far."""
    per_round = scored(results, points).groupBy(*DRIVER, "round").agg(F.sum("points").alias("won"))
    debut = per_round.groupBy(*DRIVER).agg(F.min("round").alias("debut"))
    rounds = results.select("season", "round").distinct()
    grid = rounds.join(debut, "season").where("round >= debut").drop("debut")
    filled = grid.join(per_round, [*DRIVER, "round"], "left").fillna(0.0, ["won"])
    total = running_total(filled, DRIVER, ["round"], "won", "points", int_block("round", 256))
    return total.select(*DRIVER, "round", "points")


def progression_consistency(progression: DataFrame, table: DataFrame) -> DataFrame:
    """Drivers whose last snapshot is not their points in the table."""
    last = progression.groupBy("season").agg(F.max("round").alias("round"))
    final = progression.join(last, ["season", "round"]).select(*DRIVER, F.col("points").alias("snapshot"))
    return final.join(table.select(*DRIVER, "points"), DRIVER, "full_outer").where(
        ~F.col("snapshot").eqNullSafe(F.col("points")))


def elimination(table: DataFrame, remaining: DataFrame, race_max: float = RACE_POINTS[0] + FASTEST_LAP_POINTS,
                sprint_max: float = SPRINT_POINTS[0]) -> DataFrame:
    """Out only if every remaining point still leaves a driver short; a tie stays alive."""
    left = remaining.groupBy("season").agg(
        F.count("*").alias("remaining_rounds"),
        (F.count("*") * float(race_max) + F.count_if(F.col("sprint")) * float(sprint_max)).alias("remaining_max"))
    leader = table.where("position = 1").select("season", F.col("points").alias("leader_points"))
    best = F.col("points") + F.coalesce("remaining_max", F.lit(0.0))
    return table.join(leader, "season").join(left, "season", "left").select(
        *DRIVER, F.coalesce("remaining_rounds", F.lit(0)).alias("remaining_rounds"), best.alias("max_possible"),
        (best < F.col("leader_points")).alias("eliminated"))


def ledger_gaps(table: DataFrame) -> DataFrame:
    """Gap to the leader and share of the leader's points."""
    leader = table.groupBy("season").agg(F.max("points").alias("leader_points"))
    return table.join(leader, "season").select(
        *DRIVER, "position", (F.col("leader_points") - F.col("points")).alias("gap"),
        F.when(F.col("leader_points") > 0, F.col("points") / F.col("leader_points")).otherwise(0.0).alias("share"))


def _editions(results: DataFrame) -> DataFrame:
    counted = classified_text("position_text")
    moved = counted & (F.col("grid") > 0) & F.col("position").isNotNull()
    return (
        results.withColumn("started", started_text("position_text")).withColumn("counted", counted)
        .withColumn("places", F.when(moved, F.abs(F.col("grid") - F.col("position"))))
        .withColumn("winner_grid", F.when((F.col("position") == 1) & (F.col("grid") > 0), F.col("grid")))
    )


def circuit_editions(results: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """One row per edition. ``stops`` has a row per answered edition and driver.

    An edition the stop feed did not answer has no rows in ``stops`` and keeps
    null; an edition that was answered with nobody stopping carries one row with
    a null driver.
    """
    base = _editions(results).groupBy(*keys, "year").agg(
        F.count_if(F.col("started")).alias("starters"), F.count_if(F.col("counted")).alias("classified"),
        F.max("winner_grid").alias("winner_grid"))
    per_driver = stops.groupBy(*keys, "year", "driver_id").agg(F.count("driver_id").alias("n"))
    stopped = per_driver.groupBy(*keys, "year").agg(
        true_median(F.when(F.col("driver_id").isNotNull(), F.col("n"))).alias("median_stops"))
    return base.join(stopped.withColumn("stops_available", F.lit(True)), [*keys, "year"], "left").fillna(
        False, ["stops_available"])


def circuit_priors(results: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """Past editions of a circuit reduced to priors, each with its sample."""
    rows = _editions(results)
    per_year = circuit_editions(results, stops, keys).groupBy(*keys).agg(
        F.count("*").alias("editions"), F.count_if("stops_available").alias("editions_with_stops"))
    figures = rows.groupBy(*keys).agg(
        F.count_if(F.col("started")).alias("starters"), F.count_if(F.col("counted")).alias("classified"),
        true_median("places").alias("median_places"), F.count("places").alias("places_n"),
        true_median("winner_grid").alias("winner_grid_median"), F.min("winner_grid").alias("winner_grid_best"),
        F.max("winner_grid").alias("winner_grid_worst"), F.count("winner_grid").alias("winner_grid_n"))
    years = results.select(*keys, "year").distinct()
    per_driver = (
        stops.where("driver_id IS NOT NULL").groupBy(*keys, "year", "driver_id").agg(F.count("*").alias("n"))
        .join(years, [*keys, "year"], "left_semi")
        .groupBy(*keys).agg(true_median("n").alias("median_stops"), F.count("*").alias("stops_n")))
    return (
        per_year.join(figures, keys).join(per_driver, keys, "left").fillna(0, ["stops_n"])
        .withColumn("finish_share", F.try_divide("classified", "starters"))
    )


def upcoming_brief(calendar: DataFrame, results: DataFrame, stops: DataFrame, as_of: datetime.date,
                   seasons: int = HISTORY_SEASONS) -> DataFrame:
    """The next round of each season with priors from its last few editions, or a reason."""
    ahead = next_round(calendar, as_of)
    wanted = ahead.where("reason IS NULL").select(
        "season", "circuit_id",
        F.explode(F.sequence(F.col("season") - seasons, F.col("season") - 1)).alias("year"))
    priors = circuit_priors(results.join(wanted, ["circuit_id", "year"]), stops.join(wanted, ["circuit_id", "year"]),
                            ["season", "circuit_id"])
    reason = F.coalesce("reason", F.when(F.col("editions").isNull(), "no past edition of this circuit is on record"))
    return ahead.join(priors, ["season", "circuit_id"], "left").withColumn("reason", reason)


def finishing_order(laps: DataFrame) -> DataFrame:
    """Drivers by last lap reached, then by position on it."""
    last = laps.groupBy("session_id", "driver_id").agg(F.max(F.struct("lap", "position")).alias("l"))
    order = Window.partitionBy("session_id").orderBy(F.desc("l.lap"), "l.position", "driver_id")
    return last.select("session_id", "driver_id", F.col("l.lap").alias("last_lap"),
                       F.row_number().over(order).alias("finish"))


def site_counts(index: DataFrame, entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rounds, sessions, lines, drivers, counterfactuals and withheld figures, per season."""
    lines = index.groupBy("season").agg(
        F.count_distinct("round").alias("rounds"), F.count_if(F.col("n_drivers") > 0).alias("sessions"),
        F.sum("n_drivers").alias("lines"))
    drivers = entries.groupBy("season").agg(F.count_distinct("driver_id").alias("drivers"))
    refused = ledger.groupBy("season").agg(
        F.sum(F.when(F.col("module") == "What-If Engine", F.col("published"))).alias("counterfactuals"),
        F.sum("refused").alias("withheld"))
    return lines.join(drivers, "season", "full_outer").join(refused, "season", "full_outer")


def missing_rounds(calendar: DataFrame, results: DataFrame, as_of: datetime.date) -> DataFrame:
    """Due rounds without a race result. Must be empty before a table is built."""
    raced = results.where("kind = 'race'").select("season", "round").distinct()
    return rounds_due(calendar, as_of).select("season", "round").join(raced, ["season", "round"], "left_anti")


def complete_or_abort(calendar: DataFrame, results: DataFrame, points: DataFrame, as_of: datetime.date) -> DataFrame:
    """Standings of the seasons whose every due round is present, and of no other."""
    broken = missing_rounds(calendar, results, as_of).select("season").distinct()
    return standings(results.join(broken, "season", "left_anti"), points)


def season_remaining(calendar: DataFrame, as_of: datetime.date) -> DataFrame:
    return rounds_remaining(calendar, as_of)
