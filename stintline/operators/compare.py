"""Laps against laps: clocks, deltas, mini-sectors and the cost of a race lap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintline.functions.scans import int_block, stepped_total

SPACING_M = 2.0
SECTORS = 24
COST_SECTORS = 12


def lap_clock(line: DataFrame, ds: float = SPACING_M) -> DataFrame:
    """Time to reach each grid point, by trapezoid speed with a floor of 1 km/h."""
    speed = line.select("lap_key", "idx", F.greatest("speed", F.lit(1.0)).alias("v"))
    return stepped_total(speed, ["lap_key"], "idx", "v", lambda p, v: F.lit(ds) / ((p + v) / 2 / 3.6), "t", int_block("idx")).select("lap_key", "idx", "t")


def delta_trace(clock: DataFrame, pairs: DataFrame) -> DataFrame:
    """Time lost to the reference lap at each grid point both reached. ``pairs`` is (ref_key, lap_key)."""
    ref = clock.select(F.col("lap_key").alias("ref_key"), "idx", F.col("t").alias("ref_t"))
    return pairs.join(clock, "lap_key").join(ref, ["ref_key", "idx"]).select(
        "ref_key", "lap_key", "idx", (F.col("t") - F.col("ref_t")).alias("delta_s"))


def integrated_lap_time(clock: DataFrame) -> DataFrame:
    return clock.groupBy("lap_key").agg(F.max_by("t", "idx").alias("lap_time_s"))


def mini_sectors(clock: DataFrame, sectors: int = SECTORS) -> DataFrame:
    """Time of each lap through equal fractions of itself."""
    size = clock.groupBy("lap_key").agg(F.count("*").alias("n"))
    # Bounds are told from the samples: a table of bounds is many times the laps it is made from, and would be sent out whole.
    place, last = F.col("idx"), F.col("n") - 1
    around = [F.coalesce(F.floor(F.try_divide((place + side) * float(sectors), last)) + wide, F.lit(rest)) for side, wide, rest in ((-0.5, -1, 0), (0.5, 1, sectors))]
    low, high = [F.greatest(F.lit(0), F.least(F.lit(sectors), e)).cast("int") for e in around]
    bounds = F.filter(F.sequence(low, high), lambda s: F.floor(s / float(sectors) * last + 0.5) == place)
    at = clock.join(size, "lap_key").select("lap_key", F.explode(bounds).alias("s"), "t")
    start = at.where(F.col("s") < sectors).select("lap_key", (F.col("s") + 1).alias("sector"), F.col("t").alias("t0"))
    end = at.where("s > 0").select("lap_key", F.col("s").alias("sector"), F.col("t").alias("t1"))
    return start.join(end, ["lap_key", "sector"]).select("lap_key", "sector", (F.col("t1") - F.col("t0")).alias("time_s"))


def sector_winners(times: DataFrame, selection: DataFrame) -> DataFrame:
    """Fastest lap of each sector and its margin; the first selected lap wins a tie.

    ``selection`` is (session_id, lap_key, pick). A lap alone has no margin.
    """
    order = Window.partitionBy("session_id", "sector").orderBy("time_s", "pick")
    picked = times.withColumn("time_s", F.round("time_s", 9)).join(selection, "lap_key")
    return picked.withColumn("_place", F.row_number().over(order)).where("_place <= 2").groupBy("session_id", "sector").agg(
        F.max(F.when(F.col("_place") == 1, F.col("lap_key"))).alias("fastest"),
        (F.max(F.when(F.col("_place") == 2, F.col("time_s"))) - F.max(F.when(F.col("_place") == 1, F.col("time_s")))).alias("margin_s"))


def winner_by_sample(line: DataFrame, winners: DataFrame, selection: DataFrame, sectors: int = SECTORS) -> DataFrame:
    """The sector winner on every sample of every selected lap."""
    size = line.groupBy("lap_key").agg(F.count("*").alias("n"))
    sector = F.least(F.lit(sectors - 1), F.floor(F.col("idx") / F.greatest(F.lit(1), F.col("n") - 1) * sectors)) + 1
    return line.select("lap_key", "idx").join(size, "lap_key").join(selection.select("session_id", "lap_key"), "lap_key").withColumn(
        "sector", sector.cast("int")).join(winners.select("session_id", "sector", "fastest"), ["session_id", "sector"]).select(
        "session_id", "lap_key", "idx", "sector", "fastest")


def sector_tally(winners: DataFrame, selection: DataFrame) -> DataFrame:
    """Sectors won per selected lap; a lap that won none keeps its zero."""
    won = winners.groupBy("session_id", F.col("fastest").alias("lap_key")).agg(F.count("*").alias("won"))
    return selection.select("session_id", "lap_key").join(won, ["session_id", "lap_key"], "left").fillna(0, ["won"])


def session_pair(qualifying: DataFrame, race: DataFrame, keys: list[str]) -> DataFrame:
    """Drivers with a lap in both sessions."""
    return qualifying.select(*keys, F.col("lap_key").alias("q_key")).join(
        race.select(*keys, F.col("lap_key").alias("r_key")), keys)


def session_cost_sectors(clock: DataFrame, pairs: DataFrame, sectors: int = COST_SECTORS) -> DataFrame:
    """Race minus qualifying, per equal fraction of each lap."""
    times = mini_sectors(clock, sectors)
    q = times.select(F.col("lap_key").alias("q_key"), "sector", F.col("time_s").alias("qualifying_s"))
    r = times.select(F.col("lap_key").alias("r_key"), "sector", F.col("time_s").alias("race_s"))
    return pairs.join(q, "q_key").join(r, ["r_key", "sector"]).select(
        "q_key", "r_key", "sector", "qualifying_s", "race_s", F.round(F.col("race_s") - F.col("qualifying_s"), 9).alias("cost_s"))


def session_cost(clock: DataFrame, line: DataFrame, pairs: DataFrame, official: DataFrame, sectors: int = COST_SECTORS) -> DataFrame:
    """What the race cost a driver's lap, and where it was paid. ``official`` is (lap_key, official_s)."""
    facts = integrated_lap_time(clock).join(line.groupBy("lap_key").agg(F.max("speed").alias("top")), "lap_key").join(
        official, "lap_key", "left")

    def side(name: str) -> DataFrame:
        return facts.select(F.col("lap_key").alias(f"{name}_key"), F.col("lap_time_s").alias(f"{name}_s"),
                            F.col("top").alias(f"{name}_top"), F.col("official_s").alias(f"{name}_official_s"))

    worst = session_cost_sectors(clock, pairs, sectors).groupBy("q_key", "r_key").agg(
        F.max(F.struct("cost_s", (-F.col("sector")).alias("s"))).alias("w"))
    return pairs.join(side("q"), "q_key").join(side("r"), "r_key").join(worst, ["q_key", "r_key"]).select(
        "q_key", "r_key", "q_s", "r_s", (F.col("r_s") - F.col("q_s")).alias("integrated_cost_s"),
        (F.col("r_official_s") - F.col("q_official_s")).alias("official_cost_s"), (F.col("r_top") - F.col("q_top")).alias("top_speed_cost_kph"),
        (-F.col("w.s")).alias("worst_sector"), F.col("w.cost_s").alias("worst_cost_s"))


def laps_by_team(survey: DataFrame, teams: DataFrame) -> DataFrame:
    """Every team, with its laps fastest first; a team with no lap keeps one empty row."""
    order = Window.partitionBy("session_id", "team_id").orderBy("lap_time_s", "lap_key")
    return teams.select("session_id", "team_id").distinct().join(survey, ["session_id", "team_id"], "left").withColumn(
        "place", F.when(F.col("lap_key").isNotNull(), F.row_number().over(order)))


def session_lap_board(survey: DataFrame) -> DataFrame:
    """Laps of one session, fastest first."""
    order = Window.partitionBy("session_id").orderBy("lap_time_s", "lap_key")
    return survey.withColumn("place", F.row_number().over(order))


def newest_with_lines(index: DataFrame) -> DataFrame:
    """Per season the newest round with a line; qualifying is looked at before the race."""
    rank = F.when(F.col("session") == "Q", 0).otherwise(1)
    return index.where("n_drivers > 0").groupBy("season").agg(
        F.min(F.struct(rank.alias("r"), (-F.col("round")).alias("n"), "session")).alias("m")).select(
        "season", (-F.col("m.n")).alias("round"), F.col("m.session").alias("session"))


def elevation_board(index: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rounds with a usable elevation profile, beside how many of the season were refused one."""
    judged = index.where("n_drivers > 0 AND elevation_usable IS NOT NULL")
    refused = judged.groupBy("season").agg(F.count_if(~F.col("elevation_usable")).alias("refused"))
    return judged.where("elevation_usable").join(calendar.select("season", "round", "circuit_id"), ["season", "round"], "left").join(
        refused, "season").select("season", "round", "circuit_id", "refused")
