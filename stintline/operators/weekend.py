"""Team-mate and sprint-weekend comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintline.functions.figures import classified, true_median

# Known non-finishes, and the smallest sample for a rank correlation.
KNOWN_UNCLASSIFIED = ["Retired", "Disqualified", "Did not start"]
MIN_CORRELATION_N = 5

SEGMENTS = ["q3_s", "q2_s", "q1_s"]


def team_mate_pairs(qualifying: DataFrame) -> DataFrame:
    """Teams with exactly two drivers that weekend; the better placed driver is ``a``.

    Two aggregates instead of a self-join: a team of any other size is dropped.
    """
    row = F.struct("position", "driver_id", *SEGMENTS)
    return (
        qualifying.where("constructor_id IS NOT NULL AND driver_id IS NOT NULL")
        .groupBy("session_id", "constructor_id")
        .agg(F.count("*").alias("n"), F.min(row).alias("a"), F.max(row).alias("b")).where("n = 2").drop("n")
    )


def head_to_head(qualifying: DataFrame) -> DataFrame:
    """Who was ahead, and the gap in the last segment both set a time in."""
    shared = [F.when((F.col(f"a.{s}") > 0) & (F.col(f"b.{s}") > 0),
                     F.struct(F.lit(s[:2].upper()).alias("segment"), F.col(f"a.{s}").alias("ta"),
                              F.col(f"b.{s}").alias("tb"))) for s in SEGMENTS]
    return team_mate_pairs(qualifying).withColumn("d", F.coalesce(*shared)).select(
        "session_id", "constructor_id",
        F.when(F.col("a.position") < F.col("b.position"), F.col("a.driver_id")).otherwise(F.col("b.driver_id")).alias("ahead"),
        F.when(F.col("a.position") < F.col("b.position"), F.col("b.driver_id")).otherwise(F.col("a.driver_id")).alias("behind"),
        F.col("d.segment").alias("segment"), F.round(F.abs(F.col("d.ta") - F.col("d.tb")), 3).alias("gap_s"),
        F.when(F.col("d.ta") <= F.col("d.tb"), F.col("a.driver_id"))
        .when(F.col("d").isNotNull(), F.col("b.driver_id")).alias("ahead_by_segment"))


def head_to_head_season(weekends: DataFrame) -> DataFrame:
    """Record per team and pair of drivers, so a driver swap starts a new record."""
    low, high = F.least("ahead", "behind"), F.greatest("ahead", "behind")
    return (
        weekends.withColumn("season", F.floor(F.col("session_id") / 1000).cast("int"))
        .groupBy("season", "constructor_id", low.alias("driver_a"), high.alias("driver_b"))
        .agg(F.count_if(F.col("ahead") == low).alias("beats_a"), F.count_if(F.col("ahead") == high).alias("beats_b"),
             F.count("*").alias("rounds_compared"), F.count("gap_s").alias("rounds_with_gap"),
             F.round(true_median("gap_s"), 3).alias("median_gap_s"))
    )


def segment_bests(qualifying: DataFrame) -> DataFrame:
    """Each segment time marked as the session best, the driver's own best, or neither."""
    best = qualifying.groupBy("session_id").agg(*[F.min(s).alias(f"best_{s}") for s in SEGMENTS])
    own = F.least(*SEGMENTS)
    timed = sum((F.col(s).isNotNull().cast("int") for s in SEGMENTS), F.lit(0))
    marks = [
        F.when(F.col(s) == F.col(f"best_{s}"), "session best")
        .when((timed > 1) & (F.col(s) == own), "personal best").alias(f"{s[:2]}_mark") for s in SEGMENTS
    ]
    return qualifying.join(best, "session_id").select("session_id", "driver_id", *SEGMENTS, *marks)


def unrecognised_statuses(results: DataFrame) -> DataFrame:
    """Statuses that are neither a finish nor a known way of not finishing."""
    return results.where((F.coalesce("status", F.lit("")) != "") & ~classified("status")
                         & ~F.col("status").isin(KNOWN_UNCLASSIFIED)).select("season", "status").distinct()


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks with ties averaged. Ordered over distinct values, not over rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("_n").over(below), F.lit(0)) + (F.col("_n") + 1) / 2
    return df.join(counts.withColumn(out, rank).drop("_n"), [*keys, value], "left")


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = MIN_CORRELATION_N) -> DataFrame:
    """Pearson on average ranks; null below ``min_n`` or where a side has no spread."""
    paired = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(paired, keys, x, "_rx"), keys, y, "_ry")
    spread = (F.min("_rx") < F.max("_rx")) & (F.min("_ry") < F.max("_ry"))
    # Not corr(): under ANSI rules it fails on a side without spread.
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    rho = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), rho))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when((F.count("*") >= min_n) & spread, rho).alias("rho"))


def sprint_weekend(sprint: DataFrame, race: DataFrame) -> DataFrame:
    """Both races of a weekend side by side, a driver missing from either kept."""
    keys = ["season", "round", "driver_id"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *keys, F.col("team_id").alias(f"{name}_team"), F.col("grid").alias(f"{name}_grid"),
            F.col("position").alias(f"{name}_finish"), F.col("status").alias(f"{name}_status"),
            F.col("points").alias(f"{name}_points"), F.col("laps").alias(f"{name}_laps"))

    return side(sprint, "sprint").join(side(race, "race"), keys, "full_outer").select(
        *keys, F.coalesce("sprint_team", "race_team").alias("team_id"),
        *[f"{n}_{c}" for n in ("sprint", "race") for c in ("grid", "finish", "status", "points", "laps")],
        classified("sprint_status").alias("sprint_classified"), classified("race_status").alias("race_classified"))


def places_changed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Mean places between grid and flag, its sample, and who was left out."""
    used = F.coalesce(F.col(f"{name}_classified") & (F.col(f"{name}_grid") > 0) & (F.col(f"{name}_finish") > 0), F.lit(False))
    moved = F.when(used, F.abs(F.col(f"{name}_finish") - F.col(f"{name}_grid")))
    return df.groupBy(*keys).agg(
        F.avg(moved).alias(f"{name}_mean_places"), F.count_if(used).alias(f"{name}_sample"),
        F.count_if(~used).alias(f"{name}_excluded"))


def sprint_round(weekend: DataFrame, min_n: int = MIN_CORRELATION_N) -> DataFrame:
    """One row per sprint weekend: movement in each race and rank agreement between them."""
    keys = ["season", "round"]
    both = weekend.where("sprint_classified AND race_classified AND sprint_finish > 0 AND race_finish > 0")
    rho = spearman(both, keys, "sprint_finish", "race_finish", min_n)
    totals = weekend.groupBy(*keys).agg(
        F.coalesce(F.max("sprint_laps"), F.lit(0)).alias("sprint_laps"),
        F.coalesce(F.max("race_laps"), F.lit(0)).alias("race_laps"),
        F.coalesce(F.sum("sprint_points"), F.lit(0.0)).alias("sprint_points"),
        F.coalesce(F.sum("race_points"), F.lit(0.0)).alias("race_points"))
    return (
        totals.join(places_changed(weekend, keys, "sprint"), keys).join(places_changed(weekend, keys, "race"), keys)
        .join(rho, keys, "left").fillna(0, ["n"])
        .withColumn("withheld_reason", F.when(F.col("rho").isNull(), "too few drivers classified in both races"))
    )


def sprint_season(rounds: DataFrame) -> DataFrame:
    """Median of the per-round rhos and mean of the per-round means."""
    return rounds.groupBy("season").agg(
        F.count("*").alias("rounds_run"), true_median("rho").alias("median_rho"),
        F.count("rho").alias("rho_rounds"), F.avg("sprint_mean_places").alias("sprint_mean_places"),
        F.avg("race_mean_places").alias("race_mean_places"),
        F.least(F.count("sprint_mean_places"), F.count("race_mean_places")).alias("movement_rounds"))


def sprint_points(weekend: DataFrame) -> DataFrame:
    """Points taken on sprint weekends and the part that came from the sprint."""
    total = F.col("sprint_points") + F.col("race_points")
    return (
        weekend.groupBy("season", "driver_id").agg(
            F.coalesce(F.sum("sprint_points"), F.lit(0.0)).alias("sprint_points"),
            F.coalesce(F.sum("race_points"), F.lit(0.0)).alias("race_points"))
        .withColumn("weekend_points", total).where("weekend_points > 0")
        .withColumn("sprint_share", F.col("sprint_points") / F.col("weekend_points"))
    )


def weekend_order(weekend: DataFrame) -> DataFrame:
    """Race finish, then sprint finish, then driver; no finish sorts last."""
    order = Window.partitionBy("season", "round").orderBy(
        F.coalesce("race_finish", F.lit(99)), F.coalesce("sprint_finish", F.lit(99)), "driver_id")
    return weekend.select("season", "round", "driver_id", "race_finish", "sprint_finish",
                          F.row_number().over(order).alias("shown_at"))
