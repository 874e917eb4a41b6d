"""Raw samples to published lines, with a reason for every lap that gave none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.functions.lineage import materialised
from stintline.operators import telemetry as tl


def racing_lines(pos: DataFrame, car: DataFrame, picked: DataFrame, min_samples: int = tl.MIN_LINE_SAMPLES,
                 min_range_m: float = tl.MIN_ELEVATION_RANGE_M) -> tuple[DataFrame, DataFrame]:
    """(lines, refusals) for the picked laps (session_id, driver_id, lap_key, pace_rank).

    The unit is measured once per session, on the fastest lap that allows it; a
    lap tried before that one has no unit and gives no line. Elevation is kept
    only where the session's fastest line carries a usable profile. The grid of
    that line is made first, by itself; of the others it is made last, as it has
    many more points than there are samples.
    """
    picked = materialised(picked)
    chosen = picked.select("lap_key")
    aligned = materialised(tl.align_channels(
        pos.join(chosen, "lap_key", "left_semi"), car.join(chosen, "lap_key", "left_semi"), steps=True))
    unit = tl.session_scale(tl.position_scale(aligned, min_samples), picked)
    usable = materialised(picked.join(unit, "session_id").where("pace_rank >= measured_on"))
    built = materialised(picked.join(tl.driven_laps(aligned, usable, min_samples), "lap_key"))
    best = built.groupBy("session_id").agg(F.min(F.struct("pace_rank", "lap_key")).alias("b")).select(
        "session_id", F.col("b.lap_key").alias("best_key"))
    fastest = best.select(F.col("best_key").alias("lap_key"))
    profile = tl.resample_by_distance(tl.driven_distance(aligned.join(fastest, "lap_key", "left_semi"), usable, min_samples))
    verdict = tl.elevation_verdict(profile, min_range_m)
    keep_z = built.join(best, "session_id").join(
        verdict.select(F.col("lap_key").alias("best_key"), "usable"), "best_key").select("lap_key", "usable")
    driven = tl.driven_distance(aligned, usable.join(keep_z, "lap_key"), min_samples, told=("usable",))
    lines = tl.resample_by_distance(driven.withColumn("z", F.when(F.col("usable"), F.col("z"))))
    report = tl.capture_report(aligned, usable, min_samples).select("lap_key", "reason")
    refused = (
        picked.join(built.select("lap_key"), "lap_key", "left_anti").join(report, "lap_key", "left")
        .join(aligned.select("lap_key").distinct().withColumn("_seen", F.lit(True)), "lap_key", "left")
        .select("session_id", "driver_id", "lap_key",
                F.when(F.col("_seen").isNull(), "no position samples").otherwise(F.col("reason")).alias("reason")))
    return lines, refused
