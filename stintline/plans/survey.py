"""The aero survey: one row per lap with its headline figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.functions.lineage import materialised
from stintline.operators import compare as cp
from stintline.operators import geometry as gm


def aero_survey(line: DataFrame, turn_limits: dict | None = None, coast_limits: dict | None = None,
                drag_limits: dict | None = None, tolerance_pct: float = gm.GRIP_TOLERANCE_PCT) -> DataFrame:
    """Every lap of every session at once; trace, turns and peaks are computed once and read back."""
    trace = materialised(gm.acceleration_trace(line))
    turns = materialised(gm.detect_turns(trace, **(turn_limits or {})))
    style, peaks, grip = gm.driving_style(trace, turns), materialised(gm.lap_peaks(trace)), gm.implied_grip(turns)
    slow = turns.groupBy("lap_key").agg(F.min("min_speed_kph").alias("slowest_corner_kph"))
    drag = gm.apparent_drag(trace, gm.coasting_samples(trace, **(coast_limits or {})), **(drag_limits or {})).select(
        "lap_key", F.col("samples").alias("coast_samples"), F.col("k").alias("drag_k"))
    # Without a turn to imply a grip level, the lap's own peak stands in.
    level = peaks.join(grip, "lap_key", "left").select("lap_key", F.coalesce("grip_g", "peak_lateral_g").alias("grip_g"))
    model = gm.corner_model_summary(gm.corner_model(turns, level, peaks, tolerance_pct)).select(
        "lap_key", "turns_modelled", "median_abs_error_pct")
    return (
        style.select("lap_key", "turns", "full_throttle_share", "braking_share")
        .join(peaks.drop("peak_accel_g"), "lap_key").join(grip.withColumnRenamed("grip_g", "implied_grip_g"), "lap_key", "left")
        .join(slow, "lap_key", "left").join(drag, "lap_key", "left").join(model, "lap_key", "left")
        .join(cp.integrated_lap_time(cp.lap_clock(line)), "lap_key").fillna(0, ["turns_modelled"])
        .withColumn("session_id", F.floor(F.col("lap_key") / 100).cast("int"))
    )
