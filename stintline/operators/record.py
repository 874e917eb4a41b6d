"""The race record: control messages, slow laps, position changes, radio, weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintline.functions.figures import true_median
from stintline.functions.ranks import ranked
from stintline.functions.scans import last_known, time_block

CAR = ["session_id", "driver_id"]

# Fixed values of the record rules.
SLOW_LAP_S = 2.0
SEVERITY = [(10.0, "major"), (4.0, "moderate"), (SLOW_LAP_S, "minor")]
FIRST_RACING_LAP = 2
MIN_GREEN_LAPS = 5
UNTERMINATED_LAPS = 5
INCIDENT_CATEGORIES = ["Flag", "Other", "CarEvent", "Drs"]
INFORMATIONAL_FLAGS = ["BLUE"]
DRIVER_FLAGS = ["BLUE", "BLACK AND WHITE", "BLACK", "BLACK AND ORANGE"]
CLEAR_FLAGS = ["GREEN", "CLEAR", "CHEQUERED"]
MIN_CHANGES = 20
MIN_CLIPS = 5
MIN_TRACKSIDE_SAMPLES = 10
MAX_AIR_DISAGREEMENT_C = 8.0


def neutralised_laps(messages: DataFrame) -> DataFrame:
    """Laps under a safety car or red flag, from ordered open and close messages.

    Each message is an opening, a closing or neither. The state in front of a
    message is the latest marker before it, found by a scan in hourly blocks, so
    a session with very many messages is still spread over tasks.
    """
    text = F.upper(F.coalesce("message", F.lit("")))
    safety = F.coalesce(F.col("category") == "SafetyCar", F.lit(False))
    has_lap = F.coalesce(F.col("lap") != 0, F.lit(False))
    ending = text.contains("ENDING") | text.contains("IN THIS LAP")
    kind = (
        F.when(safety & ending & has_lap, "close")
        .when(safety & ~ending & text.contains("DEPLOYED") & has_lap, "open")
        .when(~safety & text.contains("SAFETY CAR LIGHTS ON") & has_lap, "lights")
        .when(~safety & ~text.contains("SAFETY CAR LIGHTS ON") & (F.col("flag") == "RED") & has_lap, "red")
    )
    rows = messages.select("session_id", "ts", "seq", "lap", kind.alias("kind")).where("kind IS NOT NULL")
    marker = F.when(F.col("kind").isin("open", "close"), F.struct("kind", "lap"))
    state = last_known(rows, ["session_id"], ["ts", "seq"], {"before": marker}, time_block("ts"), inclusive=False)
    is_open = F.coalesce(F.col("before.kind") == "open", F.lit(False))
    lap = F.col("lap")
    spans = state.select("session_id", (
        F.when((F.col("kind") == "close") & is_open,
               F.struct(F.least("before.lap", "lap").alias("a"), F.greatest("before.lap", "lap").alias("b")))
        .when((F.col("kind") == "lights") & ~is_open, F.struct(lap.alias("a"), (lap + UNTERMINATED_LAPS).alias("b")))
        .when(F.col("kind") == "red", F.struct(lap.alias("a"), lap.alias("b")))
    ).alias("span"))
    never_closed = (
        rows.where("kind IN ('open', 'close')").groupBy("session_id")
        .agg(F.max_by(F.struct("kind", "lap"), F.struct("ts", "seq")).alias("m")).where("m.kind = 'open'")
        .select("session_id", F.struct(F.col("m.lap").alias("a"), (F.col("m.lap") + UNTERMINATED_LAPS).alias("b")).alias("span"))
    )
    return spans.where("span IS NOT NULL").unionByName(never_closed).distinct().select(
        "session_id", F.explode(F.sequence("span.a", "span.b")).alias("lap")).distinct()


def track_flags(messages: DataFrame) -> DataFrame:
    """Flags about the track rather than about one car, as published."""
    flag = F.upper(F.coalesce("flag", F.lit("")))
    about_track = F.coalesce(F.col("driver_id"), F.lit(0)) == 0
    return messages.where(
        (F.coalesce(F.col("lap"), F.lit(0)) != 0) & (flag != "") & about_track & ~flag.isin(DRIVER_FLAGS + CLEAR_FLAGS)
    ).select("session_id", "lap", "seq", "flag", "sector", F.trim("message").alias("message"))


def track_flags_on_laps(laps: DataFrame, messages: DataFrame) -> DataFrame:
    """Laps with how many track flags fell on them and which ones."""
    per_lap = track_flags(messages).groupBy("session_id", "lap").agg(
        F.count("*").alias("flag_messages"), F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"))
    return laps.join(per_lap, ["session_id", "lap"], "left").fillna({"flag_messages": 0, "flags": ""})


def attributed_incidents(messages: DataFrame, drivers: DataFrame) -> DataFrame:
    """Messages that name a car by its published number, verbatim."""
    named = messages.where(
        (F.coalesce(F.col("driver_id"), F.lit(0)) != 0) & F.col("category").isin(INCIDENT_CATEGORIES)
        & (F.trim(F.coalesce("message", F.lit(""))) != ""))
    nature = F.when(F.col("flag").isin(INFORMATIONAL_FLAGS), "informational").otherwise("noted")
    return named.join(drivers.select(*CAR, "code"), CAR, "left").select(
        *CAR, "seq", "lap", F.coalesce("code", F.col("driver_id").cast("string")).alias("code"),
        nature.alias("nature"), "category", "flag", F.trim("message").alias("message"))


def slow_laps(laps: DataFrame, neutralised: DataFrame, threshold_s: float = SLOW_LAP_S,
              min_green: int = MIN_GREEN_LAPS) -> DataFrame:
    """Laps well off the driver's own green median; lap 1, in- and out-laps never count."""
    in_laps = laps.where("is_pit_out").select(*CAR, (F.col("lap") - 1).alias("lap"))
    green = (
        laps.where((F.coalesce("time_s", F.lit(0.0)) != 0) & ~F.col("is_pit_out") & (F.col("lap") >= FIRST_RACING_LAP))
        .join(in_laps, [*CAR, "lap"], "left_anti")
        .join(neutralised, ["session_id", "lap"], "left_anti")
    )
    norm = green.groupBy(*CAR).agg(true_median("time_s").alias("baseline"), F.count("*").alias("green")).where(
        F.col("green") >= min_green)
    loss = F.col("time_s") - F.col("baseline")
    severity = F.lit("minor")
    for least, label in reversed(SEVERITY):
        severity = F.when(loss >= least, label).otherwise(severity)
    return green.join(norm, CAR).where(loss >= threshold_s).select(
        *CAR, "lap", F.round("time_s", 3).alias("lap_time_s"), F.round("baseline", 3).alias("baseline_s"),
        F.round(loss, 3).alias("estimated_loss_s"), severity.alias("severity"))


def error_review(laps: DataFrame, messages: DataFrame, drivers: DataFrame) -> DataFrame:
    """Recorded events and flagged laps of every driver in one table.

    ``severity_rank`` orders flagged laps major, moderate, minor; a recorded event has none.
    """
    recorded = attributed_incidents(messages, drivers).select(
        *CAR, "lap", F.lit("recorded").alias("kind"), F.col("nature").alias("label"), "message")
    flagged = track_flags_on_laps(slow_laps(laps, neutralised_laps(messages)), messages).select(
        *CAR, "lap", F.lit("flagged").alias("kind"), F.col("severity").alias("label"), "estimated_loss_s", "flags")
    rank = F.array_position(F.array(*[F.lit(label) for _, label in SEVERITY]), F.col("label")).cast("int")
    return recorded.unionByName(flagged, allowMissingColumns=True).withColumn(
        "severity_rank", F.when(F.col("kind") == "flagged", rank))


def split_dismissed(flags: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Mark flagged laps the reader put away. Recorded events cannot be dismissed."""
    keys = dismissals.select(*CAR, "lap").distinct().withColumn("_away", F.lit(True))
    return flags.join(keys, [*CAR, "lap"], "left").withColumn(
        "hidden", F.coalesce("_away", F.lit(False)) & (F.col("kind") == "flagged")).drop("_away")


def restore_all(dismissals: DataFrame, cars: DataFrame) -> DataFrame:
    """Forget the dismissals of the given session-drivers only."""
    return dismissals.join(cars.select(*CAR).distinct(), CAR, "left_anti")


def position_change_net(changes: DataFrame) -> DataFrame:
    """Changes made, suffered and net per driver. Either side may be unknown."""
    made = changes.where("gained_by IS NOT NULL").select(
        "session_id", F.col("gained_by").alias("driver_id"), F.lit(1).alias("made"), F.lit(0).alias("suffered"))
    lost = changes.where("lost_by IS NOT NULL").select(
        "session_id", F.col("lost_by").alias("driver_id"), F.lit(0).alias("made"), F.lit(1).alias("suffered"))
    return made.unionByName(lost).groupBy(*CAR).agg(
        F.sum("made").alias("made"), F.sum("suffered").alias("suffered"),
        (F.sum("made") - F.sum("suffered")).alias("net"))


def change_residuals(net: DataFrame, results: DataFrame) -> DataFrame:
    """Recorded net against grid minus finish. A pit-lane start has no grid slot.

    Only sessions the change feed answered for: without one, nothing recorded is no record of nothing.
    """
    placed = results.where("grid <> 0 AND position <> 0").join(net.select("session_id").distinct(), "session_id", "left_semi")
    recorded = F.coalesce("net", F.lit(0))
    official = F.col("grid") - F.col("position")
    return placed.join(net, CAR, "left").select(
        *CAR, official.alias("official_net"), recorded.alias("recorded_net"), (recorded - official).alias("residual"))


def change_completeness(net: DataFrame, results: DataFrame) -> DataFrame:
    return change_residuals(net, results).groupBy("session_id").agg(
        F.count("*").alias("drivers"), true_median(F.abs("residual")).alias("median_abs_residual"),
        F.count_if(F.col("residual") == 0).alias("exact"))


def position_changes(changes: DataFrame, results: DataFrame, min_changes: int = MIN_CHANGES) -> DataFrame:
    """A session's position-change record, or the reason there is none."""
    counted = changes.groupBy("session_id").agg(F.count("*").alias("changes"))
    check = change_completeness(position_change_net(changes), results)
    enough = F.col("changes") >= min_changes
    return counted.join(check, "session_id", "left").select(
        "session_id", "changes", enough.alias("published"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("drivers", "median_abs_residual", "exact")],
        F.when(~enough, "too few changes: the feed did not cover the session").alias("withheld_reason"))


def lap_starts(laps: DataFrame) -> DataFrame:
    """When each lap number began: the earliest car to start it."""
    return laps.where("lap IS NOT NULL AND start_ts IS NOT NULL").groupBy("session_id", "lap").agg(
        F.min("start_ts").alias("start_ts"))


def lap_at(clips: DataFrame, starts: DataFrame) -> DataFrame:
    """The lap a moment fell in; a moment before the first start belongs to none.

    A lap counts as begun once every earlier lap has, hence the running maximum
    over one row per lap. The as-of join is a scan over both in time blocks.
    """
    in_order = Window.partitionBy("session_id").orderBy("lap").rowsBetween(Window.unboundedPreceding, 0)
    begun = starts.select("session_id", F.max("start_ts").over(in_order).alias("ts"),
                          F.lit(0).alias("_side"), F.col("lap").alias("_lap"))
    both = clips.withColumn("_side", F.lit(1)).unionByName(begun, allowMissingColumns=True)
    known = last_known(both, ["session_id"], ["ts", "_side", "_lap"], {"lap": F.col("_lap")}, time_block("ts", 6 * 3600))
    return known.where("_side = 1").drop("_side", "_lap")


def radio_timeline(clips: DataFrame, starts: DataFrame, drivers: DataFrame) -> DataFrame:
    """Clips with their lap and driver code. Links only, never text."""
    return lap_at(clips, starts).join(drivers.select(*CAR, "code"), CAR, "left")


def radio_counts(timeline: DataFrame) -> DataFrame:
    return timeline.where("driver_id IS NOT NULL").groupBy(*CAR).agg(
        F.count("*").alias("clips"), F.max("code").alias("code"))


def radio_summary(timeline: DataFrame, min_clips: int = MIN_CLIPS) -> DataFrame:
    enough = F.col("clips") >= min_clips
    return timeline.groupBy("session_id").agg(F.count("*").alias("clips"), F.count("lap").alias("placed")).select(
        "session_id", "clips", enough.alias("published"), F.when(enough, F.col("placed")).alias("with_lap"),
        F.when(~enough, "a handful of stray messages rather than a timeline").alias("withheld_reason"))


def radio_for_driver(timeline: DataFrame, drivers: list[int]) -> DataFrame:
    return timeline.where(F.col("driver_id").isin(drivers))


def trackside_summary(weather: DataFrame) -> DataFrame:
    """Medians and ranges of a session's own sensors, and the share of wet readings."""
    middle = ranked(weather, ["session_id"], {c: (c, "median") for c in ("air_c", "track_c", "humidity_pct", "wind_ms") if c in weather.columns})
    return weather.groupBy("session_id").agg(
        F.count("*").alias("samples"), F.min("air_c").alias("air_min_c"), F.max("air_c").alias("air_max_c"), F.min("track_c").alias("track_min_c"),
        F.max("track_c").alias("track_max_c"), F.count_if(F.col("rainfall") > 0).alias("wet_samples"),
        F.try_divide(F.count_if(F.col("rainfall") > 0), F.count("rainfall")).alias("wet_share")).join(
        middle, "session_id", "left")


def hours_within(sessions: DataFrame, hours: DataFrame) -> DataFrame:
    """Archive hours overlapping each session window, compared by hour.

    The window is laid out as its own hours, which makes this an equi-join. A
    window that ends before it starts falls back to its start hour.
    """
    begin, end = F.date_trunc("hour", "start_ts"), F.date_trunc("hour", "end_ts")
    wanted = sessions.select("session_id", F.explode(
        F.sequence(begin, F.greatest(begin, end), F.expr("INTERVAL 1 HOUR"))).alias("hour_ts"))
    return hours.join(wanted, ["session_id", "hour_ts"], "left_semi")


def archive_summary(hours: DataFrame) -> DataFrame:
    extra = [true_median(c).alias(f"archive_{c}") for c in ("humidity_pct", "wind_ms") if c in hours.columns]
    return hours.groupBy("session_id").agg(
        F.count("*").alias("hours"), true_median("air_c").alias("archive_air_c"),
        F.coalesce(F.sum("precip_mm"), F.lit(0.0)).alias("precip_mm"), *extra)


def weather_cross_check(trackside: DataFrame, archive: DataFrame,
                        tolerance_c: float = MAX_AIR_DISAGREEMENT_C) -> DataFrame:
    """The one quantity both sources measure. Not compared if either is missing."""
    delta = F.round(F.abs(F.col("air_c") - F.col("archive_air_c")), 9)
    return trackside.select("session_id", "air_c").join(
        archive.select("session_id", "archive_air_c"), "session_id", "left").select(
        "session_id", "air_c", "archive_air_c", delta.isNotNull().alias("compared"), delta.alias("delta_c"),
        (delta <= tolerance_c).alias("agrees"))


def session_conditions(weather: DataFrame, hours: DataFrame, min_samples: int = MIN_TRACKSIDE_SAMPLES,
                       tolerance_c: float = MAX_AIR_DISAGREEMENT_C) -> DataFrame:
    """A session's conditions, or the reason they are withheld. With too few readings there is no figure at all."""
    trackside, archive = trackside_summary(weather), archive_summary(hours)
    check = weather_cross_check(trackside, archive, tolerance_c).select("session_id", "compared", "delta_c", "agrees")
    reason = F.when(F.col("samples") < min_samples, "too few trackside readings").when(
        F.col("compared") & ~F.col("agrees"), "the two sources disagree on air temperature")
    joined = trackside.join(archive, "session_id", "left").join(check, "session_id", "left")
    figures = [k for k in joined.columns if k not in ("session_id", "samples", "hours")]
    enough = F.col("samples") >= min_samples
    return (
        joined.withColumn("withheld_reason", reason).withColumn("published", F.col("withheld_reason").isNull())
        .withColumns({k: F.when(enough, F.col(k)) for k in figures})
    )


def conditions_counts(conditions: DataFrame) -> DataFrame:
    return conditions.groupBy(F.floor(F.col("session_id") / 1000).cast("int").alias("season")).agg(
        F.count_if(F.col("published")).alias("published"), F.count_if(~F.col("published")).alias("withheld"))
