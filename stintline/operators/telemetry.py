"""From raw position and car samples to lines on a fixed distance grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintline.functions.lineage import materialised
from stintline.functions.scans import known_around, last_known

CAR = ["session_id", "driver_id"]

# Fixed values of the line format and the capture rules.
SPACING_M = 2.0
LINE_SCALE = {"x": 10, "y": 10, "z": 10, "speed": 10, "throttle": 1, "brake": 1, "gear": 1}
CHANNELS = list(LINE_SCALE)
WINDOW_PAD_S = 1.5
MIN_LINE_SAMPLES = 120
MIN_MOVING_SAMPLES = 20
SCALE_MIN_SPEED_KPH = 50.0
MIN_ELEVATION_RANGE_M = 3.0
OUTLINE_POINTS = 1200
LINES_PER_SESSION = 4

SAMPLE_BLOCK_S = 1024
JOIN_BUCKET_S = 120


def _time_block() -> Column:
    return F.floor(F.col("t") / SAMPLE_BLOCK_S)


def fastest_laps(laps: DataFrame) -> DataFrame:
    """Each driver's fastest timed lap that is not an out-lap; the earliest wins a tie."""
    usable = laps.where("NOT is_pit_out AND time_s > 0 AND start_ts IS NOT NULL")
    return usable.groupBy(*CAR).agg(F.min(F.struct("time_s", "lap", "start_ts")).alias("b")).select(
        *CAR, F.col("b.lap").alias("lap"), F.col("b.time_s").alias("time_s"), F.col("b.start_ts").alias("start_ts"))


def top_n_laps(fastest: DataFrame, n: int = LINES_PER_SESSION) -> DataFrame:
    """The n fastest drivers of a session, over one row per driver."""
    order = Window.partitionBy("session_id").orderBy("time_s", "driver_id")
    return fastest.withColumn("pace_rank", F.row_number().over(order)).where(F.col("pace_rank") <= n)


def _seconds(c) -> Column:
    return F.make_dt_interval(secs=F.col(c) if isinstance(c, str) else F.lit(c))


def lap_window(laps: DataFrame, pad_s: float = WINDOW_PAD_S) -> DataFrame:
    timed = laps.where("time_s > 0 AND start_ts IS NOT NULL")
    pad = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(pad_s))
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("time_s"))
    return timed.select(*CAR, "lap", (F.col("start_ts") - pad).alias("begin_ts"),
                        (F.col("start_ts") + length + pad).alias("end_ts"))


def samples_in_lap(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples strictly inside a lap window.

    A range join made an equi-join: the window is offered in the few time
    buckets it touches, so one car's samples spread over many keys.
    """
    def bucket(c: str) -> Column:
        return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / JOIN_BUCKET_S)

    offered = windows.withColumn("_bucket", F.explode(F.sequence(bucket("begin_ts"), bucket("end_ts"))))
    return (
        samples.withColumn("_bucket", bucket("ts")).join(offered, [*CAR, "_bucket"])
        .where("ts > begin_ts AND ts < end_ts").drop("_bucket", "begin_ts", "end_ts")
    )


def window_honoured(samples: DataFrame, laps: DataFrame, pad_s: float = WINDOW_PAD_S) -> DataFrame:
    """Whether the samples returned for a lap span no more than twice what was asked for."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = samples.groupBy(*CAR, "lap").agg(((F.max(micros) - F.min(micros)) / 1e6).alias("span_s"))
    allowed = 2 * (F.col("time_s") + 4 * pad_s)
    return span.join(laps.where("time_s > 0").select(*CAR, "lap", "time_s"), [*CAR, "lap"]).select(
        *CAR, "lap", F.col("span_s"), allowed.alias("allowed_s"), (F.col("span_s") <= allowed).alias("honoured"))


def align_channels(pos: DataFrame, car: DataFrame, steps: bool = False) -> DataFrame:
    """Car channels on the position clock.

    Speed and throttle are linear between their neighbours and held at the ends;
    gear and brake keep the previous car sample. Both clocks are merged into one
    ordered scan, so no sample is compared with any but its neighbours. With
    ``steps`` the same scan also tells the raw distance and the time since the
    position sample before.
    """
    c = F.col
    ours = lambda e: F.when(c("_side") == 0, e)
    timed = lambda name: F.when((c("_side") == 0) & c(name).isNotNull(), F.struct("t", c(name).alias("v")))
    clock = ours(c("t"))
    first = F.struct(F.min(clock).alias("t"), *[F.min_by(k, clock).alias(k) for k in ("gear", "brake")])
    both = car.withColumn("_side", F.lit(0)).unionByName(
        pos.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    near = known_around(
        both, ["lap_key"], ["t", "_side"], _time_block(),
        back={"_sp": timed("speed"), "_tp": timed("throttle"), "_row": ours(F.struct("gear", "brake"))},
        ahead={"_sn": timed("speed"), "_tn": timed("throttle")},
        before={"_before": F.when(c("_side") == 1, F.struct("t", "x", "y"))} if steps else None,
        whole={"_ns": (F.count(ours(c("speed"))), F.sum), "_nt": (F.count(ours(c("throttle"))), F.sum),
               "_first": (F.when(F.count(clock) > 0, first), F.min),
               "_flat": (F.count_if((c("_side") == 1) & c("z").isNull()), F.sum)}, place="t").where("_side = 1")

    def linear(before: str, after: str, count: str) -> Column:
        a, b = c(before), c(after)
        slope = F.try_divide(b["v"] - a["v"], b["t"] - a["t"])
        value = (F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == c("t")), a["v"])
                 .otherwise(a["v"] + slope * (c("t") - a["t"])))
        return F.when(c(count) >= 2, value)

    held = lambda name: F.when(c("_first").isNotNull(), F.coalesce(
        F.when(c("_row").isNotNull(), c("_row")[name]).otherwise(c("_first")[name]).cast("double"), F.lit(0.0)))
    return near.select(
        "lap_key", "t", "x", "y", F.when(c("_flat") == 0, c("z")).alias("z"),
        linear("_sp", "_sn", "_ns").alias("speed"), linear("_tp", "_tn", "_nt").alias("throttle"),
        F.when(held("brake") > 0, 1.0).when(held("brake").isNotNull(), 0.0).alias("brake"), held("gear").alias("gear"),
        *(_since() if steps else []))


def _since() -> list[Column]:
    """The raw distance and the time since the sample in ``_before``."""
    c = F.col
    return [F.hypot(c("x") - c("_before.x"), c("y") - c("_before.y")).alias("step"), (c("t") - c("_before.t")).alias("dt")]


def _with_step(aligned: DataFrame) -> DataFrame:
    """Each sample with the raw distance and the time since the one before, unless it comes with them."""
    if "step" in aligned.columns:
        return aligned
    before = last_known(aligned, ["lap_key"], ["t"], {"_before": F.struct("t", "x", "y")}, _time_block(),
                        inclusive=False, place="t")
    return before.select(*aligned.columns, *_since())


def position_scale(aligned: DataFrame, min_samples: int = MIN_LINE_SAMPLES, min_moving: int = MIN_MOVING_SAMPLES,
                   min_speed: float = SCALE_MIN_SPEED_KPH) -> DataFrame:
    """Raw position units per metre: path length over integrated speed, while moving."""
    moving = (F.col("speed") >= min_speed) & F.col("dt").isNotNull()
    sums = _with_step(aligned).groupBy("lap_key").agg(
        F.count("*").alias("samples"), F.count_if(moving).alias("moving"),
        F.sum(F.when(moving, F.col("speed") / 3.6 * F.col("dt"))).alias("metres"),
        F.sum(F.when(moving, F.col("step"))).alias("raw"))
    good = (F.col("samples") >= min_samples) & (F.col("moving") >= min_moving) & (F.col("metres") > 0) & (F.col("raw") > 0)
    return sums.where(good).select("lap_key", (F.col("raw") / F.col("metres")).alias("units_per_metre"),
                                   F.col("moving").alias("sample_size"))


def session_scale(scales: DataFrame, picked: DataFrame) -> DataFrame:
    """One scale per session: the first driver in pace order that yields one."""
    return picked.join(scales, "lap_key").groupBy("session_id").agg(
        F.min(F.struct("pace_rank", "units_per_metre", "sample_size")).alias("s")).select(
        "session_id", F.col("s.units_per_metre").alias("units_per_metre"), F.col("s.sample_size").alias("sample_size"),
        F.col("s.pace_rank").alias("measured_on"))


def capture_report(aligned: DataFrame, scales: DataFrame, min_samples: int = MIN_LINE_SAMPLES) -> DataFrame:
    """Why a lap gave no line, with the counts that decided it. ``scales`` is per lap."""
    counted = _with_step(aligned).groupBy("lap_key").agg(
        F.count("*").alias("samples"), (F.count_if(F.col("step") > 0) + 1).alias("advancing"))
    reason = (
        F.when(F.col("samples") < min_samples, "too few position samples")
        .when(F.col("units_per_metre").isNull(), "no measured position unit")
        .when(F.col("advancing") < min_samples, "the feed repeated the same coordinates")
    )
    return counted.join(scales.select("lap_key", "units_per_metre"), "lap_key", "left").select(
        "lap_key", "samples", "advancing", reason.alias("reason"))


def _advanced(aligned: DataFrame) -> DataFrame:
    return _with_step(aligned).where("step IS NULL OR step > 0")


def driven_laps(aligned: DataFrame, scales: DataFrame, min_samples: int = MIN_LINE_SAMPLES) -> DataFrame:
    """The laps that ``driven_distance`` keeps: a unit, and samples enough that advanced."""
    counted = _advanced(aligned).groupBy("lap_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_samples)
    return counted.select("lap_key").join(scales.select("lap_key"), "lap_key", "left_semi")


def driven_distance(aligned: DataFrame, scales: DataFrame, min_samples: int = MIN_LINE_SAMPLES, told: tuple[str, ...] = ()) -> DataFrame:
    """Samples that advanced, in metres, with the distance driven so far.

    The unit and what was driven before meet the samples as one row per lap and
    block, so the samples are laid out once. ``told`` are further columns of
    ``scales`` to keep; with any, the block of a sample stays too, for a scan
    that goes on from this layout.
    """
    c, unit = F.col, F.col("units_per_metre")
    stepped = aligned if "step" in aligned.columns else materialised(_with_step(aligned))
    advanced = _advanced(stepped).withColumn("_block", _time_block())
    blocks = Window.partitionBy("lap_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    facts = (
        advanced.groupBy("lap_key", "_block").agg(F.count("*").alias("_n"), F.sum("step").alias("_t"))
        .withColumn("_n", F.sum("_n").over(Window.partitionBy("lap_key")))
        .withColumn("_carry", F.coalesce(F.sum("_t").over(blocks), F.lit(0.0))).where(c("_n") >= min_samples)
        .join(scales.select("lap_key", "units_per_metre", *told), "lap_key").drop("_n", "_t")
    )
    inside = Window.partitionBy("lap_key", "_block").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    driven = (c("_carry") + F.coalesce(F.sum("step").over(inside), F.lit(0.0))) / unit
    out = advanced.join(facts, ["lap_key", "_block"]).withColumn("distance_m", driven).withColumns({k: c(k) / unit for k in "xyz"})
    return out.drop("step", "dt", "_carry", "units_per_metre", *([] if told else ["_block"]))


def resample_by_distance(driven: DataFrame, spacing_m: float = SPACING_M) -> DataFrame:
    """Every channel on a fixed distance grid.

    Each sample owns the grid points between its predecessor and itself and
    interpolates them from the two; the first sample owns point 0. No join.
    """
    channels = [c for c in CHANNELS if c in driven.columns]
    block = F.col("_block") if "_block" in driven.columns else F.floor(F.col("distance_m") / 8192)
    before = last_known(driven, ["lap_key"], ["distance_m"], {"_p": F.struct("distance_m", *channels)}, block, inclusive=False, place="distance_m")
    first = F.when(F.col("_p").isNull(), F.array(F.lit(0).cast("long")))
    low = F.floor(F.col("_p.distance_m") / spacing_m) + 1
    high = F.floor(F.col("distance_m") / spacing_m)
    points = before.withColumn("idx", F.explode(F.coalesce(first, F.when(low <= high, F.sequence(low, high)))))
    share = (F.col("idx") * spacing_m - F.col("_p.distance_m")) / (F.col("distance_m") - F.col("_p.distance_m"))
    return points.select("lap_key", F.col("idx").cast("int").alias("idx"), *[
        F.when(F.col("_p").isNull(), F.col(c)).otherwise(
            F.col(f"_p.{c}") + (F.col(c) - F.col(f"_p.{c}")) * share).alias(c) for c in channels])


def rotate_xy(samples: DataFrame, degrees: float) -> DataFrame:
    a = F.radians(F.lit(float(degrees)))
    return samples.withColumns({
        "x": F.col("x") * F.cos(a) - F.col("y") * F.sin(a), "y": F.col("x") * F.sin(a) + F.col("y") * F.cos(a)})


def with_length(line: DataFrame) -> DataFrame:
    """Samples with the length of their lap."""
    return line.join(line.groupBy("lap_key").agg(F.count("*").cast("int").alias("n")), "lap_key")


def circuit_outline(line: DataFrame, max_points: int = OUTLINE_POINTS) -> DataFrame:
    """Every k-th point of a driven lap, to a decimetre."""
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / max_points))
    return with_length(line).where(F.col("idx") % step == 0).select(
        "lap_key", "idx", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


def outline_source(laps: DataFrame) -> DataFrame:
    """The lap a circuit is drawn from: qualifying before the race, then the fastest."""
    rank = F.when(F.col("session") == "Q", 0).otherwise(1)
    return laps.groupBy("circuit_id").agg(F.min(F.struct(rank.alias("r"), "time_s", "lap_key", "session")).alias("m")).select(
        "circuit_id", F.col("m.lap_key").alias("lap_key"), F.col("m.session").alias("session"))


def elevation_verdict(line: DataFrame, min_range_m: float = MIN_ELEVATION_RANGE_M) -> DataFrame:
    """Whether a lap's z varies enough to be a profile, and the range it was judged on."""
    z = F.when(~F.isnan("z"), F.col("z"))
    facts = line.groupBy("lap_key").agg(
        F.count("z").alias("present"), F.count(z).alias("finite"), F.min(z).alias("lo"), F.max(z).alias("hi"))
    span = F.col("hi") - F.col("lo")
    reason = (
        F.when(F.col("present") == 0, "no elevation published").when(F.col("finite") < 2, "the elevation channel is empty")
        .when(span < min_range_m, "the elevation channel does not vary enough")
    )
    return facts.withColumn("reason", reason).select(
        "lap_key", F.col("reason").isNull().alias("usable"),
        F.when(F.col("finite") >= 2, F.round(span, 2)).alias("range_m"),
        F.when(F.col("reason").isNull(), F.round("lo", 2)).alias("min_m"),
        F.when(F.col("reason").isNull(), F.round("hi", 2)).alias("max_m"), "reason")


CELL_M = 25.0
COARSER = 8


def nearest_sample_corners(corners: DataFrame, samples: DataFrame, reach: int = 20, cell_m: float = CELL_M) -> DataFrame:
    """Published corners on the lap: apex, entry and minimum speed, gear, first braking.

    A corner meets the samples of its own grid cell and the eight around it; its nearest sample is found if it is no farther
    than one cell. What is left tries cells ``COARSER`` times as wide, and only a corner off those too meets its whole lap.
    """
    apart = F.hypot(F.col("x") - F.col("corner_x"), F.col("y") - F.col("corner_y"))
    places, wanted, found = samples.select("lap_key", "idx", "x", "y"), corners.select("lap_key", "number", "corner_x", "corner_y"), None
    for size in (cell_m, cell_m * COARSER, None):
        if size:
            cells = [F.floor(F.col("x") / size).alias("_cx"), F.floor(F.col("y") / size).alias("_cy")]
            around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j))))"))
            asked = wanted.withColumn("_o", around).select("*", (F.floor(F.col("corner_x") / size) + F.col("_o.i")).alias("_cx"), (F.floor(F.col("corner_y") / size) + F.col("_o.j")).alias("_cy"))
            met = places.select("*", *cells).join(asked, ["lap_key", "_cx", "_cy"])
        else:
            met = places.join(wanted, "lap_key")
        best = met.groupBy("lap_key", "number").agg(F.min(F.struct(F.round(apart, 6).alias("d"), "idx")).alias("m"))
        sure = best.where(F.col("m.d") < size) if size else best
        sure = sure.select("lap_key", "number", F.col("m.idx").alias("apex_idx"))
        found = sure if found is None else found.unionByName(sure)
        wanted = wanted.join(sure, ["lap_key", "number"], "left_anti")
    nearest = found
    around = nearest.withColumn("idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("apex_idx") - reach),
                                                            F.col("apex_idx") + reach - 1)))
    braking = F.when(F.col("brake") > 0, F.struct("idx", "distance_m"))
    at_apex = F.col("idx") == F.col("apex_idx")
    return around.join(samples, ["lap_key", "idx"]).groupBy("lap_key", "number", "apex_idx").agg(
        F.min_by("speed", "idx").alias("entry_speed_kph"), F.min("speed").alias("min_speed_kph"),
        F.max(F.when(at_apex, F.col("distance_m"))).alias("apex_distance_m"),
        F.max(F.when(at_apex, F.col("gear"))).alias("gear"), F.min(braking).getField("distance_m").alias("braking_point_m"))


def quantise_lines(line: DataFrame) -> DataFrame:
    """Scale, round half to even, and clip to 16 bits. Never wraps."""
    def short(c: str) -> Column:
        return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(F.col(c) * LINE_SCALE[c]))).cast("short").alias(c)

    return line.select("lap_key", "idx", *[short(c) for c in CHANNELS if c in line.columns])


def dequantise_lines(stored: DataFrame, scale: dict[str, float] | None = None) -> DataFrame:
    """Divide by the scale stored with the lines; a channel without one keeps its value."""
    scale = LINE_SCALE if scale is None else scale
    return stored.select("lap_key", "idx", *[
        (F.col(c) / float(scale.get(c, 1))).alias(c) for c in CHANNELS if c in stored.columns])


def line_manifest(line: DataFrame) -> DataFrame:
    """Per lap how many points each channel has and which channels it carries."""
    channels = [c for c in CHANNELS if c in line.columns]
    counts = line.groupBy("lap_key").agg(F.count("*").alias("points"), *[F.count(c).alias(f"_{c}") for c in channels])
    listed = F.concat_ws(",", *[F.when(F.col(f"_{c}") > 0, F.lit(c)) for c in channels])
    return counts.select("lap_key", "points", listed.alias("channels"))


def unavailable_lines(attempts: DataFrame, lines: DataFrame) -> DataFrame:
    """Sessions tried with nothing usable, a row per driver with the reason."""
    worked = lines.select("session_id").distinct()
    return attempts.join(worked, "session_id", "left_anti").select(*CAR, "reason")


def telemetry_index(manifests: DataFrame, attempts: DataFrame, elevation: DataFrame) -> DataFrame:
    """Which sessions have lines, for which drivers, and whether elevation is usable."""
    tried = attempts.select("session_id").distinct()
    listed = manifests.join(elevation.select("lap_key", "usable"), "lap_key", "left").groupBy("session_id").agg(
        F.count("*").alias("n_drivers"), F.array_join(F.sort_array(F.collect_set(F.col("driver_id").cast("string"))), ",").alias("drivers"),
        F.coalesce(F.max_by("usable", -F.col("lap_key")), F.lit(False)).alias("elevation_usable"))
    return tried.join(listed, "session_id", "full_outer").select(
        "session_id", F.coalesce("n_drivers", F.lit(0)).alias("n_drivers"), F.coalesce("drivers", F.lit("")).alias("drivers"),
        F.col("n_drivers").isNull().alias("unavailable"), "elevation_usable")


def lap_extent(line: DataFrame) -> DataFrame:
    """Bounding box and spans; a sample missing any coordinate is dropped."""
    whole = line.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x + y + z)")
    box = whole.groupBy("lap_key").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return box.withColumns({f"span_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"})
