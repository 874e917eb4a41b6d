"""The race model: a field-wide fit, what it implies per driver, and pit loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintline.functions.figures import nearest_rank, true_median
from stintline.functions.lineage import materialised
from stintline.functions.ranks import ranked

CAR = ["session_id", "driver_id"]

# Fixed values of the fit and of the pit-loss rule.
NEUTRALISED_FACTOR = 1.15
MIN_FIELD = 5
SUSPENSION_FACTOR = 3.0
MIN_LAPS_PER_COMPOUND = 5
MIN_GREEN_LAPS = 20
MAX_RACING_STOP_S = 120.0
KNOWN_COMPOUNDS = ["SOFT", "MEDIUM", "HARD", "INTERMEDIATE", "WET"]
MIN_PIT_LOSS_DRIVERS = 5
MAX_SPREAD_RATIO = 0.25

# Share of a column's spread that must be left when the columns before it are
# taken out; below it tyre life and fuel load count as inseparable.
RANK_TOLERANCE = 1e-9


def neutralised_by_pace(laps: DataFrame, factor: float = NEUTRALISED_FACTOR, min_field: int = MIN_FIELD) -> DataFrame:
    """Laps whose field median is far above the median of the lap medians."""
    per_lap = laps.where("time_s > 0").groupBy("session_id", "lap").agg(
        true_median("time_s").alias("median_s"), F.count("*").alias("cars")).where(F.col("cars") >= min_field)
    green = per_lap.groupBy("session_id").agg(true_median("median_s").alias("green_s"))
    return per_lap.join(green, "session_id").where(F.col("median_s") > F.col("green_s") * factor).select("session_id", "lap", "median_s")


def suspended_sessions(laps: DataFrame, factor: float = SUSPENSION_FACTOR) -> DataFrame:
    """Sessions with a lap so long that the race was stopped, and that lap's time."""
    timed = laps.where("time_s > 0")
    middle = ranked(timed, ["session_id"], {"median_s": ("time_s", "median")})
    return timed.groupBy("session_id").agg(F.max("time_s").alias("longest_s")).join(middle, "session_id").where(
        F.col("longest_s") > F.col("median_s") * factor)


def lap_stint_index(stints: DataFrame) -> DataFrame:
    """Every covered lap with its compound, tyre life and in-/out-lap marks.

    A stint of unknown compound keeps a placeholder of its own, so two unknown
    stints are never taken for one compound.
    """
    cars = Window.partitionBy(*CAR)
    key = F.coalesce("compound", F.concat_ws("-", F.lit("UNKNOWN"), "driver_id", "stint"))
    marked = stints.withColumn("_first", F.min("start_lap").over(cars)).withColumn("_last", F.max("start_lap").over(cars))
    out_lap = (F.col("lap") == F.col("start_lap")) & (F.col("start_lap") > F.col("_first"))
    in_lap = (F.col("lap") == F.col("end_lap")) & (F.col("start_lap") < F.col("_last"))
    return marked.withColumn("lap", F.explode(F.sequence("start_lap", "end_lap"))).select(
        *CAR, "stint", "lap", key.alias("compound"), (F.col("lap") - F.col("start_lap") + 1).alias("life"),
        in_lap.alias("is_in"), out_lap.alias("is_out"))


def fit_rows(laps: DataFrame, index: DataFrame, neutralised: DataFrame, min_per_compound: int = MIN_LAPS_PER_COMPOUND,
             min_rows: int = MIN_GREEN_LAPS) -> DataFrame:
    """Green racing laps the model may be fitted to, of compounds run often enough."""
    length = laps.groupBy("session_id").agg(F.max("lap").alias("total_laps"))
    # Both sides have a row per lap: neither is broadcast, however small its files are.
    green = (
        laps.where("time_s > 0 AND lap <> 1").select(*CAR, "lap", "time_s")
        .join(index.where("NOT is_in AND NOT is_out").select(*CAR, "lap", "compound", "life").hint("merge"), [*CAR, "lap"])
        .join(neutralised.select("session_id", "lap"), ["session_id", "lap"], "left_anti")
        .join(length, "session_id")
    )
    green = materialised(green)
    counts = green.groupBy("session_id", "compound").agg(F.count("*").alias("sample_laps"))
    sizes = counts.groupBy("session_id").agg(
        F.sum("sample_laps").alias("_all"),
        F.sum(F.when(F.col("sample_laps") >= min_per_compound, F.col("sample_laps"))).alias("_kept")).where(
        (F.col("_all") >= min_rows) & (F.col("_kept") >= min_rows)).select("session_id")
    usable = counts.where(F.col("sample_laps") >= min_per_compound).join(sizes, "session_id", "left_semi")
    return green.join(usable.hint("merge"), ["session_id", "compound"]).select(
        *CAR, "lap", "compound", "life", (F.col("total_laps") - F.col("lap")).alias("remaining"), "time_s", "sample_laps")


def _driver_sums(rows: DataFrame) -> DataFrame:
    """Sums and products of a driver's laps on a compound, one row each: all the fit needs, with a map-side combine."""
    life, fuel, y = F.col("life").cast("double"), F.col("remaining").cast("double"), F.col("time_s")
    columns = {"l": life, "f": fuel, "y": y, "ll": life * life, "lf": life * fuel, "ly": life * y, "ff": fuel * fuel, "fy": fuel * y, "yy": y * y}
    return rows.groupBy(*CAR, "compound").agg(F.count("*").cast("double").alias("n"), *[F.sum(e).alias(k) for k, e in columns.items()])


def _gram(sums: DataFrame) -> DataFrame:
    """The cells of ``normal_equations`` from the sums of each driver and compound."""
    c = F.col
    reference = sums.groupBy("session_id").agg(F.min("compound").alias("_ref"))
    known = sums.join(reference, "session_id").withColumns({
        "_life": F.concat(F.lit("life:"), "compound"), "_off": F.when(c("compound") != c("_ref"), F.concat(F.lit("offset:"), "compound"))})
    life, off, fuel, y = c("_life"), c("_off"), F.lit("fuel"), F.lit("y")
    pairs = [(life, life, "ll"), (life, off, "l"), (fuel, life, "lf"), (life, y, "ly"), (off, off, "n"), (fuel, off, "f"), (off, y, "y"),
             (fuel, fuel, "ff"), (fuel, y, "fy"), (y, y, "yy")]
    cell = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), c(v).alias("v"))
    squares = known.select("session_id", F.explode(F.array(*[cell(*p) for p in pairs])).alias("e")).where("e.i IS NOT NULL AND e.j IS NOT NULL").groupBy(
        "session_id", c("e.i").alias("i"), c("e.j").alias("j")).agg(F.sum("e.v").alias("s"))
    columns = F.array(*[F.struct(i.alias("c"), c(v).alias("v")) for i, v in ((life, "l"), (off, "n"), (fuel, "f"), (y, "y"))])
    per_driver = known.select(*CAR, F.explode(columns).alias("e")).where("e.c IS NOT NULL").groupBy(*CAR, c("e.c").alias("c")).agg(F.sum("e.v").alias("s"))
    sizes = known.groupBy(*CAR).agg(F.sum("n").alias("n"))
    # A driver has one row per column (twice the compounds plus two).
    left, right = per_driver.withColumnRenamed("c", "i"), per_driver.withColumnsRenamed({"c": "j", "s": "t"})
    means = left.join(right, CAR).where("i <= j").join(sizes, CAR).groupBy("session_id", "i", "j").agg(
        F.sum(c("s") * c("t") / c("n")).alias("m"))
    return squares.join(means, ["session_id", "i", "j"], "full_outer").select(
        "session_id", "i", "j", (F.coalesce("s", F.lit(0.0)) - F.coalesce("m", F.lit(0.0))).alias("value"))


def normal_equations(rows: DataFrame) -> DataFrame:
    """Gram matrix of the fit with the driver terms projected out, one row per cell.

    A lap touches at most four columns (life and offset of its compound, fuel,
    and the lap time), so it adds at most ten products, summed by driver and
    compound first; per driver the products of the column sums are taken off. A
    session of any size reduces to its cells.
    """
    return _gram(_driver_sums(rows))


# One column p taken out of the flattened symmetric matrix g of m columns (a sweep of its pivot). When all columns but the last
# are out, the last column holds the solution, its corner the residual, and the rest the negative inverse.
_SWEEP = """
    aggregate(sequence(0, m - 2), named_struct('g', g, 'ok', true), (acc, p) -> named_struct(
        'g', if(acc.ok AND acc.g[p * (m + 1)] > {tolerance}D, transform(acc.g, (x, q) ->
            if(q div m = p, if(q % m = p, -1D / x, x / acc.g[p * (m + 1)]), if(q % m = p, x / acc.g[p * (m + 1)],
               x - acc.g[cast(q div m as int) * m + p] * acc.g[p * m + q % m] / acc.g[p * (m + 1)]))), acc.g),
        'ok', acc.ok AND acc.g[p * (m + 1)] > {tolerance}D))"""


def race_fit(rows: DataFrame, tolerance: float = RANK_TOLERANCE) -> DataFrame:
    """Field-wide least squares, one row per term; a rank-deficient session has none.

    Terms are ``life:<compound>``, ``offset:<compound>`` (none for the reference,
    the first compound) and ``fuel``. Unknown stints are compounds of their own,
    so a session's terms grow with its laps; but the two terms of a compound that
    one driver alone ran touch only that driver's laps on it, and are taken out
    there. What is left is a matrix of the shared compounds, solved by array
    expressions; the terms taken out follow from its solution.
    """
    c = F.col
    sums = materialised(_driver_sums(rows))
    used = sums.groupBy("session_id", "compound").agg(F.count("*").alias("_by"))
    reference = sums.groupBy("session_id").agg(F.min("compound").alias("_ref"))
    lone = used.join(reference, "session_id").where("_by = 1 AND compound <> _ref").select("session_id", "compound")
    shared = sums.join(lone, ["session_id", "compound"], "left_anti")
    # Of a lone compound the laps' spread about its own mean and slope is left, in fuel and in time.
    spread = {k: c(k) - c(k[0]) * c(k[1]) / c("n") for k in ("ll", "lf", "ly", "ff", "fy", "yy")}
    own = sums.join(lone, ["session_id", "compound"], "left_semi").select(
        *CAR, "compound", "n", *[(c(k) / c("n")).alias(f"_m{k}") for k in "lfy"], c("ll").alias("_raw"), *[e.alias(f"_{k}") for k, e in spread.items()])
    own = own.withColumn("_lost", c("_ll") <= tolerance * c("_raw"))
    left_ff = c("_ff") - c("_lf") * c("_lf") / c("_ll")
    moved = F.coalesce(left_ff > tolerance * c("_ff"), F.lit(False))
    left = own.where("NOT _lost").withColumns({
        "ff": F.when(moved, left_ff).otherwise(0.0), "fy": F.when(moved, c("_fy") - c("_lf") * c("_ly") / c("_ll")).otherwise(0.0),
        "yy": F.greatest(F.lit(0.0), c("_yy") - c("_ly") * c("_ly") / c("_ll"))})
    added = left.select("session_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), c(v).alias("value")) for i, j, v in (
        ("fuel", "fuel", "ff"), ("fuel", "y", "fy"), ("y", "y", "yy"))])).alias("e")).select("session_id", "e.*")
    cells = _gram(shared).unionByName(added).groupBy("session_id", "i", "j").agg(F.sum("value").alias("value"))
    # No slope of its own, or a driver seen on lone compounds only: its terms cannot be told from the driver's pace.
    ran = shared.groupBy(*CAR).agg(F.sum("n").alias("_nd"), (F.sum("y") / F.sum("n")).alias("_yd"))
    lost = own.where("_lost").select("session_id").unionByName(own.join(ran, CAR, "left_anti").select("session_id")).distinct()

    mirrored = cells.unionByName(cells.where("i <> j").select("session_id", c("j").alias("i"), c("i").alias("j"), "value"))
    last = c("i") == "y"
    scale = F.when(last, 1.0).otherwise(F.sqrt(F.greatest("value", F.lit(0.0))))
    names = cells.where("i = j").groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct(last.alias("last"), c("i").alias("c"), scale.alias("s")))).alias("names")).where(
        "forall(names, e -> e.s > 0)").join(lost, "session_id", "left_anti")
    grid = names.select("session_id", "names", F.posexplode("names").alias("a", "x")).select("session_id", "a", "x", F.posexplode("names").alias("b", "y")).select(
        "session_id", "a", "b", c("x.c").alias("i"), c("y.c").alias("j"), (c("x.s") * c("y.s")).alias("scale"))
    flat = grid.join(mirrored, ["session_id", "i", "j"], "left").groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("a", "b", (F.coalesce("value", F.lit(0.0)) / c("scale")).alias("v")))).alias("g"))
    sizes = sums.groupBy("session_id").agg(F.sum("n").cast("long").alias("green_laps"), F.count_distinct("driver_id").alias("drivers"))
    alone = lone.groupBy("session_id").agg(F.count("*").alias("_lone"))
    swept = flat.join(names, "session_id").select("session_id", "names", c("g.v").alias("g"), F.size("names").alias("m")).withColumn(
        "w", F.expr(_SWEEP.format(tolerance=tolerance))).where("w.ok").select("session_id", "names", "m", c("w.g").alias("g"))
    terms = c("m") + 2 * F.coalesce("_lone", F.lit(0))
    sigma2 = F.greatest(F.lit(0.0), F.expr("g[m * m - 1]")) / F.greatest(F.lit(1), c("green_laps") - c("drivers") - terms + 1)
    solved = materialised(swept.join(sizes, "session_id").join(alone, "session_id", "left").withColumn("sigma2", sigma2).drop("_lone"))
    told = [F.sqrt("sigma2").alias("rms_s"), "green_laps", "drivers"]
    found = solved.select("*", F.posexplode("names").alias("p", "t")).where("NOT t.last").select(
        "session_id", c("t.c").alias("term"), (F.expr("g[p * m + m - 1]") / c("t.s")).alias("value"),
        (F.sqrt(F.greatest(F.lit(0.0), -F.expr("g[p * (m + 1)]") * c("sigma2"))) / c("t.s")).alias("std_err"), *told)

    # Back to the terms taken out. Fuel is the first column; z holds a driver's mean of each shared column, in its scale.
    means = shared.select(*CAR, F.explode(F.array(
        F.struct(F.concat(F.lit("life:"), "compound").alias("c"), c("l").alias("v")), F.struct(F.concat(F.lit("offset:"), "compound").alias("c"), c("n").alias("v")),
        F.struct(F.lit("fuel").alias("c"), c("f").alias("v")))).alias("e")).groupBy(*CAR, c("e.c").alias("c")).agg(F.sum("e.v").alias("v"))
    held = means.groupBy(*CAR).agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("_x")).join(ran, CAR).join(
        own.select(*CAR).distinct(), CAR, "left_semi").join(solved, "session_id")
    z = held.withColumn("z", F.expr("transform(slice(names, 1, m - 1), e -> coalesce(_x[e.c], 0D) / _nd / e.s)"))
    total = "aggregate(sequence(0, m - 2), 0D, (s, {i}) -> s + {e})"
    facts = z.select(
        *CAR, "_nd", "_yd", "sigma2", "green_laps", "drivers", F.expr("g[m - 1] / names[0].s").alias("_fuel"), F.expr("-g[0] / names[0].s / names[0].s").alias("_vff"),
        F.expr(total.format(i="q", e="z[q] * g[q * m + m - 1]")).alias("_xb"), F.expr(total.format(i="q", e="z[q] * -g[q]") + " / names[0].s").alias("_xf"),
        F.expr(total.format(i="p", e="z[p] * " + total.format(i="q", e="z[q] * -g[p * m + q]"))).alias("_xx"))
    slope, off = c("_lf") / c("_ll"), c("_mf") - c("_ml") * c("_lf") / c("_ll")
    deviation = lambda share: F.sqrt(F.greatest(F.lit(0.0), share * c("sigma2")))
    back = own.join(facts, CAR)
    life = F.struct(F.concat(F.lit("life:"), "compound").alias("term"), (c("_ly") / c("_ll") - slope * c("_fuel")).alias("value"),
                    deviation(1 / c("_ll") + slope * slope * c("_vff")).alias("std_err"))
    offset = F.struct(F.concat(F.lit("offset:"), "compound").alias("term"),
                      (c("_my") - c("_ml") * c("_ly") / c("_ll") - c("_yd") + c("_xb") - off * c("_fuel")).alias("value"),
                      deviation(1 / c("n") + c("_ml") * c("_ml") / c("_ll") + 1 / c("_nd") + c("_xx") - 2 * off * c("_xf") + off * off * c("_vff")).alias("std_err"))
    return found.unionByName(back.select("session_id", F.explode(F.array(life, offset)).alias("t"), *told).select(
        "session_id", "t.term", "t.value", "t.std_err", "rms_s", "green_laps", "drivers"))


def base_pace(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Each driver's own pace: their mean lap less what the shared terms explain of it."""
    compounds = compound_terms(rows, fit)
    fuel = fit.where("term = 'fuel'").select("session_id", F.col("value").alias("fuel_s"))
    explained = F.col("offset_s") + F.col("rate_s") * F.col("life") + F.col("fuel_s") * F.col("remaining")
    return rows.join(compounds.hint("merge"), ["session_id", "compound"]).join(fuel, "session_id").groupBy(*CAR).agg(
        F.avg(F.col("time_s") - explained).alias("base_s"), F.first("fuel_s").alias("fuel_s"))


def compound_terms(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Offset, degradation rate and its error per fitted compound."""
    kind, name = F.split_part("term", F.lit(":"), F.lit(1)), F.split_part("term", F.lit(":"), F.lit(2))
    terms = fit.where("term <> 'fuel'").groupBy("session_id", name.alias("compound")).agg(
        F.coalesce(F.max(F.when(kind == "offset", F.col("value"))), F.lit(0.0)).alias("offset_s"),
        F.max(F.when(kind == "life", F.col("value"))).alias("rate_s"),
        F.max(F.when(kind == "life", F.col("std_err"))).alias("rate_ci_s"))
    counts = rows.select("session_id", "compound", "sample_laps").distinct()
    return terms.join(counts, ["session_id", "compound"])


def predict_laps(laps: DataFrame, index: DataFrame, compounds: DataFrame, pace: DataFrame) -> DataFrame:
    """What the fit says each covered lap should have taken green."""
    length = laps.groupBy("session_id").agg(F.max("lap").alias("total_laps"))
    return (
        laps.where("time_s > 0").select(*CAR, "lap", "time_s")
        .join(index.hint("merge"), [*CAR, "lap"]).join(compounds.select("session_id", "compound", "offset_s", "rate_s"), ["session_id", "compound"])
        .join(pace.join(length, "session_id"), CAR)
        .withColumn("predicted_s", F.col("base_s") + F.col("offset_s") + F.col("rate_s") * F.col("life")
                    + F.col("fuel_s") * (F.col("total_laps") - F.col("lap")))
        .select(*CAR, "lap", "stint", "compound", "is_in", "time_s", "predicted_s", "total_laps",
                (F.col("time_s") - F.col("predicted_s")).alias("excess_s"))
    )


def stop_losses(predicted: DataFrame, neutralised: DataFrame, max_stop_s: float = MAX_RACING_STOP_S) -> DataFrame:
    """In-lap plus out-lap excess of every racing stop. Lap to next lap is an equi-join."""
    racing = predicted.join(neutralised.select("session_id", "lap"), ["session_id", "lap"], "left_anti")
    after = racing.select(*CAR, (F.col("lap") - 1).alias("lap"), F.col("excess_s").alias("_out"))
    loss = F.col("excess_s") + F.col("_out")
    return racing.where("is_in").join(after.hint("merge"), [*CAR, "lap"]).where((loss > 0) & (loss < max_stop_s)).select(
        *CAR, "lap", loss.alias("loss_s"))


def driver_params(predicted: DataFrame, losses: DataFrame, neutralised: DataFrame, index: DataFrame,
                  compounds: DataFrame, pace: DataFrame) -> DataFrame:
    """Model parameters of the drivers who ran every lap, on fitted compounds only."""
    unfitted = index.select(*CAR, "compound").distinct().join(
        compounds.select("session_id", "compound"), ["session_id", "compound"], "left_anti").select(*CAR).distinct()
    slow = neutralised.select("session_id", "lap").withColumn("_slow", F.lit(True))
    c = F.col
    facts = predicted.join(slow, ["session_id", "lap"], "left").groupBy(*CAR).agg(
        F.count("*").alias("_ran"), F.max("total_laps").alias("total_laps"), F.sum("time_s").alias("actual_total_s"),
        F.coalesce(F.max(F.when(c("lap") == 1, c("excess_s"))), F.lit(0.0)).alias("start_loss_s"),
        F.count_if(c("_slow") & (c("lap") > 1)).alias("sc_laps"),
        F.coalesce(true_median(F.when(c("_slow") & (c("lap") > 1), c("excess_s"))), F.lit(0.0)).alias("sc_extra_s"))
    stops = losses.groupBy(*CAR).agg(
        true_median("loss_s").alias("pit_loss_s"), F.stddev_pop("loss_s").alias("pit_sigma_s"), F.count("*").alias("stops"))
    return (
        facts.where("_ran = total_laps").drop("_ran").join(unfitted, CAR, "left_anti").join(pace, CAR)
        .join(stops, CAR, "left").fillna(0.0, ["pit_loss_s", "pit_sigma_s"]).fillna(0, ["stops"])
        .withColumn("seed", F.lit(20260101) + c("total_laps"))
    )


def race_params(laps: DataFrame, stints: DataFrame, min_field: int = MIN_FIELD) -> dict[str, DataFrame]:
    """Fit, compound terms, driver parameters, strategies and the skipped sessions.

    One DAG over all sessions. The shared intermediate tables are written once.
    """
    suspended = materialised(suspended_sessions(laps))
    raced = laps.join(suspended.select("session_id"), "session_id", "left_anti")
    neutralised = materialised(neutralised_by_pace(raced, min_field=min_field))
    index = lap_stint_index(stints)
    rows = materialised(fit_rows(raced, index, neutralised))
    fit = materialised(race_fit(rows))
    compounds, pace = compound_terms(rows, fit), base_pace(rows, fit)
    predicted = materialised(predict_laps(raced, index, compounds, pace))
    params = driver_params(predicted, stop_losses(predicted, neutralised), neutralised, index, compounds, pace)
    unfit = raced.select("session_id").distinct().join(fit.select("session_id").distinct(), "session_id", "left_anti")
    skipped = suspended.select("session_id", F.lit("suspended").alias("reason"), F.col("longest_s").alias("figure")).unionByName(
        unfit.select("session_id", F.lit("fit_rank_deficient").alias("reason"), F.lit(None).cast("double").alias("figure")))
    order = Window.partitionBy(*CAR).orderBy("start_lap")
    key = F.coalesce("compound", F.concat_ws("-", F.lit("UNKNOWN"), "driver_id", "stint"))
    strategies = stints.select(*CAR, (F.row_number().over(order) - 1).alias("stint_ix"), key.alias("compound"), "laps")
    return {"fit": fit, "compounds": compounds, "drivers": params, "strategies": strategies, "neutralised": neutralised,
            "skipped": skipped}


def circuit_pit_loss(losses: DataFrame, min_drivers: int = MIN_PIT_LOSS_DRIVERS, max_spread: float = MAX_SPREAD_RATIO) -> DataFrame:
    """A circuit's pit loss where enough drivers agree, or the reason there is none.

    ``losses`` is (circuit_id, driver_id, pit_loss_s). Zero means none was measurable.
    """
    c = F.col
    stats = losses.groupBy("circuit_id").agg(
        F.count_if(c("pit_loss_s") > 0).alias("drivers"),
        *[e.alias(n) for n, e in (
            ("median_s", true_median(F.when(c("pit_loss_s") > 0, c("pit_loss_s")))),
            ("q1_s", nearest_rank("CASE WHEN pit_loss_s > 0 THEN pit_loss_s END", 0.25)),
            ("q3_s", nearest_rank("CASE WHEN pit_loss_s > 0 THEN pit_loss_s END", 0.75)),
            ("min_s", F.min(F.when(c("pit_loss_s") > 0, c("pit_loss_s")))), ("max_s", F.max(F.when(c("pit_loss_s") > 0, c("pit_loss_s")))))])
    reason = F.when(c("drivers") < min_drivers, "drivers_low").when(
        c("spread_ratio") > max_spread, "spread_high")
    enough = c("drivers") >= min_drivers
    return stats.withColumn("spread_ratio", (c("q3_s") - c("q1_s")) / c("median_s")).withColumn("withheld_reason", reason).select(
        "circuit_id", "drivers", c("withheld_reason").isNull().alias("published"), "withheld_reason",
        *[F.when(enough, c(k)).alias(k) for k in ("median_s", "q1_s", "q3_s", "min_s", "max_s", "spread_ratio")])
