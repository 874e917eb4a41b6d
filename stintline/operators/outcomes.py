"""Counterfactual strategies: validity, outcome draws, summaries and edits.

A strategy is a set of rows (scenario_id, stint_ix, compound, laps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintline.functions.figures import nearest_rank, true_median

# The minimal-standard congruential generator and the publish gate.
MODULUS = 2147483647
MULTIPLIER = 48271
MAX_REPLAY_ERROR = 0.01
BINS = 24
DRAWS = 1000


def uniform(seed: Column, k: Column) -> Column:
    """The k-th number (from 1) of the generator, straight from its index.

    state_k = seed * a^k mod m by repeated squaring: any draw can be made on any
    row, so the draws need no order and no loop.
    """
    state = F.pmod(seed.cast("long"), F.lit(MODULUS))
    state = F.when(state <= 0, state + (MODULUS - 1)).otherwise(state)
    power = MULTIPLIER
    for bit in range(31):
        factor = F.when(F.shiftright(k.cast("long"), bit).bitwiseAND(F.lit(1)) == 1, F.lit(power)).otherwise(F.lit(1))
        state = state * factor.cast("long") % MODULUS
        power = power * power % MODULUS
    return state / MODULUS


def valid_scenarios(strategies: DataFrame, params: DataFrame, compounds: DataFrame) -> DataFrame:
    """Per scenario whether it covers the race on fitted compounds, or why not.

    ``params`` is (scenario_id, session_id, total_laps, ...).
    """
    fitted = compounds.select("session_id", "compound").withColumn("_fit", F.lit(True))
    checked = strategies.join(params.select("scenario_id", "session_id", "total_laps"), "scenario_id").join(
        fitted, ["session_id", "compound"], "left").groupBy("scenario_id", "total_laps").agg(
        F.sum("laps").alias("laps"), F.count_if(F.col("_fit").isNull()).alias("unfitted"))
    reason = F.when(F.col("laps") != F.col("total_laps"), "the strategy does not cover the race").when(
        F.col("unfitted") > 0, "no degradation parameters for a compound")
    return checked.select("scenario_id", reason.isNull().alias("valid"), reason.alias("reason"))


def _stint_sums(strategies: DataFrame, params: DataFrame, compounds: DataFrame) -> DataFrame:
    """Every stint with the sums over its laps that the model is linear in.

    The frames run over one scenario's stints, a handful of rows. They come
    last, so the result is laid out by scenario and the draws group in place.
    A scenario with a stint on an unfitted compound is left out whole: a total of
    the other stints would be wrong. ``valid_scenarios`` names it and the reason.
    """
    c = F.col
    whole = Window.partitionBy("scenario_id")
    earlier = whole.orderBy("stint_ix").rowsBetween(Window.unboundedPreceding, -1)
    n = c("laps").cast("double")
    return (
        strategies.join(params, "scenario_id").join(compounds.withColumn("_fit", F.lit(1)), ["session_id", "compound"], "left")
        .withColumn("_fitted", F.count("_fit").over(whole) == F.count("*").over(whole)).where("_fitted").drop("_fit", "_fitted")
        .withColumn("stints", F.count("*").over(whole).cast("int"))
        .withColumn("before", F.coalesce(F.sum("laps").over(earlier), F.lit(0)))
        .withColumns({"life_sum": n * (n + 1) / 2, "life2_sum": n * (n + 1) * (2 * n + 1) / 6,
                      "remaining_sum": n * (c("total_laps") - c("before")) - n * (n + 1) / 2,
                      "elapsed_sum": n * c("before") + n * (n - 1) / 2})
        .withColumn("fixed_s", n * (c("base_s") + c("offset_s")) + c("quad_s") * c("life2_sum") + c("fuel_s") * c("remaining_sum")
                    - c("evolution_s") * c("elapsed_sum"))
    )


def strategy_outcomes(strategies: DataFrame, params: DataFrame, compounds: DataFrame, draws: int = DRAWS) -> DataFrame:
    """Race time per scenario and draw.

    The lap times of a stint are linear in its drawn rate, so a stint enters
    with its sums instead of its laps. Draws are laid out inside the task that
    already holds the scenario, and grouped there without another shuffle.

    ``params``: scenario_id, session_id, total_laps, base_s, fuel_s, evolution_s,
    pit_loss_s, pit_sigma_s, seed, extra_s (start, traffic and neutralised laps).
    ``compounds``: session_id, compound, offset_s, rate_s, rate_ci_s, quad_s.
    """
    c = F.col
    stints = _stint_sums(strategies, params, compounds)
    drawn = stints.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    first = c("draw") * (2 * c("stints") - 1) + c("stint_ix") + 1
    last = c("stint_ix") == c("stints") - 1
    spread = lambda u: 2.0 * u - 1.0
    rate = c("rate_s") + spread(uniform(c("seed"), first)) * c("rate_ci_s")
    stop = c("pit_loss_s") + spread(uniform(c("seed"), first + c("stints"))) * c("pit_sigma_s")
    time = c("fixed_s") + rate * c("life_sum") + F.when(last, c("extra_s")).otherwise(stop)
    return drawn.withColumn("_t", time).groupBy("scenario_id", "draw").agg(F.sum("_t").alias("total_s"))


def outcome_summary(totals: DataFrame) -> DataFrame:
    return totals.groupBy("scenario_id").agg(
        F.count("*").alias("draws"), true_median("total_s").alias("median_s"),
        *[nearest_rank("total_s", p / 100).alias(f"p{p:02d}_s") for p in (5, 10, 90, 95)])


def outcome_histogram(totals: DataFrame, actual: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins over the draws and the actual time; empty bins kept."""
    c = F.col
    limits = totals.groupBy("scenario_id").agg(F.min("total_s").alias("lo"), F.max("total_s").alias("hi")).join(
        actual.select("scenario_id", "actual_s"), "scenario_id").select(
        "scenario_id", F.least("lo", "actual_s").alias("lo"), F.greatest("hi", "actual_s").alias("hi")).withColumn(
        "span", F.when(c("hi") == c("lo"), 1.0).otherwise(c("hi") - c("lo")))
    bin_ = F.least(F.lit(bins - 1), F.floor(F.round((c("total_s") - c("lo")) / c("span") * bins, 9))).cast("int")
    counted = totals.join(limits, "scenario_id").groupBy("scenario_id", bin_.alias("bin")).agg(F.count("*").alias("draws"))
    grid = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, ["scenario_id", "bin"], "left").fillna(0, ["draws"]).select("scenario_id", "bin", "lo", "hi", "draws")


def replay_gate(totals: DataFrame, actual: DataFrame, max_error: float = MAX_REPLAY_ERROR) -> DataFrame:
    """Whether replaying the real strategy lands near enough to the real race time."""
    error = (F.col("median_s") - F.col("actual_s")) / F.col("actual_s")
    return outcome_summary(totals).join(actual.select("scenario_id", "actual_s"), "scenario_id").select(
        "scenario_id", "median_s", "actual_s", (error * 100).alias("error_pct"), (F.abs(error) < max_error).alias("validated"))


def sensitivity(strategies: DataFrame, params: DataFrame, compounds: DataFrame) -> DataFrame:
    """Race-time swing of each uncertain input moved to its ends.

    The total is linear in every input, so a swing is the input's own error
    times what multiplies it. No draw is made.
    """
    c = F.col
    stints = _stint_sums(strategies, params, compounds)
    wear = stints.where("rate_ci_s > 0").groupBy("scenario_id", c("compound").alias("input")).agg(
        F.sum(c("rate_ci_s") * c("life_sum")).alias("swing_s"))
    stops = stints.groupBy("scenario_id").agg(
        F.max("stints").alias("n"), F.max("pit_sigma_s").alias("s")).where("s > 0 AND n > 1").select(
        "scenario_id", F.lit("pit loss").alias("input"), (c("s") * (c("n") - 1)).alias("swing_s"))
    stop = F.when(c("stint_ix") == c("stints") - 1, c("extra_s")).otherwise(c("pit_loss_s"))
    base = stints.groupBy("scenario_id").agg(F.sum(c("fixed_s") + c("rate_s") * c("life_sum") + stop).alias("base_total_s"))
    return wear.unionByName(stops).join(base, "scenario_id").select(
        "scenario_id", "input", (-c("swing_s")).alias("low_s"), c("swing_s").alias("high_s"), "base_total_s")


def set_laps(strategies: DataFrame, edits: DataFrame) -> DataFrame:
    """Give stints a new length, never below one lap. ``edits`` is (scenario_id, stint_ix, new_laps)."""
    laps = F.greatest(F.lit(1), F.floor(F.coalesce("new_laps", F.lit(1))).cast("int"))
    return strategies.join(edits.withColumn("_edit", F.lit(True)), ["scenario_id", "stint_ix"], "left").select(
        "scenario_id", "stint_ix", "compound", F.when(F.col("_edit"), laps).otherwise(F.col("laps")).alias("laps"))


def strategy_variants(strategies: DataFrame, compounds: list[str]) -> DataFrame:
    """Every one-edit neighbour that keeps the race length, as (scenario_id, edit, ...).

    ``add`` splits the longest stint, ``remove:i`` hands stint i to its
    neighbour, ``set:i:COMPOUND`` changes one compound. Each scenario carries its
    own few stints as an array, so nothing is joined.
    """
    c = F.col
    packed = strategies.groupBy("scenario_id").agg(
        F.array_sort(F.collect_list(F.struct("stint_ix", "compound", "laps"))).alias("s")).withColumn("n", F.size("s"))
    longest = F.array_max(F.transform("s", lambda x: F.struct(x["laps"].alias("l"), (-x["stint_ix"]).alias("i"))))
    half = F.floor(c("_l") / 2).cast("int")
    added = packed.withColumn("_l", longest["l"]).withColumn("_i", -longest["i"]).where("_l >= 2").select(
        "scenario_id", F.lit("add").alias("edit"), F.explode("s").alias("x"), "_l", "_i").withColumn(
        "part", F.explode(F.when(c("x.stint_ix") == c("_i"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "scenario_id", "edit", (c("x.stint_ix") + (c("x.stint_ix") > c("_i")).cast("int") + c("part")).alias("stint_ix"),
        c("x.compound").alias("compound"),
        F.when(c("x.stint_ix") != c("_i"), c("x.laps")).when(c("part") == 0, half).otherwise(c("_l") - half).alias("laps"))
    position = c("x.stint_ix") - (c("x.stint_ix") > c("gone.stint_ix")).cast("int")
    removed = packed.where("n > 1").select("scenario_id", "n", "s", F.explode("s").alias("gone")).select(
        "scenario_id", "n", "gone", F.explode("s").alias("x")).where("x.stint_ix <> gone.stint_ix").select(
        "scenario_id", F.concat(F.lit("remove:"), c("gone.stint_ix")).alias("edit"), position.alias("stint_ix"),
        c("x.compound").alias("compound"),
        (c("x.laps") + F.when(position == F.least(c("gone.stint_ix"), c("n") - 2), c("gone.laps")).otherwise(0)).alias("laps"))
    options = F.explode(F.array(*map(F.lit, compounds)))
    changed = packed.select("scenario_id", "s", F.explode("s").alias("at")).withColumn("to", options).where("to <> at.compound").select(
        "scenario_id", F.concat_ws(":", F.lit("set"), c("at.stint_ix"), "to").alias("edit"), "at", "to", F.explode("s").alias("x")).select(
        "scenario_id", "edit", c("x.stint_ix").alias("stint_ix"),
        F.when(c("x.stint_ix") == c("at.stint_ix"), c("to")).otherwise(c("x.compound")).alias("compound"), c("x.laps").alias("laps"))
    return added.unionByName(removed).unionByName(changed)
