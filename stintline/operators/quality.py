"""Gates over derived tables. Each returns the violating rows; empty means pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.functions.figures import same_number
from stintline.operators import model as mdl
from stintline.operators import outcomes as out
from stintline.operators import record as rec
from stintline.operators import season as sn
from stintline.operators import telemetry as tel
from stintline.operators import weekend as wk


def _errors(df: DataFrame, keys: list[str], checks: dict) -> DataFrame:
    """One row per failed check: ``checks`` maps a message to its failing condition."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for text, cond in checks.items()]))
    return df.select(*keys, F.explode(found).alias("error"))


def check_standings(computed: DataFrame, official: DataFrame) -> DataFrame:
    """A mismatch fails, and so does a season the cross-check never ran for."""
    checked = official.select("season").distinct()
    ran = sn.standings_cross_check(computed.join(checked, "season", "left_semi"), official)
    skipped = computed.select("season").distinct().join(checked, "season", "left_anti")
    return ran.select("season", "driver_id", F.col("reason").alias("error")).unionByName(
        skipped.select("season", F.lit(None).cast("int").alias("driver_id"),
                       F.lit("cross-check did not run").alias("error")))


def check_brief(brief: DataFrame, editions: DataFrame, keys: list[str]) -> DataFrame:
    """The brief's arithmetic against its own per-edition rows."""
    own = editions.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum("classified").alias("_c"), F.sum("starters").alias("_s"),
        F.count_if(F.col("classified") > F.col("starters")).alias("_bad"))
    return _errors(brief.join(own, keys), keys, {
        "edition count": F.col("editions") != F.col("_n"),
        "finish rate does not sum": (F.col("classified") != F.col("_c")) | (F.col("starters") != F.col("_s")),
        "more finishers than starters": F.col("_bad") > 0,
        "sample exceeds classified finishes": F.col("places_n") > F.col("_c"),
    })


def check_sprint(document: DataFrame, weekend: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every figure of the sprint document recomputed from its own driver rows."""
    keys = ["season", "round"]
    flags = wk.classified("sprint_status"), wk.classified("race_status")
    wrong_flags = weekend.groupBy(*keys).agg(F.count_if(
        (F.col("sprint_classified") != flags[0]) | (F.col("race_classified") != flags[1])).alias("_flags"))
    own = wk.sprint_round(weekend).select(*keys, *[F.col(c).alias(f"_{c}") for c in (
        "sprint_mean_places", "race_mean_places", "sprint_sample", "race_sample", "rho", "n")])
    listed = calendar.select(*keys, F.col("sprint").alias("_sprint"))
    joined = document.join(own, keys, "left").join(wrong_flags, keys, "left").join(listed, keys, "left")
    rounds = _errors(joined, keys, {
        "round is not on the calendar": F.col("_sprint").isNull(),
        "calendar does not flag a sprint": ~F.col("_sprint"),
        "classification disagrees with the status": F.col("_flags") > 0,
        "sprint movement": ~same_number("sprint_mean_places", "_sprint_mean_places"),
        "race movement": ~same_number("race_mean_places", "_race_mean_places"),
        "sprint sample": F.col("sprint_sample") != F.col("_sprint_sample"),
        "race sample": F.col("race_sample") != F.col("_race_sample"),
        "rank agreement": ~same_number("rho", "_rho"),
        "rank agreement sample": F.col("n") != F.col("_n"),
        "withheld without a reason": F.col("_rho").isNull() & F.col("withheld_reason").isNull(),
    })
    statuses = weekend.select("season", F.explode(F.array("sprint_status", "race_status")).alias("status"))
    unseen = wk.unrecognised_statuses(statuses).select(
        "season", F.lit(None).cast("int").alias("round"), F.concat(F.lit("unseen status "), F.col("status")).alias("error"))
    return rounds.unionByName(unseen)


def check_sprint_season(published: DataFrame, rounds: DataFrame) -> DataFrame:
    figures = ["median_rho", "sprint_mean_places", "race_mean_places"]
    own = wk.sprint_season(rounds).select("season", *[F.col(c).alias(f"_{c}") for c in figures])
    return _errors(published.join(own, "season"), ["season"],
                   {f"season {c}": ~same_number(c, f"_{c}") for c in figures})


def check_sprint_points(points: DataFrame, table: DataFrame) -> DataFrame:
    """Points from sprint weekends must fit inside the season's total."""
    joined = points.join(table.select("season", "driver_id", F.col("points").alias("_total")),
                         ["season", "driver_id"], "left")
    return _errors(joined, ["season", "driver_id"], {
        "not in the standings": F.col("_total").isNull(),
        "more points than the season": F.col("weekend_points") > F.col("_total") + 1e-9,
    })


def check_conditions(conditions: DataFrame, tolerance_c: float = rec.MAX_AIR_DISAGREEMENT_C) -> DataFrame:
    """Published conditions against the check their own summaries give."""
    delta = F.abs(F.col("air_c") - F.col("archive_air_c"))
    return _errors(conditions, ["session_id"], {
        "withheld without a reason": ~F.col("published") & F.col("withheld_reason").isNull(),
        "compared flag": F.col("published") & (F.col("compared") != delta.isNotNull()),
        "gap between the sources": F.col("published") & F.col("compared") & ~same_number("delta_c", delta),
        "published although the sources disagree": F.col("published") & (delta > tolerance_c + 1e-9),
    })


def check_changes(net: DataFrame, residuals: DataFrame) -> DataFrame:
    """Changes made equal changes suffered; every net and residual adds up."""
    balance = _errors(
        net.groupBy("session_id").agg(F.sum("made").alias("m"), F.sum("suffered").alias("s")),
        ["session_id"], {"made and suffered differ": F.col("m") != F.col("s")})
    rows = _errors(net, ["session_id", "driver_id"], {
        "net is not made minus suffered": F.col("net") != F.col("made") - F.col("suffered")})
    checks = _errors(residuals, ["session_id", "driver_id"], {
        "residual is not recorded minus official": F.col("residual") != F.col("recorded_net") - F.col("official_net")})
    return balance.withColumn("driver_id", F.lit(None).cast("int")).unionByName(rows).unionByName(checks)


# Columns that would mean audio had been turned into text.
FORBIDDEN_RADIO_FIELDS = ["transcript", "text", "message", "content", "summary", "sentiment", "tone", "audio", "clip"]


def check_radio(timeline: DataFrame) -> DataFrame:
    """No text-bearing column, and a link for every clip."""
    carried = [c for c in FORBIDDEN_RADIO_FIELDS if c in timeline.columns]
    checks = {"clip without a link": F.coalesce("link", F.lit("")) == ""}
    checks.update({f"carries a '{c}' column": F.lit(True) for c in carried})
    return _errors(timeline, ["session_id", "clip_id"], checks)


def check_line_counts(manifest: DataFrame, line: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Declared points and channels against the stored rows, both ways."""
    own = tel.line_manifest(line).select("lap_key", F.col("points").alias("_points"), F.col("channels").alias("_channels"))
    joined = manifest.join(own, "lap_key", "full_outer").join(
        unavailable.select("lap_key").withColumn("_refused", F.lit(True)), "lap_key", "left")
    return _errors(joined, ["lap_key"], {
        "declares no channels": F.col("channels") == "",
        "listed but not stored": F.col("_points").isNull(),
        "stored but not listed": F.col("points").isNull(),
        "point count": F.col("points") != F.col("_points"),
        "channel list": F.col("channels") != F.col("_channels"),
        "unavailable lap has a line": F.coalesce("_refused", F.lit(False)) & F.col("_points").isNotNull(),
    })


# Fixed value: the two sources agree to the millisecond on every lap of record.
QUALIFYING_TOLERANCE_S = 0.01


def check_qualifying_sources(traced: DataFrame, qualifying: DataFrame,
                             tolerance_s: float = QUALIFYING_TOLERANCE_S) -> DataFrame:
    """The traced lap against the driver's best official qualifying time."""
    official = qualifying.select("session_id", "driver_id", F.least("q1_s", "q2_s", "q3_s").alias("official_s"))
    drift = F.round(F.abs(F.col("time_s") - F.col("official_s")), 6)
    return traced.join(official, ["session_id", "driver_id"]).where(drift > tolerance_s).select(
        "session_id", "driver_id", "time_s", "official_s", drift.alias("drift_s"))


def stale_survey(stored: DataFrame, fresh: DataFrame, keys: list[str], ignore: tuple[str, ...] = ("generated_at",)) -> DataFrame:
    """Laps a new survey would gain, lose or change, whatever the time stamp says."""
    columns = [c for c in stored.columns if c not in keys and c not in ignore]
    old = stored.select(*keys, F.struct(*columns).alias("_old"))
    new = fresh.select(*keys, F.struct(*columns).alias("_new"))
    state = F.when(F.col("_old").isNull(), "gained").when(F.col("_new").isNull(), "lost").when(
        ~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return old.join(new, keys, "full_outer").select(*keys, state.alias("change")).where("change IS NOT NULL")


def check_replay(gate: DataFrame, totals: DataFrame, max_error: float = out.MAX_REPLAY_ERROR) -> DataFrame:
    """Every scenario marked validated, replayed again from its parameters."""
    again = out.replay_gate(totals, gate, max_error).select(
        "scenario_id", F.col("median_s").alias("replayed_s"), F.col("validated").alias("_ok"))
    return gate.where("validated").join(again, "scenario_id", "left").where(~F.coalesce("_ok", F.lit(False))).select(
        "scenario_id", "actual_s", "replayed_s")


def check_pit_loss(published: DataFrame, losses: DataFrame, **limits) -> DataFrame:
    """The published circuit figures against the driver losses they came from."""
    own = mdl.circuit_pit_loss(losses, **limits).select("circuit_id", *[
        F.col(c).alias(f"_{c}") for c in ("published", "median_s", "q1_s", "q3_s", "drivers")])
    both = F.col("published") & F.col("_published")
    return _errors(published.join(own, "circuit_id", "left"), ["circuit_id"], {
        "nothing measured it": F.col("_published").isNull(),
        "published flag": F.col("published") != F.col("_published"),
        **{c: both & ~same_number(c, f"_{c}") for c in ("median_s", "q1_s", "q3_s", "drivers")},
        "withheld without a reason": ~F.col("published") & F.col("withheld_reason").isNull(),
    })


def refusal_ledger(groups: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Every withheld figure of every module, counted beside what was published.

    Each group is its rule and a table (season, scope, published, reason, figure): a row per figure, where it was withheld with
    the code of the reason and the number that decided it. Rows of three levels come from one grouping: ``module`` with the counts
    of a module and season, ``reason`` with those of a reason, and ``entry`` for each withheld figure. Published figures are
    counted map-side and never listed.
    """
    c = F.col
    tables = [df.select(F.lit(name).alias("module"), F.lit(rule).alias("rule"), "season", "published", *[
        F.when(~c("published"), c(k).cast(kind)).alias(k) for k, kind in (("scope", "string"), ("reason", "string"), ("figure", "double"))])
        for name, (rule, df) in groups.items()]
    merged = tables[0]
    for more in tables[1:]:
        merged = merged.unionByName(more)
    by = [c("module"), c("rule"), c("season")]
    sets = merged.groupingSets([by, [*by, c("reason")], [*by, c("reason"), c("scope"), c("figure")]], *by, c("reason"), c("scope"), c("figure"))
    level = F.when(F.grouping("reason") == 1, "module").when(F.grouping("scope") == 1, "reason").otherwise("entry")
    told = sets.agg(level.alias("level"), F.count_if("published").alias("published"), F.count_if(~c("published")).alias("refused"))
    return told.where("level = 'module' or refused > 0").select("level", "module", "rule", "season", "reason", "scope", "figure", "published", "refused")
