"""Which rounds are due, next or stale, and which feed session belongs to a round."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUND = ["season", "round"]


def rounds_due(calendar: DataFrame, as_of: datetime.date) -> DataFrame:
    return calendar.where(F.col("date") <= F.lit(as_of))


def rounds_remaining(calendar: DataFrame, as_of: datetime.date) -> DataFrame:
    return calendar.where(F.col("date") > F.lit(as_of))


def next_round(calendar: DataFrame, as_of: datetime.date) -> DataFrame:
    """Earliest future round per season, or the reason there is none."""
    ahead = F.when(F.col("date") > F.lit(as_of), F.struct("date", "round", "circuit_id"))
    return calendar.groupBy("season").agg(F.min(ahead).alias("n")).select(
        "season", F.col("n.round").alias("round"), F.col("n.circuit_id").alias("circuit_id"),
        F.col("n.date").alias("date"),
        F.when(F.col("n").isNull(), "every round on the published calendar has been run").alias("reason"))


def stale_rounds(calendar: DataFrame, published: DataFrame, version: int) -> DataFrame:
    """Rounds to rebuild: missing, other version, renamed, or built from an older source.

    Running it again after the rebuild returns nothing, which makes the batch idempotent.
    """
    p = published.select(
        *ROUND, F.col("schema_version"), F.col("race_name").alias("stored_name"),
        F.col("source_stamp").alias("stored_stamp"))
    reason = (
        F.when(F.col("schema_version").isNull(), "missing")
        .when(F.col("schema_version") != version, "schema version")
        .when(~F.col("stored_name").eqNullSafe(F.col("race_name")), "renamed")
        .when(~F.col("stored_stamp").eqNullSafe(F.col("source_stamp")), "source changed")
    )
    return calendar.join(p, ROUND, "left").withColumn("reason", reason).where("reason IS NOT NULL").select(
        *ROUND, "reason")


def match_sessions(calendar: DataFrame, sessions: DataFrame, slack_days: int) -> DataFrame:
    """Pair a round with the first feed session within ``slack_days`` of its date.

    A range join turned into an equi-join: each round is offered on the few days
    it may match, and the earliest start among the matches is kept.
    """
    days = F.explode(F.sequence(F.date_sub("date", slack_days), F.date_add("date", slack_days)))
    offered = calendar.withColumn("day", days)
    started = sessions.select("session_key", "date_start", F.to_date("date_start").alias("day"))
    return (
        offered.join(started, "day").groupBy(*ROUND)
        .agg(F.min(F.struct("date_start", "session_key")).alias("m"))
        .select(*ROUND, F.col("m.session_key").alias("session_key"), F.col("m.date_start").alias("date_start"))
    )


def round_circuit(calendar: DataFrame) -> DataFrame:
    return calendar.select(*ROUND, "circuit_id", "sprint")


def latest_round_for_circuit(calendar: DataFrame) -> DataFrame:
    """A circuit can be visited twice; the later visit wins."""
    return calendar.groupBy("season", "circuit_id").agg(F.max("round").alias("round"))


def driver_index(entries: DataFrame) -> DataFrame:
    """driver_key -> published code and full name."""
    name = F.nullif(F.trim(F.concat_ws(" ", F.nullif("given_name", F.lit("")), F.nullif("family_name", F.lit("")))),
                    F.lit(""))
    return entries.where("driver_key IS NOT NULL").select(
        "driver_key", F.nullif("code", F.lit("")).alias("code"), F.coalesce(name, F.col("driver_key")).alias("name"))


def driver_label(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Published code and name; otherwise the id made readable, never cut short."""
    parts = F.transform(F.split("driver_key", "_"),
                        lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    pretty = F.array_join(parts, " ")
    return keys.join(driver_index(entries), "driver_key", "left").select(
        "driver_key", F.coalesce("code", pretty).alias("code"), F.coalesce("name", pretty).alias("name"))
