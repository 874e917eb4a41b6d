"""The race document: stints, compounds, undercuts and trends of every session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.operators import strategy as st


def race_document(laps: DataFrame, stops: DataFrame, feed: DataFrame) -> DataFrame:
    """One row per session: what was derived, and how much was withheld."""
    stints = st.attach_compounds(st.build_stints(laps, stops), feed)
    pairs = st.undercut_candidates(laps, stops)
    fits = st.fit_reliability(st.stint_trend(laps, stints))
    length = laps.groupBy("session_id").agg(F.max("lap").alias("total_laps"))
    report = st.compound_report(stints).select("session_id", "stints", "identified")
    ledger = pairs.groupBy("session_id").agg(
        F.count_if(F.col("reason").isNull()).alias("undercuts"),
        F.count_if(F.col("reason").isNotNull()).alias("undercuts_excluded"))
    trend = fits.groupBy("session_id").agg(
        F.count("*").alias("fits"), F.count_if("reliable").alias("reliable_fits"))
    out = length.join(report, "session_id", "left").join(ledger, "session_id", "left").join(
        trend, "session_id", "left")
    counts = ["undercuts", "undercuts_excluded", "fits", "reliable_fits"]
    return out.fillna(0, counts)
