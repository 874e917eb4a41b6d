"""Race-model, counterfactual and refusal-ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintline.catalog.registry import SHARED, query, r6
from stintline.catalog.season import AS_OF
from stintline.catalog.strategy import _compounds
from stintline.catalog.telemetry import _ATTEMPTS, _ELEV
from stintline.functions.figures import rounded
from stintline.functions.lineage import materialised
from stintline.operators import model as md
from stintline.operators import outcomes as oc
from stintline.operators import quality
from stintline.operators import record as rec
from stintline.operators import season as sn
from stintline.operators import strategy as st
from stintline.operators import telemetry as tl

DRAWS = 24
# Few cars share a lap number late in the fixture's races.
MIN_FIELD = 5


def _rep(cols, digits=6):
    return "REPLACE (" + ", ".join(f"{r6(c, digits)} AS {c}" for c in cols) + ")"


def _r(df, cols, digits=6):
    return df.withColumns({c: rounded(c, digits) for c in cols})


# Slow laps made common enough for some laps to count as neutralised.
_PACED = "SELECT session_id, driver_id, lap, time_s + CASE WHEN lap % 31 = 9 AND driver_id % 4 <> 0 THEN 24.0 ELSE 0.0 END AS time_s FROM laps_v"
_STOPPED = "SELECT session_id, driver_id, lap, CASE WHEN session_id % 4 = 1 AND lap = 3 AND driver_id = 7 THEN 1758.0 ELSE time_s END AS time_s FROM laps_v"
SHARED["paced_o"] = _PACED
SHARED["pacemed_o"] = "SELECT session_id, lap, median(time_s) AS m FROM paced_o WHERE time_s > 0 GROUP BY ALL HAVING count(*) >= 5"
SHARED["pace_o"] = """
    SELECT session_id, lap, m AS median_s FROM pacemed_o JOIN (SELECT session_id, median(m) AS g FROM pacemed_o GROUP BY session_id) g
    USING (session_id) WHERE m > g * 1.15"""


@query("neutralised_by_pace", "SELECT * FROM pace_o")
def _(v):
    return md.neutralised_by_pace(v.sql(_PACED), min_field=MIN_FIELD)


@query("suspended_sessions", f"""
    SELECT session_id, max(time_s) AS longest_s, median(time_s) AS median_s FROM ({_STOPPED}) s WHERE time_s > 0
    GROUP BY session_id HAVING max(time_s) > 3 * median(time_s)""")
def _(v):
    return md.suspended_sessions(v.sql(_STOPPED))


SHARED["stintindex_o"] = """
    SELECT session_id, driver_id, stint, CAST(lap AS INT) AS lap, coalesce(compound, 'UNKNOWN-' || driver_id || '-' || stint) AS compound,
           CAST(lap - start_lap + 1 AS INT) AS life, lap = end_lap AND nxt IS NOT NULL AS is_in, lap = start_lap AND prv IS NOT NULL AS is_out
    FROM (SELECT *, unnest(range(start_lap, end_lap + 1)) AS lap, lag(stint) OVER w AS prv, lead(stint) OVER w AS nxt
          FROM compounds_o WINDOW w AS (PARTITION BY session_id, driver_id ORDER BY start_lap)) t"""
SHARED["green_o"] = """
    SELECT l.session_id, l.driver_id, l.lap, i.compound, i.life, t.total - l.lap AS remaining, l.time_s
    FROM paced_o l JOIN stintindex_o i USING (session_id, driver_id, lap)
    JOIN (SELECT session_id, max(lap) AS total FROM paced_o GROUP BY session_id) t USING (session_id)
    WHERE l.time_s > 0 AND l.lap <> 1 AND NOT i.is_in AND NOT i.is_out
      AND NOT EXISTS (SELECT 1 FROM pace_o n WHERE n.session_id = l.session_id AND n.lap = l.lap)"""
SHARED["fitrows_o"] = """
    SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS kept FROM (
      SELECT *, count(*) OVER (PARTITION BY session_id, compound) AS sample_laps FROM green_o) a WHERE sample_laps >= 5) b WHERE kept >= 20"""


def _index(v):
    return materialised(md.lap_stint_index(_compounds(v)))


def _fit_rows(v, index=None):
    laps = v.sql(_PACED)
    return md.fit_rows(laps, _index(v) if index is None else index, md.neutralised_by_pace(laps, min_field=MIN_FIELD))


@query("lap_stint_index", "SELECT * FROM stintindex_o")
def _(v):
    return _index(v)


@query("fit_rows", "SELECT * EXCLUDE (kept) FROM fitrows_o")
def _(v):
    v = v.keeping("laps")
    return _fit_rows(v)


# The demeaned sums, cell by cell, from a dense design with one column per term.
SHARED["cells_o"] = """
    SELECT session_id, driver_id, lap, unnest(list_filter([{'c': 'life:' || compound, 'v': life::DOUBLE},
        CASE WHEN compound <> ref THEN {'c': 'offset:' || compound, 'v': 1::DOUBLE} END,
        {'c': 'fuel', 'v': remaining::DOUBLE}, {'c': 'y', 'v': time_s}], lambda e: e IS NOT NULL)) AS cell
    FROM fitrows_o JOIN (SELECT session_id, min(compound) AS ref FROM fitrows_o GROUP BY session_id) r USING (session_id)"""
SHARED["dense_o"] = """
    SELECT d.session_id, d.driver_id, d.lap, k.c, coalesce(x.v, 0) AS v FROM fitrows_o d
    JOIN (SELECT DISTINCT session_id, cell.c AS c FROM cells_o) k ON k.session_id = d.session_id
    LEFT JOIN (SELECT session_id, driver_id, lap, cell.c AS c, cell.v AS v FROM cells_o) x
      ON x.session_id = d.session_id AND x.driver_id = d.driver_id AND x.lap = d.lap AND x.c = k.c"""
SHARED["centred_o"] = "SELECT *, v - avg(v) OVER (PARTITION BY session_id, driver_id, c) AS u FROM dense_o"


@query("normal_equations", f"""
    SELECT session_id, i, j, {r6('s + 3.3e-7', 5)} AS value FROM (
      SELECT a.session_id, a.c AS i, b.c AS j, sum(a.u * b.u) AS s FROM centred_o a JOIN centred_o b
        ON b.session_id = a.session_id AND b.driver_id = a.driver_id AND b.lap = a.lap AND a.c <= b.c GROUP BY ALL) t
    WHERE EXISTS (SELECT 1 FROM cells_o x JOIN cells_o y ON y.session_id = x.session_id AND y.driver_id = x.driver_id
                  WHERE x.session_id = t.session_id AND x.cell.c = t.i AND y.cell.c = t.j)""")
def _(v):
    v = v.keeping("laps")
    # Cells are often exact halves of the last digit; the nudge settles which way they round.
    return md.normal_equations(materialised(_fit_rows(v))).withColumn("value", rounded(F.col("value") + 3.3e-7, 5))


def _fit_statements(tag: str) -> None:
    """The fit of ``fitrows<tag>_o``: sums over a lap's few cells less what the drivers' means take, then elimination column by column."""
    SHARED[f"gram{tag}_o"] = f"""
    SELECT session_id, i, j, coalesce(s, 0) - coalesce(m, 0) AS value FROM (
      SELECT x.session_id, x.cell.c AS i, y.cell.c AS j, sum(x.cell.v * y.cell.v) AS s FROM cells{tag}_o x JOIN cells{tag}_o y
        ON y.session_id = x.session_id AND y.driver_id = x.driver_id AND y.lap = x.lap GROUP BY ALL) a
    FULL JOIN (
      SELECT x.session_id, x.c AS i, y.c AS j, sum(x.s * y.s / n) AS m
      FROM (SELECT session_id, driver_id, cell.c AS c, sum(cell.v) AS s FROM cells{tag}_o GROUP BY ALL) x
      JOIN (SELECT session_id, driver_id, cell.c AS c, sum(cell.v) AS s FROM cells{tag}_o GROUP BY ALL) y ON y.session_id = x.session_id AND y.driver_id = x.driver_id
      JOIN (SELECT session_id, driver_id, count(*) AS n FROM fitrows{tag}_o GROUP BY ALL) z ON z.session_id = x.session_id AND z.driver_id = x.driver_id GROUP BY ALL) b
    USING (session_id, i, j)"""
    SHARED[f"terms{tag}_o"] = f"""
    SELECT session_id, i AS c, row_number() OVER (PARTITION BY session_id ORDER BY i = 'y', i) - 1 AS place, count(*) OVER (PARTITION BY session_id) AS m,
           CASE WHEN i = 'y' THEN 1 ELSE sqrt(greatest(value, 0)) END AS spread FROM gram{tag}_o WHERE i = j"""
    SHARED[f"swept{tag}_o"] = f"""
    SELECT session_id, m, list_reduce(list_prepend(g, list_transform(range(0, m - 1), lambda p: [p::DOUBLE])), lambda acc, e:
        CASE WHEN len(acc) = 1 OR acc[e[1]::BIGINT * (m + 1) + 1] <= {md.RANK_TOLERANCE} THEN [0.0::DOUBLE]
        ELSE list_transform(acc, lambda x, q: CASE
            WHEN (q - 1) // m = e[1] AND (q - 1) % m = e[1] THEN -1 / x
            WHEN (q - 1) // m = e[1] OR (q - 1) % m = e[1] THEN x / acc[e[1]::BIGINT * (m + 1) + 1]
            ELSE x - acc[(q - 1) // m * m + e[1]::BIGINT + 1] * acc[e[1]::BIGINT * m + (q - 1) % m + 1] / acc[e[1]::BIGINT * (m + 1) + 1] END) END) AS g
    FROM (SELECT a.session_id, a.m::BIGINT AS m, list(coalesce(value, 0) / (a.spread * b.spread) ORDER BY a.place, b.place) AS g FROM terms{tag}_o a JOIN terms{tag}_o b USING (session_id)
          LEFT JOIN gram{tag}_o t ON t.session_id = a.session_id AND t.i = a.c AND t.j = b.c GROUP BY ALL HAVING min(a.spread * b.spread) > 0) f"""
    SHARED[f"fit{tag}_o"] = f"""
    SELECT session_id, t.c AS term, g[place * w.m + w.m] / spread AS value, sqrt(greatest(0, -g[place * (w.m + 1) + 1] * sigma2)) / spread AS std_err, sqrt(sigma2) AS rms_s, green_laps, drivers
    FROM (SELECT *, greatest(0, g[m * m]) / greatest(1, green_laps - drivers - m + 1) AS sigma2 FROM swept{tag}_o JOIN (
            SELECT session_id, count(*) AS green_laps, count(DISTINCT driver_id) AS drivers FROM fitrows{tag}_o GROUP BY session_id) n USING (session_id) WHERE len(g) > 1) w
    JOIN terms{tag}_o t USING (session_id) WHERE t.c <> 'y'"""
    SHARED[f"fitted{tag}_o"] = f"""
    SELECT session_id, compound, coalesce(max(value) FILTER (WHERE kind = 'offset'), 0) AS offset_s, max(value) FILTER (WHERE kind = 'life') AS rate_s,
           max(std_err) FILTER (WHERE kind = 'life') AS rate_ci_s, any_value(sample_laps) AS sample_laps
    FROM (SELECT *, split_part(term, ':', 1) AS kind, split_part(term, ':', 2) AS compound FROM fit{tag}_o WHERE term <> 'fuel') f
    JOIN (SELECT DISTINCT session_id, compound, sample_laps FROM fitrows{tag}_o) r USING (session_id, compound) GROUP BY session_id, compound"""
    SHARED[f"base{tag}_o"] = f"""
    SELECT session_id, driver_id, avg(time_s - (offset_s + rate_s * life + fuel_s * remaining)) AS base_s, any_value(fuel_s) AS fuel_s FROM fitrows{tag}_o
    JOIN fitted{tag}_o USING (session_id, compound) JOIN (SELECT session_id, value AS fuel_s FROM fit{tag}_o WHERE term = 'fuel') f USING (session_id) GROUP BY session_id, driver_id"""


_fit_statements("")
_FIT = ["value", "std_err", "rms_s"]


@query("race_fit", f"SELECT * {_rep(_FIT, 5)} FROM fit_o")
def _(v):
    v = v.keeping("laps")
    return _r(md.race_fit(materialised(_fit_rows(v))), _FIT, 5)


@query("race_fit_residual", "SELECT session_id, term, true AS solved FROM fit_o")
def _(v):
    """The fit put back into its own normal equations: Gram * beta equals the right-hand side."""
    v = v.keeping("laps")
    rows = materialised(_fit_rows(v))
    cells = materialised(md.normal_equations(rows))
    full = cells.unionByName(cells.where("i <> j").select("session_id", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    beta = md.race_fit(rows).select("session_id", F.col("term").alias("j"), F.col("value").alias("b"))
    left = full.join(beta.hint("merge"), ["session_id", "j"]).groupBy("session_id", "i").agg(F.sum(F.col("value") * F.col("b")).alias("l"))
    right = full.where("j = 'y' AND i <> 'y'").select("session_id", "i", F.col("value").alias("r"))
    return left.join(right, ["session_id", "i"]).select(
        "session_id", F.col("i").alias("term"), (F.abs(F.col("l") - F.col("r")) < 1e-5 * (1 + F.abs("r"))).alias("solved"))


def _fitted(v, index=None):
    rows = materialised(_fit_rows(v, index))
    fit = materialised(md.race_fit(rows))
    return md.compound_terms(rows, fit), md.base_pace(rows, fit)


def _predicted(v):
    index = _index(v)
    compounds, pace = _fitted(v, index)
    return md.predict_laps(v.sql(_PACED), index, compounds, pace)


_CT = ["offset_s", "rate_s", "rate_ci_s"]


@query("compound_terms", f"SELECT * {_rep(_CT, 5)} FROM fitted_o")
def _(v):
    return _r(_fitted(v)[0], _CT, 5)


@query("base_pace", f"SELECT * {_rep(['base_s', 'fuel_s'], 5)} FROM base_o")
def _(v):
    v = v.keeping("laps")
    return _r(_fitted(v)[1], ["base_s", "fuel_s"], 5)


@query("predict_laps", f"""
    SELECT l.session_id, l.driver_id, l.lap, i.stint, i.compound, i.is_in, l.time_s, {r6('b.base_s + c.offset_s + c.rate_s * i.life + b.fuel_s * (t.total - l.lap)', 5)} AS predicted_s,
           t.total AS total_laps, {r6('l.time_s - (b.base_s + c.offset_s + c.rate_s * i.life + b.fuel_s * (t.total - l.lap))', 5)} AS excess_s
    FROM paced_o l JOIN stintindex_o i USING (session_id, driver_id, lap) JOIN fitted_o c USING (session_id, compound) JOIN base_o b USING (session_id, driver_id)
    JOIN (SELECT session_id, max(lap) AS total FROM paced_o GROUP BY session_id) t USING (session_id) WHERE l.time_s > 0""")
def _(v):
    v = v.keeping("laps")
    return _r(_predicted(v), ["predicted_s", "excess_s"], 5)


# Prediction, stop loss and driver parameters on a stated fit, which SQL can follow.
_TERMS = """
    SELECT DISTINCT session_id, compound, CASE compound WHEN 'HARD' THEN 0.0 WHEN 'MEDIUM' THEN -0.2 ELSE -0.4 END AS offset_s,
           CASE compound WHEN 'HARD' THEN 0.01 WHEN 'MEDIUM' THEN 0.015 ELSE 0.02 END AS rate_s FROM stint_feed_v WHERE compound <> 'SOFT'"""
_PACE = "SELECT DISTINCT session_id, driver_id, 87.5 + driver_id * 0.01 AS base_s, 0.001 AS fuel_s FROM laps_v"
SHARED["predicted_o"] = f"""
    SELECT l.session_id, l.driver_id, l.lap, i.stint, i.compound, i.is_in, l.time_s, t.total AS total_laps,
           p.base_s + c.offset_s + c.rate_s * i.life + p.fuel_s * (t.total - l.lap) AS predicted_s
    FROM paced_o l JOIN stintindex_o i USING (session_id, driver_id, lap) JOIN ({_TERMS}) c USING (session_id, compound)
    JOIN ({_PACE}) p USING (session_id, driver_id) JOIN (SELECT session_id, max(lap) AS total FROM paced_o GROUP BY session_id) t USING (session_id)
    WHERE l.time_s > 0"""
SHARED["stoploss_o"] = """
    SELECT a.session_id, a.driver_id, a.lap, a.time_s - a.predicted_s + b.time_s - b.predicted_s AS loss_s
    FROM predicted_o a JOIN predicted_o b ON b.session_id = a.session_id AND b.driver_id = a.driver_id AND b.lap = a.lap + 1
    WHERE a.is_in AND a.time_s - a.predicted_s + b.time_s - b.predicted_s > 0 AND a.time_s - a.predicted_s + b.time_s - b.predicted_s < 120
      AND NOT EXISTS (SELECT 1 FROM pace_o n WHERE n.session_id = a.session_id AND n.lap IN (a.lap, a.lap + 1))"""


def _doubles(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _stated(v):
    terms = _doubles(v.sql(_TERMS), "offset_s", "rate_s")
    pace = _doubles(v.sql(_PACE), "base_s", "fuel_s")
    index = _index(v)
    laps = v.sql(_PACED)
    return md.predict_laps(laps, index, terms, pace), md.neutralised_by_pace(laps, min_field=MIN_FIELD), index, terms, pace


@query("predict_laps_stated", f"""
    SELECT session_id, driver_id, lap, stint, compound, is_in, time_s, total_laps, {r6('predicted_s')} AS predicted_s,
           {r6('time_s - predicted_s')} AS excess_s FROM predicted_o""")
def _(v):
    return _r(_stated(v)[0], ["predicted_s", "excess_s"])


@query("stop_losses", f"SELECT session_id, driver_id, lap, {r6('loss_s')} AS loss_s FROM stoploss_o")
def _(v):
    v = v.keeping("laps")
    predicted, neutralised, *_rest = _stated(v)
    return _r(md.stop_losses(materialised(predicted), neutralised), ["loss_s"])


_DP = ["actual_total_s", "start_loss_s", "sc_extra_s", "base_s", "fuel_s", "pit_loss_s", "pit_sigma_s"]
# Full distance is asked of the car's own race, so that some cars pass.
SHARED["dparams_o"] = f"""
    SELECT f.*, p.base_s, p.fuel_s, coalesce(s.m, 0) AS pit_loss_s, coalesce(s.sd, 0) AS pit_sigma_s, coalesce(s.n, 0) AS stops,
           20260101 + total_laps AS seed
    FROM (SELECT session_id, driver_id, max(lap) AS total_laps, sum(time_s) AS actual_total_s,
                 coalesce(max(CASE WHEN lap = 1 THEN time_s - predicted_s END), 0) AS start_loss_s,
                 count(*) FILTER (WHERE slow AND lap > 1) AS sc_laps,
                 coalesce(median(time_s - predicted_s) FILTER (WHERE slow AND lap > 1), 0) AS sc_extra_s
          FROM (SELECT q.*, EXISTS (SELECT 1 FROM pace_o n WHERE n.session_id = q.session_id AND n.lap = q.lap) AS slow FROM predicted_o q) q
          GROUP BY session_id, driver_id HAVING count(*) = max(lap)) f
    JOIN ({_PACE}) p USING (session_id, driver_id)
    LEFT JOIN (SELECT session_id, driver_id, median(loss_s) AS m, stddev_pop(loss_s) AS sd, count(*) AS n FROM stoploss_o GROUP BY ALL) s
      USING (session_id, driver_id)
    WHERE NOT EXISTS (SELECT 1 FROM stintindex_o i WHERE i.session_id = f.session_id AND i.driver_id = f.driver_id
        AND NOT EXISTS (SELECT 1 FROM ({_TERMS}) c WHERE c.session_id = i.session_id AND c.compound = i.compound))"""


@query("driver_params", f"SELECT * {_rep(_DP)} FROM dparams_o")
def _(v):
    v = v.keeping("laps")
    predicted, neutralised, index, terms, pace = _stated(v)
    predicted = materialised(predicted)
    own = predicted.groupBy("session_id", "driver_id").agg(F.max("lap").alias("_own"))
    shorter = predicted.join(own, ["session_id", "driver_id"]).withColumn("total_laps", F.col("_own")).drop("_own")
    losses = md.stop_losses(predicted, neutralised)
    return _r(md.driver_params(shorter, losses, neutralised, index, terms, pace), _DP)


SHARED["predfit_o"] = """
    SELECT l.session_id, l.driver_id, l.lap, i.is_in, l.time_s, t.total AS total_laps, b.base_s + c.offset_s + c.rate_s * i.life + b.fuel_s * (t.total - l.lap) AS predicted_s,
           EXISTS (SELECT 1 FROM pace_o n WHERE n.session_id = l.session_id AND n.lap = l.lap) AS slow
    FROM paced_o l JOIN stintindex_o i USING (session_id, driver_id, lap) JOIN fitted_o c USING (session_id, compound) JOIN base_o b USING (session_id, driver_id)
    JOIN (SELECT session_id, max(lap) AS total FROM paced_o GROUP BY session_id) t USING (session_id) WHERE l.time_s > 0"""
SHARED["fitloss_o"] = """
    SELECT a.session_id, a.driver_id, a.time_s - a.predicted_s + b.time_s - b.predicted_s AS loss_s
    FROM predfit_o a JOIN predfit_o b ON b.session_id = a.session_id AND b.driver_id = a.driver_id AND b.lap = a.lap + 1
    WHERE a.is_in AND NOT a.slow AND NOT b.slow AND loss_s > 0 AND loss_s < 120"""


@query("race_params", f"""
    SELECT * {_rep(_DP, 5)} FROM (
    SELECT f.*, p.base_s, p.fuel_s, coalesce(s.m, 0) AS pit_loss_s, coalesce(s.sd, 0) AS pit_sigma_s, coalesce(s.n, 0) AS stops, 20260101 + total_laps AS seed
    FROM (SELECT session_id, driver_id, max(total_laps) AS total_laps, sum(time_s) AS actual_total_s, coalesce(max(CASE WHEN lap = 1 THEN time_s - predicted_s END), 0) AS start_loss_s,
                 count(*) FILTER (WHERE slow AND lap > 1) AS sc_laps, coalesce(median(time_s - predicted_s) FILTER (WHERE slow AND lap > 1), 0) AS sc_extra_s
          FROM predfit_o GROUP BY session_id, driver_id HAVING count(*) = max(total_laps)) f
    JOIN base_o p USING (session_id, driver_id)
    LEFT JOIN (SELECT session_id, driver_id, median(loss_s) AS m, stddev_pop(loss_s) AS sd, count(*) AS n FROM fitloss_o GROUP BY ALL) s USING (session_id, driver_id)
    WHERE NOT EXISTS (SELECT 1 FROM stintindex_o i WHERE i.session_id = f.session_id AND i.driver_id = f.driver_id
        AND NOT EXISTS (SELECT 1 FROM fitted_o c WHERE c.session_id = i.session_id AND c.compound = i.compound))) t""")
def _(v):
    v = v.keeping("laps")
    return _r(md.race_params(v.sql(_PACED), _compounds(v))["drivers"], _DP, 5)


SHARED["suspended_o"] = f"SELECT session_id, max(time_s) AS longest_s FROM ({_STOPPED}) s WHERE time_s > 0 GROUP BY session_id HAVING max(time_s) > 3 * median(time_s)"
SHARED["racedlaps_o"] = f"SELECT * FROM ({_STOPPED}) s WHERE session_id NOT IN (SELECT session_id FROM suspended_o)"
for _from, _to in (("pacemed_o", "racedmed_o"), ("pace_o", "racedpace_o"), ("green_o", "racedgreen_o"), ("fitrows_o", "fitrowsraced_o"), ("cells_o", "cellsraced_o")):
    SHARED[_to] = SHARED[_from].replace("paced_o", "racedlaps_o").replace("pacemed_o", "racedmed_o").replace("pace_o", "racedpace_o").replace(
        "green_o", "racedgreen_o").replace("fitrows_o", "fitrowsraced_o")
_fit_statements("raced")


@query("race_params_skipped", f"""
    SELECT session_id, 'suspended' AS reason, {r6('longest_s')} AS figure FROM suspended_o
    UNION ALL SELECT session_id, 'fit_rank_deficient', NULL FROM (SELECT DISTINCT session_id FROM racedlaps_o) t WHERE session_id NOT IN (SELECT session_id FROM fitraced_o)""")
def _(v):
    v = v.keeping("laps")
    return _r(md.race_params(v.sql(_STOPPED), _compounds(v))["skipped"], ["figure"])


# Scenarios: the real strategies, with stated parameters.
SHARED["scen_o"] = """
    SELECT session_id * 100 + driver_id AS scenario_id, CAST(row_number() OVER (PARTITION BY session_id, driver_id ORDER BY start_lap) - 1 AS INT) AS stint_ix,
           CASE CAST(stint % 3 AS INT) WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS compound, laps FROM stints_o"""
_PARAMS = """
    SELECT session_id * 100 + driver_id AS scenario_id, session_id, CAST(max(lap) AS INT) AS total_laps, 88.5 + driver_id * 0.05 AS base_s,
           0.03 AS fuel_s, 0.004 AS evolution_s, 21.3 AS pit_loss_s, CASE WHEN driver_id % 5 = 0 THEN 0.0 ELSE 0.8 END AS pit_sigma_s,
           20260101 + max(lap) AS seed, 5.0 + driver_id AS extra_s, 92.5 * max(lap) AS actual_s FROM laps_v GROUP BY session_id, driver_id"""
_COMPOUNDS = """
    SELECT session_id, compound, CASE compound WHEN 'SOFT' THEN 0.0 WHEN 'MEDIUM' THEN 0.35 ELSE 0.7 END AS offset_s,
           CASE compound WHEN 'SOFT' THEN 0.05 WHEN 'MEDIUM' THEN 0.03 ELSE 0.02 END AS rate_s,
           CASE compound WHEN 'SOFT' THEN 0.02 WHEN 'MEDIUM' THEN 0.01 ELSE 0.0 END AS rate_ci_s, 0.0004 AS quad_s
    FROM laps_v GROUP BY session_id, compound"""
_P_NUM = ["base_s", "fuel_s", "evolution_s", "pit_loss_s", "pit_sigma_s", "extra_s", "actual_s"]


def _scenarios(v):
    stints = st.build_stints(v.laps, v.stops)
    name = F.when(F.col("stint") % 3 == 0, "SOFT").when(F.col("stint") % 3 == 1, "MEDIUM").otherwise("HARD")
    w = st.Window.partitionBy("session_id", "driver_id").orderBy("start_lap")
    strategies = stints.select(
        (F.col("session_id") * 100 + F.col("driver_id")).alias("scenario_id"), (F.row_number().over(w) - 1).alias("stint_ix"),
        name.alias("compound"), "laps")
    return (strategies, _doubles(v.sql(_PARAMS), *_P_NUM),
            _doubles(v.sql(_COMPOUNDS), "offset_s", "rate_s", "rate_ci_s", "quad_s"))


@query("valid_scenarios", f"""
    SELECT scenario_id, bad IS NULL AS valid, bad AS reason FROM (
      SELECT scenario_id, CASE WHEN sum(laps) <> any_value(total_laps) THEN 'the strategy does not cover the race'
             WHEN count(*) FILTER (WHERE c.compound IS NULL) > 0 THEN 'no degradation parameters for a compound' END AS bad
      FROM (SELECT s.scenario_id, s.compound, s.laps + CASE WHEN s.scenario_id % 5 = 0 AND stint_ix = 0 THEN 1 ELSE 0 END AS laps, p.session_id, p.total_laps
            FROM scen_o s JOIN ({_PARAMS}) p USING (scenario_id)) s
      LEFT JOIN ({_COMPOUNDS}) c ON c.session_id = s.session_id AND c.compound = s.compound AND c.compound <> 'SOFT' GROUP BY scenario_id) t""")
def _(v):
    strategies, params, compounds = _scenarios(v)
    longer = strategies.withColumn("laps", F.col("laps") + ((F.col("scenario_id") % 5 == 0) & (F.col("stint_ix") == 0)).cast("int"))
    return oc.valid_scenarios(longer, params, compounds.where("compound <> 'SOFT'"))




def _state(k: str) -> str:
    """seed * 48271^k mod (2^31 - 1) as SQL."""
    text, step = "seed % 2147483647", 48271
    for bit in range(31):
        text = f"({text} * CASE WHEN ({k} >> {bit}) & 1 = 1 THEN {step} ELSE 1 END % 2147483647)"
        step = step * step % 2147483647
    return text


SHARED["stintsum_o"] = f"""
    SELECT s.*, p.*, c.* EXCLUDE (session_id, compound), count(*) OVER (PARTITION BY s.scenario_id) AS m,
           coalesce(sum(s.laps) OVER (PARTITION BY s.scenario_id ORDER BY stint_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM scen_o s JOIN (SELECT * EXCLUDE (scenario_id), scenario_id AS sid FROM ({_PARAMS}) x) p ON p.sid = s.scenario_id
    JOIN ({_COMPOUNDS}) c ON c.session_id = p.session_id AND c.compound = s.compound"""
# Lap by lap, as the model is written down, rather than by sums per stint.
SHARED["lapcost_o"] = """
    SELECT scenario_id, stint_ix, sum(base_s + offset_s + quad_s * l * l + fuel_s * (total_laps - before - l) - evolution_s * (before + l - 1)) AS fixed, sum(l) AS life
    FROM (SELECT *, unnest(range(1, CAST(laps AS BIGINT) + 1)) AS l FROM stintsum_o) t GROUP BY ALL"""
SHARED["drawn_o"] = f"""
    SELECT *, draw * (2 * m - 1) + stint_ix + 1 AS k1, draw * (2 * m - 1) + stint_ix + 1 + m AS k2
    FROM (SELECT s.* REPLACE (CAST(seed AS BIGINT) AS seed), c.fixed, c.life, unnest(range(0, {DRAWS})) AS draw
          FROM stintsum_o s JOIN lapcost_o c ON c.scenario_id = s.scenario_id AND c.stint_ix = s.stint_ix) t"""
SHARED["totals_o"] = f"""
    SELECT scenario_id, draw, sum(fixed + (rate_s + (2 * {_state('k1')} / 2147483647.0::DOUBLE - 1) * rate_ci_s) * life
               + CASE WHEN stint_ix = m - 1 THEN extra_s
                      ELSE pit_loss_s + (2 * {_state('k2')} / 2147483647.0::DOUBLE - 1) * pit_sigma_s END) AS total_s
    FROM drawn_o GROUP BY ALL"""


def _totals(v):
    strategies, params, compounds = _scenarios(v)
    return materialised(oc.strategy_outcomes(strategies, params, compounds, DRAWS)), params


@query("strategy_outcomes", f"SELECT scenario_id, CAST(draw AS INT) AS draw, {r6('total_s', 5)} AS total_s FROM totals_o")
def _(v):
    strategies, params, compounds = _scenarios(v)
    return _r(oc.strategy_outcomes(strategies, params, compounds, DRAWS), ["total_s"], 5)


def _p(q):
    return f"list_sort(list(total_s))[CAST(least(count(*) - 1, floor({q} * count(*))) AS INT) + 1]"


SHARED["summary_o"] = f"""
    SELECT scenario_id, count(*) AS draws, median(total_s) AS median_s, {_p(0.05)} AS p05_s, {_p(0.1)} AS p10_s, {_p(0.9)} AS p90_s,
           {_p(0.95)} AS p95_s FROM totals_o GROUP BY scenario_id"""
_SM = ["median_s", "p05_s", "p10_s", "p90_s", "p95_s"]


@query("outcome_summary", f"SELECT * {_rep(_SM, 5)} FROM summary_o")
def _(v):
    return _r(oc.outcome_summary(_totals(v)[0]), _SM, 5)


@query("outcome_histogram", f"""
    SELECT g.scenario_id, CAST(g.bin AS INT) AS bin, {r6('g.lo', 5)} AS lo, {r6('g.hi', 5)} AS hi, coalesce(c.n, 0) AS draws
    FROM (SELECT *, unnest(range(0, 24)) AS bin FROM (SELECT scenario_id, least(min(total_s), any_value(actual_s)) AS lo,
            greatest(max(total_s), any_value(actual_s)) AS hi FROM totals_o JOIN ({_PARAMS}) p USING (scenario_id) GROUP BY scenario_id) l) g
    LEFT JOIN (SELECT t.scenario_id, least(23, floor(round((total_s - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 24, 9))) AS bin, count(*) AS n
      FROM totals_o t JOIN (SELECT scenario_id, least(min(total_s), any_value(actual_s)) AS lo, greatest(max(total_s), any_value(actual_s)) AS hi
        FROM totals_o JOIN ({_PARAMS}) p USING (scenario_id) GROUP BY scenario_id) l USING (scenario_id) GROUP BY ALL) c
      ON c.scenario_id = g.scenario_id AND c.bin = g.bin""")
def _(v):
    totals, params = _totals(v)
    return _r(oc.outcome_histogram(totals, params), ["lo", "hi"], 5)


SHARED["gate_o"] = f"""
    SELECT scenario_id, median_s, CAST(actual_s AS DOUBLE) AS actual_s, (median_s - actual_s) / actual_s * 100 AS error_pct,
           abs((median_s - actual_s) / actual_s) < 0.01 AS validated FROM summary_o JOIN ({_PARAMS}) p USING (scenario_id)"""
_GT = ["median_s", "actual_s", "error_pct"]


@query("replay_gate", f"SELECT * {_rep(_GT, 5)} FROM gate_o")
def _(v):
    totals, params = _totals(v)
    return _r(oc.replay_gate(totals, params), _GT, 5)


@query("check_replay", f"""
    SELECT scenario_id, {r6('actual_s', 5)} AS actual_s, {r6('median_s', 5)} AS replayed_s FROM gate_o
    WHERE (validated OR scenario_id % 4 = 0) AND NOT validated""")
def _(v):
    totals, params = _totals(v)
    claimed = oc.replay_gate(totals, params).withColumn("validated", F.col("validated") | (F.col("scenario_id") % 4 == 0))
    return _r(quality.check_replay(claimed, totals), ["actual_s", "replayed_s"], 5)


@query("sensitivity", f"""
    SELECT i.scenario_id, i.input, {r6('-i.swing', 5)} AS low_s, {r6('i.swing', 5)} AS high_s, {r6('b.base', 5)} AS base_total_s FROM (
      SELECT s.scenario_id, s.compound AS input, sum(s.rate_ci_s * c.life) AS swing FROM stintsum_o s JOIN lapcost_o c USING (scenario_id, stint_ix)
        WHERE s.rate_ci_s > 0 GROUP BY ALL
      UNION ALL SELECT scenario_id, 'pit loss', any_value(pit_sigma_s) * (count(*) - 1) FROM stintsum_o GROUP BY scenario_id
        HAVING any_value(pit_sigma_s) > 0 AND count(*) > 1) i
    JOIN (SELECT s.scenario_id, sum(c.fixed + s.rate_s * c.life + CASE WHEN s.stint_ix = s.m - 1 THEN s.extra_s ELSE s.pit_loss_s END) AS base
          FROM stintsum_o s JOIN lapcost_o c USING (scenario_id, stint_ix) GROUP BY s.scenario_id) b USING (scenario_id)""")
def _(v):
    return _r(oc.sensitivity(*_scenarios(v)), ["low_s", "high_s", "base_total_s"], 5)


@query("set_laps", """
    SELECT scenario_id, stint_ix, compound, CASE WHEN stint_ix % 2 = 1 THEN greatest(1, laps - 12) ELSE laps END AS laps FROM scen_o""")
def _(v):
    strategies = _scenarios(v)[0]
    edits = strategies.where("stint_ix % 2 = 1").select("scenario_id", "stint_ix", (F.col("laps") - 12).alias("new_laps"))
    return oc.set_laps(strategies, edits)


@query("strategy_variants", """
    SELECT s.scenario_id, 'add' AS edit, CAST(s.stint_ix + CASE WHEN s.stint_ix > l.i THEN 1 ELSE 0 END AS INT) AS stint_ix, s.compound,
           CASE WHEN s.stint_ix = l.i THEN l.l // 2 ELSE s.laps END AS laps
    FROM scen_o s JOIN (SELECT scenario_id, arg_max(stint_ix, {'l': laps, 'i': -stint_ix}) AS i, max(laps) AS l FROM scen_o GROUP BY ALL) l USING (scenario_id) WHERE l.l >= 2
    UNION ALL
    SELECT s.scenario_id, 'add', s.stint_ix + 1, s.compound, s.laps - s.laps // 2
    FROM scen_o s JOIN (SELECT scenario_id, arg_max(stint_ix, {'l': laps, 'i': -stint_ix}) AS i, max(laps) AS l FROM scen_o GROUP BY ALL) l
      ON l.scenario_id = s.scenario_id AND l.i = s.stint_ix WHERE l.l >= 2
    UNION ALL
    SELECT scenario_id, 'remove:' || g, pos, compound, laps + CASE WHEN pos = least(g, n - 2) THEN glaps ELSE 0 END FROM (
      SELECT s.scenario_id, g.stint_ix AS g, g.laps AS glaps, s.stint_ix - CASE WHEN s.stint_ix > g.stint_ix THEN 1 ELSE 0 END AS pos, s.compound, s.laps,
             (SELECT count(*) FROM scen_o k WHERE k.scenario_id = s.scenario_id) AS n
      FROM scen_o s JOIN scen_o g ON g.scenario_id = s.scenario_id AND g.stint_ix <> s.stint_ix) r
    UNION ALL
    SELECT s.scenario_id, 'set:' || g.stint_ix || ':' || c.c, s.stint_ix, CASE WHEN s.stint_ix = g.stint_ix THEN c.c ELSE s.compound END, s.laps
    FROM scen_o s JOIN scen_o g ON g.scenario_id = s.scenario_id JOIN (SELECT unnest(['SOFT', 'MEDIUM', 'HARD']) AS c) c ON c.c <> g.compound""")
def _(v):
    return oc.strategy_variants(_scenarios(v)[0], ["SOFT", "MEDIUM", "HARD"])


_LOSSES = """
    SELECT session_id AS circuit_id, driver_id, CASE WHEN driver_id % 9 = 0 THEN 0.0 ELSE
           CASE WHEN session_id % 3 = 0 THEN 20.0 + driver_id * 1.25 ELSE 21.0 + (driver_id % 7) * 0.25 END END AS pit_loss_s
    FROM stops_v WHERE stop = 1 AND NOT (session_id % 5 = 0 AND driver_id > 3)"""
SHARED["pitstats_o"] = f"""
    SELECT circuit_id, n AS drivers, why IS NULL AS published, why AS withheld_reason,
           CASE WHEN n >= 5 THEN m END AS median_s, CASE WHEN n >= 5 THEN q1 END AS q1_s, CASE WHEN n >= 5 THEN q3 END AS q3_s,
           CASE WHEN n >= 5 THEN lo END AS min_s, CASE WHEN n >= 5 THEN hi END AS max_s, CASE WHEN n >= 5 THEN (q3 - q1) / m END AS spread_ratio
    FROM (SELECT *, CASE WHEN n < 5 THEN 'drivers_low' WHEN (q3 - q1) / m > 0.25 THEN 'spread_high' END AS why FROM (
      SELECT circuit_id, count(v) AS n, median(v) AS m, min(v) AS lo, max(v) AS hi,
             list_sort(list(v) FILTER (WHERE v IS NOT NULL))[CAST(least(count(v) - 1, floor(0.25 * count(v))) AS INT) + 1] AS q1,
             list_sort(list(v) FILTER (WHERE v IS NOT NULL))[CAST(least(count(v) - 1, floor(0.75 * count(v))) AS INT) + 1] AS q3
      FROM (SELECT circuit_id, CASE WHEN pit_loss_s > 0 THEN CAST(pit_loss_s AS DOUBLE) END AS v FROM ({_LOSSES}) l) a GROUP BY circuit_id) b) c"""


def _losses(v):
    return _doubles(v.sql(_LOSSES), "pit_loss_s")


@query("circuit_pit_loss", f"SELECT * {_rep(['spread_ratio'])} FROM pitstats_o")
def _(v):
    return _r(md.circuit_pit_loss(_losses(v)), ["spread_ratio"])


@query("check_pit_loss", """
    SELECT circuit_id, error FROM (SELECT circuit_id, unnest([
        CASE WHEN circuit_id % 4 = 0 THEN 'published flag' END,
        CASE WHEN published AND circuit_id % 4 <> 0 AND circuit_id % 2 = 0 THEN 'q1_s' END,
        CASE WHEN NOT published AND circuit_id % 4 <> 0 AND circuit_id % 3 = 0 OR published AND circuit_id % 4 = 0 THEN 'withheld without a reason' END]) AS error
      FROM pitstats_o) t WHERE error IS NOT NULL""")
def _(v):
    losses = _losses(v)
    published = md.circuit_pit_loss(losses).withColumns({
        "published": F.when(F.col("circuit_id") % 4 == 0, ~F.col("published")).otherwise(F.col("published")),
        "q1_s": F.when(F.col("circuit_id") % 2 == 0, F.col("q1_s") + 1).otherwise(F.col("q1_s")),
        "withheld_reason": F.when(F.col("circuit_id") % 3 != 0, F.col("withheld_reason"))})
    return quality.check_pit_loss(published, losses)


def _season(c):
    return f"CAST(floor({c}) AS INT) AS season"


# The rule of each module as a code, and what is told of a refusal.
RULES = {"Tyre compounds": "overlap_at_least_0.6", "Degradation fits": "samples_at_least_6_and_r_squared_at_least_0.3", "Conditions": "sources_agree",
         "Pit loss": "drivers_at_least_5_and_spread_at_most_0.25", "Elevation": "range_at_least_3_m", "Upcoming brief": "past_edition_on_record",
         "What-If Engine": "replay_within_1_percent", "Racing Lines": "position_feed_carries_a_lap"}
_RULE = "CASE module " + " ".join(f"WHEN '{m}' THEN '{r}'" for m, r in RULES.items()) + " END AS rule"
SHARED["figures_o"] = f"""
    SELECT 'Tyre compounds' AS module, {_season('session_id / 1000')}, session_id || '/' || driver_id || '/' || stint AS scope, compound IS NOT NULL AS published, compound_source AS reason, NULL::DOUBLE AS figure FROM compounds_o
    UNION ALL SELECT 'Degradation fits', {_season('session_id / 1000')}, session_id || '/' || driver_id || '/' || stint, sample_count >= 6 AND r_squared >= 0.3,
      CASE WHEN sample_count < 6 THEN 'samples_low' ELSE 'r_squared_low' END, CASE WHEN sample_count < 6 THEN sample_count ELSE r_squared END FROM trend_o
    UNION ALL SELECT 'Conditions', {_season('session_id / 1000')}, session_id::VARCHAR, published, withheld_reason, NULL FROM conditions_o
    UNION ALL SELECT 'Pit loss', {_season('circuit_id / 1000')}, circuit_id::VARCHAR, published, withheld_reason, CASE WHEN withheld_reason = 'drivers_low' THEN drivers ELSE spread_ratio END FROM pitstats_o
    UNION ALL SELECT 'Elevation', {_season('lap_key / 100000')}, lap_key::VARCHAR, lap_key % 4 = 3 AND max(z) - min(z) >= 3,
      CASE lap_key % 4 WHEN 0 THEN 'no elevation published' WHEN 1 THEN 'the elevation channel is empty' ELSE 'the elevation channel does not vary enough' END,
      CASE WHEN lap_key % 4 IN (2, 3) THEN round(CASE lap_key % 4 WHEN 2 THEN max(z / 10) - min(z / 10) ELSE max(z) - min(z) END, 2) END FROM line_v GROUP BY lap_key
    UNION ALL SELECT 'Upcoming brief', season, season::VARCHAR, reason IS NULL AND EXISTS (SELECT 1 FROM wanted_o w JOIN editions_v e USING (circuit_id, year)
        WHERE w.season = nextround_o.season),
      coalesce(reason, 'no past edition of this circuit is on record'), NULL FROM nextround_o
    UNION ALL SELECT 'What-If Engine', {_season('scenario_id / 100000')}, scenario_id::VARCHAR, validated, 'replay_missed', error_pct FROM gate_o
    UNION ALL SELECT 'What-If Engine', {_season('session_id / 1000')}, session_id::VARCHAR, false, 'suspended', longest_s FROM suspended_o
    UNION ALL SELECT 'Racing Lines', {_season('session_id / 1000')}, session_id || '/' || driver_id, session_id % 4 <> 1, reason, NULL FROM ({_ATTEMPTS}) a"""
SHARED["toldfigures_o"] = f"""
    SELECT module, {_RULE}, season, published, CASE WHEN NOT published THEN scope END AS scope, CASE WHEN NOT published THEN reason END AS reason,
           CASE WHEN NOT published THEN {r6('figure', 4)} END AS figure FROM figures_o"""


@query("refusal_ledger", """
    SELECT 'module' AS level, module, rule, season, NULL AS reason, NULL AS scope, NULL AS figure, count(*) FILTER (WHERE published) AS published, count(*) FILTER (WHERE NOT published) AS refused
    FROM toldfigures_o GROUP BY ALL
    UNION ALL SELECT 'reason', module, rule, season, reason, NULL, NULL, 0, count(*) FROM toldfigures_o WHERE NOT published GROUP BY ALL
    UNION ALL SELECT 'entry', module, rule, season, reason, scope, figure, 0, count(*) FROM toldfigures_o WHERE NOT published GROUP BY ALL""")
def _(v):
    return _ledger(v.keeping("laps"))


def _ledger(v):
    c = F.col

    def figures(df, season: tuple[str, int], published, reason, figure=None, scope: tuple[str, ...] = ()):
        return df.select(F.floor(c(season[0]) / season[1]).cast("int").alias("season"), F.concat_ws("/", *(scope or season[:1])).alias("scope"),
                         published.alias("published"), reason.alias("reason"), rounded(F.lit(None).cast("double") if figure is None else figure.cast("double"), 4).alias("figure"))

    car = ("session_id", "driver_id")
    stints = _compounds(v)
    fits = st.fit_reliability(st.stint_trend(v.laps, stints))
    hours = rec.hours_within(v.sql(_windows()), v.archive)
    totals, params = _totals(v)
    brief = sn.upcoming_brief(v.calendar, v.editions, v.edition_stops, AS_OF)
    attempts = v.sql(_ATTEMPTS)
    unavailable = tl.unavailable_lines(attempts, attempts.where("session_id % 4 <> 1")).withColumn("_none", F.lit(True))
    tables = {
        "Tyre compounds": figures(stints, ("session_id", 1000), c("compound").isNotNull(), c("compound_source"), scope=(*car, "stint")),
        "Degradation fits": figures(fits, ("session_id", 1000), c("reliable"), c("withheld_reason"),
                                    F.when(c("withheld_reason") == "samples_low", c("sample_count")).otherwise(c("r_squared")), (*car, "stint")),
        "Conditions": figures(rec.session_conditions(v.trackside, hours, 285, 2.15), ("session_id", 1000), c("published"), c("withheld_reason")),
        "Pit loss": figures(md.circuit_pit_loss(_losses(v)), ("circuit_id", 1000), c("published"), c("withheld_reason"),
                            F.when(c("withheld_reason") == "drivers_low", c("drivers")).otherwise(c("spread_ratio"))),
        "Elevation": figures(tl.elevation_verdict(v.sql(_ELEV)), ("lap_key", 100000), c("usable"), c("reason"), c("range_m")),
        "Upcoming brief": figures(brief, ("season", 1), c("reason").isNull(), c("reason")),
        "What-If Engine": figures(oc.replay_gate(totals, params), ("scenario_id", 100000), c("validated"), F.lit("replay_missed"), c("error_pct")).unionByName(
            figures(md.suspended_sessions(v.sql(_STOPPED)), ("session_id", 1000), F.lit(False), F.lit("suspended"), c("longest_s"))),
        "Racing Lines": figures(attempts.join(unavailable.select(*car, "_none"), [*car], "left"), ("session_id", 1000), c("_none").isNull(), c("reason"), scope=car),
    }
    return quality.refusal_ledger({name: (RULES[name], table) for name, table in tables.items()})


def _windows():
    from stintline.catalog.record import WINDOWS

    return WINDOWS


@query("site_counts", """
    SELECT season, l.rounds, l.sessions, l.lines, d.drivers, f.counterfactuals, f.withheld
    FROM (SELECT CAST(floor(session_id / 1000) AS INT) AS season, count(DISTINCT session_id) AS rounds, count(DISTINCT session_id) AS sessions,
                 count(DISTINCT session_id * 100 + driver_id) AS lines FROM laps_v GROUP BY ALL) l
    FULL JOIN (SELECT season, count(DISTINCT driver_id) AS drivers FROM results_v GROUP BY season) d USING (season)
    FULL JOIN (SELECT season, sum(CASE WHEN module = 'Pit loss' THEN p END)::BIGINT AS counterfactuals, sum(r)::BIGINT AS withheld FROM (
        SELECT module, season, count(*) FILTER (WHERE published) AS p, count(*) FILTER (WHERE NOT published) AS r FROM (
          SELECT 'Pit loss' AS module, CAST(floor(circuit_id / 1000) AS INT) AS season, published FROM pitstats_o
          UNION ALL SELECT 'Tyre compounds', CAST(floor(session_id / 1000) AS INT), compound IS NOT NULL FROM compounds_o) x GROUP BY ALL) y
      GROUP BY season) f USING (season)""")
def _(v):
    def by(column: str):
        return F.floor(F.col(column) / 1000).cast("int").alias("season")

    index = v.laps.groupBy("session_id").agg(F.count_distinct("driver_id").alias("n_drivers")).select(
        by("session_id"), F.col("session_id").alias("round"), "n_drivers")
    nothing = [F.lit(None).cast("string").alias("scope"), F.lit(None).cast("double").alias("figure")]
    ledger = quality.refusal_ledger({
        "What-If Engine": ("", md.circuit_pit_loss(_losses(v)).select(by("circuit_id"), "published", F.col("withheld_reason").alias("reason"), *nothing)),
        "Tyre compounds": ("", _compounds(v).select(by("session_id"), F.col("compound").isNotNull().alias("published"),
                                                    F.col("compound_source").alias("reason"), *nothing)),
    }).where("level = 'module'").select("module", "season", "published", "refused")
    return sn.site_counts(index, v.results, ledger)
