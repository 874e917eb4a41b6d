from pyspark.sql import functions as F

from stintline.operators import model as md
from stintline.operators import outcomes as oc


def race(spark, varied=True):
    """A race built from stated parameters: 6 cars, 50 laps."""
    laps, stints = [], []
    rate, offset = {"HARD": 0.02, "MEDIUM": 0.05}, {"HARD": 0.0, "MEDIUM": -0.5}
    for d in range(6):
        stop = 20 + 3 * d if varied else 25
        plan = [("MEDIUM", 1, stop), ("HARD", stop + 1, 50)] if d % 2 == 0 or not varied else [("HARD", 1, stop), ("MEDIUM", stop + 1, 50)]
        for number, (compound, start, end) in enumerate(plan, 1):
            stints.append((1, d, number, start, end, end - start + 1, compound))
            for lap in range(start, end + 1):
                t = 90 + 0.1 * d + offset[compound] + rate[compound] * (lap - start + 1) + 0.055 * (50 - lap)
                t += 5.0 if lap == 1 else 0.0
                t += 10.5 if lap == stop or lap == stop + 1 else 0.0
                laps.append((1, d, lap, t))
    return (spark.createDataFrame(laps, "session_id int, driver_id int, lap int, time_s double"),
            spark.createDataFrame(stints, "session_id int, driver_id int, stint int, start_lap int, end_lap int, laps int, compound string"))


def test_fit_recovers_the_race(spark):
    parts = md.race_params(*race(spark))
    compounds = {r.compound: r for r in parts["compounds"].collect()}
    assert abs(compounds["HARD"].rate_s - 0.02) < 1e-6 and abs(compounds["MEDIUM"].rate_s - 0.05) < 1e-6
    assert abs(compounds["MEDIUM"].offset_s + 0.5) < 1e-5 and compounds["HARD"].offset_s == 0.0
    drivers = {r.driver_id: r for r in parts["drivers"].collect()}
    assert len(drivers) == 6
    for d, r in drivers.items():
        assert abs(r.base_s - (90 + 0.1 * d)) < 1e-5 and abs(r.fuel_s - 0.055) < 1e-6
        assert abs(r.pit_loss_s - 21.0) < 1e-4 and abs(r.start_loss_s - 5.0) < 1e-4
    assert parts["skipped"].count() == 0


def test_identical_strategies_are_refused(spark):
    parts = md.race_params(*race(spark, varied=False))
    assert parts["drivers"].count() == 0
    assert parts["skipped"].first().reason == "fit_rank_deficient"


def test_fit_solves_its_normal_equations(spark):
    laps, stints = race(spark)
    laps = laps.withColumn("time_s", F.col("time_s") + F.sin(F.col("lap") * 7 + F.col("driver_id")))
    rows = md.fit_rows(laps, md.lap_stint_index(stints), md.neutralised_by_pace(laps))
    cells = {(r.i, r.j): r.value for r in md.normal_equations(rows).collect()}
    cells.update({(j, i): v for (i, j), v in list(cells.items())})
    beta = {r.term: r.value for r in md.race_fit(rows).collect()}
    for i in beta:
        assert abs(sum(cells.get((i, j), 0.0) * b for j, b in beta.items()) - cells[(i, "y")]) < 1e-5


def test_published_outcomes_are_reproduced(spark):
    """Fixed parameters with known totals."""
    strategy = spark.createDataFrame([(1, 0, "MEDIUM", 20), (1, 1, "HARD", 37)], "scenario_id int, stint_ix int, compound string, laps int")
    extra = 1.2 + 0.8 + 0.4 + 3 * 25.0
    params = spark.createDataFrame(
        [(1, 1, 57, 92.5, 0.055, 0.012, 21.3, 0.8, 12345, extra)],
        "scenario_id int, session_id int, total_laps int, base_s double, fuel_s double, evolution_s double, pit_loss_s double, "
        "pit_sigma_s double, seed int, extra_s double")
    compounds = spark.createDataFrame(
        [(1, "MEDIUM", 0.0, 0.045, 0.015, 0.0008), (1, "HARD", 0.35, 0.03, 0.01, 0.0005)],
        "session_id int, compound string, offset_s double, rate_s double, rate_ci_s double, quad_s double")
    totals = [r.total_s for r in oc.strategy_outcomes(strategy, params, compounds, 200).orderBy("draw").collect()]
    for got, want in zip(totals, (5496.488068535558, 5496.312290572908, 5492.530884319626)):
        assert abs(got - want) < 1e-8
    assert abs(totals[-1] - 5488.160554200008) < 1e-8
    frame = spark.createDataFrame([(1, t) for t in totals], "scenario_id int, total_s double")
    assert abs(oc.outcome_summary(frame).first().median_s - 5495.226612312979) < 1e-8
    swing = {r.input: r.high_s for r in oc.sensitivity(strategy, params, compounds).collect()}
    assert abs(swing["pit loss"] - 0.8) < 1e-12 and abs(swing["MEDIUM"] - 0.015 * 210) < 1e-12


def test_edits_keep_the_race_length(spark):
    strategy = spark.createDataFrame(
        [(1, 0, "SOFT", 22), (1, 1, "HARD", 31), (1, 2, "MEDIUM", 17)], "scenario_id int, stint_ix int, compound string, laps int")
    variants = oc.strategy_variants(strategy, ["SOFT", "HARD"])
    assert {r.n for r in variants.groupBy("edit").agg(F.sum("laps").alias("n")).collect()} == {70}
    added = [(r.stint_ix, r.laps) for r in variants.where("edit = 'add'").orderBy("stint_ix").collect()]
    assert added == [(0, 22), (1, 15), (2, 16), (3, 17)]
    last = [(r.stint_ix, r.laps) for r in variants.where("edit = 'remove:2'").orderBy("stint_ix").collect()]
    assert last == [(0, 22), (1, 48)]
