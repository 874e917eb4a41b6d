import datetime
import math
import random

import numpy as np
from pyspark.sql import functions as F

from stintline.functions import scans
from stintline.functions.figures import nearest_rank, same_number, upper_median
from stintline.operators import geometry as gm
from stintline.operators import record as rec
from stintline.operators import strategy as st
from stintline.operators import telemetry as tl
from stintline.operators import weekend as wk

LAPS = "session_id int, driver_id int, lap int, time_s double"
STOPS = "session_id int, driver_id int, lap int"


def test_nearest_rank_and_upper_median(spark):
    for n in (1, 2, 3, 4, 7, 8, 20, 100):
        df = spark.range(n).withColumn("v", F.col("id").cast("double"))
        row = df.agg(*[nearest_rank("v", p).alias(f"p{i}") for i, p in enumerate((0.01, 0.25, 0.9, 0.95))], upper_median("v").alias("m")).first()
        want = [float(min(n - 1, math.floor(p * n))) for p in (0.01, 0.25, 0.9, 0.95)]
        assert [row[f"p{i}"] for i in range(4)] == want and row.m == float(n // 2)


def test_null_equals_only_null(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0), (1.0, 1.0 + 1e-12), (1.0, 1.1)], "a double, b double")
    assert [r[0] for r in df.select(same_number("a", "b")).collect()] == [True, False, True, False]


def test_scans_do_not_depend_on_the_block_size(spark):
    rows = [(k, i, float(i % 7) if i % 5 else None) for k in (1, 2) for i in range(57)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    for size in (3, 10, 1000):
        out = scans.running_total(df, ["k"], ["i"], "v", "t", scans.int_block("i", size)).where("k = 1").orderBy("i").collect()
        total = 0.0
        for r in out:
            total += r.v or 0.0
            assert r.t == total
        near = scans.known_around(df, ["k"], ["i"], scans.int_block("i", size), back={"b": F.col("v")}, ahead={"a": F.col("v")},
                                  inclusive=False).where("k = 2").orderBy("i").collect()
        values = [r.v for r in near]
        for n, r in enumerate(near):
            assert r.b == next((x for x in reversed(values[:n]) if x is not None), None)
            assert r.a == next((x for x in values[n + 1:] if x is not None), None)


def test_ring_frames_split_over_blocks(spark):
    df = spark.range(50).select(F.lit(1).alias("lap_key"), F.col("id").cast("int").alias("idx"), F.lit(50).alias("n"))
    ring, w = scans.closed_ring(df, "lap_key", 3, block=16)
    rows = ring.withColumn("s", F.collect_list("idx").over(w.rowsBetween(-3, 3))).where("core").collect()
    assert len(rows) == 50
    for r in rows:
        assert list(r.s) == [(r.idx + k) % 50 for k in range(-3, 4)]


def test_stint_numbering_advances_over_an_empty_stint(spark):
    laps = spark.createDataFrame([(1, 1, i, 90.0) for i in range(1, 11)], LAPS)
    stops = spark.createDataFrame([(1, 1, 4), (1, 1, 4), (1, 1, 10)], STOPS)
    got = [(r.stint, r.start_lap, r.end_lap) for r in st.build_stints(laps, stops).orderBy("stint").collect()]
    assert got == [(1, 1, 4), (3, 5, 10)]


def test_elapsed_time_stops_at_a_gap(spark):
    laps = spark.createDataFrame([(1, 1, 1, 90.0), (1, 1, 2, None), (1, 1, 3, 90.0)], LAPS)
    assert [r.lap for r in st.cumulative_times(laps).collect()] == [1]


def test_undercut_by_hand(spark):
    a = [90, 90, 110, 95, 89, 89, 89]
    b = [91, 91, 91, 91, 111, 96, 90]
    laps = spark.createDataFrame([(1, d, i + 1, float(t)) for d, ts in ((1, a), (2, b)) for i, t in enumerate(ts)], LAPS)
    stops = spark.createDataFrame([(1, 1, 3), (1, 2, 5)], STOPS)
    row = st.undercut_ledger(laps, stops).first()
    assert (row.driver_id, row.rival_id, row.stop_lap, row.rival_stop_lap, row.compared_laps) == (1, 2, 3, 5, 4)
    assert (row.gap_before_s, row.gap_after_s, row.net_s) == (2.0, 8.0, 6.0)


def test_same_lap_stop_is_neither_earlier_nor_later(spark):
    laps = spark.createDataFrame([(1, d, i, 90.0 + d) for d in (1, 2) for i in range(1, 12)], LAPS)
    stops = spark.createDataFrame([(1, 1, 4), (1, 2, 4), (1, 2, 7)], STOPS)
    got = [(r.driver_id, r.rival_id, r.rival_stop_lap) for r in st.undercut_ledger(laps, stops).collect()]
    assert got == [(1, 2, 7)]


def test_flat_stint_has_no_explanatory_power(spark):
    laps = spark.createDataFrame([(1, 1, i, 90.0) for i in range(1, 10)], LAPS)
    stops = spark.createDataFrame([], STOPS)
    fit = st.fit_reliability(st.stint_trend(laps, st.build_stints(laps, stops))).first()
    assert fit.r_squared == 0.0 and not fit.reliable and fit.sample_count == 7


def messages(spark, rows):
    t0 = datetime.datetime(2024, 1, 1)
    data = [(1, i, t0 + datetime.timedelta(minutes=50 * i), lap, cat, flag, msg) for i, (lap, cat, flag, msg) in enumerate(rows)]
    return spark.createDataFrame(data, "session_id int, seq long, ts timestamp, lap int, category string, flag string, message string")


def test_neutralised_state_machine(spark):
    got = rec.neutralised_laps(messages(spark, [
        (2, "Other", None, "SAFETY CAR LIGHTS ON"), (10, "SafetyCar", None, "VSC DEPLOYED"), (12, "SafetyCar", None, "VSC DEPLOYED"),
        (13, "Other", None, "SAFETY CAR LIGHTS ON"), (14, "SafetyCar", None, "VSC ENDING"), (20, "SafetyCar", None, "VSC ENDING"),
        (30, "Flag", "RED", "RED FLAG"), (40, "SafetyCar", None, "SAFETY CAR DEPLOYED")]))
    laps = sorted(r.lap for r in got.collect())
    assert laps == [2, 3, 4, 5, 6, 7, 12, 13, 14, 30, 40, 41, 42, 43, 44, 45]


def test_clip_before_the_first_lap_has_none(spark):
    t0 = datetime.datetime(2024, 1, 1)
    starts = spark.createDataFrame([(1, 1, t0), (1, 2, t0 + datetime.timedelta(seconds=90))], "session_id int, lap int, start_ts timestamp")
    clips = spark.createDataFrame([(1, 1, t0 - datetime.timedelta(seconds=1)), (1, 2, t0), (1, 3, t0 + datetime.timedelta(hours=30))],
                                  "session_id int, clip_id int, ts timestamp")
    assert {r.clip_id: r.lap for r in rec.lap_at(clips, starts).collect()} == {1: None, 2: 1, 3: 2}


def test_rank_agreement_bounds(spark):
    up = spark.createDataFrame([(1, float(i), float(i)) for i in range(6)] + [(2, float(i), float(-i)) for i in range(6)]
                               + [(3, 1.0, float(i)) for i in range(6)] + [(4, float(i), float(i)) for i in range(4)], "k int, x double, y double")
    got = {r.k: r.rho for r in wk.spearman(up, ["k"], "x", "y").collect()}
    assert abs(got[1] - 1) < 1e-12 and abs(got[2] + 1) < 1e-12 and got[3] is None and got[4] is None


def circle(spark, radius=100.0, kph=180.0):
    n = int(2 * math.pi * radius / 2)
    rows = [(1, i, radius * math.cos(2 * math.pi * i / n), radius * math.sin(2 * math.pi * i / n), kph) for i in range(n)]
    return spark.createDataFrame(rows, "lap_key int, idx int, x double, y double, speed double")


def test_circle_gives_its_own_lateral_g(spark):
    expected = (180 / 3.6) ** 2 / 100 / gm.G
    for cell in (gm.CELL, 5):
        worst = gm.acceleration_trace(circle(spark), cell=cell).agg(F.max(F.abs(F.col("lateral_g") - expected)), F.count("*")).first()
        assert worst[0] < 0.02 * expected and worst[1] == 314


def test_curvature_equals_a_fit_of_each_window(spark):
    """Windows from 17 samples to half a lap, far from the origin of the map, against a plain least-squares fit."""
    n, rng = 240, random.Random(5)
    at = [2 * math.pi * i / n for i in range(n)]
    xs = [4000 + 90 * math.cos(t) + 12 * math.cos(3 * t) + rng.uniform(-0.2, 0.2) for t in at]
    ys = [-2500 + 60 * math.sin(t) + 9 * math.sin(2 * t) + rng.uniform(-0.2, 0.2) for t in at]
    kph = [rng.choice((0.0, 80.0, 210.0, 330.0, 900.0, 5000.0)) for _ in at]
    rows = [(1, i, xs[i], ys[i], kph[i]) for i in range(n)] + [(2, i, 0.0, float(i), 50.0) for i in range(18)]
    lap = spark.createDataFrame(rows, "lap_key int, idx int, x double, y double, speed double")

    def fitted(i):
        half = min((n - 1) // 2, max(8, math.floor(1.5 * kph[i] / 3.6 / 3.7 / 2 + 0.5)))
        dx, dy = (np.array([p[(i + k) % n] - p[i] for k in range(-half, half + 1)]) for p in (xs, ys))
        chord = np.array([dx[-1] - dx[0], dy[-1] - dy[0]])
        tx, ty = chord / np.hypot(*chord)
        bend, slope, _ = np.polyfit(dx * tx + dy * ty, dy * tx - dx * ty, 2)
        return 2 * bend / (1 + slope * slope) ** 1.5

    for cell in (gm.CELL, 7):
        got = {(r.lap_key, r.idx): r for r in gm.acceleration_trace(lap, cell=cell).collect()}
        assert set(got) == {(1, i) for i in range(n)}, "a lap shorter than a window gives nothing"
        for i in range(n):
            r = got[1, i]
            assert abs(r.curvature - fitted(i)) < 1e-9 * max(1, abs(fitted(i))), (i, kph[i])
            assert abs(r.longitudinal_g - kph[i] / 3.6 * (kph[(i + 4) % n] - kph[i - 4]) / 3.6 / 16 / gm.G) < 1e-9
            assert abs(r.speed_step_g - abs((kph[(i + 1) % n] / 3.6) ** 2 - (kph[i] / 3.6) ** 2) / 4 / gm.G) < 1e-6
    assert gm.acceleration_trace(lap.where("false")).isEmpty()


def test_all_over_lap_has_no_turn(spark):
    assert gm.detect_turns(gm.acceleration_trace(circle(spark))).count() == 0


def test_quantise_clips_and_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 0, 5000.0, -5000.0, 0.25), (1, 1, 0.05, 0.15, 0.0)], "lap_key int, idx int, x double, y double, speed double")
    got = tl.quantise_lines(df).orderBy("idx").collect()
    assert (got[0].x, got[0].y, got[0].speed) == (32767, -32768, 2) and (got[1].x, got[1].y) == (0, 2)


def test_position_unit_is_measured(spark):
    for unit in (1.0, 10.0, 100.0):
        step = 50 * 0.27 / 300
        pos = spark.createDataFrame([(1, i * 0.27, 300 * unit * math.cos(step * i), 300 * unit * math.sin(step * i), None) for i in range(150)],
                                    "lap_key int, t double, x double, y double, z double")
        car = spark.createDataFrame([(1, i * 0.25, 180.0, 100.0, 0.0, 7) for i in range(170)],
                                    "lap_key int, t double, speed double, throttle double, brake double, gear int")
        scale = tl.position_scale(tl.align_channels(pos, car)).first()
        assert abs(scale.units_per_metre - unit) < 0.01 * unit
