"""Plans whose work, memory or disk must not grow faster than their tables."""

import datetime
import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from stintline.catalog import load
from stintline.functions import scans
from stintline.operators import compare as cp
from stintline.operators import geometry as gm
from stintline.operators import model as md
from stintline.operators import telemetry as tl
from stintline.plans.lines import racing_lines
from stintline.sources.views import Views


def plan_lines(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_sector_bounds_are_made_from_the_samples(spark):
    laps = {k: n for k, n in enumerate((1, 2, 3, 13, 24, 25, 26, 86, 601))}
    clock = spark.createDataFrame([(k, i, float(i * i)) for k, n in laps.items() for i in range(n)], "lap_key long, idx int, t double")
    for sectors in (12, 24):
        at = {(k, s): float(math.floor(s / float(sectors) * (n - 1) + 0.5)) ** 2 for k, n in laps.items() for s in range(sectors + 1)}
        out = cp.mini_sectors(clock, sectors)
        assert {(r.lap_key, r.sector): r.time_s for r in out.collect()} == {(k, s): at[k, s] - at[k, s - 1] for k, s in at if s}
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        lines = plan_lines(out)
        # The bounds come out of a join with the samples, so no table of bounds can be broadcast into one.
        for i, line in enumerate(lines):
            if "Generate" in line:
                below = [x for j, x in enumerate(lines[i + 1:]) if all(depth(y) > depth(line) for y in lines[i + 1:i + 2 + j])]
                assert any("Join" in x for x in below)


def test_scans_ahead_read_each_row_once(spark):
    rows = [(k, i // 2, i % 2, float(i) if i % 7 == 3 else None) for k in (1, 2, None) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, j int, v double")
    for inclusive in (True, False):
        out = scans.known_around(df, ["k"], ["i", "j"], scans.int_block("i", 8), back={"b": F.col("v")}, ahead={"a": F.col("v")}, inclusive=inclusive)
        assert not any("unboundedfollowing" in line.lower() for line in plan_lines(out))
        marks = [i for i in range(60) if i % 7 == 3]
        for r in out.where("k = 1").collect():
            at = r.i * 2 + r.j
            assert r.a == next((float(m) for m in marks if m > at or (inclusive and m == at)), None)
            assert r.b == next((float(m) for m in reversed(marks) if m < at or (inclusive and m == at)), None)


def test_a_lap_is_laid_out_once_for_its_curvature(spark):
    line = spark.createDataFrame([(1, i, 300 * math.cos(i / 10), 300 * math.sin(i / 10), 100.0 + i % 7) for i in range(63)],
                                 "lap_key long, idx int, x double, y double, speed double")
    lines = plan_lines(gm.acceleration_trace(line))
    assert not any("Aggregate" in x and "collect_list" in x for x in lines)


def test_terms_of_lone_compounds_are_solved_apart(spark):
    rng, rows = random.Random(3), []
    for session in (1, 2):
        for driver in range(6):
            lap = 2
            for stint in range(9):
                lone = stint % 3 == 2 or (session == 2 and driver == 0)
                compound = f"UNKNOWN-{driver}-{stint}" if lone else ("HARD", "MEDIUM", "WET")[rng.randrange(3)]
                for life in range(1, rng.randrange(8, 16)):
                    rows.append((session, driver, lap, compound, life, 200 - lap, 90 + driver * 0.1 + life * 0.05 * (1 + stint % 2) + (200 - lap) * 0.03 + rng.gauss(0, 0.2)))
                    lap += 1
    fit = {(r.session_id, r.term): r for r in md.race_fit(spark.createDataFrame(
        rows, "session_id int, driver_id int, lap int, compound string, life int, remaining int, time_s double")).collect()}
    assert {s for s, _t in fit} == {1}  # a driver of the second session ran lone compounds only
    held = [r for r in rows if r[0] == 1]
    names = ["fuel"] + [f"{k}:{c}" for k in ("life", "offset") for c in sorted({r[3] for r in held}) if k == "life" or c != "HARD"]
    design = np.array([[{"fuel": r[5], f"life:{r[3]}": r[4], f"offset:{r[3]}": 1}.get(n, 0) for n in names] + [float(r[1] == d) for d in range(6)] for r in held], float)
    y = np.array([r[6] for r in held])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    sigma2 = np.sum((y - design @ beta) ** 2) / (len(y) - design.shape[1])
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sigma2)
    assert {t for _s, t in fit} == set(names)
    for i, name in enumerate(names):
        got = fit[1, name]
        assert abs(got.value - beta[i]) < 1e-7 and abs(got.std_err - error[i]) < 1e-7 and abs(got.rms_s - sigma2 ** 0.5) < 1e-9


def test_the_matrix_of_a_fit_does_not_grow_with_lone_compounds(spark):
    rows = [(1, d, 2 + 8 * s + i, "HARD" if s % 2 == 0 else f"UNKNOWN-{d}-{s}", i + 1, 700 - 8 * s - i, 90.0 + i * 0.1 + d + (i * 7 + s * 3 + d) % 5 * 0.01)
            for d in range(20) for s in range(60) for i in range(8)]
    fit = md.race_fit(spark.createDataFrame(rows, "session_id int, driver_id int, lap int, compound string, life int, remaining int, time_s double"))
    begun = time.time()
    assert fit.count() == 2 + 2 * 20 * 30  # 1,203 columns with the lap time; swept as one matrix, over a billion steps
    assert time.time() - begun < 60


def traces(spark):
    """Laps of one sample, of less than a block and of several blocks, with turns over the line and over the edges of blocks."""
    rng, laps = random.Random(7), {1: 19, 2: 86, 3: 5000, 4: 8192, 5: 40, 6: 300, 7: 9001}
    rows = []
    for k, n in laps.items():
        at = {i for b in [0, 4096, 8192, *(rng.randrange(n) for _ in range(n // 60))] for i in range(b - rng.randrange(9, 30), b + rng.randrange(9, 30))}
        turning = {i % n for i in at} if k != 5 else set(range(n))
        for i in range(n):
            g = rng.choice((-1, 1)) * rng.uniform(1.0, 2.0) if i in turning and rng.random() < 0.9 else rng.uniform(0, 0.9)
            rows.append((k, i, n, None if i % 97 == 5 else rng.uniform(60, 360), rng.uniform(-0.02, 0.02), float("nan") if i % 89 == 7 else g,
                         rng.uniform(10, 20) if rng.random() < 0.01 else 1.0, rng.choice((0.0, 50.0, 99.0, 100.0) if k != 6 else (0.0, 20.0)),
                         float(rng.random() < 0.1), rng.randrange(3, 6)))
    names = "lap_key long, idx int, n int, speed double, curvature double, lateral_g double, speed_step_g double, throttle double, brake double, gear int"
    by = {k: [dict(zip([c.split()[0] for c in names.split(", ")], r)) for r in rows if r[0] == k] for k in laps}
    return spark.createDataFrame(rows, names), by


def half_window(speed):
    return max(16.0, 1.5 * ((speed or 0.0) / 3.6 / 3.7))


def stepped(lap):
    reach = [max(1, math.floor(half_window(r["speed"]) / 2.0 + 0.5)) for r in lap]
    steps, n = [r["idx"] for r in lap if r["speed_step_g"] > 10], len(lap)
    return [any(min((s - i) % n, (i - s) % n) <= reach[i] for s in steps) for i in range(n)]


def turns_of(lap, threshold=1.0, shortest=25.0, gap=40.0):
    n, near = len(lap), stepped(lap)
    g = [None if math.isnan(r["lateral_g"]) else abs(r["lateral_g"]) for r in lap]
    load = []
    for i in range(n):
        held = [v for v in (g[(i + d) % n] for d in range(-5, 6)) if v is not None]
        load.append(round(sum(held) / len(held), 9) if held else 0.0)
    start = next((i for i in range(n) if load[i] < threshold), None)
    runs = []
    for q in range(n) if start is not None else ():
        if load[(q + start) % n] >= threshold:
            if runs and (q == runs[-1][1] + 1 or (q - runs[-1][1] - 1) * 2.0 <= gap):
                runs[-1][1] = q
            else:
                runs.append([q, q])
    out = []
    for a, b in runs:
        if (b - a + 1) * 2.0 >= shortest:
            held = [(q + start) % n for q in range(a, b + 1)]
            apex = max(range(a, b + 1), key=lambda q: (load[(q + start) % n], -q))
            apex = (apex + start) % n
            rank = min(len(held) - 1, math.floor(0.9 * len(held)))
            k, speed = abs(lap[apex]["curvature"]), lap[apex]["speed"]
            why = "speed_step_near" if near[apex] else "radius_below_window" if speed is None or 1 / k < half_window(speed) else None
            out.append((len(out) + 1, held[0], held[-1], apex, (b - a + 1) * 2.0, sorted(load[i] for i in held)[rank], why,
                        min((lap[i]["speed"] for i in held if lap[i]["speed"] is not None), default=None), lap[held[0]]["speed"], lap[held[-1]]["speed"],
                        sorted(abs(lap[i]["curvature"]) for i in held)[rank]))
    return out


def test_turns_come_from_one_layout_of_the_samples(spark):
    trace, laps = traces(spark)
    for limits in ({}, {"g_threshold": 1.1, "min_length_m": 4.0, "merge_gap_m": 6.0}, {"merge_gap_m": -1.0, "min_length_m": 4.0}):
        found = gm.detect_turns(trace, **limits)
        lines = plan_lines(found)
        assert sum("Join" in x for x in lines) == 1 and not any("Generate explode(sequence(a" in x for x in lines)
        got = {}
        for r in found.collect():
            got.setdefault(r.lap_key, []).append((
                r.number, r.start_index, r.end_index, r.apex_index, r.length_m, r.sustained_lateral_g if r.withheld_reason is None else r.unresolved_lateral_g,
                r.withheld_reason, r.min_speed_kph, r.entry_speed_kph, r.exit_speed_kph, r.sustained_curvature))
            assert r.n == len(laps[r.lap_key]) and (r.sustained_lateral_g is None) == (r.withheld_reason is not None)
        args = {"g_threshold": "threshold", "min_length_m": "shortest", "merge_gap_m": "gap"}
        want = {k: t for k, lap in laps.items() if (t := turns_of(lap, **{args[a]: v for a, v in limits.items()}))}
        assert 5 not in got and {k: sorted(t) for k, t in got.items()} == want
        assert any(t[1] > t[2] for ts in got.values() for t in ts) and any(t[1] < 4096 <= t[2] for t in got[7])


def test_steps_near_are_found_with_one_layout(spark):
    trace, laps = traces(spark)
    out = gm.curvature_resolution(trace)
    assert sum("Join" in x for x in plan_lines(out)) == 1
    got = {(r.lap_key, r.idx): r.steps_near for r in out.collect()}
    assert got == {(k, i): v for k, lap in laps.items() for i, v in enumerate(stepped(lap))}


def test_turns_ask_for_few_samples(spark):
    trace, laps = traces(spark)
    turns = gm.detect_turns(trace, g_threshold=1.1, min_length_m=4.0, merge_gap_m=6.0).localCheckpoint()
    spots = [(r.lap_key, r.number, r.start_index, r.apex_index, r.n) for r in turns.collect()]
    details = {(r.lap_key, r.number): r for r in gm.turn_details(turns, trace, lookback_m=24.0).collect()}
    assert len(details) == len(spots)
    for k, number, start, apex, n in spots:
        lap, r = laps[k], details[k, number]
        back = next((d for d in range(12) if lap[(start - d) % n]["brake"] > 0 and lap[(start - d - 1) % n]["brake"] == 0), None)
        assert (r.gear_at_apex, r.braking_index, r.braking_distance_m) == (
            lap[apex]["gear"], None if back is None else (start - back) % n, None if back is None else back * 2.0)
    for window in (24.0, 600.0):
        for r in gm.driving_style(trace, turns, pickup_window_m=window).collect():
            full = lambda i: laps[r.lap_key][i % len(laps[r.lap_key])]["throttle"] >= 98  # noqa: B023, E731
            ahead = [next((d for d in range(min(n, round(window / 2))) if full(apex + d)), None) for k, _number, _start, apex, n in spots if k == r.lap_key]
            met = [d * 2.0 for d in ahead if d is not None]
            assert (r.turns, r.pickups) == (len(ahead), len(met)) and (not met or abs(r.mean_pickup_m - sum(met) / len(met)) < 1e-9)


def test_turns_order_the_samples_once_each_way(spark):
    trace, _laps = traces(spark)
    backward = [x for x in plan_lines(gm.detect_turns(trace)) if "Window [" in x and "pos" in x and "DESC" in x]
    assert len(backward) == 1


def test_looking_ahead_for_full_throttle_lays_no_sample_out(spark):
    full = {1: [], 2: [0], 3: [31, 32, 63], 4: [5], 5: [99, 129], 6: list(range(300))}
    n = {1: 70, 2: 64, 3: 65, 4: 33, 5: 130, 6: 300}
    rows = [(k, i, n[k], 100.0 if i in full[k] else None if i % 3 else 97.9, 0.0, 4, 200.0) for k in n for i in range(n[k])]
    trace = spark.createDataFrame(rows, "lap_key long, idx int, n int, throttle double, brake double, gear int, speed double")
    spots = [(k, i) for k in n for i in range(n[k])]
    turns = spark.createDataFrame([(k, i, 1.0 * i) for k, i in spots] + [(9, 0, 1.0)], "lap_key long, apex_index int, min_speed_kph double")
    for window in (2.0, 70.0, 10_000.0):
        out = gm.driving_style(trace, turns, pickup_window_m=window)
        assert sum("Generate explode(sequence" in x for x in plan_lines(out)) == 1
        got = {r.lap_key: r for r in out.collect()}
        assert set(got) == set(n)
        for k, r in got.items():
            ahead = [min(((s - i) % n[k] for s in full[k]), default=None) for i in range(n[k])]
            met = [a * 2.0 for a in ahead if a is not None and a < window / 2]
            assert (r.turns, r.pickups) == (n[k], len(met)) and (r.mean_pickup_m is None) == (not met)
            assert not met or abs(r.mean_pickup_m - sum(met) / len(met)) < 1e-9


def test_deltas_are_read_once_for_the_turns(spark):
    read = spark.sparkContext.accumulator(0)

    def told(x):
        read.add(1)
        return x

    turns = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 7, 1), (9, 1, 0, 3)], "lap_key long, number int, start_index int, end_index int")
    laps = {2: [0.5 * i for i in range(10)], 3: [0.1 * i * i for i in range(8)], 4: [1.0] * 4}
    rows = [(1, k, i, d) for k, ds in laps.items() for i, d in enumerate(ds)] + [(8, 5, 0, 1.0)]
    delta = spark.createDataFrame(rows, "ref_key long, lap_key long, idx int, d double")
    delta = delta.select("ref_key", "lap_key", "idx", F.udf(told, "double")("d").alias("delta_s"))
    got = {(r.ref_key, r.number, r.lap_key): (r.delta_s, r.worst_s, r.shown_at) for r in gm.turn_deltas(turns, delta).collect()}
    assert got == {(1, 1, 2): (1.5, 2.1, 1), (1, 1, 3): (2.1, 2.1, 1), (1, 2, 2): (1.5, 1.5, 2), (1, 2, 3): (0.1, 1.5, 2)}
    assert read.value <= len(rows)


def samples(spark):
    """Three cars of a session of which one sends too few samples, one of a flat session, one that sends none. Laps run over several blocks of time."""
    rng, pos, car, picked = random.Random(5), [], [], []
    for session, driver, n in ((1, 0, 70), (1, 1, 90), (1, 2, 6), (2, 0, 80), (2, 1, 0)):
        key, x = session * 100 + driver, 0.0
        picked.append((session, driver, key, driver + 1))
        for i in range(n):
            x += 0.0 if i % 9 == 4 else rng.uniform(3000, 6000)
            pos.append((key, i * 30.0, x, 7.0, 10.0 * i if session == 1 else 0.0))
            car.append((key, i * 30.0, 54.0 + i % 5, 80.0 + i % 3, 0.0, 4))
    return (spark.createDataFrame(pos, "lap_key long, t double, x double, y double, z double"),
            spark.createDataFrame(car, "lap_key long, t double, speed double, throttle double, brake double, gear int"),
            spark.createDataFrame(picked, "session_id int, driver_id int, lap_key long, pace_rank int"), pos, car)


def test_lines_are_made_last_from_samples_laid_out_once(spark):
    pos, car, picked, places, speeds = samples(spark)
    lines, refused = racing_lines(pos, car, picked, min_samples=20)
    shown = plan_lines(lines)
    made = next(i for i, x in enumerate(shown) if "Generate explode" in x)
    assert not any("Join" in x for x in shown[:made])  # nothing is joined to the points of the grid, which are many more than the samples
    assert {(r.lap_key, r.reason) for r in refused.collect()} == {(102, "too few position samples"), (201, "no position samples")}
    got = {}
    for r in lines.collect():
        got.setdefault(r.lap_key, {})[r.idx] = r
    speed = {(k, t): v for k, t, v, *_ in speeds}
    unit = {}
    for key, ranked in ((100, 1), (200, 2)):
        lap = [p for p in places if p[0] == key]
        metres = sum(speed[key, b[1]] / 3.6 * 30.0 for b in lap[1:])
        unit[ranked] = sum(b[2] - a[2] for a, b in zip(lap, lap[1:])) / metres
    assert set(got) == {100, 101, 200}
    for key, points in got.items():
        u, lap = unit[key // 100], [p for p in places if p[0] == key]
        kept = [lap[0]] + [b for a, b in zip(lap, lap[1:]) if b[2] > a[2]]
        driven = [(p[2] - lap[0][2]) / u for p in kept]
        assert set(points) == set(range(math.floor(driven[-1] / 2.0) + 1))
        for i in (0, 1, 500, max(points)):
            at = next(j for j, d in enumerate(driven) if d >= i * 2.0) if i else 0
            share = (i * 2.0 - driven[at - 1]) / (driven[at] - driven[at - 1]) if i else 0.0
            mixed = lambda v: v[0] if not i else v[at - 1] + (v[at] - v[at - 1]) * share  # noqa: B023, E731
            assert abs(points[i].x - mixed([p[2] / u for p in kept])) < 1e-6 and abs(points[i].speed - mixed([speed[key, p[1]] for p in kept])) < 1e-6
            assert (points[i].z is None) == (key == 200) and (key == 200 or abs(points[i].z - mixed([p[4] / u for p in kept])) < 1e-6)


def test_alignment_joins_only_the_carries(spark):
    pos, car, picked, places, _speeds = samples(spark)
    aligned = tl.align_channels(pos, car, steps=True)
    assert sum("Join" in x for x in plan_lines(aligned)) == 1
    plain = {(r.lap_key, r.t): (r.step, r.dt) for r in tl._with_step(tl.align_channels(pos, car)).collect()}
    stepped = {(r.lap_key, r.t): (r.step, r.dt) for r in aligned.collect()}
    assert plain == stepped and len(stepped) == len(places)
    scales = picked.select("lap_key", F.lit(3.0).alias("units_per_metre"), F.lit(True).alias("usable"))
    told = lambda df: sorted(tuple(v if v is None else round(v, 6) for v in r) for r in df.collect())
    driven = told(tl.driven_distance(aligned, scales, 20))
    assert driven == told(tl.driven_distance(tl.align_channels(pos, car), scales, 20))
    assert {r[0] for r in driven} == {100, 101, 200} == {r.lap_key for r in tl.driven_laps(aligned, scales, 20).collect()}
    # The grid goes on from the layout of the distance: no sample is dealt out again.
    laid = tl.driven_distance(aligned.localCheckpoint(), scales, 20, told=("usable",))
    sent = lambda df: sum("Exchange" in x for x in df._jdf.queryExecution().executedPlan().toString().splitlines())
    grid = tl.resample_by_distance(laid)
    blocks = tl.driven_distance(aligned.localCheckpoint(), scales, 20)
    assert sent(grid) < sent(tl.resample_by_distance(blocks))
    assert told(grid) == told(tl.resample_by_distance(blocks))


def test_laps_are_numbered_once_for_a_query(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    rows = [(i, rng.randrange(2000), rng.randrange(40), 1 + i % 7, float(rng.randrange(1, 50)), rng.uniform(1000, 9000), rng.randrange(11) / 100, 0.02,
             "ANR"[i % 3], "F", datetime.datetime(1995, 1, 1) + datetime.timedelta(days=rng.randrange(700))) for i in range(3000)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    read, table = [], Views.table
    monkeypatch.setattr(Views, "table", lambda v, name: (read.append(name), table(v, name))[1])
    for name in ("fit_rows", "race_params", "stop_losses", "race_document", "driven_distance"):
        read.clear()
        assert load().QUERIES[name](spark, str(tmp_path)).columns
        assert read == ["lineitem"], name
    plain = Views(spark, str(tmp_path))
    kept = plain.keeping("laps")
    assert not any("Window" in x for x in plan_lines(kept.laps)) and kept.laps.count() == 3000
    for name in ("laps", "stops", "timing_laps", "stint_feed"):
        a, b = getattr(plain, name), getattr(kept, name)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sides_with_a_row_per_lap_or_turn_are_not_broadcast(spark):
    run = lambda df: df._jdf.queryExecution().executedPlan().toString()
    laps = spark.createDataFrame([(1, d, lap, 90.0 + lap) for d in range(3) for lap in range(1, 30)], "session_id int, driver_id int, lap int, time_s double")
    index = md.lap_stint_index(spark.createDataFrame([(1, d, 1, 1, 29, "HARD") for d in range(3)], "session_id int, driver_id int, stint int, start_lap int, end_lap int, compound string"))
    compounds = spark.createDataFrame([(1, "HARD", 0.0, 0.01)], "session_id int, compound string, offset_s double, rate_s double")
    pace = spark.createDataFrame([(1, d, 90.0, 0.1) for d in range(3)], "session_id int, driver_id int, base_s double, fuel_s double")
    by_lap = [x for x in run(md.predict_laps(laps, index, compounds, pace)).splitlines() if "Join" in x and "lap#" in x]
    assert by_lap and all("SortMergeJoin" in x for x in by_lap)
    trace, _laps = traces(spark)
    turns = gm.detect_turns(trace, g_threshold=1.1, min_length_m=4.0, merge_gap_m=6.0).localCheckpoint()
    assert "Broadcast" not in run(gm.turn_details(turns, trace))


def test_neutralised_laps_of_a_race_are_found_once(spark):
    laps = spark.createDataFrame([(1, d, lap, 90.0 + lap % 3 + (40.0 if lap == 12 else 0.0)) for d in range(6) for lap in range(1, 30)], "session_id int, driver_id int, lap int, time_s double")
    stints = spark.createDataFrame([(1, d, 1, 1, 29, 29, "HARD") for d in range(6)], "session_id int, driver_id int, stint int, start_lap int, end_lap int, laps int, compound string")
    parts = md.race_params(laps, stints)
    assert [(r.session_id, r.lap) for r in parts["neutralised"].collect()] == [(1, 12)]
    assert not any("Aggregate" in x or "Join" in x for x in plan_lines(parts["neutralised"]))
