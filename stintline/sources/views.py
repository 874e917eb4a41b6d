"""Fixture views: the driver's tables read as laps, feeds and telemetry.

One SQL text per view runs in Spark and in DuckDB, so both engines start from
the same input. The values have no racing meaning, only the right shape.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from stintline.functions.lineage import materialised

SESSION = "(1995 + CAST(user_id % 7 AS INT)) * 1000"

VIEWS: dict[str, str] = {
    # Numbered over (session_id, driver_id), so later windows and groupings on
    # that pair reuse this shuffle instead of adding one.
    "laps_v": """
        SELECT session_id, driver_id,
               CAST(row_number() OVER (PARTITION BY session_id, driver_id ORDER BY l_shipdate, l_orderkey,
                    l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS INT) AS lap,
               CASE WHEN l_partkey % 211 = 0 THEN NULL
                    ELSE 88.0 + l_quantity / 50.0 + l_discount * 10
                         + CASE WHEN l_partkey % 97 = 0 THEN 25.0 ELSE 0.0 END END AS time_s,
               l_partkey % 40 = 0 AS pit,
               CASE l_returnflag WHEN 'A' THEN 'HARD' WHEN 'N' THEN 'MEDIUM' ELSE 'SOFT' END AS compound
        FROM (SELECT *, year(l_shipdate) * 1000 + CAST(floor(l_suppkey / 20) AS INT) AS session_id,
                     CAST(l_suppkey % 20 AS INT) AS driver_id FROM lineitem) t""",
    "stops_v": """
        SELECT session_id, driver_id, lap,
               CAST(row_number() OVER (PARTITION BY session_id, driver_id ORDER BY lap) AS INT) AS stop
        FROM laps_v WHERE pit""",
    "timing_laps_v": """
        SELECT session_id, driver_id, lap, time_s,
               coalesce(lag(pit) OVER (PARTITION BY session_id, driver_id ORDER BY lap), false) AS is_pit_out,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) + (lap - 1) * INTERVAL '6' HOUR
                   + driver_id * INTERVAL '1' SECOND AS start_ts
        FROM laps_v""",
    "stint_feed_v": """
        SELECT session_id, driver_id, CAST(floor((lap - 1) / 20) AS INT) AS feed_stint,
               min(lap) AS lap_start, max(lap) AS lap_end, min(compound) AS compound
        FROM laps_v GROUP BY session_id, driver_id, floor((lap - 1) / 20)""",
    "results_v": """
        SELECT session_id, CAST(floor(session_id / 1000) AS INT) AS season,
               CAST(session_id % 1000 + 1 AS INT) AS round, kind, driver_id,
               CAST(driver_id % 10 AS INT) AS team_id, laps,
               CAST(row_number() OVER (PARTITION BY session_id, kind
                    ORDER BY laps DESC, total_s, driver_id) AS INT) AS position,
               CAST((driver_id * 7 + session_id) % 21 AS INT) AS grid,
               CASE WHEN (driver_id * 7 + session_id) % 11 = 0 THEN 'Retired'
                    WHEN laps < max(laps) OVER (PARTITION BY session_id, kind) THEN 'Lapped'
                    ELSE 'Finished' END AS status
        FROM (SELECT session_id, driver_id, 'race' AS kind, count(*) AS laps, round(sum(time_s), 6) AS total_s
              FROM laps_v GROUP BY session_id, driver_id
              UNION ALL
              SELECT session_id, driver_id, 'sprint', count(*), round(sum(time_s), 6)
              FROM laps_v WHERE lap <= 20 AND session_id % 2 = 0 GROUP BY session_id, driver_id) t""",
    "calendar_v": """
        SELECT DISTINCT season, round, session_id, CAST(session_id % 1000 AS INT) AS circuit_id,
               make_date(season, 1, 1) + CAST(round * 7 AS INT) AS date, session_id % 2 = 0 AS sprint
        FROM results_v WHERE kind = 'race'""",
    "editions_v": """
        SELECT CAST(session_id % 1000 AS INT) AS circuit_id, season AS year, driver_id, position, grid,
               CASE WHEN status <> 'Retired' THEN CAST(position AS VARCHAR(9)) WHEN driver_id % 5 = 0 THEN 'W'
                    ELSE 'R' END AS position_text
        FROM results_v WHERE kind = 'race'""",
    "edition_stops_v": """
        SELECT CAST(session_id % 1000 AS INT) AS circuit_id, CAST(floor(session_id / 1000) AS INT) AS year, driver_id
        FROM stops_v WHERE CAST(floor(session_id / 1000) AS INT) % 3 <> 0""",
    "qualifying_v": """
        SELECT session_id, driver_id, CAST(floor(driver_id / 2) AS INT) AS constructor_id,
               CAST(row_number() OVER (PARTITION BY session_id ORDER BY q1_s, driver_id) AS INT) AS position,
               q1_s, CASE WHEN driver_id % 4 <> 3 THEN q2_s END AS q2_s,
               CASE WHEN driver_id % 4 < 2 THEN q3_s END AS q3_s
        FROM (SELECT session_id, driver_id, min(CASE WHEN lap % 3 = 0 THEN time_s END) AS q1_s,
                     min(CASE WHEN lap % 3 = 1 THEN time_s END) AS q2_s,
                     min(CASE WHEN lap % 3 = 2 THEN time_s END) AS q3_s
              FROM laps_v GROUP BY session_id, driver_id) t""",
    "race_control_v": f"""
        SELECT event_id AS seq, ts, {SESSION} AS session_id, CAST(1 + event_id % 60 AS INT) AS lap,
               CASE WHEN event_id % 10 <> 0 THEN 'Weather' WHEN event_type = 'error' THEN 'SafetyCar'
                    WHEN event_type = 'purchase' THEN 'Flag' ELSE 'Other' END AS category,
               CASE WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'RED'
                    WHEN 1 THEN 'BLUE' WHEN 2 THEN 'CLEAR' ELSE 'YELLOW' END END AS flag,
               CASE WHEN event_id % 10 <> 0 THEN 'RISK OF RAIN' WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'VSC ENDING'
                    ELSE 'VSC DEPLOYED' END
                    WHEN event_id % 101 = 0 THEN 'SAFETY CAR LIGHTS ON' ELSE event_type END AS message,
               CASE WHEN event_id % 4 = 0 THEN CAST(user_id % 20 AS INT) END AS driver_id,
               CASE WHEN event_id % 3 = 0 THEN CAST(1 + event_id % 20 AS INT) END AS sector
        FROM events""",
    "changes_v": f"""
        SELECT ts, {SESSION} AS session_id, CAST(user_id % 20 AS INT) AS gained_by,
               CAST((user_id + 1 + event_id % 19) % 20 AS INT) AS lost_by
        FROM events WHERE event_type = 'click'""",
    "radio_v": f"""
        SELECT event_id AS clip_id, ts, {SESSION} AS session_id, CAST(user_id % 20 AS INT) AS driver_id,
               props AS link
        FROM events WHERE event_type = 'view'""",
    "trackside_v": f"""
        SELECT ts, {SESSION} AS session_id, 15 + value / 20 AS air_c, 25 + value / 10 AS track_c,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE CASE WHEN value > 80 THEN 1 ELSE 0 END END AS rainfall
        FROM events WHERE event_type = 'signup'""",
    "archive_v": f"""
        SELECT session_id, hour_ts, 15 + min(value) / 10 AS air_c, min(value) / 100 AS precip_mm
        FROM (SELECT {SESSION} AS session_id, date_trunc('hour', ts) AS hour_ts, value FROM events) t
        GROUP BY session_id, hour_ts""",
    "line_v": """
        SELECT session_id * 100 + driver_id AS lap_key, lap - 1 AS idx,
               300.0 * cos(2 * pi() * (lap - 1) / n) AS x, 300.0 * sin(2 * pi() * (lap - 1) / n) AS y,
               10.0 * sin(2 * pi() * (lap - 1) / n) AS z,
               80.0 + (coalesce(time_s, 90.0) - 80.0) * 8.0 AS speed,
               CAST(CASE WHEN lap % 5 = 0 THEN 0 ELSE 100 END AS DOUBLE) AS throttle,
               CAST(CASE WHEN lap % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS brake, CAST(3 + lap % 5 AS INT) AS gear
        FROM (SELECT *, count(*) OVER (PARTITION BY session_id, driver_id) AS n FROM laps_v) t""",
    "pos_v": """
        SELECT lap_key, CAST(idx * 0.27 AS DOUBLE) AS t, x * 10 AS x, y * 10 AS y, z * 10 AS z FROM line_v""",
    "car_v": """
        SELECT lap_key, CAST(0.1 + idx * 0.25 AS DOUBLE) AS t,
               CASE WHEN idx % 17 = 0 THEN NULL ELSE speed END AS speed, throttle, brake * 100 AS brake, gear
        FROM line_v""",
}

TABLES = ("lineitem", "events")


def spelled(text: str, spark: bool) -> str:
    """``@{x}@`` is x of a group, in order and joined by commas; each engine has its own name for it."""
    opened, closed = ("array_join(array_sort(collect_list(", ")), ',')") if spark else ("array_to_string(list_sort(list(", ")), ',')")
    return text.replace("@{", opened).replace("}@", closed)


def _ordered(names: list[str], texts: dict[str, str]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        for word in sorted(set(re.findall(r"\b\w+_[vo]\b", texts[name]))):
            if word in texts and word != name and word not in done:
                visit(word)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    return done


def with_views(body: str, extra: dict[str, str] | None = None, as_: str = "AS", kept: Collection[str] = ()) -> str:
    """Prefix a statement with the definitions it mentions, in dependency order; those that are ``kept`` need none."""
    texts = {n: t for n, t in {**VIEWS, **(extra or {})}.items() if n not in kept}
    used = [w for w in sorted(set(re.findall(r"\b\w+_[vo]\b", body))) if w in texts]
    ctes = ",\n".join(f"{n} {as_} ({texts[n]})" for n in _ordered(used, texts))
    return f"WITH {ctes}\n{body}" if ctes else body


class Views:
    """The fixture views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._kept: dict[str, DataFrame] = {}

    def keeping(self, *names: str) -> Views:
        """The same views, with these written once: what reads them several times then lays their tables out only once."""
        out = Views(self.spark, self.sf_dir)
        out._kept.update(self._kept)
        for name in names:
            if f"{name}_v" not in out._kept:
                out._kept[f"{name}_v"] = materialised(getattr(out, name))
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, body: str) -> DataFrame:
        text = spelled(with_views(body, kept=self._kept), True)
        used = {t: self._kept[t] if t in self._kept else self.table(t) for t in (*TABLES, *self._kept) if re.search(rf"\b{t}\b", text)}
        text = text.replace("{", "{{").replace("}", "}}")  # the only fields of the format are the tables
        for t in used:
            text = re.sub(rf"\b{t}\b", f"{{{t}}}", text)
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if f"{name}_v" not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}_v")
