"""DuckDB SQL of the registered queries, put together from shared table expressions."""

from __future__ import annotations

import math

from cellwise.functions import geo
from cellwise.operators.forecast import taps
from cellwise.sources.events import HOTSPOTS
from cellwise.sources.sinks import CATEGORY_COLORS

Z = "1.959963984540054"


def _points(table: str, key: str, event: str, when: str, kind: str) -> str:
    place = lambda a, b, s: f"CAST((({key} * {a}) % 20000) * (({key} * {b}) % 20000) AS DOUBLE) / 20000 + ({event} * {s}) % 200"
    return f"SELECT {event} AS event_id, {place(7919, 104729, 31)} AS x, {place(15485863, 32452843, 37)} AS y, {when} AS datetime, {kind} AS crime_type FROM {table}"


def _binned(points: str, unit: str) -> str:
    cell = lambda c: f"CAST(least(greatest(floor({c} / 2000), 0), 9) AS INTEGER)"
    return f"""SELECT *, {cell("y")} AS "row", {cell("x")} AS col, {cell("y")} * 10 + {cell("x")} AS flat_idx,
  CAST(date_diff('{unit}', (SELECT min(datetime) FROM {points}), datetime) AS INTEGER) AS t FROM {points}"""


def _cube(binned: str) -> str:
    return f"""SELECT p.t, c.f // 10 AS "row", c.f % 10 AS col, c.f AS flat_idx, CAST(coalesce(n.n, 0) AS DOUBLE) AS count
FROM (SELECT CAST(unnest(range((SELECT max(t) + 1 FROM {binned}))) AS INTEGER) AS t) p
CROSS JOIN (SELECT CAST(unnest(range(100)) AS INTEGER) AS f) c
LEFT JOIN (SELECT t, flat_idx, count(*) AS n FROM {binned} GROUP BY ALL) n ON n.t = p.t AND n.flat_idx = c.f"""


def _near(cube: str, value: str, own: bool) -> str:
    skip = "" if own else " AND NOT (a.flat_idx = b.flat_idx)"
    return f"""SELECT a.t, a."row", a.col, a.flat_idx, sum(b.{value}) AS n_sum, count(*) AS deg
FROM {cube} a JOIN {cube} b ON a.t = b.t AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1{skip} GROUP BY ALL"""


def _gi(cube: str, near: str) -> str:
    return f"""SELECT c.*, CASE WHEN s.sd = 0 THEN 0.0 ELSE (n.n_sum - s.mean * n.deg) / (s.sd * sqrt((100.0 * n.deg - n.deg * n.deg) / 99)) END AS gi_z
FROM {cube} c JOIN {near} n USING (t, flat_idx) JOIN (SELECT t, avg(count) AS mean, stddev_pop(count) AS sd FROM {cube} GROUP BY t) s ON s.t = c.t"""


def _kendall(table: str, value: str) -> str:
    return f"""SELECT "row", col, CAST(n AS INTEGER) AS n, s, z, CASE WHEN z > 0 THEN 'increasing' WHEN z < 0 THEN 'decreasing' ELSE 'no trend' END AS trend, abs(z) > {Z} AS significant FROM (
  SELECT *, CASE WHEN n < 4 OR s = 0 THEN 0.0 ELSE (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) END AS z FROM (
    SELECT a."row", a.col, (SELECT max(t) + 1 FROM {table}) AS n, CAST(coalesce(sum(sign(b.{value} - a.{value})), 0) AS DOUBLE) AS s
    FROM {table} a LEFT JOIN {table} b ON a.flat_idx = b.flat_idx AND b.t > a.t GROUP BY a."row", a.col))"""


TABLES = {
    "pe": (_points("events", "user_id", "event_id", "ts", "event_type"), ()),
    "po": (_points("orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"), ()),
    "be": (_binned("pe", "day"), ("pe",)),
    "bo": (_binned("po", "month"), ("po",)),
    "ce": (_cube("be"), ("be",)),
    "co": (_cube("bo"), ("bo",)),
    "closed": ("SELECT * FROM ce WHERE t <= (SELECT max(t) FROM be WHERE date_trunc('day', datetime) + INTERVAL 1 DAY <= (SELECT max(datetime) FROM pe) - INTERVAL 1 DAY)", ("ce", "be", "pe")),
    "closed_mk": (_kendall("closed", "count"), ("closed",)),
    "ne": (_near("ce", "count", True), ("ce",)),
    "no": (_near("co", "count", True), ("co",)),
    "le": (_near("ce", "count", False), ("ce",)),
    "ge": (_gi("ce", "ne"), ("ce", "ne")),
    "go": ("SELECT * EXCLUDE (gi_z), gi_z, round(gi_z, 9) AS z9 FROM (" + _gi("co", "no") + ")", ("co", "no")),
    # Clusters: neighbours within 500 m and a day, cores of 8 or more, components by closure, borders to the smallest.
    "cl_np": (
        """SELECT a.event_id AS a, b.event_id AS b FROM (SELECT *, CAST(floor(x / 500) AS INTEGER) AS gx, CAST(floor(y / 500) AS INTEGER) AS gy FROM pe) a
JOIN (SELECT *, CAST(floor(x / 500) AS INTEGER) + i AS gx, CAST(floor(y / 500) AS INTEGER) + j AS gy FROM pe, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) b USING (gx, gy)
WHERE a.event_id <> b.event_id AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 500 AND abs(epoch_us(a.datetime) - epoch_us(b.datetime)) <= 86400000000""",
        ("pe",),
    ),
    "cl_kc": ("SELECT a AS id FROM cl_np GROUP BY 1 HAVING count(*) >= 8", ("cl_np",)),
    "cl_rc": ("SELECT id AS a, id AS b FROM cl_kc UNION SELECT cl_rc.a, cl_np.b FROM cl_rc JOIN cl_np ON cl_np.a = cl_rc.b WHERE cl_np.b IN (SELECT id FROM cl_kc)", ("cl_np", "cl_kc")),
    "cl_lc": ("SELECT a AS id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster FROM (SELECT a, min(b) AS root FROM cl_rc GROUP BY 1)", ("cl_rc",)),
    "cl_sc": (
        "SELECT event_id, coalesce(cl_lc.cluster, near.cluster, -1) AS cluster FROM pe LEFT JOIN cl_lc ON cl_lc.id = event_id LEFT JOIN (SELECT cl_np.b, min(cluster) AS cluster FROM cl_np JOIN cl_lc ON cl_lc.id = cl_np.a GROUP BY 1) near ON near.b = event_id",
        ("pe", "cl_np", "cl_lc"),
    ),
    "mk": (_kendall("co", "count"), ("co",)),
    "mg": (_kendall("go", "z9"), ("go",)),
    "sg": (f"SELECT *, z9 > {Z} AS hot, z9 < -{Z} AS cold, (SELECT max(t) FROM go) AS last FROM go", ("go",)),
    "fg": (
        'SELECT flat_idx, "row", col, sum(count) AS total_count, avg(gi_z) AS mean_gi_z, max_by(gi_z, t) AS last_gi_z, '
        + ", ".join(
            f"bool_or({f}) AS {f}_any, avg(CAST({f} AS INTEGER)) AS {f}_share, bool_or({f} AND t = last) AS {f}_last, bool_or({f} AND t = last - 1) AS {f}_two, bool_or({f} AND t = 0) AS {f}_gone, bool_or({f} AND t < last) AS {f}_old"
            for f in ("hot", "cold")
        )
        + " FROM sg GROUP BY ALL",
        ("sg",),
    ),
    "cat": (
        "SELECT f.flat_idx, f.\"row\", f.col, total_count, mean_gi_z, last_gi_z, m.z AS mk_z, m.trend AS mk_trend, CASE WHEN hot_any AND cold_any THEN 'OSCILLATING_HOTSPOT' "
        + " ".join(
            f"""WHEN {f}_any AND {f}_share >= 0.9 THEN CASE WHEN significant AND trend = '{up}' THEN 'INTENSIFYING_{n}' WHEN significant AND trend = '{down}' THEN 'DIMINISHING_{n}' ELSE 'PERSISTENT_{n}' END
            WHEN {f}_any AND NOT {f}_last AND NOT {f}_gone THEN 'HISTORICAL_{n}' WHEN {f}_any AND {f}_last AND NOT {f}_old THEN 'NEW_{n}' WHEN {f}_any AND {f}_last AND {f}_two THEN 'CONSECUTIVE_{n}' WHEN {f}_any THEN 'SPORADIC_{n}'"""
            for f, n, up, down in (("hot", "HOTSPOT", "increasing", "decreasing"), ("cold", "COLDSPOT", "decreasing", "increasing"))
        )
        + " ELSE 'NO_PATTERN' END AS category FROM fg f JOIN mg m ON m.\"row\" = f.\"row\" AND m.col = f.col",
        ("fg", "mg"),
    ),
    "mo": ('SELECT flat_idx, "row", col, greatest(avg(count), 0) AS yhat, greatest(greatest(avg(count), 0) - 1.96 * stddev_pop(count), 0) AS lower, greatest(avg(count), 0) + 1.96 * stddev_pop(count) AS upper FROM co WHERE t < 60 GROUP BY ALL', ("co",)),
    "pa": ('SELECT m.flat_idx, m."row", m.col, m.yhat AS pred, CAST((SELECT count(*) FROM bo b WHERE b.flat_idx = m.flat_idx AND b.t >= 60) AS DOUBLE) AS actual FROM mo m', ("mo", "bo")),
    "lo": ("SELECT *, coalesce(lag(count) OVER (PARTITION BY flat_idx ORDER BY t), count) AS y_lag1 FROM co", ("co",)),
    "nl": (_near("lo", "y_lag1", False), ("lo",)),
    "fe": ('SELECT l.t, l."row", l.col, l.flat_idx, l.count AS y, l.y_lag1, n.n_sum / n.deg AS sp_lag, CAST(l.t AS DOUBLE) AS trend, sin(2 * pi() * (l.t % 12) / 12) AS sin, cos(2 * pi() * (l.t % 12) / 12) AS cos FROM lo l JOIN nl n USING (t, flat_idx)', ("lo", "nl")),
    "fit": ("SELECT min(x) AS x0, min(y) AS y0, CAST(greatest(1, ceil((max(y) - min(y)) / 2000)) AS INTEGER) AS nr, CAST(greatest(1, ceil((max(x) - min(x)) / 2000)) AS INTEGER) AS nc FROM pe", ("pe",)),
    "fitted": ('SELECT f AS flat_idx, f // nc AS "row", f % nc AS col, x0 + (f % nc) * 2000.0::DOUBLE AS minx, y0 + (f // nc) * 2000.0::DOUBLE AS miny, x0 + (f % nc + 1) * 2000.0::DOUBLE AS maxx, y0 + (f // nc + 1) * 2000.0::DOUBLE AS maxy, x0 + (f % nc + 0.5::DOUBLE) * 2000 AS cx, y0 + (f // nc + 0.5::DOUBLE) * 2000 AS cy FROM (SELECT CAST(unnest(range(nr * nc)) AS INTEGER) AS f, * FROM fit)', ("fit",)),
    "cells": ("SELECT f AS flat_idx, f // 10 AS \"row\", f % 10 AS col, (f % 10) * 2000.0::DOUBLE AS minx, (f // 10) * 2000.0::DOUBLE AS miny, (f % 10 + 1) * 2000.0::DOUBLE AS maxx, (f // 10 + 1) * 2000.0::DOUBLE AS maxy, (f % 10 + 0.5::DOUBLE) * 2000 AS cx, (f // 10 + 0.5::DOUBLE) * 2000 AS cy FROM (SELECT CAST(unnest(range(100)) AS INTEGER) AS f)", ()),
    "cum": ("SELECT threshold, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM (SELECT round(pred, 9) AS threshold, count(*) FILTER (WHERE actual > 20) AS tp, count(*) FILTER (WHERE NOT actual > 20) AS fp FROM pa GROUP BY 1) WINDOW w AS (ORDER BY threshold DESC)", ("pa",)),
    "pp": (
        f"""SELECT percentile, avg(CAST(hot AS INTEGER)) AS area_fraction, CASE WHEN sum(actual) = 0 THEN 0.0 ELSE coalesce(sum(actual) FILTER (WHERE hot), 0) / sum(actual) END AS hit_rate FROM (
SELECT q.percentile, pa.actual, round(pa.pred, 9) >= round(q.mark, 9) AS hot FROM pa CROSS JOIN (SELECT unnest({[float(k) for k in range(50, 100, 5)]}::DOUBLE[]) AS percentile, unnest(quantile_cont(pred, {[k / 100 for k in range(50, 100, 5)]})) AS mark FROM pa) q) GROUP BY percentile""",
        ("pa",),
    ),
    "sc": ("SELECT hit_rate, area_fraction, CASE WHEN area_fraction = 0 THEN 0.0 ELSE hit_rate / area_fraction END AS pai, CASE WHEN area_fraction = 1 THEN 0.0 ELSE (hit_rate - area_fraction) / (1 - area_fraction) END AS pei FROM pp WHERE percentile = 80", ("pp",)),
    "er": ("SELECT sqrt(avg(power(pred - actual, 2))) AS rmse, avg(abs(pred - actual)) AS mae, CASE WHEN stddev_pop(pred) < 1e-12 OR stddev_pop(actual) < 1e-12 THEN 0.0 ELSE corr(pred, actual) END AS pearson_r, CAST(sum(actual) AS BIGINT) AS n_actual FROM pa", ("pa",)),
    "li": (
        """SELECT *, CASE WHEN m2 = 0 THEN 0.0 ELSE z * lag / m2 END AS local_i, (CASE WHEN m2 = 0 THEN 0.0 ELSE z * lag / m2 END + 1.0 / 99) / 0.5 AS i_z FROM (
SELECT c.t, c."row", c.col, c.flat_idx, c.count - s.mean AS z, l.n_sum / l.deg - s.mean AS lag, s.m2 FROM ce c JOIN le l USING (t, flat_idx) JOIN (SELECT t, avg(count) AS mean, var_pop(count) AS m2 FROM ce GROUP BY t) s ON s.t = c.t)""",
        ("ce", "le"),
    ),
    "rk": (
        "SELECT d AS distance, 4e8 * (SELECT count(*) FROM dd WHERE dist <= d) / (n * (n - 1.0::DOUBLE)) AS k FROM (SELECT CAST(unnest(range(100, 1001, 100)) AS DOUBLE) AS d) CROSS JOIN (SELECT count(*) AS n FROM pe)",
        ("dd", "pe"),
    ),
    "dd": (
        """SELECT sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist FROM (SELECT *, CAST(floor(x / 1000) AS INTEGER) AS gx, CAST(floor(y / 1000) AS INTEGER) AS gy FROM pe) a
JOIN (SELECT *, CAST(floor(x / 1000) AS INTEGER) + i AS gx, CAST(floor(y / 1000) AS INTEGER) + j AS gy FROM pe, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) b USING (gx, gy)
WHERE a.event_id <> b.event_id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 1000100""",
        ("pe",),
    ),
}


def _sql(body: str, *names: str) -> str:
    """body after the table expressions that it needs, each once, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in TABLES[name][1]:
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return body
    # Materialised where used more than once, so that the engine makes a cube once.
    recursive = "RECURSIVE " if "cl_rc" in order else ""
    return f"WITH {recursive}" + ",\n".join(f"{n}{' ' if n == 'cl_rc' else ' AS MATERIALIZED '}{'AS ' if n == 'cl_rc' else ''}({TABLES[n][0]})" for n in order) + "\n" + body


def _r(expression: str, name: str | None = None, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0 AS {name or expression}"


KEYS = '"row", col'
WHEN = "strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime"
POINT = f"event_id, {_r('x')}, {_r('y')}, {WHEN}, crime_type"
PAI_OF = "CASE WHEN area_fraction = 0 THEN 0.0 ELSE hit_rate / area_fraction END"
SHARE = "CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END"
GRAM_COLUMNS = ["one", "y_lag1", "sp_lag", "trend", "sin", "cos", "y"]


def _smooth() -> str:
    values = ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in taps(0.8))
    fold = lambda c: f"CASE WHEN ((m.{c} + k.k) % 20 + 20) % 20 >= 10 THEN 19 - ((m.{c} + k.k) % 20 + 20) % 20 ELSE ((m.{c} + k.k) % 20 + 20) % 20 END"
    return f"""SELECT "row", col, {_r("yhat")} FROM (
SELECT m."row", {fold("col")} AS col, sum(m.yhat * k.w) AS yhat FROM (
SELECT {fold('"row"')} AS "row", m.col, sum(m.yhat * k.w) AS yhat FROM mo m CROSS JOIN (VALUES {values}) k(k, w) GROUP BY 1, 2) m CROSS JOIN (VALUES {values}) k(k, w) GROUP BY 1, 2)"""


def _synthetic() -> str:
    spots = ", ".join(f"({k}, CAST({i!r} AS DOUBLE), CAST({g!r} AS DOUBLE), {first})" for k, (_, _, _, i, g, first) in enumerate(HOTSPOTS))
    return f"""WITH m AS (SELECT CAST(m AS INTEGER) AS m, DATE '2022-01-01' + to_months(CAST(m AS INTEGER)) AS d FROM range(24) r(m)),
q AS (SELECT m, d, floor((SELECT count(*) FROM events)::DOUBLE / 24 * (1 + 0.35::DOUBLE * sin(pi() * (month(d) - 1) / 6 - pi() / 2))) AS total FROM m)
SELECT q.m, strftime(q.d, '%Y-%m-%d') AS month_start, CAST(floor(q.total * 0.3::DOUBLE) + sum(CASE WHEN q.m >= s.f THEN floor(q.total * least(greatest(s.i * (1 + s.g * (q.m - s.f)), 0), 1)) ELSE 0 END) AS BIGINT) AS n
FROM q CROSS JOIN (VALUES {spots}) s(k, i, g, f) GROUP BY q.m, q.d, q.total"""


def _lonlat(zone: int = 16) -> str:
    """Degrees of local metres: the same series as the operator's, in SQL."""
    series = lambda terms, at, other, x, y: "".join(f" {'-' if other else '+'} ({c!r}::DOUBLE) * {x}({2 * k} * {at})" + (f" * {y}({2 * k} * {other})" if other else "") for k, c in enumerate(terms, 1))
    scale = geo.SCALE * geo.RADIUS
    centre = math.radians(zone * 6 - 183)
    return f"""(SELECT event_id, degrees(atan2(sinh(e0), cos(x0)) + ({centre!r}::DOUBLE)) AS longitude, degrees(chi{series(geo.LATITUDE, "chi", "", "sin", "")}) AS latitude
FROM (SELECT *, asin(sin(x0) / cosh(e0)) AS chi FROM (SELECT event_id, xi{series(geo.INVERSE, "xi", "eta", "sin", "cosh")} AS x0, eta{series(geo.INVERSE, "xi", "eta", "cos", "sinh")} AS e0
FROM (SELECT event_id, (y + {geo.LOCAL_OFFSET[1]!r}::DOUBLE) / {scale!r}::DOUBLE AS xi, (x + {geo.LOCAL_OFFSET[0]!r}::DOUBLE - {geo.FALSE_EASTING!r}::DOUBLE) / {scale!r}::DOUBLE AS eta FROM pe))))"""


def _legend() -> str:
    named = ", ".join(f"('{name}', '{color}')" for name, color in CATEGORY_COLORS.items())
    title = "array_to_string(list_transform(string_split(v.category, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    return f"SELECT v.category, {title} AS title, v.color, CAST(count(c.category) AS BIGINT) AS n FROM (VALUES {named}) v(category, color) LEFT JOIN cat c ON c.category = v.category GROUP BY v.category, v.color"


ORACLES = {
    "stream_trends": _sql(f"SELECT {KEYS}, n, {_r('s')}, {_r('z')}, trend, significant FROM closed_mk", "closed_mk"),
    "stream_counts": _sql(
        f"""SELECT strftime(date_trunc('day', datetime), '%Y-%m-%d %H:%M:%S') AS period_start, {KEYS}, flat_idx, count(*) AS n FROM be
WHERE date_trunc('day', datetime) + INTERVAL 1 DAY <= (SELECT max(datetime) FROM pe) - INTERVAL 1 DAY GROUP BY ALL""",
        "be",
        "pe",
    ),
    "category_legend": _sql(_legend(), "cat"),
    "local_to_lonlat": _sql(f"SELECT event_id, {_r('longitude')}, {_r('latitude')} FROM {_lonlat()}", "pe"),
    "synthetic_counts": _synthetic(),
    "events_points": _sql(f"SELECT {POINT} FROM pe", "pe"),
    "offence_map": _sql("SELECT CASE crime_type WHEN 'click' THEN 'theft' WHEN 'purchase' THEN 'assault' WHEN 'signup' THEN 'burglary' ELSE 'other' END AS category, count(*) AS n FROM pe GROUP BY 1", "pe"),
    "date_filter": _sql(f"SELECT {POINT} FROM pe WHERE datetime >= TIMESTAMP '2024-01-05' AND datetime <= TIMESTAMP '2024-01-12'", "pe"),
    "type_filter": _sql(f"SELECT {POINT} FROM pe WHERE crime_type IN ('purchase', 'error')", "pe"),
    "train_test_split": _sql("SELECT CASE WHEN t < 60 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM bo GROUP BY 1", "bo"),
    "grid_assign": _sql(f"SELECT event_id, {KEYS}, flat_idx FROM be", "be"),
    "grid_cells": _sql(f"SELECT flat_idx, {KEYS}, {', '.join(map(_r, ('minx', 'miny', 'maxx', 'maxy', 'cx', 'cy')))} FROM fitted", "fitted"),
    "count_cube": _sql(f"SELECT t, {KEYS}, flat_idx, count FROM ce", "ce"),
    "cube_totals": _sql(f"SELECT flat_idx, {KEYS}, sum(count) AS total FROM ce GROUP BY ALL", "ce"),
    "cube_means": _sql(f"SELECT flat_idx, {KEYS}, {_r('avg(count)', 'mean')} FROM ce GROUP BY ALL", "ce"),
    "active_cells": _sql(f"SELECT flat_idx, {KEYS}, sum(count) AS total, {_r('avg(count)', 'mean')} FROM ce GROUP BY flat_idx, {KEYS} HAVING sum(count) >= 10", "ce"),
    "time_slice": _sql("SELECT * FROM ce WHERE t = (SELECT max(t) FROM ce)", "ce"),
    "cell_series": _sql('SELECT * FROM ce WHERE "row" = 0 AND col = 0', "ce"),
    "panel": _sql("SELECT co.*, strftime(date_trunc('month', (SELECT min(datetime) FROM po)) + to_months(t), '%Y-%m') AS period FROM co", "co", "po"),
    "bbox": _sql(f"SELECT {_r('min(x)', 'minx')}, {_r('min(y)', 'miny')}, {_r('max(x)', 'maxx')}, {_r('max(y)', 'maxy')} FROM pe", "pe"),
    "type_counts": "SELECT event_type AS crime_type, count(*) AS n FROM events GROUP BY 1",
    "hexbin": _sql(
        """SELECT CASE WHEN da <= db THEN ax ELSE gx + 0.5 END AS hx, CASE WHEN da <= db THEN ay ELSE gy + 0.5 END AS hy, count(*) AS n FROM (
SELECT *, power(u - ax, 2) + 3 * power(v - ay, 2) AS da, power(u - gx - 0.5, 2) + 3 * power(v - gy - 0.5, 2) AS db FROM (
SELECT x / 500 AS u, y / (500 * power(3::DOUBLE, 0.5)) AS v, round(u) AS ax, round(v) AS ay, floor(u) AS gx, floor(v) AS gy FROM pe)) GROUP BY 1, 2""",
        "pe",
    ),
    "monthly_resample": _sql(
        """SELECT e.flat_idx AS cluster, strftime(date_trunc('month', (SELECT min(datetime) FROM po)) + to_months(m.t), '%Y-%m-%d') AS month, CAST(coalesce(n.n, 0) AS BIGINT) AS n
FROM (SELECT flat_idx, min(t) AS a, max(t) AS b FROM bo GROUP BY 1) e JOIN (SELECT DISTINCT t FROM co) m ON m.t BETWEEN e.a AND e.b LEFT JOIN (SELECT flat_idx, t, count(*) AS n FROM bo GROUP BY 1, 2) n ON n.flat_idx = e.flat_idx AND n.t = m.t""",
        "bo",
        "co",
        "po",
    ),
    "neighbour_lag": _sql(f"SELECT t, {KEYS}, deg, {_r('n_sum / deg', 'lag')} FROM le", "le"),
    "weight_edges": _sql('SELECT a.flat_idx AS src, b.flat_idx AS dst, 1.0::DOUBLE AS w, round(1.0::DOUBLE / count(*) OVER (PARTITION BY a.flat_idx), 6) AS w_std FROM fitted a JOIN fitted b ON a.flat_idx <> b.flat_idx AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1', "fitted"),
    "rook_edges": _sql('SELECT a.flat_idx AS src, b.flat_idx AS dst, 1.0::DOUBLE AS w, round(1.0::DOUBLE / count(*) OVER (PARTITION BY a.flat_idx), 6) AS w_std FROM fitted a JOIN fitted b ON abs(a."row" - b."row") + abs(a.col - b.col) = 1', "fitted"),
    "gi_star": _sql(f"SELECT t, {KEYS}, flat_idx, count, {_r('gi_z')} FROM ge", "ge"),
    "gi_star_summary": _sql(f"SELECT t, CAST(count(*) FILTER (WHERE round(gi_z, 9) > {Z}) AS BIGINT) AS hot, CAST(count(*) FILTER (WHERE round(gi_z, 9) < -{Z}) AS BIGINT) AS cold FROM ge GROUP BY t", "ge"),
    "gi_star_top": _sql(f"SELECT t, {KEYS}, flat_idx, count, {_r('gi_z')} FROM ge WHERE t = (SELECT max(t) FROM ge) ORDER BY ge.gi_z DESC, flat_idx LIMIT 10", "ge"),
    "mann_kendall": _sql(f"SELECT {KEYS}, n, {_r('s')}, {_r('z')}, trend, significant FROM mk", "mk"),
    "hotspot_category": _sql(f"SELECT flat_idx, {KEYS}, {_r('total_count')}, {_r('mean_gi_z')}, {_r('last_gi_z')}, {_r('mk_z')}, mk_trend, category FROM cat", "cat"),
    "category_summary": _sql("SELECT category, count(*) AS n FROM cat GROUP BY 1", "cat"),
    "moran_global": _sql(
        f"""SELECT {_r("i", "I")}, {_r("-1.0::DOUBLE / 99", "E_I")}, {_r("(i + 1.0::DOUBLE / 99) / sqrt(greatest(v, 1e-12))", "z")} FROM (
SELECT 100 / s0 * zwz / zz AS i, (100 * ((10000 - 300 + 3) * 2 * s0 - 100 * s2 + 3 * s0 * s0) - 100 * z4 / (zz * zz) * ((10000 - 100) * 2 * s0 - 200 * s2 + 6 * s0 * s0)) / (99.0 * 98 * 97 * s0 * s0) - power(1.0::DOUBLE / 99, 2) AS v FROM (
SELECT sum(z * (n_sum - deg * mean)) AS zwz, sum(z * z) AS zz, sum(power(z, 4)) AS z4, CAST(sum(deg) AS DOUBLE) AS s0, CAST(sum(4 * deg * deg) AS DOUBLE) AS s2 FROM (
SELECT c.count - s.mean AS z, s.mean, n.n_sum - c.count AS n_sum, n.deg - 1 AS deg FROM co c JOIN no n USING (t, flat_idx) CROSS JOIN (SELECT avg(count) AS mean FROM co WHERE t = (SELECT max(t) FROM co)) s WHERE c.t = (SELECT max(t) FROM co))))""",
        "co",
        "no",
    ),
    "lisa_stat": _sql(f"SELECT t, {KEYS}, flat_idx, {_r('z')}, {_r('lag')}, {_r('local_i')} FROM li", "li"),
    "lisa_quadrant": _sql(
        f"""SELECT t, {KEYS}, q AS quadrant_all, CASE WHEN s THEN q ELSE 0 END AS quadrant, CASE WHEN NOT s THEN 'ns' ELSE CASE q WHEN 1 THEN 'HH' WHEN 2 THEN 'LH' WHEN 3 THEN 'LL' WHEN 4 THEN 'HL' ELSE 'ns' END END AS label FROM (
SELECT *, abs(round(i_z, 9)) > {Z} AS s, CASE WHEN a > 0 AND b > 0 THEN 1 WHEN a < 0 AND b > 0 THEN 2 WHEN a < 0 AND b < 0 THEN 3 WHEN a > 0 AND b < 0 THEN 4 ELSE 0 END AS q FROM (SELECT *, round(z, 9) AS a, round(lag, 9) AS b FROM li))""",
        "li",
    ),
    "kde_grid": _sql(f"SELECT c.flat_idx, c.\"row\", c.col, {_r('1e8 * avg(exp(-(power(p.x - c.cx, 2) + power(p.y - c.cy, 2)) / 2e6)) / (2 * pi() * 1e6)', 'density')} FROM cells c CROSS JOIN pe p GROUP BY ALL", "cells", "pe"),
    "kde_bandwidth": _sql(f"SELECT {_r('stddev_pop(v) * power(count(*) / 2, -1.0 / 6)', 'bandwidth')} FROM (SELECT x AS v FROM pe UNION ALL SELECT y FROM pe)", "pe"),
    "ripley_k": _sql(f"SELECT distance, {_r('k', 'K')} FROM rk", "rk"),
    "ripley_l": _sql(f"SELECT distance, {_r('sqrt(k / pi()) - distance', 'L')} FROM rk", "rk"),
    "band_join_count": _sql(
        """SELECT a.event_id, count(*) AS n FROM (SELECT *, CAST(floor(x / 500) AS INTEGER) AS gx, CAST(floor(y / 500) AS INTEGER) AS gy FROM pe) a
JOIN (SELECT *, CAST(floor(x / 500) AS INTEGER) + i AS gx, CAST(floor(y / 500) AS INTEGER) + j AS gy FROM pe, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) b USING (gx, gy)
WHERE a.event_id <> b.event_id AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 500 AND abs(epoch_us(a.datetime) - epoch_us(b.datetime)) <= 86400000000 GROUP BY 1""",
        "pe",
    ),
    "cluster_summary": _sql(
        f"SELECT flat_idx AS cluster, count(*) AS n_events, strftime(min(datetime), '%Y-%m-%d') AS start_date, strftime(max(datetime), '%Y-%m-%d') AS end_date, {_r('avg(x)', 'centroid_x', 4)}, {_r('avg(y)', 'centroid_y', 4)}, CAST(floor(epoch(max(datetime) - min(datetime)) / 86400) AS INTEGER) AS duration_days FROM be GROUP BY 1 HAVING count(*) >= 8", "be"
    ),
    "stdbscan": _sql("SELECT event_id, cluster FROM cl_sc", "cl_sc"),
    "stdbscan_summary": _sql(
        f"SELECT cluster, count(*) AS n_events, strftime(min(datetime), '%Y-%m-%d') AS start_date, strftime(max(datetime), '%Y-%m-%d') AS end_date, {_r('avg(x) + 1e-7', 'centroid_x', 4)}, {_r('avg(y) + 1e-7', 'centroid_y', 4)}, CAST(floor(epoch(max(datetime) - min(datetime)) / 86400) AS INTEGER) AS duration_days FROM cl_sc JOIN pe USING (event_id) WHERE cluster >= 0 GROUP BY 1", "cl_sc"
    ),
    "mean_forecast": _sql(f"SELECT flat_idx, {KEYS}, {_r('yhat')}, {_r('lower')}, {_r('upper')} FROM mo", "mo"),
    "forecast_route": _sql(f"SELECT *, CASE WHEN total = 0 THEN 'zero' WHEN nonzero >= 8 AND n >= 12 THEN 'arima' WHEN nonzero >= 3 THEN 'ses' ELSE 'mean' END AS model FROM (SELECT flat_idx, {KEYS}, sum(count) AS total, count(*) FILTER (WHERE count > 0) AS nonzero, count(*) AS n FROM co WHERE t < 60 GROUP BY ALL)".replace("SELECT *,", f"SELECT flat_idx, {KEYS}, total, nonzero,"), "co"),
    "forecast_model_counts": _sql("SELECT CASE WHEN total = 0 THEN 'zero' WHEN nonzero >= 8 AND n >= 12 THEN 'arima' WHEN nonzero >= 3 THEN 'ses' ELSE 'mean' END AS model, count(*) AS n FROM (SELECT flat_idx, sum(count) AS total, count(*) FILTER (WHERE count > 0) AS nonzero, count(*) AS n FROM co WHERE t < 60 GROUP BY 1) GROUP BY 1", "co"),
    "gaussian_smooth": _sql(_smooth(), "mo"),
    "risk_surface": _sql(f"SELECT {KEYS}, {_r('yhat')}, {_r('CASE WHEN hi > lo THEN (mo.yhat - lo) / (hi - lo) ELSE 0.0 END', 'risk')} FROM mo, (SELECT min(yhat) AS lo, max(yhat) AS hi FROM mo)", "mo"),
    "hotspot_mask": _sql(f"SELECT {KEYS}, round(r, 9) >= round((SELECT quantile_cont(CASE WHEN h > l THEN (yhat - l) / (h - l) ELSE 0.0 END, 0.8) FROM mo, (SELECT min(yhat) AS l, max(yhat) AS h FROM mo)), 9) AS hotspot FROM (SELECT {KEYS}, CASE WHEN hi > lo THEN (yhat - lo) / (hi - lo) ELSE 0.0 END AS r FROM mo, (SELECT min(yhat) AS lo, max(yhat) AS hi FROM mo))", "mo"),
    "future_periods": _sql("SELECT t, strftime(s, '%Y-%m-%d') AS period_start, strftime(s, '%Y-%m') AS label FROM (SELECT CAST(unnest(range(60, 64)) AS INTEGER) AS t, date_trunc('month', (SELECT min(datetime) FROM po)) + to_months(CAST(t AS INTEGER)) AS s)", "po"),
    "reg_features": _sql(f"SELECT t, {KEYS}, flat_idx, y, y_lag1, {_r('sp_lag')}, trend, {_r('sin')}, {_r('cos')} FROM fe", "fe"),
    "ols_gram": _sql(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, {_r(f'sum({a} * {b})', 'value', 4)} FROM f1" for k, a in enumerate(GRAM_COLUMNS) for b in GRAM_COLUMNS[k:]), "fe").replace("\nSELECT 'one'", ",\nf1 AS MATERIALIZED (SELECT 1.0::DOUBLE AS one, * FROM fe WHERE t >= 1 AND t < 60)\nSELECT 'one'", 1),
    "gwr_features": _sql(
        f"""SELECT flat_idx, {KEYS}, cx, cy, y, y_lag, {_r("d / max(d) OVER ()", "dist_center")}, {_r("sin(2 * pi() * (tt % 12) / 12)", "seasonal")} FROM (
SELECT c.flat_idx, c."row", c.col, c.cx, c.cy, a.count AS y, b.count AS y_lag, sqrt(power(c.cx - 10000, 2) + power(c.cy - 10000, 2)) AS d, a.t AS tt FROM cells c JOIN co a USING (flat_idx) JOIN co b ON b.flat_idx = a.flat_idx AND b.t = a.t - 1 WHERE a.t = (SELECT max(t) - 1 FROM co))""",
        "cells",
        "co",
    ),
    "gwr_bandwidth_p25": _sql(f"SELECT {_r('quantile_cont(sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)), 0.25)', 'distance')} FROM fitted a JOIN fitted b ON a.flat_idx < b.flat_idx", "fitted"),
    **{name: _sql(f"SELECT {_r(name)} FROM sc", "sc") for name in ("hit_rate", "pai", "pei")},
    "rmse_mae": _sql(f"SELECT {_r('rmse')}, {_r('mae')} FROM er", "er"),
    "pearson_r": _sql(f"SELECT {_r('pearson_r')} FROM er", "er"),
    "report": _sql(f"SELECT {', '.join(map(_r, ('area_fraction', 'hit_rate', 'pai', 'pei', 'rmse', 'mae', 'pearson_r')))}, n_actual, 80.0::DOUBLE AS threshold_pct FROM sc, er", "sc", "er"),
    "pai_curve": _sql(f"SELECT percentile, {_r('area_fraction')}, {_r('hit_rate')}, {_r(PAI_OF, 'pai')} FROM pp", "pp"),
    "roc_curve": _sql(f"SELECT {_r('threshold')}, {_r(SHARE.format(a='fp', b='n'), 'fpr')}, {_r(SHARE.format(a='tp', b='p'), 'tpr')} FROM cum", "cum"),
    "auc": _sql(f"SELECT {_r('sum((x - px) * (y + py) / 2)', 'auc')} FROM (SELECT fp / n AS x, tp / p AS y, coalesce(lag(fp / n) OVER w, 0) AS px, coalesce(lag(tp / p) OVER w, 0) AS py FROM cum WINDOW w AS (ORDER BY threshold DESC))", "cum"),
    "pr_curve": _sql(f"SELECT {_r('threshold')}, {_r('tp / (tp + fp)', 'precision')}, {_r(SHARE.format(a='tp', b='p'), 'recall')} FROM cum", "cum"),
    "average_precision": _sql(f"SELECT {_r('sum((r - coalesce(pr, 0)) * q)', 'average_precision')} FROM (SELECT tp / p AS r, lag(tp / p) OVER (ORDER BY threshold DESC) AS pr, tp / (tp + fp) AS q FROM cum)", "cum"),
    "confusion": _sql(
        f"""SELECT "TP", "FP", "FN", "TN", {_r("p", "precision")}, {_r("r", "recall")}, {_r('("TP" + "TN") / ("TP" + "FP" + "FN" + "TN")', "accuracy")}, {_r("CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END", "f1")} FROM (
SELECT *, {SHARE.format(a='"TP"', b='("TP" + "FP")')} AS p, {SHARE.format(a='"TP"', b='("TP" + "FN")')} AS r FROM (
SELECT count(*) FILTER (WHERE h AND a) AS "TP", count(*) FILTER (WHERE h AND NOT a) AS "FP", count(*) FILTER (WHERE NOT h AND a) AS "FN", count(*) FILTER (WHERE NOT h AND NOT a) AS "TN" FROM (
SELECT round(pred, 9) >= round((SELECT quantile_cont(pred, 0.8) FROM pa), 9) AS h, actual > 20 AS a FROM pa)))""",
        "pa",
    ),
    "most_active_cells": _sql(f"SELECT flat_idx, {KEYS}, sum(count) AS total, {_r('avg(count)', 'mean')} FROM ce GROUP BY flat_idx, {KEYS} HAVING sum(count) >= 10 ORDER BY total DESC, flat_idx LIMIT 3", "ce"),
    "forecast_summed": _sql(f"SELECT {KEYS}, {_r('sum(count)', 'count')} FROM co WHERE t >= 60 GROUP BY ALL", "co"),
    "compare_models": _sql(
        f"""SELECT 'Mean' AS model, {', '.join(map(_r, ('hit_rate', 'pai', 'pei', 'rmse', 'mae', 'pearson_r')))} FROM sc, er
UNION ALL SELECT 'Naive', 1.0, 1.0, 0.0, {_r("(SELECT stddev_pop(actual) FROM pa)", "rmse")}, {_r("(SELECT avg(abs(actual - (SELECT avg(actual) FROM pa))) FROM pa)", "mae")}, 0.0""",
        "sc",
        "er",
    ),
    "geojson_cells": _sql("SELECT flat_idx, CAST(flat_idx AS VARCHAR) AS id, round(maxx, 6) AS first_x FROM fitted", "fitted"),
    "map_values": _sql("SELECT CAST(flat_idx AS VARCHAR) AS id, sum(count) AS value FROM ce GROUP BY flat_idx", "ce"),
}


def _body(name: str) -> str:
    """The statement of a query after its table expressions."""
    return f"({ORACLES[name]})"


ORACLES["largest_clusters"] = f"SELECT * FROM {_body('cluster_summary')} ORDER BY n_events DESC, cluster LIMIT 10"
ORACLES["validation_bundle"] = f"SELECT * FROM {_body('report')}, {_body('auc')}, {_body('average_precision')}, {_body('confusion')}"
ORACLES["compare_in_full"] = f"SELECT 'Mean' AS model, pai, hit_rate, auc, f1, \"precision\", recall, rmse, mae FROM {_body('report')}, {_body('auc')}, {_body('confusion')}"
ORACLES["neighbour_count"] = ORACLES["band_join_count"]
