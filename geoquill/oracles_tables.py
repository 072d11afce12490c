"""Handwritten SQL for queries that join: stored grids, parameters by time, neighbours, crossings, states of streams."""

from __future__ import annotations

from .oracles import _geocentric, points, pts


def stored() -> dict[str, str]:
    near = "(lon BETWEEN 7.5 AND 16.5 AND lat BETWEEN 53.5 AND 58.5)"  # half a cell beyond is still taken
    out = lambda lon, lat, h, area="nordic": f"{pts(area)} SELECT k, round({lon}, 8) + 0.0 AS lon_out, round({lat}, 8) + 0.0 AS lat_out, round({h}, 5) + 0.0 AS h_out FROM pts"
    # shifts are the position itself in seconds, so the inverse is a division
    back = out("lon / (1 + 1 / 3600::DOUBLE)", "lat / (1 + 1 / 3600::DOUBLE)", "h")
    geoid = out("lon", "lat", "h - (lat - lon / 10)")
    shift = f"CASE WHEN {near} THEN 1 / 3600::DOUBLE ELSE 0 END"
    return {
        "gridshift_store": out(f"lon + lon * {shift}", f"lat + lat * {shift}", "h", "world"), "gridshift_store_inv": back, "geoid_store": geoid,
        "grid_ntv2": back, "grid_gtx": geoid, "grid_gravsoft": back, "grid_gsa": back, "grid_geotiff": back,
    }


def by_time() -> str:
    """Parameters of the last error event of the user, by DuckDB's own join."""
    x, y, z = _geocentric()
    turn = "radians(e.value / 7 / 3600)"
    grow = "(1 + (e.k % 5 - 2) * 1e-6::DOUBLE)"
    moved = [f"{grow} * (g.gx + {turn} * g.gy) + e.value", f"{grow} * (g.gy - {turn} * g.gx)", f"{grow} * g.gz"]
    out = ", ".join(f"round({v}, 3) + 0.0 AS {n}" for v, n in zip(moved, "xyz", strict=True))
    return f"""WITH p0 AS (SELECT ts, user_id, event_type, value, {points('nordic', 'events', 'event_id')[7:]}), pts AS (SELECT *, radians(lat) AS phi, radians(lon) AS lam FROM p0),
    g AS (SELECT *, {x} AS gx, {y} AS gy, {z} AS gz FROM pts WHERE event_type <> 'error'), e AS (SELECT * FROM pts WHERE event_type = 'error')
    SELECT g.k AS k, {out}, e.k IS NOT NULL AS ok FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.ts >= e.ts"""


def leg(table: str, key: str, mix: int) -> str:
    return f"SELECT k AS id, lon AS x1, lat AS y1, lon + ((k + {mix}) * {mix} % 401 - 200) / 1000::DOUBLE AS x2, lat + (k * {mix + 16} % 401 - 200) / 1000::DOUBLE AS y2 FROM ({points('nordic', table, key)})"


def crossed(a: str, b: str, condition: str) -> str:
    """All pairs; the parameter along each segment by Cramer's rule. Ends and parallel segments lie beyond the data."""
    return f"""WITH a AS ({a}), b AS ({b}), p AS (
      SELECT a.id AS id1, b.id AS id2, a.x1, a.y1, a.x2 - a.x1 AS ux, a.y2 - a.y1 AS uy, b.x2 - b.x1 AS vx, b.y2 - b.y1 AS vy, b.x1 - a.x1 AS wx, b.y1 - a.y1 AS wy FROM a JOIN b ON {condition}
    ), q AS (SELECT *, ux * vy - uy * vx AS bend FROM p), r AS (SELECT *, (wx * vy - wy * vx) / bend AS s, (wx * uy - wy * ux) / bend AS t FROM q WHERE abs(bend) > 1e-12)
    SELECT id1, id2, round(x1 + s * ux, 6) + 0.0 AS x, round(y1 + s * uy, 6) + 0.0 AS y FROM r WHERE s BETWEEN -1e-9 AND 1 + 1e-9 AND t BETWEEN -1e-9 AND 1 + 1e-9"""


def sql(known: dict[str, str]) -> dict[str, str]:
    ours, theirs = leg("customer", "c_custkey", 37), leg("supplier", "s_suppkey", 91)
    return stored() | {"leg_crossings": crossed(ours, ours, "a.id < b.id"), "leg_crossings_between": crossed(ours, theirs, "true"), "helmert_by_time": by_time(), "deformation_store": known["deformation_fwd"], "deflection_store": known["deflection_fwd"]}
