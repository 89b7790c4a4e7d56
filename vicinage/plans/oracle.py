"""The oracle's SQL text, written independently of the Spark expressions: vertices as rows, window sums, recursion."""

from __future__ import annotations

from vicinage.plans.fixtures import ORACLE_MS, VIEWS

A2, B2 = "(6378137e0 * 6378137e0)", "(6356752.314245179e0 * 6356752.314245179e0)"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def fixture(*names: str) -> list[str]:
    """CTEs of the named views, what they need first."""
    if set(names) & {"raw_capture", "raw_feature"}:
        names = ("geo_query", *(n for n in names if n != "geo_query"))
    return [f"{n} AS ({VIEWS[n].format(ms=ORACLE_MS)})" for n in names]


def normal(lat: str) -> str:
    return f"({A2} / sqrt({A2} * cos(radians({lat})) * cos(radians({lat})) + {B2} * sin(radians({lat})) * sin(radians({lat}))))"


def ecef(lat: str, lon: str, h: str = "0e0") -> tuple[str, str, str]:
    n = normal(lat)
    return (f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))", f"(({n} * ({B2} / {A2}) + {h}) * sin(radians({lat})))")


def enu_cte(name: str, source: str, lat: str = "lat", lon: str = "lon", ele: str = "0e0") -> str:
    """``source`` (with lat0, lon0) and the columns e, n, u."""
    x, y, z = ecef(lat, lon, ele)
    x0, y0, z0 = ecef("lat0", "lon0")
    p, q = "radians(lat0)", "radians(lon0)"
    return f"""{name}_d AS (SELECT *, {x} - {x0} AS dx_, {y} - {y0} AS dy_, {z} - {z0} AS dz_ FROM {source}),
{name} AS (SELECT *, -sin({q}) * dx_ + cos({q}) * dy_ AS e, -sin({p}) * (cos({q}) * dx_ + sin({q}) * dy_) + cos({p}) * dz_ AS n,
  cos({p}) * (cos({q}) * dx_ + sin({q}) * dy_) + sin({p}) * dz_ AS u FROM {name}_d)"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2e0 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))"


def rnd(x: str, digits: int) -> str:
    return f"(round({x}, {digits}) + 0e0)"


#: Features to vertices: part 0, and a second part of half the size for a MultiPolygon.
VERTICES = """part_shape AS (
  SELECT osm_id, qid, 0 AS part, x0, y0, w, h, l_shape FROM raw_feature WHERE geom_type <> 'Point'
  UNION ALL SELECT osm_id, qid, 1, x0 + w * 2, y0, w / 2, h / 2, l_shape FROM raw_feature WHERE geom_type = 'MultiPolygon'),
vertex AS (
  SELECT osm_id, qid, part, k, CASE k WHEN 0 THEN x0 WHEN 1 THEN x0 + w WHEN 2 THEN x0 + w WHEN 3 THEN CASE WHEN l_shape THEN x0 + w / 2 ELSE x0 END
      WHEN 4 THEN CASE WHEN l_shape THEN x0 + w / 2 ELSE x0 END ELSE x0 END AS lon,
    CASE k WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN CASE WHEN l_shape THEN y0 + h / 2 ELSE y0 + h END WHEN 3 THEN CASE WHEN l_shape THEN y0 + h / 2 ELSE y0 + h END
      WHEN 4 THEN CASE WHEN l_shape THEN y0 + h ELSE y0 END WHEN 5 THEN y0 + h ELSE y0 END AS lat
  FROM part_shape, range(7) r(k) WHERE l_shape OR k < 5),
degree_area AS (
  SELECT osm_id, part, abs(sum(lon * next_lat - lat * next_lon)) / 2 AS a FROM (
    SELECT *, lead(lon, 1, lon) OVER w AS next_lon, lead(lat, 1, lat) OVER w AS next_lat FROM vertex WINDOW w AS (PARTITION BY osm_id, part ORDER BY k))
  GROUP BY osm_id, part),
largest AS (SELECT osm_id, arg_max(part, (a, -part)) AS part FROM degree_area GROUP BY osm_id),
ring AS (SELECT v.*, q.lat0, q.lon0 FROM vertex v JOIN largest USING (osm_id, part) JOIN geo_query q USING (qid))"""

MEASURES = """edge AS (SELECT *, lead(e, 1, e) OVER w AS e1, lead(n, 1, n) OVER w AS n1 FROM enu WINDOW w AS (PARTITION BY osm_id ORDER BY k)),
measure AS (
  SELECT qid, osm_id, abs(sum(e * n1 - n * e1)) / 2 AS area_m2, sum((e + e1) * (e * n1 - n * e1)) / (3 * sum(e * n1 - n * e1)) AS ce,
    sum((n + n1) * (e * n1 - n * e1)) / (3 * sum(e * n1 - n * e1)) AS cn FROM edge GROUP BY qid, osm_id)"""


def footprint_ctes() -> list[str]:
    return [*fixture("geo_query", "raw_feature"), VERTICES, enu_cte("enu", "ring"), MEASURES]


HEIGHT = """height AS (
  SELECT *, CASE WHEN v > 0 AND v <= 1000 THEN v END AS tag_m,
    TRY_CAST(round_even(TRY_CAST(nullif(regexp_extract(lower(levels_tag), '^[ ]*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]+)?)[ ]*$', 1), '') AS DOUBLE), 0) AS INTEGER) AS levels
  FROM (SELECT *, TRY_CAST(nullif(regexp_extract(lower(height_tag), rx_, 1), '') AS DOUBLE) * CASE WHEN regexp_extract(lower(height_tag), rx_, 2) <> '' THEN 0.3048e0 ELSE 1e0 END AS v
    FROM raw_feature, (SELECT '^[ ]*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]+)?)[ ]*([ft]*''+|[ft]*ft)?[ ]*(m| meters| metres)?[ ]*$' AS rx_))),
height_of AS (
  SELECT *, coalesce(tag_m, CASE WHEN levels > 0 THEN levels * 3.5e0 END) AS height_m,
    CASE WHEN tag_m IS NOT NULL THEN 'tag' WHEN levels > 0 THEN 'levels' ELSE 'none' END AS height_source FROM height)"""

DEDUP = "once AS (SELECT * FROM raw_capture WHERE raw_id <> '' QUALIFY row_number() OVER (PARTITION BY qid, raw_id ORDER BY arrival) = 1)"
PLACED = "placed AS (SELECT o.*, q.lat0, q.lon0 FROM once o JOIN geo_query q USING (qid) WHERE lat IS NOT NULL AND lon IS NOT NULL AND captured_ms IS NOT NULL)"


def image_ctes() -> list[str]:
    return [*fixture("geo_query", "raw_capture"), DEDUP, PLACED, enu_cte("img", "placed")]


def sample_ctes(k: int, least: float | None = None, hidden: str = "grp") -> list[str]:
    """Greedy farthest-point sampling as a recursion that carries the running minima as a list."""
    stop = f" AND list_max(gap) >= {least}e0" if least is not None else ""
    small = "" if least is not None else f" WHERE len(p) > {k}"
    return [
        f"{hidden} AS (SELECT qid, list({{'id': raw_id, 'e': e, 'n': n, 'c': compass}} ORDER BY arrival) AS p FROM img GROUP BY qid)",
        f"""walk(qid, step, sel, gap) AS (
  SELECT qid, 1, 1::BIGINT, list_transform(p, lambda x, i: CASE WHEN i = 1 THEN -1e0 ELSE sqrt((x.e - p[1].e) * (x.e - p[1].e) + (x.n - p[1].n) * (x.n - p[1].n))
      + 0.44e0 * coalesce(least(abs(x.c - p[1].c), 360e0 - abs(x.c - p[1].c)), 0e0) END) FROM {hidden}{small}
  UNION ALL
  SELECT qid, step + 1, nxt, list_transform(p, lambda x, i: CASE WHEN i = nxt OR gap[i] < 0 THEN -1e0 ELSE least(gap[i], sqrt((x.e - p[nxt].e) * (x.e - p[nxt].e) + (x.n - p[nxt].n) * (x.n - p[nxt].n))
      + 0.44e0 * coalesce(least(abs(x.c - p[nxt].c), 360e0 - abs(x.c - p[nxt].c)), 0e0)) END)
  FROM (SELECT w.qid, step, gap, p, list_position(gap, list_max(gap))::BIGINT AS nxt FROM walk w JOIN {hidden} g ON g.qid = w.qid WHERE step < {k} AND list_max(gap) >= 0{stop}))""",
        f"""chosen AS (
  SELECT w.qid, w.step::INTEGER AS rank, g.p[w.sel].id AS image_id FROM walk w JOIN {hidden} g ON g.qid = w.qid"""
        + ("" if least is not None else f" UNION ALL SELECT qid, i::INTEGER, p[i].id FROM {hidden}, range(1, {k} + 1) r(i) WHERE len(p) <= {k} AND i <= len(p)")
        + ")",
    ]
