import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vicinage.functions.geo import haversine_m
from vicinage.operators import cells, images, sampling
from vicinage.plans import retrieval, stages
from vicinage.plans.fixtures import features, view
from vicinage.sources import bronze, cache, cellsource, featuresource
from vicinage.sources.figure import svg
from vicinage.sources.files import Thumbnails, download, lookup

ORIGIN = (47.6059, -122.3392)


def payload(n, seed=0):
    rng = np.random.default_rng(seed)
    return [{"id": str(1000 + i), "geometry": {"type": "Point", "coordinates": [ORIGIN[1] + rng.uniform(-0.0012, 0.0012), ORIGIN[0] + rng.uniform(-0.0008, 0.0008)]}, "compass_angle": None if i % 5 == 0 else float(rng.uniform(0, 360)), "captured_at": 1_600_000_000_000 + i} for i in range(n)]


def frames(spark):
    return spark.createDataFrame([(0, *ORIGIN, 150.0)], "qid int, lat0 double, lon0 double, radius_m double")


def raw_of(spark, items):
    rows = [(i, json.dumps(x), 0) for i, x in enumerate(items)]
    return images.parse_json(spark.createDataFrame(rows, "arrival long, payload string, qid int")).withColumn("sequence_id", F.lit(0).cast("long"))


def test_twenty_items_ten_sampled(spark):
    got = retrieval.street_images(raw_of(spark, payload(20)), frames(spark), target_count=10).collect()
    assert len(got) == 10 and all(abs(r.e) < 200 and abs(r.n) < 200 for r in got)
    whole = retrieval.street_images(raw_of(spark, payload(20)), frames(spark), target_count=30).collect()
    assert len(whole) == 20 and any(r.compass_deg is None for r in whole) and any(r.compass_deg is not None for r in whole)


def test_malformed_items_are_skipped(spark):
    good, no_place, no_time, bad_compass = payload(4)
    del no_place["geometry"], no_time["captured_at"]
    bad_compass["compass_angle"] = "north"
    got = retrieval.street_images(raw_of(spark, [good, no_place, no_time, bad_compass]), frames(spark)).collect()
    assert [r.image_id for r in got] == ["1000"]
    assert retrieval.street_images(raw_of(spark, []), frames(spark)).count() == 0


def test_times_are_utc(spark):
    got = images.parse(raw_of(spark, payload(1)), frames(spark)).select(F.unix_millis("captured_at")).first()[0]
    assert got == 1_600_000_000_000


def test_first_arrival_wins(spark):
    raw = spark.createDataFrame([(5, "a", 0, 1.0), (2, "a", 0, 2.0), (3, "", 0, 3.0), (4, None, 0, 4.0), (9, "a", 1, 5.0)], "arrival long, raw_id string, qid int, lat double")
    assert sorted((r.qid, r.raw_id, r.arrival, r.lat) for r in images.dedup_by_id(raw).collect()) == [(0, "a", 2, 2.0), (1, "a", 9, 5.0)]


def test_farthest_point_sampling():
    line = np.arange(100.0)
    none = np.full(100, np.nan)
    assert sampling.farthest(line[:5], line[:5] * 0, none[:5], 10) == [0, 1, 2, 3, 4]
    got = sampling.farthest(line, line * 0, none, 5, sampling.random_start(100, 42))
    assert len(set(got)) == 5 and min(got) < 20 and max(got) > 80
    assert got == sampling.farthest(line, line * 0, none, 5, sampling.random_start(100, 42))
    assert sampling.farthest(line, line * 0, none, 0) == [0] and sampling.farthest(line[:0], line[:0], none[:0], 3) == []
    turned = sampling.farthest(np.zeros(4), np.zeros(4), np.array([0.0, 10.0, 180.0, 350.0]), 2)
    assert turned == [0, 2]
    assert len(sampling.farthest(line, line * 0, none, 50, min_separation=30.0)) == 3


def test_native_sampling_agrees(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"qid": rng.integers(0, 3, 200).astype(np.int32), "arrival": np.arange(200), "image_id": [f"i{k}" for k in range(200)], "e": rng.uniform(-100, 100, 200), "n": rng.uniform(-100, 100, 200), "compass_deg": np.where(np.arange(200) % 4 == 0, np.nan, rng.uniform(0, 360, 200))})
    df = spark.createDataFrame(pdf).withColumn("compass_deg", F.when(~F.isnan("compass_deg"), F.col("compass_deg")))
    a = {(r.qid, r.rank): r.image_id for r in sampling.sample(df, 12, None).collect()}
    assert a == {(r.qid, r.rank): r.image_id for r in sampling.sample_hof(df, 12).collect()} and len(a) == 36


def test_range_join_equals_nested_loop(spark, small):
    queries, points = view(spark, small, "geo_query"), view(spark, small, "raw_capture").where("lat is not null").select("arrival", "lat", "lon")
    got = {(r.qid, r.arrival) for r in cells.range_join(queries, points).collect()}
    from vicinage.functions.geo import haversine_m

    want = queries.crossJoin(points).where(haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")) <= F.col("radius_m"))
    assert got == {(r.qid, r.arrival) for r in want.collect()} and got
    plan = cells.range_join(queries, points)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quadtree_equals_recursion(spark):
    rng = np.random.default_rng(1)
    w, s = ORIGIN[1] - 0.001, ORIGIN[0] - 0.001
    pts = [(0, float(w + 0.002 * rng.beta(1, 6)), float(s + 0.002 * rng.beta(1, 6))) for _ in range(900)]
    df = spark.createDataFrame(pts, "qid int, lon double, lat double")
    from vicinage.functions.geo import radius_box

    q = frames(spark)
    b = q.select(radius_box(F.col("lat0"), F.col("lon0"), F.col("radius_m")).alias("b")).first().b
    items = [{"geometry": {"coordinates": [x, y]}} for _, x, y in pts]
    for cap in (20, 60, 2000):
        assert sum(r.n_rows for r in cells.quadtree(df, q, cap).collect()) == len(list(cellsource.scan((b.w, b.s, b.e, b.n), cellsource.replay(items, cap), limit=10**6)))


def test_cell_source_reads_in_parts(spark):
    spark.dataSource.register(cellsource.CellSource)
    items = payload(120)
    boxes = {"0": [ORIGIN[1] - 0.002, ORIGIN[0] - 0.002, ORIGIN[1] + 0.002, ORIGIN[0] + 0.002]}
    df = spark.read.format("image_cells").options(boxes=json.dumps(boxes), items=json.dumps(items), dense="20").load()
    assert df.rdd.getNumPartitions() == 4
    assert sorted(json.loads(r.payload)["id"] for r in df.collect()) == sorted(x["id"] for x in items)


def test_given_up_cells_and_other_errors():
    def always(box, limit):
        raise cellsource.CellTooDense

    assert list(cellsource.scan((0, 0, 1, 1), always)) == []

    def broken(box, limit):
        raise OSError("403")

    with pytest.raises(OSError):
        list(cellsource.scan((0, 0, 1, 1), broken))


def test_token(monkeypatch):
    for value in ("", "your_token_here", "abc"):
        monkeypatch.setenv("IMAGE_API_TOKEN", value)
        with pytest.raises(cellsource.ConfigError):
            cellsource.token()
    monkeypatch.setenv("IMAGE_API_TOKEN", " MLY|1|2 ")
    assert cellsource.token() == "MLY|1|2"


def test_cache_keys(spark):
    """The digest is taken of the whole key."""
    at = (47.60969, -122.3331, 150.9)
    whole = "osm_buildings_47.6097_-122.3331_r150"
    assert cache.building_key(*at) == f"{whole}_{hashlib.md5(whole.encode()).hexdigest()[:8]}"
    assert cache.building_key(47.6062, -122.3321, 150) == "osm_buildings_47.6062_-122.3321_r150_19179a5f"
    assert cache.image_key(*at) == "raw_47.6097_-122.3331_r150"
    row = spark.range(1).select(cache.building_key_column(*map(F.lit, at)).alias("b"), cache.image_key_column(*map(F.lit, at)).alias("i")).first()
    assert (row.b, row.i) == (cache.building_key(*at), cache.image_key(*at))
    assert len(cache.distinct_keys([(1.00001, 2, 3), (1.00002, 2, 3), (1.1, 2, 3)])) == 2


def test_fetch_cache(spark, tmp_path):
    """Cold, warm, a new query beside a known one, an empty result, queries of one key, and a bypass that is kept."""
    calls = []

    def scan(queries):
        calls.append(sorted(r.qid for r in queries.collect()))
        return queries.where("radius_m > 1").select("qid", F.concat(F.lit(f"{len(calls)}:"), F.col("lat0").cast("string")).alias("payload"))

    c = cache.FetchCache(spark, str(tmp_path / "cache"))
    q = lambda *rows: spark.createDataFrame(rows, "qid int, lat0 double, lon0 double, radius_m double")
    get = lambda queries, **more: sorted(tuple(r) for r in c.fetch("x", queries, cache.image_key_column, scan, **more).select("qid", "payload").collect())
    assert c.fetch("x", q().limit(0), cache.image_key_column, scan).count() == 0
    calls.clear()
    first = q((1, 47.0, 8.0, 150.0), (2, 47.00001, 8.0, 150.2), (3, 48.0, 8.0, 0.5))
    assert get(first) == [(1, "1:47.0"), (2, "1:47.0")] and calls == [[1, 3]]
    assert get(first) == [(1, "1:47.0"), (2, "1:47.0")] and len(calls) == 1
    assert get(q((7, 47.0, 8.0, 150.9), (8, 49.0, 8.0, 9.0))) == [(7, "1:47.0"), (8, "2:49.0")] and calls[1] == [8]
    assert get(first, use_cache=False) == [(1, "3:47.0"), (2, "3:47.0")] and calls[2] == [1, 3]
    assert get(first) == [(1, "3:47.0"), (2, "3:47.0")] and len(calls) == 3


def test_building_source(spark, tmp_path):
    """The scan of recorded buildings around two points, through the cache and the stage."""
    def square(k, lat, lon):
        ring = [[lon, lat], [lon + 2e-4, lat], [lon + 2e-4, lat + 2e-4], [lon, lat + 2e-4], [lon, lat]]
        return {"type": "Feature", "properties": {"osmid": k, "building": "yes", "height": str(k)}, "geometry": {"type": "Polygon", "coordinates": [ring]}}

    feats = [square(5, 47.6, -122.3), square(6, 47.61, -122.3), square(7, 47.7, -122.3), {"type": "Feature", "properties": {}, "geometry": None}]
    queries = spark.createDataFrame([(0, 47.6, -122.3, 150.0), (1, 47.61, -122.3, 150.0)], "qid int, lat0 double, lon0 double, radius_m double")
    scan = featuresource.scanner(features=json.dumps(feats))
    assert scan(queries).rdd.getNumPartitions() == 2
    options = {"cache": cache.FetchCache(spark, str(tmp_path / "c"))}
    for source in (scan, lambda queries: pytest.fail("known")):
        got = stages.run("osm", {"queries": queries, "feature_scan": source}, options).tables["osm"]
        assert {(r.qid, r.osm_id, r.height_m) for r in got.collect()} == {(0, 5, 5.0), (1, 6, 6.0)}


def test_overpass_elements():
    ring = [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 1.0}, {"lat": 1.0, "lon": 1.0}, {"lat": 0.0, "lon": 0.0}]
    way = featuresource.feature_of({"type": "way", "id": 4, "tags": {"building": "yes"}, "geometry": ring})
    assert way["properties"] == {"building": "yes", "osmid": 4} and way["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    many = featuresource.feature_of({"type": "relation", "id": 5, "members": [{"role": "outer", "geometry": ring}, {"role": "inner", "geometry": ring}]})
    assert many["geometry"]["type"] == "MultiPolygon" and len(many["geometry"]["coordinates"]) == 1
    assert featuresource.feature_of({"type": "node", "id": 6, "lat": 1.0, "lon": 2.0})["geometry"] == {"type": "Point", "coordinates": [2.0, 1.0]}
    assert featuresource.feature_of({"type": "relation", "id": 7, "members": []}) is None and featuresource.feature_of({"type": "way", "id": 8}) is None


def test_thumbnail_store(spark, tmp_path):
    """What is stored isn't fetched again; an image whose download fails has no path."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(url):
        (asked / f"{url}-{len(list(asked.iterdir()))}").touch()
        if url == "bad":
            raise OSError
        return url.encode()

    store = Thumbnails(spark, str(tmp_path / "thumbs"))
    df = spark.createDataFrame([("a", "good", "p/a"), ("b", "bad", "p/b"), ("c", "", None)], "image_id string, thumb_url string, thumb_path string").coalesce(1)
    for _ in range(2):
        got = store.add(df, fetch)
        assert got.columns == df.columns and {r.image_id: r.thumb_path for r in got.collect()} == {"a": "p/a", "b": None, "c": None}
    names = sorted(x.name.split("-")[0] for x in asked.iterdir())
    assert names == ["bad", "bad", "good"] and [bytes(r.content) for r in store.stored().collect()] == [b"good"]


def test_thumbnails_are_looked_up_for_the_sample_only(spark, tmp_path):
    def fetch(image_id):
        (tmp_path / image_id).touch()
        if image_id == "1001":
            raise OSError
        return f"u{image_id}"

    got = retrieval.street_images(raw_of(spark, payload(20)), frames(spark), lookup(fetch), target_count=6).collect()
    assert len(got) == 6 and {r.image_id for r in got} == {x.name for x in tmp_path.iterdir()}
    assert all((r.thumb_url, r.thumb_path) == (("", None) if r.image_id == "1001" else (f"u{r.image_id}", f"thumbnails/{r.image_id}.jpg")) for r in got)


def test_sampling_few(spark):
    """Both forms give one image for a count of 0 or 1, as long as there is any."""
    df = images.parse(raw_of(spark, payload(6)), frames(spark))
    for k in (0, 1, 2, 5, 6, 9):
        a = {(r.qid, r.rank): r.image_id for r in sampling.sample(df, k, None).collect()}
        assert a == {(r.qid, r.rank): r.image_id for r in sampling.sample_hof(df, k).collect()} and len(a) == max(1, min(k, 6))


def test_sampling_starts_as_seeded(spark):
    df = images.parse(raw_of(spark, payload(40)), frames(spark))
    first = lambda **more: [r.image_id for r in sampling.sample(df, 5, **more).orderBy("rank").collect()]
    order = [r.image_id for r in df.orderBy("arrival").collect()]
    assert first() == first(seed=0) and first()[0] == order[int(np.random.default_rng(0).integers(len(order)))] and first(seed=None)[0] == order[0]


def test_dedup_ties_go_to_the_least_row(spark):
    df = spark.createDataFrame([(0, "a", 5, 2.0), (0, "a", 5, 1.0), (0, "", 1, 0.0)], "qid int, raw_id string, arrival long, lat double")
    assert [tuple(r) for r in images.dedup_by_id(df).collect()] == [(0, "a", 5, 1.0)]


def test_range_join_of_large_radii(spark):
    """Cells follow the radius, so a query never spreads over many."""
    queries = spark.createDataFrame([(0, 47.6, -122.3, 200_000.0)], "qid int, lat0 double, lon0 double, radius_m double")
    points = spark.range(500).selectExpr("id AS arrival", "47.6 + (id % 20 - 10) * 0.4 AS lat", "-122.3 + (id / 20 - 12) * 0.4 AS lon")
    got = {r.arrival for r in cells.range_join(queries, points).collect()}
    want = {r.arrival for r in points.crossJoin(queries).where(haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")) <= F.col("radius_m")).collect()}
    assert got == want and 0 < len(want) < 500


def test_no_views_are_left_behind(spark, small):
    before = {t.name for t in spark.catalog.listTables()}
    entry.queries()["win_rate"](spark, small).collect()
    assert {t.name for t in spark.catalog.listTables()} <= before


def test_thumbnails(spark):
    df = spark.createDataFrame([("a", "u1"), ("b", None)], "image_id string, url string")
    chosen = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    got = {r.image_id: (r.thumb_url, r.thumb_path) for r in images.with_thumbs(chosen, df).collect()}
    assert got == {"a": ("u1", "thumbnails/a.jpg"), "b": ("", None), "c": ("", None)}

    def fetch(url):
        if url == "bad":
            raise OSError
        return url.encode()

    files = download(spark.createDataFrame([("p1", "good"), ("p2", "bad"), ("p3", "")], "thumb_path string, thumb_url string"), fetch)
    assert {r.path: (r.ok, r.content and bytes(r.content)) for r in files.collect()} == {"p1": (True, b"good"), "p2": (False, None)}


def test_geojson(spark, tmp_path):
    def box(x, y, w, h):
        return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]

    lat, lon = 47.6097, -122.3331
    feats = [
        {"type": "Feature", "properties": {"osmid": 1, "building": "yes", "height": "12"}, "geometry": {"type": "Polygon", "coordinates": [box(lon, lat, 0.0002, 0.0002)]}},
        {"type": "Feature", "properties": {"osmid": 2, "building:levels": "3"}, "geometry": {"type": "MultiPolygon", "coordinates": [[box(lon, lat, 0.0001, 0.0001)], [box(lon + 0.001, lat, 0.0003, 0.0002)]]}},
        {"type": "Feature", "properties": {"osmid": 3, "height": "5"}, "geometry": {"type": "Polygon", "coordinates": [box(lon, lat, 0.00002, 0.00002)]}},
        {"type": "Feature", "properties": {"osmid": 4}, "geometry": {"type": "Point", "coordinates": [lon, lat]}},
    ]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    (tmp_path / "i.json").write_text(json.dumps(payload(12)))
    f = bronze.read_features(spark, str(tmp_path / "f.geojson")).withColumn("qid", F.lit(0))
    q = spark.createDataFrame([(0, lat, lon, 150.0)], "qid int, lat0 double, lon0 double, radius_m double")
    got = {r.osm_id: (r.height_m, r.height_source, r.building_type) for r in retrieval.buildings(f, q).collect()}
    assert got == {1: (12.0, "tag", "yes"), 2: (10.5, "levels", "yes")}
    items = images.parse_json(bronze.read_image_items(spark, str(tmp_path / "i.json"))).withColumns({"qid": F.lit(0), "sequence_id": F.lit(None).cast("long")})
    assert retrieval.street_images(items, frames(spark)).count() == 12


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import vicinage.__main__ as cli

    (tmp_path / "i.json").write_text(json.dumps({"data": payload(8)}))
    (tmp_path / "f.geojson").write_text(json.dumps({"features": []}))
    (tmp_path / "pic").write_bytes(b"jpg")
    (tmp_path / "urls.json").write_text("\n".join(json.dumps({"image_id": x["id"], "url": f"file://{tmp_path}/pic"}) for x in payload(8)[:5]))
    assert cli.main(["--list-stages"]) == 0 and "osm" in capsys.readouterr().out
    place = ["--lat", str(ORIGIN[0]), "--lon", str(ORIGIN[1]), "--out", str(tmp_path / "out"), "--cache", str(tmp_path / "cache"), "--thumb-urls", str(tmp_path / "urls.json"), "--thumbnails", str(tmp_path / "thumbs")]
    args = [*place, "--features", str(tmp_path / "f.geojson"), "--images", str(tmp_path / "i.json")]
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert cli.main([*args, "--no-download"]) == 0
    assert read("layer_images").count() == 8 and read("osm").count() == 0 and read("mapillary").where("thumb_path is not null").count() == 0
    assert cli.main([*args, "--figure", str(tmp_path / "f.svg"), "--title", "a < b"]) == 0 and read("mapillary").where("thumb_path is not null").count() == 5
    drawn = (tmp_path / "f.svg").read_text()
    assert drawn.count("<circle") == 8 + 1 and "a &lt; b" in drawn and drawn.endswith("</svg>\n")
    assert spark.read.parquet(str(tmp_path / "thumbs")).count() == 5
    (tmp_path / "i.json").write_text(json.dumps({"data": payload(3)}))
    assert cli.main(args) == 0 and read("mapillary").count() == 8  # from the cache
    assert cli.main([*args, "--no-cache"]) == 0 and read("mapillary").count() == 3
    assert cli.main(args) == 0 and read("mapillary").count() == 3


def test_figure():
    square = [{"e": e, "n": n} for e, n in ((0, 0), (10, 0), (10, 10), (0, 0))]
    text = svg([{"footprint": square, "colour": "#111111"}], [{"e": 5.0, "n": -5.0, "dx": 8.0, "dy": 0.0, "colour": "#222222"}, {"e": 1.0, "n": 1.0, "dx": None, "dy": None, "colour": "#333333"}], 50.0, 100.0, "t", 200)
    assert 'points="100.0,100.0 110.0,100.0 110.0,90.0 100.0,100.0"' in text and text.count("<line") == 1 and 'r="50.0"' in text


def test_stages(spark, small):
    assert [s.name for s in stages.stages_up_to("mapillary")] == ["osm", "mapillary"] and [s.name for s in stages.stages_up_to("osm")] == ["osm"]
    with pytest.raises(KeyError, match="Unknown stage"):
        stages.stages_up_to("terrain")
    assert [n for n, _ in stages.list_stages()] == ["osm", "mapillary"]
    assert stages.StageData().tables is not stages.StageData().tables
    sources = {"features": features(spark, small), "queries": view(spark, small, "geo_query"), "captures": view(spark, small, "raw_capture"), "thumbs": view(spark, small, "thumb")}
    data = stages.run("mapillary", sources, {"image_limit": 5})
    assert set(data.tables) == {"osm", "mapillary"} and data.tables["mapillary"].groupBy("qid").count().agg(F.max("count")).first()[0] <= 5
