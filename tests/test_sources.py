"""Round trips of the file formats."""

import sqlite3
import struct

import numpy as np

from gridloom.sources import geojson, geotiff, vector, wkb

RING = np.array([[0, 0], [4, 0], [4, 3], [0, 3], [0, 0.0]])


def test_geotiff_round_trip(spark, tmp_path):
    bands = [np.arange(300 * 270, dtype=np.float32).reshape(300, 270), np.full((300, 270), 7, dtype=np.float32)]
    bands[0][5, 5] = -9999
    geotiff.write(str(tmp_path / "a.tif"), bands, (100.0, 200.0), 1.0, -9999)
    got = geotiff.read(spark, str(tmp_path / "*.tif"))
    assert got.count() == 2 * 300 * 270
    assert got.where("v is null").select("band", "r", "c").collect() == [(1, 5, 5)]
    assert got.where("band = 1 and r = 299 and c = 269").first()["v"] == bands[0][299, 269]


def test_geopackage(spark, tmp_path):
    path = tmp_path / "a.gpkg"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('buildings', 'geom')")
        db.execute("CREATE TABLE buildings (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
        for i in range(5):
            db.execute("INSERT INTO buildings VALUES (?, ?, ?)", (i + 1, b"GP\0\1" + struct.pack("<i", 0) + wkb.encode_polygon([RING + 10 * i]), f"b{i}"))
    spark.dataSource.register(vector.GeoPackage)
    every = spark.read.format("geopackage").load(str(path))
    assert [(r["fid"], r["name"], r["maxx"]) for r in every.orderBy("fid").collect()] == [(i + 1, f"b{i}", 10.0 * i + 4) for i in range(5)]
    assert spark.read.format("geopackage").option("bbox", "9,9,12,12").load(str(path)).count() == 1


def test_shapefile(spark, tmp_path):
    records = []
    for i in range(3):
        ring = RING + i
        body = struct.pack("<I4d2I1I", 5, *ring.min(axis=0), *ring.max(axis=0), 1, len(ring), 0) + ring.astype("<f8").tobytes()
        records.append(struct.pack(">II", i + 1, len(body) // 2) + body)
    data = b"".join(records)
    (tmp_path / "a.shp").write_bytes(struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(data)) // 2) + struct.pack("<II8d", 1000, 5, *[0.0] * 8) + data)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 3, 32 + 32 + 1, 7) + field + b"\r" + b"".join(b" " + f"n{i}".encode().ljust(6) for i in range(3)))
    spark.dataSource.register(vector.Shapefile)
    got = spark.read.format("shapefile").load(str(tmp_path / "a.shp")).orderBy("fid").collect()
    assert [(r["fid"], r["NAME"], r["minx"], len(r["rings"][0][0])) for r in got] == [(i, f"n{i}", float(i), 5) for i in range(3)]
    places = np.cumsum([100] + [len(r) for r in records[:-1]]) // 2
    (tmp_path / "a.shx").write_bytes(b"\0" * 100 + b"".join(struct.pack(">II", p, len(r) // 2 - 4) for p, r in zip(places.tolist(), records, strict=True)))
    assert spark.read.format("shapefile").option("partitions", "2").load(str(tmp_path / "a.shp")).orderBy("fid").collect() == got


def test_geopackage_written(spark, tmp_path):
    """Polygons with holes, several parts, nulls and clashing box columns come back; appended layers keep the others."""
    spark.dataSource.register(vector.GeoPackage)
    shape = lambda *parts: [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts]
    hole = RING[::-1] / 4 + 1
    rows = [(9, "a", 1.5, 0.0, shape([RING, hole])), (9, None, None, 0.0, shape([RING], [RING + 20])), (9, "c", 2.5, 0.0, None), (9, "d", 3.5, 0.0, [])]
    df = spark.createDataFrame(rows, "fid long, `the \"name\"` string, h double, minx double, rings array<array<array<struct<x:double,y:double>>>>").repartition(3)
    path = str(tmp_path / "w.gpkg")
    df.write.format("geopackage").mode("overwrite").option("layer", "houses").option("srs", "27700").save(path)
    df.limit(0).write.format("geopackage").mode("append").option("layer", "none").save(path)
    df.write.format("geopackage").mode("append").option("layer", "houses").option("srs", "27700").save(path)
    got = spark.read.format("geopackage").option("layer", "houses").load(path)
    assert sorted(r["fid"] for r in got.collect()) == list(range(1, 9))
    back = {r['the "name"']: r for r in got.collect()}
    assert [[tuple(p) for p in ring] for ring in back["a"]["rings"][0]] == rows[0][4][0] and (back["a"]["maxx"], back["a"]["h"]) == (4.0, "1.5")
    assert len(back[None]["rings"]) == 2 and back[None]["maxx"] == 24.0
    assert back["c"]["minx"] is None and back["d"]["rings"] == []
    assert spark.read.format("geopackage").option("layer", "none").load(path).count() == 0
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents WHERE table_name = 'houses'").fetchone() == (0, 0, 24, 23, 27700)
        assert db.execute("SELECT count(*) FROM gpkg_contents").fetchone()[0] == 2
    near = lambda: sorted(str(r['the "name"']) for r in spark.read.format("geopackage").option("layer", "houses").option("bbox", "15,15,22,22").load(path).collect())
    assert near() == ["None", "None"]
    with sqlite3.connect(path) as db:  # an R-tree is asked first
        db.execute("CREATE VIRTUAL TABLE rtree_houses_geom USING rtree(id, minx, maxx, miny, maxy)")
        db.execute("INSERT INTO rtree_houses_geom SELECT fid, 0, 30, 0, 30 FROM houses WHERE \"the \"\"name\"\"\" IS NULL LIMIT 1")
    assert near() == ["None"]
    assert [f.name for f in tmp_path.iterdir()] == ["w.gpkg"]


def test_shapefile_rings():
    """Clockwise rings are shells; a hole goes to the smallest shell around it."""
    shell, inner = RING[::-1] * 10, RING[::-1] + 5
    far = RING[::-1] + 100
    holes = [RING / 4 + 6, RING / 4 + 30 - 2, RING + 500]
    parts = vector.dealt([shell, holes[0], inner, far, holes[1], holes[2]])
    assert [[float(r[0][0]) for r in part] for part in parts] == [[0.0, 28.0], [5.0, 6.0], [100.0], [500.0]]
    assert [len(p) for p in vector.dealt([RING, RING + 9])] == [1, 1]


def test_geojson_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.34567, [(0.12345678, 1.0), (2.0, 1.0), (2.0, 2.0), (0.12345678, 1.0)])], "id int, h double, ring array<struct<x:double,y:double>>")
    geojson.write_features(df, "ring", ["id", "h"], str(tmp_path / "j"))
    assert '"coordinates":[[[0.123457,1.0]' in spark.read.text(str(tmp_path / "j")).first()[0]
    geojson.write_report(df.drop("ring"), 2, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["h"] == "2.35"
