"""Python Data Sources for GeoPackage and Shapefile layers.

Rows have fid, the attributes as strings, the box (minx, miny, maxx, maxy), and rings:
array (parts) of array (rings) of array of struct<x, y>. Options: ``layer``, ``bbox``
("x0,y0,x1,y1", keeps boxes that meet it), ``partitions``. A partition reads its own range of
features; a box filter on the columns is an ordinary Spark filter. A GeoPackage's bbox goes to
the layer's R-tree where it has one, else to the envelopes in the geometries' headers; only
what is left is decoded. Shapefile records are found by the .shx file.

``df.write.format("geopackage").mode("overwrite")`` writes column ``rings`` as polygons and the
other columns, without fid and box, as attributes (options ``layer``, ``srs``); mode "append"
adds to the file. Tasks write parts beside the file, which must be on a shared folder; the driver
only joins them, in partition order, and numbers the features. Rows without rings have no geometry.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.functions.kernels import area, contains
from gridloom.sources import wkb

GEOMETRY = "minx double, miny double, maxx double, maxy double, rings array<array<array<struct<x:double,y:double>>>>"


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(None)
        self.first, self.last = first, last


def _rows(parts: list[list[np.ndarray]]) -> list:
    return [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts]


def _meets(box: tuple[float, float, float, float], want: list[float] | None) -> bool:
    return want is None or (box[0] <= want[2] and want[0] <= box[2] and box[1] <= want[3] and want[1] <= box[3])


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layer = options["path"], options.get("layer")
        self.bbox = [float(v) for v in options["bbox"].split(",")] if "bbox" in options else None
        self.count = max(1, int(options.get("partitions", "4")))

    def _split(self, first: int, last: int) -> list[_Range]:
        step = max(1, -(-(last - first) // self.count))
        return [_Range(a, min(a + step, last)) for a in range(first, last, step)] or [_Range(0, 0)]


class GeoPackage(DataSource):
    """``spark.read.format("geopackage").option("layer", ...).load(path)``; a GeoPackage is an SQLite file."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _layer(self) -> tuple[str, str, list[str]]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            row = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns WHERE ? IS NULL OR table_name = ? ORDER BY table_name LIMIT 1", (self.options.get("layer"),) * 2).fetchone()
            columns = [c[1] for c in db.execute(f"PRAGMA table_info({_quoted(row[0])})")]
        return row[0], row[1], [c for c in columns if c not in (row[1], "fid")]

    def schema(self) -> str:
        return "fid long, " + "".join(f"`{c}` string, " for c in self._layer()[2]) + GEOMETRY

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GeoPackageReader(dict(self.options), self._layer())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _GeoPackageWriter(dict(self.options), schema, overwrite)


class _GeoPackageReader(_Reader):
    def __init__(self, options: dict, layer: tuple[str, str, list[str]]):
        super().__init__(options)
        self.table, self.column, self.names = layer

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        return self._split(low or 0, (high or -1) + 1)

    def _found(self, db: sqlite3.Connection, partition: _Range) -> Iterator[tuple]:
        names = "".join(f", t.{_quoted(n)}" for n in self.names)
        query, values = f"SELECT t.rowid, t.{_quoted(self.column)}{names} FROM {_quoted(self.table)} t", [partition.first, partition.last]
        tree = f"rtree_{self.table}_{self.column}"
        if self.bbox and db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (tree,)).fetchone():
            query += f' JOIN {_quoted(tree)} b ON b.id = t.rowid AND b.minx <= ? AND b.maxx >= ? AND b.miny <= ? AND b.maxy >= ?'
            values = [self.bbox[2], self.bbox[0], self.bbox[3], self.bbox[1], *values]
        return db.execute(f"{query} WHERE t.rowid >= ? AND t.rowid < ?", values)

    def read(self, partition: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for fid, blob, *values in self._found(db, partition):
                if self.bbox and (blob is None or (envelope := wkb.geopackage_envelope(blob)) and not _meets(envelope, self.bbox)):
                    continue
                parts = wkb.decode(wkb.strip_geopackage(blob))[1] if blob else []
                box = wkb.bounds(parts) if parts else (None,) * 4
                if self.bbox is None or (parts and _meets(box, self.bbox)):
                    yield (fid, *(None if v is None else str(v) for v in values), *box, _rows(parts))


@dataclass
class _Part(WriterCommitMessage):
    path: str


class _GeoPackageWriter(DataSourceWriter):
    #: Fixed values of the format: application id ("GPKG"), version, the reference systems every file has.
    APPLICATION, VERSION = 0x47504B47, 10300
    SYSTEMS = ((-1, "Undefined Cartesian", "NONE", -1), (0, "Undefined geographic", "NONE", 0), (4326, "WGS 84", "EPSG", 4326))
    TABLES = """
        CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
        CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id));
        CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY REFERENCES gpkg_contents(table_name), column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.layer, self.srs, self.overwrite = options["path"], options.get("layer", "layer"), int(options.get("srs", "-1")), overwrite
        if "rings" not in schema.names:
            raise ValueError("a GeoPackage is written from a column rings")
        kinds = {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        self.columns = [(f.name, kinds.get(f.dataType.typeName(), "TEXT")) for f in schema if f.name not in ("fid", "minx", "miny", "maxx", "maxy", "rings")]
        self.names = "".join(", " + _quoted(n) for n, _ in self.columns)
        self.types = "".join(f", {_quoted(n)} {kind}" for n, kind in self.columns)

    def write(self, iterator: Iterator) -> _Part:
        path = f"{self.path}.{uuid.uuid4().hex}.part"

        def values() -> Iterator[tuple]:
            for row in iterator:
                parts = [[np.array([(p["x"], p["y"]) for p in ring], dtype=float) for ring in part if ring] for part in row["rings"] or () if part]
                parts = [part for part in parts if part]
                box = wkb.bounds(parts) if parts else (None,) * 4
                own = [v if v is None or kind != "TEXT" else str(v) for v, kind in ((row[n], kind) for n, kind in self.columns)]
                yield (wkb.geopackage_blob(parts, self.srs) if parts else None, *box, *own)

        with contextlib.closing(sqlite3.connect(path)) as db, db:
            db.execute(f"CREATE TABLE part (geom BLOB, minx REAL, miny REAL, maxx REAL, maxy REAL{self.types})")
            db.executemany(f"INSERT INTO part VALUES (?, ?, ?, ?, ?{', ?' * len(self.columns)})", values())
        return _Part(path)

    def commit(self, messages: list) -> None:
        whole, layer = f"{self.path}.{uuid.uuid4().hex}.whole", _quoted(self.layer)
        if not self.overwrite and os.path.exists(self.path):
            shutil.copyfile(self.path, whole)
        with contextlib.closing(sqlite3.connect(whole, isolation_level=None)) as db:
            db.executescript(f"PRAGMA application_id = {self.APPLICATION}; PRAGMA user_version = {self.VERSION};{self.TABLES}")
            systems = [*self.SYSTEMS, (self.srs, f"EPSG:{self.srs}", "EPSG", self.srs)]
            db.executemany("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?2, ?1, ?3, ?4, 'undefined', NULL)", systems)
            db.execute(f"CREATE TABLE IF NOT EXISTS {layer} (fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, geom BLOB{self.types})")
            db.execute("INSERT OR IGNORE INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?1, 'features', ?1, ?2)", (self.layer, self.srs))
            db.execute("INSERT OR IGNORE INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (self.layer, self.srs))
            for message in filter(None, messages):
                db.execute("ATTACH ? AS own", (message.path,))
                db.execute(f"INSERT INTO {layer} (geom{self.names}) SELECT geom{self.names} FROM own.part ORDER BY rowid")
                box = db.execute("SELECT min(minx), min(miny), max(maxx), max(maxy) FROM own.part").fetchone()
                if box[0] is not None:
                    # min and max of several values are NULL if one is
                    db.execute("UPDATE gpkg_contents SET min_x = min(coalesce(min_x, ?1), ?1), min_y = min(coalesce(min_y, ?2), ?2), max_x = max(coalesce(max_x, ?3), ?3), max_y = max(coalesce(max_y, ?4), ?4) WHERE table_name = ?5", (*box, self.layer))
                db.execute("DETACH own")
        os.replace(whole, self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Parts of tasks that gave no message stay; they end in .part."""
        for message in filter(None, messages):
            with contextlib.suppress(FileNotFoundError):
                os.remove(message.path)


def dealt(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Parts of a polygon record: clockwise rings are shells, the others go to the smallest shell around them.

    A hole without a shell around it, and each ring of a record without clockwise rings, is a part of its own.
    """
    shells = [r for r in rings if area(r) < 0]
    parts = [[r] for r in shells]
    for ring in rings:
        if area(ring) >= 0:
            around = [k for k, shell in enumerate(shells) if contains(shell, ring[:1])[0]]
            if around:
                parts[min(around, key=lambda k: abs(area(shells[k])))].append(ring)
            else:
                parts.append([ring])
    return parts


class Shapefile(DataSource):
    """``spark.read.format("shapefile").load("layer.shp")``: .shp with .dbf; polygons, lines and points."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _fields(self) -> list[tuple[str, int]]:
        with open(self.options["path"][:-4] + ".dbf", "rb") as file:
            head = file.read(32)
            size = struct.unpack_from("<H", head, 8)[0]
            raw = file.read(size - 32)
        return [(raw[i : i + 11].split(b"\0")[0].decode("latin-1"), raw[i + 16]) for i in range(0, len(raw) - 31, 32) if raw[i] != 13]

    def schema(self) -> str:
        return "fid long, " + "".join(f"`{n}` string, " for n, _ in self._fields()) + GEOMETRY

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ShapefileReader(dict(self.options), self._fields())


class _ShapefileReader(_Reader):
    def __init__(self, options: dict, fields: list[tuple[str, int]]):
        super().__init__(options)
        self.fields = fields

    def _table(self) -> tuple[int, int, int]:
        with open(self.path[:-4] + ".dbf", "rb") as file:
            return struct.unpack_from("<IHH", file.read(32), 4)

    def partitions(self) -> list[_Range]:
        return self._split(0, self._table()[0])

    def _places(self, partition: _Range) -> list[int]:
        """Where the partition's records begin; empty without a .shx file."""
        try:
            with open(self.path[:-4] + ".shx", "rb") as index:
                index.seek(100 + 8 * partition.first)
                data = index.read(8 * (partition.last - partition.first))
        except FileNotFoundError:
            return []
        return (np.frombuffer(data, dtype=">i4")[::2].astype(np.int64) * 2).tolist()

    def read(self, partition: _Range) -> Iterator[tuple]:
        _, head, width = self._table()
        with open(self.path, "rb") as shapes, open(self.path[:-4] + ".dbf", "rb") as table:
            places = self._places(partition)
            for fid in range(partition.first, partition.last):
                if places:
                    shapes.seek(places[fid - partition.first])
                elif fid == partition.first:
                    shapes.seek(100)
                    for _ in range(fid):
                        shapes.seek(struct.unpack(">II", shapes.read(8))[1] * 2, 1)
                data = shapes.read(struct.unpack(">II", shapes.read(8))[1] * 2)
                kind = struct.unpack_from("<I", data)[0] % 10
                parts: list[list[np.ndarray]] = []
                if kind == 1:
                    parts = [[np.frombuffer(data, "<f8", 2, 4).reshape(1, 2)]]
                elif kind in (3, 5):
                    n_parts, n_points = struct.unpack_from("<II", data, 36)
                    cuts = [*struct.unpack_from(f"<{n_parts}I", data, 44), n_points]
                    points = np.frombuffer(data, "<f8", n_points * 2, 44 + 4 * n_parts).reshape(-1, 2)
                    rings = [points[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    parts = [[r] for r in rings] if kind == 3 else dealt(rings)
                table.seek(head + fid * width + 1)
                record, at, values = table.read(width - 1), 0, []
                for _, size in self.fields:
                    values.append(record[at : at + size].decode("utf-8", "replace").strip() or None)
                    at += size
                box = wkb.bounds(parts) if parts else (None,) * 4
                if self.bbox is None or (parts and _meets(box, self.bbox)):
                    yield (fid, *values, *box, _rows(parts))
