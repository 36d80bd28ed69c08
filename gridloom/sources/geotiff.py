"""Single- and multi-band GeoTIFF: tile reading (plain and deflate, predictor 1 to 3) and tiled writing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: tags and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, SCALE, TIE, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of the first image."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    out = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = _TYPES[kind]
        size = struct.calcsize(order + code) * count
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        out[tag] = (data[place : place + count],) if kind == 2 else struct.unpack_from(order + code * count, data, place)
    return order, out


def tiles(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band, first row, first column, values) of every tile or strip, cut to the image."""
    order, t = tags(data)
    width, height, bands = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[t.get(SAMPLE_FORMAT, (1,))[0]] + str(t[BITS][0] // 8)).newbyteorder(order)
    tw, th = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if TILES in t else (width, t.get(ROWS_PER_STRIP, (height,))[0])
    places, sizes = t.get(TILES, t.get(STRIPS)), t.get(TILE_BYTES, t.get(STRIP_BYTES))
    across, down = -(-width // tw), -(-height // th)
    apart = t.get(PLANAR, (1,))[0] == 2
    inside = 1 if apart else bands
    for n, (place, size) in enumerate(zip(places, sizes, strict=True)):
        raw = data[place : place + size]
        if t.get(COMPRESSION, (1,))[0] in (8, 32946):
            raw = zlib.decompress(raw)
        band, n = divmod(n, across * down) if apart else (0, n)
        r, c = n // across * th, n % across * tw
        rows = th if TILES in t else min(th, height - r)
        predictor = t.get(PREDICTOR, (1,))[0]
        if predictor == 3:
            flat = np.frombuffer(raw, np.uint8).reshape(rows, -1)
            flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, tw * inside)
            values = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, tw, inside)
        else:
            values = np.frombuffer(raw, kind).reshape(rows, tw, inside)
            if predictor == 2:
                values = np.cumsum(values, axis=1, dtype=kind)
        for k in range(inside):
            yield band + k, r, c, values[: height - r, : width - c, k].astype(kind.newbyteorder("="))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, band, r, c, v) pixels of all files at ``path``; nodata becomes NULL. One file is one task's work."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                content = bytes(content)
                nodata = tags(content)[1].get(NODATA)
                limit = float(nodata[0].split(b"\0")[0]) if nodata else None
                for band, r, c, v in tiles(content):
                    rr, cc = np.mgrid[r : r + v.shape[0], c : c + v.shape[1]]
                    flat = v.ravel().astype(float)
                    yield pd.DataFrame({"path": name, "band": band + 1, "r": rr.ravel(), "c": cc.ravel(), "v": pd.array(np.where(flat == limit, np.nan, flat), dtype="Float64") if limit is not None else flat})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, band int, r int, c int, v double")


def write(path: str, bands: list[np.ndarray], origin: tuple[float, float], resolution: float, nodata: float | None = None, tile: int = 256) -> None:
    """A float32 file in deflated tiles, one plane per band."""
    height, width = bands[0].shape
    across, down = -(-width // tile), -(-height // tile)
    blobs = []
    for band in bands:
        full = np.full((down * tile, across * tile), 0 if nodata is None else nodata, dtype="<f4")
        full[:height, :width] = band
        blobs += [zlib.compress(np.ascontiguousarray(full[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]).tobytes()) for i in range(down) for j in range(across)]
    entries: list[tuple[int, int, int, bytes]] = []

    def put(tag: int, kind: int, *values: float) -> None:
        entries.append((tag, kind, len(values), struct.pack("<" + _TYPES[kind] * len(values), *values)))

    n = len(bands)
    for tag, kind, values in (
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (32,) * n), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (n,)), (PLANAR, 3, (2 if n > 1 else 1,)),
        (TILE_WIDTH, 3, (tile,)), (TILE_HEIGHT, 3, (tile,)), (TILES, 4, (0,) * len(blobs)), (TILE_BYTES, 4, tuple(map(len, blobs))), (SAMPLE_FORMAT, 3, (3,) * n),
        (SCALE, 12, (resolution, resolution, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, origin[0], origin[1], 0.0)),
    ):
        put(tag, kind, *values)
    if nodata is not None:
        text = f"{nodata:g}".encode() + b"\0"
        entries.append((NODATA, 2, len(text), text))
    after = 8 + 2 + 12 * len(entries) + 4
    data_at = after + sum(len(e[3]) + len(e[3]) % 2 for e in entries if len(e[3]) > 4)
    places, at = [], data_at
    for b in blobs:
        places.append(at)
        at += len(b)
    entries = [(t, k, c, struct.pack(f"<{len(places)}I", *places) if t == TILES else d) for t, k, c, d in entries]
    head, extra = [struct.pack("<2sHIH", b"II", 42, 8, len(entries))], []
    for tag, kind, count, data in entries:
        if len(data) > 4:
            head.append(struct.pack("<HHII", tag, kind, count, after))
            extra.append(data + b"\0" * (len(data) % 2))
            after += len(extra[-1])
        else:
            head.append(struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0"))
    with open(path, "wb") as file:
        file.write(b"".join([*head, b"\0" * 4, *extra, *blobs]))
