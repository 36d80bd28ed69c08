"""Well-known binary to rings and back. A geometry is a list of parts, a part a list of (n, 2) arrays."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: geometry type codes.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = 1, 2, 3, 4, 5, 6, 7


def decode(data: bytes, at: int = 0) -> tuple[int, list[list[np.ndarray]], int]:
    """(base type, parts, next offset); third and fourth coordinates are dropped."""
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    dims = 2
    if code & 0xE0000000:  # extended flags
        dims += bool(code & 0x80000000) + bool(code & 0x40000000)
        at += 4 * bool(code & 0x20000000)
        code &= 0x1FFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    code %= 1000

    def points(n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=np.dtype("f8").newbyteorder(order), count=n * dims, offset=at).reshape(n, dims)[:, :2].astype(float)
        at += n * dims * 8
        return out

    def count() -> int:
        nonlocal at
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        return n

    if code == POINT:
        return code, [[points(1)]], at
    if code == LINE:
        return code, [[points(count())]], at
    if code == POLYGON:
        return code, [[points(count()) for _ in range(count())]], at
    parts: list[list[np.ndarray]] = []
    for _ in range(count()):
        _, inner, at = decode(data, at)
        parts += inner
    return code, parts, at


def encode_polygon(rings: list[np.ndarray]) -> bytes:
    out = [struct.pack("<BII", 1, POLYGON, len(rings))]
    for ring in rings:
        out.append(struct.pack("<I", len(ring)))
        out.append(np.ascontiguousarray(ring, dtype="<f8").tobytes())
    return b"".join(out)


def encode_polygons(parts: list[list[np.ndarray]]) -> bytes:
    """One part is a polygon, several are a multipolygon."""
    if len(parts) == 1:
        return encode_polygon(parts[0])
    return struct.pack("<BII", 1, MULTI_POLYGON, len(parts)) + b"".join(encode_polygon(p) for p in parts)


def bounds(parts: list[list[np.ndarray]]) -> tuple[float, float, float, float]:
    every = np.vstack([r for p in parts for r in p])
    return (*every.min(axis=0).tolist(), *every.max(axis=0).tolist())


def strip_geopackage(blob: bytes) -> bytes:
    """The WKB inside a GeoPackage geometry blob."""
    flags = blob[3]
    return blob[8 + (0, 32, 48, 48, 64)[(flags >> 1) & 7] :]


def geopackage_envelope(blob: bytes) -> tuple[float, float, float, float] | None:
    """The box in a GeoPackage geometry blob's header, if it has one."""
    flags = blob[3]
    if not (flags >> 1) & 7:
        return None
    x0, x1, y0, y1 = struct.unpack_from("<4d" if flags & 1 else ">4d", blob, 8)
    return x0, y0, x1, y1


def geopackage_blob(parts: list[list[np.ndarray]], srs: int) -> bytes:
    x0, y0, x1, y1 = bounds(parts)
    return b"GP" + struct.pack("<BBi4d", 0, 3, srs, x0, x1, y0, y1) + encode_polygons(parts)
