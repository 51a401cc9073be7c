"""TIFF in numpy: strips or tiles without compression, deflate or LZW, 8 to 32 bits, band-interleaved or planar, with the tags that place
a raster, and overviews in directories of their own. Predictors and other compressions raise ValueError.

What is read may be bytes or anything with slices, so that a window costs its directory and the blocks that it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Bytes of each field type, and the tags in use.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
TYPE_FORMAT = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 254, 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS = 33550, 33922, 34735
CRS_KEYS = (3072, 2048)  # projected, geographic


@dataclass
class Raster:
    data: np.ndarray  # band, row, column
    transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    epsg: int = 0
    bands: list[str] = field(default_factory=list)


def unlzw(data: bytes) -> bytes:
    """LZW as in TIFF: codes of 9 to 12 bits from the high end, widened one code early; 256 starts anew, 257 ends."""
    out, table, width, buffer, held, before = bytearray(), [], 9, 0, 0, b""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        buffer, held = (buffer << 8) | byte, held + 8
        while held >= width:
            held -= width
            code = (buffer >> held) & ((1 << width) - 1)
            buffer &= (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, before = list(fresh), 9, b""
                continue
            if not before:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else before + before[:1]
                table.append(before + entry[:1])
            out += entry
            before = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def directories(raw) -> list[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each directory: the raster itself, then its overviews, the largest first."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack(order + "I", raw[4:8])
    out = []
    while at and len(out) < 32:
        tags: dict[int, tuple] = {}
        (n_tags,) = struct.unpack(order + "H", raw[at : at + 2])
        head = raw[at + 2 : at + 6 + 12 * n_tags]
        for i in range(n_tags):
            tag, kind, n = struct.unpack(order + "HHI", head[12 * i : 12 * i + 8])
            size = TYPE_BYTES.get(kind, 1) * n
            where = head[12 * i + 8 : 12 * i + 12]
            if size > 4:
                (pos,) = struct.unpack(order + "I", where)
            value = where[:size] if size <= 4 else raw[pos : pos + size]
            tags[tag] = (value.rstrip(b"\0").decode(),) if kind == 2 else struct.unpack(f"{order}{n}{TYPE_FORMAT[kind]}", value) if kind in TYPE_FORMAT else (value,)
        out.append((order, tags))
        (at,) = struct.unpack(order + "I", head[12 * n_tags : 12 * n_tags + 4])
    return out


def read(raw, bands: Sequence[int] | None = None, window: tuple[int, int, int, int] | None = None, level: int = 0) -> Raster:
    """The raster, or only some of its bands (from 0), in their order. window: (row, column, height, width) of the part that is
    wanted; only blocks that it touches, of bands that are wanted, are read and unpacked. level: 0, or the number of an overview, whose pixels
    the window then counts in; a level that isn't there raises IndexError."""
    found = directories(raw)
    order, tags = found[level]
    one = lambda t, d=None: tags.get(t, (d,))[0]
    if one(PREDICTOR, 1) != 1 or one(COMPRESSION, 1) not in (1, 5, 8, 32946):
        raise ValueError("predicted or otherwise compressed")
    h, w, n, bits, kind = one(HEIGHT), one(WIDTH), one(SAMPLES, 1), one(BITS, 8), one(FORMAT, 1)
    dtype = np.dtype(f"{order}{'uif'[kind - 1]}{bits // 8}")
    inflate = {1: bytes, 5: unlzw}.get(one(COMPRESSION, 1), zlib.decompress)
    top, left, rows, cols = window or (0, 0, h, w)
    if top < 0 or left < 0 or rows < 1 or cols < 1 or top + rows > h or left + cols > w:
        raise ValueError("the window leaves the raster")
    tiled = TILE_WIDTH in tags
    tall, wide = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, h), h), w)
    starts, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    across, down = -(-w // wide), -(-h // tall)

    def plane(p: int, values: int) -> np.ndarray:
        out = np.empty((rows, cols, values), dtype)
        for r in range(top // tall, (top + rows - 1) // tall + 1):
            for c in range(left // wide, (left + cols - 1) // wide + 1):
                k = (p * down + r) * across + c
                # the last strip may be short, tiles are always whole
                block = np.frombuffer(inflate(raw[starts[k] : starts[k] + counts[k]]), dtype).reshape(-1, wide, values)
                y0, x0 = max(top, r * tall), max(left, c * wide)
                y1, x1 = min(top + rows, (r + 1) * tall), min(left + cols, (c + 1) * wide)
                out[y0 - top : y1 - top, x0 - left : x1 - left] = block[y0 - r * tall : y1 - r * tall, x0 - c * wide : x1 - c * wide]
        return out

    wanted = range(n) if bands is None else list(bands)
    if one(PLANAR, 1) == 2:
        data = np.stack([plane(range(n)[b], 1)[:, :, 0] for b in wanted])
    else:
        data = plane(0, n).transpose(2, 0, 1)[list(wanted)]
    step_y, step_x = found[0][1][HEIGHT][0] / h, found[0][1][WIDTH][0] / w
    tags = found[0][1]  # the place is that of the whole raster
    data = data.astype(dtype.newbyteorder("="))
    sx, sy = tags.get(PIXEL_SCALE, (1.0, 1.0))[:2]
    col, row, _, x, y = tags.get(TIE_POINT, (0.0,) * 5)[:5]
    keys = tags.get(GEO_KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    names = one(DESCRIPTION, "")
    return Raster(np.ascontiguousarray(data), (sx * step_x, 0.0, x - col * sx + left * sx * step_x, 0.0, -sy * step_y, y + row * sy - top * sy * step_y), next((found[k] for k in CRS_KEYS if k in found), 0), names.split(",") if names else [])


def _file(levels: list[tuple[list[tuple], list[bytes]]]) -> bytes:
    """A file of directories (fields, blocks): all directories first, then the blocks of the smallest level up to those of the largest, so
    that a reader finds places and overviews at the front. The offsets' field has zeros where the places go."""
    at, plan = 8, []
    for fields, _ in levels:
        head = at
        at += 2 + 12 * len(fields) + 4
        starts = []
        for _, k, v in fields:
            size = len(v) + 1 if k == "s" else struct.calcsize(k) * len(v)
            starts.append((at, size))
            at += size + size % 2 if size > 4 else 0
        plan.append((head, starts))
    places: list[list[int]] = [[] for _ in levels]
    for k in reversed(range(len(levels))):
        for block in levels[k][1]:
            places[k].append(at)
            at += len(block)
    out = struct.pack("<2sHI", b"II", 42, 8)
    for k, (fields, _) in enumerate(levels):
        head, body = struct.pack("<H", len(fields)), b""
        for (tag, kind, v), (start, size) in zip(fields, plan[k][1], strict=True):
            v = places[k] if tag in (OFFSETS, TILE_OFFSETS) else v
            raw = v.encode() + b"\0" if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
            code = {"s": 2, "H": 3, "I": 4, "d": 12}[kind]
            head += struct.pack("<HHI", tag, code, size if kind == "s" else len(v)) + (raw.ljust(4, b"\0") if size <= 4 else struct.pack("<I", start))
            body += raw + b"\0" * (size % 2) if size > 4 else b""
        out += head + struct.pack("<I", plan[k + 1][0] if k + 1 < len(levels) else 0) + body
    return out + b"".join(b for _, blocks in reversed(levels) for b in blocks)


def _fields(r: Raster, data: np.ndarray, block: list[tuple], placed: bool, sub: bool) -> list[tuple]:
    n, h, w = data.shape
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    a, _, c, _, e, f = r.transform
    fields = [(SUBFILE, "I", [1])] * sub + [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [data.dtype.itemsize * 8] * n), (COMPRESSION, "H", [8]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [n]), (PLANAR, "H", [2]), (FORMAT, "H", [kind] * n), *block]
    if placed:
        fields += [(DESCRIPTION, "s", ",".join(r.bands))] * bool(r.bands) + [(PIXEL_SCALE, "d", [a, -e, 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, c, f, 0.0]), (GEO_KEYS, "H", [1, 1, 0, 1, 3072, 0, 1, r.epsg])]
    return sorted(fields)


def write(r: Raster, rows: int = 64) -> bytes:
    """Planar, strips of some rows, deflate."""
    h = r.data.shape[1]
    rows = min(rows, h)
    strips = [zlib.compress(np.ascontiguousarray(b[i : i + rows]).tobytes(), 6) for b in r.data for i in range(0, h, rows)]
    block = [(OFFSETS, "I", [0] * len(strips)), (ROWS_PER_STRIP, "I", [rows]), (COUNTS, "I", [len(s) for s in strips])]
    return _file([(_fields(r, r.data, block, True, False), strips)])


def halved(data: np.ndarray, nearest: bool) -> np.ndarray:
    """Half as high and wide: means of 2 x 2 pixels (fewer at odd edges), or their upper left ones, as for labels."""
    if nearest:
        return data[:, ::2, ::2]
    p = np.pad(data.astype(np.float64), ((0, 0), (0, data.shape[1] % 2), (0, data.shape[2] % 2)), mode="edge")
    mean = (p[:, ::2, ::2] + p[:, 1::2, ::2] + p[:, ::2, 1::2] + p[:, 1::2, 1::2]) / 4
    return (mean if data.dtype.kind == "f" else np.rint(mean)).astype(data.dtype)


def write_tiled(r: Raster, side: int = 256, overviews: int | None = None, nearest: bool = False) -> bytes:
    """Planar, tiles of side x side (a multiple of 16; less where all fits), deflate, with overviews, each half the size of the one before: as many as named, or until
    one tile holds all."""
    if side % 16:
        raise ValueError("tiles are multiples of 16 wide")
    side = min(side, -(-max(r.data.shape[1:]) // 16) * 16) or side
    levels, data = [], r.data
    while True:
        n, h, w = data.shape
        full = np.pad(data, ((0, 0), (0, -h % side), (0, -w % side)), mode="edge")
        blocks = [zlib.compress(np.ascontiguousarray(b[y : y + side, x : x + side]).tobytes(), 6) for b in full for y in range(0, h, side) for x in range(0, w, side)]
        block = [(TILE_WIDTH, "I", [side]), (TILE_HEIGHT, "I", [side]), (TILE_OFFSETS, "I", [0] * len(blocks)), (TILE_COUNTS, "I", [len(b) for b in blocks])]
        levels.append((_fields(r, data, block, not levels, bool(levels)), blocks))
        if len(levels) > (overviews if overviews is not None else 30) or max(h, w) < 2 or overviews is None and max(h, w) <= side:
            return _file(levels)
        data = halved(data, nearest)
