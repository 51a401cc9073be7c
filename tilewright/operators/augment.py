"""Seeded augmentation of tiles: colour on RGB alone, then geometry on RGB, EXTRA and label alike.

What a tile gets depends on its id, the epoch and the seed only, so a lost task draws the same again and any partitioning
gives the same tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .raster import resample


@dataclass(frozen=True)
class Chances:
    """Probability of each step and how far it may go."""

    brightness_contrast: float = 0.5
    brightness: float = 0.2
    contrast: float = 0.2
    saturation: float = 0.1
    rot90: float = 0.5
    hflip: float = 0.5
    vflip: float = 0.5
    scale: float = 0.3
    scale_range: tuple[float, float] = (0.8, 1.2)


def colour(rgb: np.ndarray, draw: np.random.Generator, c: Chances) -> np.ndarray:
    """rgb: band, row, column, 0 to 255."""
    out = rgb.astype(np.float32)
    if draw.random() < c.brightness_contrast:
        out = out * (1 + draw.uniform(-c.contrast, c.contrast)) + 255 * draw.uniform(-c.brightness, c.brightness)
    if draw.random() < c.brightness_contrast:
        grey = out.mean(0, keepdims=True)
        out = grey + (out - grey) * (1 + draw.uniform(-c.saturation, c.saturation))
    return np.clip(np.rint(out), 0, 255).astype(rgb.dtype)


def fit_size(a: np.ndarray, size: int) -> np.ndarray:
    """Padded with zeros, then cut, about the centre."""
    for axis in (-2, -1):
        n = a.shape[axis]
        if n < size:
            pad = [(0, 0)] * a.ndim
            pad[axis] = ((size - n) // 2, size - n - (size - n) // 2)
            a = np.pad(a, pad)
        elif n > size:
            a = np.take(a, range((n - size) // 2, (n - size) // 2 + size), axis)
    return a


def scaled(a: np.ndarray, height: int, width: int, nearest: bool) -> np.ndarray:
    if nearest:
        r, c = (np.minimum((np.arange(m) + 0.5) * n / m, n - 1).astype(int) for n, m in ((a.shape[-2], height), (a.shape[-1], width)))
        return a[..., r[:, None], c]
    out = np.stack([resample(b.astype(np.float64), height, width) for b in a.reshape(-1, *a.shape[-2:])])
    return (np.rint(out) if a.dtype.kind in "ui" else out).astype(a.dtype).reshape(*a.shape[:-2], height, width)


def augment(rgb: np.ndarray, extra: np.ndarray | None, label: np.ndarray, draw: np.random.Generator, c: Chances = Chances(), size: int | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """All of one tile; labels take the nearest pixel, so that no new ones come up."""
    size = size or label.shape[-1]
    parts = [colour(rgb, draw, c), extra, label]
    each = lambda f: [p if p is None else np.ascontiguousarray(f(p)) for p in parts]
    if draw.random() < c.rot90:
        k = int(draw.integers(0, 4))
        parts = each(lambda a: np.rot90(a, k, (-2, -1)))
    if draw.random() < c.hflip:
        parts = each(lambda a: a[..., ::-1])
    if draw.random() < c.vflip:
        parts = each(lambda a: a[..., ::-1, :])
    if draw.random() < c.scale:
        f = draw.uniform(*c.scale_range)
        h, w = (max(1, round(n * f)) for n in label.shape[-2:])
        parts = [p if p is None else scaled(p, h, w, p is parts[2]) for p in parts]
    return tuple(each(lambda a: fit_size(a, size)))


def generator(tile_id: str, epoch: int, seed: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{tile_id}|{epoch}|{seed}".encode()).digest()[:8], "big"))


def augmented(tiles: DataFrame, epoch: int, seed: int = 42, chances: Chances = Chances()) -> DataFrame:
    """tiles: tile_id, size, rgb and label (binary, uint8, band by band) and extra (binary, float32; may be null), changed where they lie."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for t, n, rgb, extra, label in zip(x["tile_id"], x["size"], x["rgb"], x["extra"], x["label"], strict=True):
                shaped = lambda raw, kind: np.frombuffer(raw, kind).reshape(-1, n, n)
                a, e, y = augment(shaped(rgb, np.uint8), None if extra is None else shaped(extra, "<f4"), shaped(label, np.uint8)[0], generator(t, epoch, seed), chances)
                rows.append((t, n, a.tobytes(), None if e is None else e.tobytes(), y.tobytes()))
            yield pd.DataFrame(rows, columns=["tile_id", "size", "rgb", "extra", "label"])

    return tiles.select("tile_id", "size", "rgb", "extra", "label").mapInPandas(run, "tile_id string, size int, rgb binary, extra binary, label binary")
