"""Shapefiles: polygons and points of .shp files with the attributes of the .dbf files beside them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape types without heights or measures.
NULL, POINT, POLYGON = 0, 1, 5
RINGS = "array<array<array<double>>>"


def shapes(raw: bytes) -> Iterator[list[list[list[float]]] | None]:
    """The rings of each record; of a point one ring with it; None: no geometry. Other types raise ValueError."""
    if len(raw) < 100 or struct.unpack(">i", raw[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at < len(raw):
        size = 2 * struct.unpack(">i", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + size]
        (kind,) = struct.unpack("<i", body[:4])
        if kind == NULL:
            yield None
        elif kind == POINT:
            yield [[list(struct.unpack("<2d", body[4:20]))]]
        elif kind == POLYGON:
            n_parts, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n]
            xy = struct.unpack(f"<{2 * n}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n])
            yield [[[xy[2 * i], xy[2 * i + 1]] for i in range(a, z)] for a, z in zip(starts, starts[1:], strict=False)]
        else:
            raise ValueError(f"shape type {kind}")
        at += 8 + size


def attributes(raw: bytes) -> Iterator[dict[str, str | None]]:
    """The records of a dBase table as text, blank ones null."""
    n, start, size = struct.unpack("<IHH", raw[4:12])
    fields = []
    for at in range(32, start - 1, 32):
        if raw[at] == 0x0D:
            break
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
    for i in range(n):
        at, out = start + i * size + 1, {}
        for name, width in fields:
            out[name] = raw[at : at + width].decode("utf-8", "replace").strip() or None
            at += width
        yield out


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, properties, rings) of the shapefiles of a folder; one without a table beside it has no properties."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.(shp|dbf)$", 1).alias("file"), F.regexp_extract("path", r"\.(shp|dbf)$", 1).alias("kind"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for file, kind, content in zip(x["file"], x["kind"], x["content"], strict=True):
                if kind == "shp":
                    rows = [(file, i, None, r) for i, r in enumerate(shapes(content))]
                else:
                    rows = [(file, i, p, None) for i, p in enumerate(attributes(content))]
                yield pd.DataFrame(rows, columns=["file", "record", "properties", "rings"])

    each = files.mapInPandas(run, f"file string, record long, properties map<string,string>, rings {RINGS}")
    # a file's shapes and its table have the records' places in common
    return each.groupBy("file", "record").agg(F.first("properties", ignorenulls=True).alias("properties"), F.first("rings", ignorenulls=True).alias("rings"))


def numbered_parts(df: DataFrame, column: str, names: list[str], sep: str = "_") -> DataFrame:
    """df with a delimited column split into others; what is a number becomes one, else null."""
    parts = F.split(F.col(column), sep)
    return df.select("*", *(F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)))
