"""GeoParquet: polygons as well-known binary, their bounds in columns, rows along a Hilbert curve, and the metadata that other readers look for.

Written through a data source, so that files appear when all tasks have succeeded; read as any Parquet, so that Spark's own scan leaves out row
groups whose bounds miss what is asked for.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.pandas.types import to_arrow_schema

from .tiles import Written, opened

#: Fixed values of the formats: byte order and type codes of well-known binary, the version of the metadata.
LITTLE, POLYGON, VERSION = 1, 3, "1.1.0"
BITS = 16
ROW_GROUP, PART_ROWS = 20_000, 1_000_000
RINGS = "array<array<array<double>>>"


def to_wkb(rings: list | None) -> bytes | None:
    """A polygon's rings of [x, y] points; rings are closed if they aren't."""
    if rings is None:
        return None
    out = struct.pack("<BII", LITTLE, POLYGON, len(rings))
    for ring in rings:
        p = np.array([[*q] for q in ring], "<f8").reshape(-1, 2)
        if len(p) and (p[0] != p[-1]).any():
            p = np.concatenate([p, p[:1]])
        out += struct.pack("<I", len(p)) + p.tobytes()
    return out


def from_wkb(raw: bytes | None) -> list | None:
    """The rings of a polygon, or of each part of a multipolygon one after the other, in either byte order; ValueError for other shapes."""
    if raw is None:
        return None

    def polygon(at: int) -> tuple[list, int]:
        order = "<" if raw[at] == LITTLE else ">"
        kind, n = struct.unpack_from(order + "II", raw, at + 1)
        at, out = at + 9, []
        if kind == 6:
            for _ in range(n):
                rings, at = polygon(at)
                out += rings
            return out, at
        if kind != POLYGON:
            raise ValueError(f"shape {kind} is no polygon")
        for _ in range(n):
            (k,) = struct.unpack_from(order + "I", raw, at)
            out.append(np.frombuffer(raw, order + "f8", 2 * k, at + 4).reshape(k, 2).tolist())
            at += 4 + 16 * k
        return out, at

    return polygon(0)[0]


def hilbert(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of cells (x, y from 0 to 2^bits - 1) along the curve: quadrant by quadrant, turned so that neighbours follow each other."""
    x, y, out = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    for k in reversed(range(bits)):
        s = 1 << k
        rx, ry = (x & s) > 0, (y & s) > 0
        out += s * s * ((3 * rx) ^ ry)
        flip = ~ry & rx
        x, y = np.where(flip, s - 1 - (x & (s - 1)), x & (s - 1)), np.where(flip, s - 1 - (y & (s - 1)), y & (s - 1))
        x, y = np.where(ry, x, y), np.where(ry, y, x)
    return out


def bounds_of(rings: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax> of a polygon's outer ring."""
    xs, ys = F.transform(rings[0], lambda p: p[0]), F.transform(rings[0], lambda p: p[1])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: pa.Schema):
        self.path, self.row_group, self.job = options["path"].rstrip("/"), int(options.get("row_group", ROW_GROUP)), uuid.uuid4().hex
        geo = {"version": VERSION, "primary_column": "geometry", "columns": {"geometry": {
            "encoding": "WKB", "geometry_types": ["Polygon"], "bbox": json.loads(options["bbox"]), "crs": None,
            "covering": {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}},
        }}}
        if "epsg" in options:
            geo["columns"]["geometry"]["crs"] = {"id": {"authority": "EPSG", "code": int(options["epsg"])}}
        self.schema = schema.with_metadata({"geo": json.dumps(geo)})

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, inner = opened(self.path)
        system.create_dir(f"{inner}/_temporary-{self.job}", recursive=True)
        name = f"{uuid.uuid4().hex}.parquet"
        at, first, out, held = f"{inner}/_temporary-{self.job}/{name}", None, None, []
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                out = out or pq.ParquetWriter(system.open_output_stream(at), self.schema, compression="zstd")
                first = first if first is not None else int(b.column(b.schema.get_field_index("_place"))[0].as_py())
                held.append(b.select(self.schema.names))
                while sum(h.num_rows for h in held) >= self.row_group:
                    table = pa.Table.from_batches(held).combine_chunks()
                    out.write_table(table.slice(0, self.row_group).cast(self.schema), row_group_size=self.row_group)
                    held = table.slice(self.row_group).to_batches()
            if out:
                if held:
                    out.write_table(pa.Table.from_batches(held).cast(self.schema), row_group_size=self.row_group)
                out.close()
        except BaseException:
            if system.get_file_info(at).type == fs.FileType.File:
                system.delete_file(at)
            raise
        # names follow the curve
        return Written([(at, f"{inner}/part-{first:012d}-{name}")] if out else [])

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.path)
        for m in messages:
            for a, b in m.moves if m else []:
                system.move(a, b)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.path)
        if system.get_file_info(f"{inner}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/_temporary-{self.job}")


class GeoParquetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("write to a new folder")
        plain = [f for f in schema if f.name != "_place"]
        return Writer(dict(self.options), to_arrow_schema(type(schema)(plain)))


def write_geoparquet(df: DataFrame, path: str, epsg: int | None = None, row_group: int = ROW_GROUP, part_rows: int = PART_ROWS) -> None:
    """df (rings, ...) as GeoParquet with columns geometry and bbox beside the others, into a new folder. Rows without a polygon are kept, and lie at
    the curve's start. Rows are dealt out by ranges of the curve, part_rows or so each, and sorted in each."""
    spark = df.sparkSession
    spark.dataSource.register(GeoParquetSource)
    rows = df.withColumn("bbox", F.when(F.size("rings") > 0, bounds_of(F.col("rings"))))
    e = rows.agg(F.count("*").alias("n"), *(f(f"bbox.{c}").alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax")))).first()
    box = [float(v) if v is not None else 0.0 for v in (e.xmin, e.ymin, e.xmax, e.ymax)]
    top = (1 << BITS) - 1
    cell = lambda a, b, lo, hi: F.coalesce(F.floor(((F.col(f"bbox.{a}") + F.col(f"bbox.{b}")) / 2 - lo) / max(hi - lo, 1e-300) * top), F.lit(0)).cast("long")

    def place(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.clip(x.to_numpy(), 0, top), np.clip(y.to_numpy(), 0, top)))

    encode = F.pandas_udf(lambda rings: rings.map(to_wkb), "binary")
    at = F.pandas_udf(place, "long")(cell("xmin", "xmax", box[0], box[2]), cell("ymin", "ymax", box[1], box[3]))
    others = [F.col(f"`{c}`") for c in df.columns if c != "rings"]
    out = rows.select(*others, encode("rings").alias("geometry"), "bbox", at.alias("_place"))
    out = out.repartitionByRange(max(1, -(-e.n // part_rows)), "_place").sortWithinPartitions("_place")
    writer = out.write.format("geoparquet").mode("append").option("bbox", json.dumps(box)).option("row_group", str(row_group))
    (writer if epsg is None else writer.option("epsg", str(epsg))).save(path)


def read_geoparquet(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(..., rings) of the polygons, with `bounds` (xmin, ymin, xmax, ymax) only of those whose bounds touch it; Spark's scan leaves out the row groups
    that can't."""
    df = spark.read.parquet(path)
    if bounds is not None:
        df = df.filter((F.col("bbox.xmax") >= bounds[0]) & (F.col("bbox.ymax") >= bounds[1]) & (F.col("bbox.xmin") <= bounds[2]) & (F.col("bbox.ymin") <= bounds[3]))
    decode = F.pandas_udf(lambda raw: raw.map(from_wkb), RINGS)
    return df.select(*(c for c in df.columns if c not in ("geometry", "bbox")), decode("geometry").alias("rings"))
