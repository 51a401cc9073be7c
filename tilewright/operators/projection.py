"""Principal components of each group: co-moments that merge, and eigenvectors of all groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from .vectors import dot

SALT = 64


def _moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sums of products of deviations)."""
    mean = x.mean(0)
    return len(x), mean, (x - mean).T @ (x - mean)


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of the union: those of the parts, and what their means differ by."""
    n = np.array([p[0] for p in parts], float)
    means = np.stack([p[1] for p in parts])
    mean = n @ means / n.sum()
    off = means - mean
    return int(n.sum()), mean, sum(p[2] for p in parts) + (off * n[:, None]).T @ off


def _parse(x: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for n, mean, m2 in zip(x["n"], x["mean"], x["m2"], strict=True):
        mean = np.asarray(mean, float)
        out.append((int(n), mean, np.frombuffer(m2, float).reshape(len(mean), len(mean))))
    return out


def co_moments(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., n, mean, m2): the co-moments of each group of vectors. Null vectors, and such with null or NaN entries, don't count.

    Every Arrow batch gives a row for each of its groups; these merge in SALT parts first and then to one, so that a group with many rows is
    merged by many tasks.
    """
    key = list(by)
    fields = [df.schema[c] for c in key]
    state = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("m2", T.BinaryType()), T.StructField("_part", T.IntegerType())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            x = b.to_pandas()
            x = x[x["_x"].map(lambda v: v is not None and not np.isnan(np.asarray(v, float)).any())]
            groups = [((), x)] if not key else x.groupby(key, dropna=False, sort=False)
            rows = []
            for keys, own in groups:
                if len(own):
                    n, mean, m2 = _moments(np.stack(own["_x"].to_numpy()).astype(float))
                    rows.append((*keys, n, mean.tolist(), m2.tobytes(), k % SALT))
            if rows:
                names = [*key, "n", "mean", "m2", "_part"]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=pa.schema([*(b.schema.field(c) for c in key), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.binary()), ("_part", pa.int32())]), preserve_index=False)

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        n, mean, m2 = _merged(_parse(x))
        out = x.iloc[:1].copy()
        out["n"], out["m2"] = [n], [m2.tobytes()]
        out["mean"] = [mean.tolist()]
        return out

    rows = df.select(*key, F.transform(vector, lambda v: v.cast("double")).alias("_x")).mapInArrow(first, state)
    rows = rows.withColumn("_part", F.pmod(F.spark_partition_id() + F.col("_part"), F.lit(SALT)))
    rows = rows.groupBy(*key, "_part").applyInPandas(merge, state).withColumn("_part", F.lit(0))
    return rows.groupBy(*key, "_part").applyInPandas(merge, state).drop("_part")


def axes(moments: DataFrame, k: int = 3) -> DataFrame:
    """(by..., n, mean, axes, share): the k first eigenvectors of each group's co-moments, each pointing to its largest entry (the first of
    several), and their shares of variance. All matrices of a batch of one size are solved together; without variance shares are 0."""
    key = [c for c in moments.columns if c not in ("n", "mean", "m2")]
    out = T.StructType([*(moments.schema[c] for c in key), T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("axes", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("share", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            parts = _parse(x)
            sizes = np.array([len(p[1]) for p in parts])
            found: list = [None] * len(parts)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                values, vectors = np.linalg.eigh(np.stack([parts[i][2] for i in at]))
                vectors = vectors[:, :, ::-1][:, :, :k]
                largest = np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None, :], 1)
                vectors = vectors * np.where(largest < 0, -1.0, 1.0)
                total = np.maximum(values, 0).sum(1)
                share = np.maximum(values[:, ::-1][:, :k], 0) / np.where(total > 0, total, 1)[:, None]
                for j, i in enumerate(at):
                    found[i] = (vectors[j].T.tolist(), share[j].tolist())
            y = x[key + ["n", "mean"]].copy()
            y["axes"], y["share"] = [f[0] for f in found], [f[1] for f in found]
            yield y

    return moments.mapInPandas(run, out)


def project(vector: Column, mean: Column, axes: Column) -> Column:
    """The centred projection of a vector on each axis."""
    centred = F.zip_with(vector, mean, lambda v, m: v.cast("double") - m)
    return F.transform(axes, lambda a: dot(centred, a))


def group_pca(df: DataFrame, vector: str, *by: str, k: int = 3) -> DataFrame:
    """df with pc and share of its group; without `by` all rows are one group. Rows without a usable vector have a null pc."""
    found = axes(co_moments(df, vector, *by), k).select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("mean").alias("_mean"), F.col("axes").alias("_axes"), "share")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    usable = F.col(vector).isNotNull() & ~F.exists(F.coalesce(F.col(vector), F.array()), lambda v: v.isNull() | F.isnan(v.cast("double")))
    both = df.join(found, on, "left") if by else df.crossJoin(F.broadcast(found))  # one row
    return both.select(*df.columns, F.when(usable, project(F.col(vector), F.col("_mean"), F.col("_axes"))).alias("pc"), "share")


# --- queries -------------------------------------------------------------------------------------------------------


def _tile_pca(s: SparkSession, d: str) -> DataFrame:
    """What holds of any principal components: projections are centred, uncorrelated, and their variances add up to that of all channels times their share."""
    e = schema.table(s, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 3).alias("v"))
    out = group_pca(e, "v", "label").withColumn("share", F.aggregate("share", F.lit(0.0), lambda a, x: a + x))
    pc = [F.col("pc")[i] for i in range(3)]
    return out.groupBy("label").agg(
        F.count("*").alias("n"), *(F.round(F.abs(F.avg(c)), 6).alias(f"mean_{i}") for i, c in enumerate(pc)), F.round(F.abs(F.covar_pop(pc[0], pc[1])), 6).alias("covariance"),
        (F.var_pop(pc[0]) >= F.var_pop(pc[1])).alias("falling"), F.round(F.var_pop(pc[0]) + F.var_pop(pc[1]) + F.var_pop(pc[2]), 5).alias("variance"), F.round(F.max("share"), 6).alias("share"))


QUERIES = {"m06_pca_by_group": _tile_pca}
SQL = {
    "m06_pca_by_group": """WITH x AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)
      SELECT label, count(*) AS n, 0.0::DOUBLE AS mean_0, 0.0::DOUBLE AS mean_1, 0.0::DOUBLE AS mean_2, 0.0::DOUBLE AS covariance, true AS falling, round(var_pop(a) + var_pop(b) + var_pop(c), 5) AS variance, 1.0::DOUBLE AS share FROM x GROUP BY 1""",
}
