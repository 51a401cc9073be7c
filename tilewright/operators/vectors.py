"""Embeddings: similarities by array functions, prototypes, nearest vectors, clusters and projections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; shorter than TINY: over TINY."""
    n = F.greatest(norm(a), F.lit(TINY))
    return F.transform(a, lambda x: x / n)


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def similarities(v: Column, prototypes: Column) -> Column:
    """Cosine of a unit vector to each of an array of unit vectors."""
    return F.transform(prototypes, lambda p: dot(v, p))


def best_similarity(v: Column, prototypes: Column) -> Column:
    return F.array_max(similarities(v, prototypes))


def contrast(v: Column, positive: Column, negative: Column) -> Column:
    return best_similarity(v, positive) - best_similarity(v, negative)


def winner(v: Column, prototypes: Column) -> Column:
    """Number of the nearest prototype, the first of several."""
    s = similarities(v, prototypes)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def mean_vector(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., mean, unit) of each group: means by position, so partial sums meet; a vanishing mean raises when read."""
    x = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v")).select(*by, F.col("v.m").alias("mean"))
    ok = norm(F.col("mean")) > TINY
    return v.withColumn("unit", F.when(ok, unit(F.col("mean"))).otherwise(F.raise_error(F.lit("the mean vector vanishes"))))


def nearest(df: DataFrame, centroids: DataFrame, n: int, key: str, vector: str) -> DataFrame:
    """(centroid, key, dist, place): the n vectors nearest to each centroid by 1 - cosine, ties by key.

    centroids: (centroid, c), a stated set of queries that must fit 64 MB. Each task keeps its own n for every centroid
    before the shuffle, so a window gets n rows of each task at most.
    """
    c = centroids.select("centroid", F.col("c").alias("_c"))
    dist = df.select(key, vector).crossJoin(F.broadcast(bounded(c, "_c"))).select("centroid", key, (1 - dot(F.col(vector), F.col("_c"))).alias("dist"))
    local = dist.withColumn("_p", F.spark_partition_id())
    top = lambda d, *by: d.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("dist", key))).filter(F.col("place") <= n)
    return top(top(local, "centroid", "_p").drop("_p", "place"), "centroid")


def bounded(df: DataFrame, vector: str, most: int = 64 << 20) -> DataFrame:
    """df, if its vectors take at most `most` bytes; else ValueError."""
    size = df.agg(F.sum(F.size(vector) * 8)).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} bytes of query vectors; at most {most} are broadcast, so search in blocks")
    return df


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, tries: int = 3) -> tuple[DataFrame, list[list[float]]]:
    """df with cluster, by raw centroids, and the centroids at unit length."""
    data = df.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    models = [KMeans(k=k, featuresCol="_f", predictionCol="cluster", maxIter=300, seed=seed + t).fit(data) for t in range(tries)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    centres = [np.asarray(c) / max(float(np.linalg.norm(c)), TINY) for c in best.clusterCenters()]
    return best.transform(data).drop("_f"), [c.tolist() for c in centres]


def silhouette(df: DataFrame, vector: str, cluster: str, key: str, most: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: mean Euclidean silhouette over at most `most` rows, which is a parameter of the estimate, as in a subsample.

    The sample meets itself in blocks: each row of the sample is one query against all of the sample, which is at most `most` vectors.
    """
    from .sampling import hash_order

    sample = df.orderBy(hash_order(F.col(key), seed), key).limit(most).select(F.col(vector).alias("v"), F.col(cluster).alias("c"))
    points = sample.toPandas()  # most rows
    x, c = np.stack(points["v"]) if len(points) else np.zeros((0, 1)), points["c"].to_numpy()
    ids, first = np.unique(c, return_inverse=True)
    shared = df.sparkSession.sparkContext.broadcast((x.astype(np.float64), first, len(ids)))

    def score(batches):
        x, c, k = shared.value
        sizes = np.bincount(c, minlength=k)
        for b in batches:
            at = b["i"].to_numpy()
            d = np.sqrt(np.maximum((x[at] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[at] @ x.T, 0))
            sums = np.stack([d[:, c == j].sum(1) for j in range(k)], 1)
            own = c[at]
            a = sums[np.arange(len(at)), own] / np.maximum(sizes[own] - 1, 1)
            means = sums / np.maximum(sizes, 1)
            means[np.arange(len(at)), own] = np.inf
            o = means.min(1)
            yield pd.DataFrame({"s": np.where(sizes[own] > 1, (o - a) / np.maximum(np.maximum(a, o), TINY), 0.0)})

    return df.sparkSession.range(len(points)).withColumnRenamed("id", "i").mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette"))


def pca(df: DataFrame, vector: str, k: int = 3) -> tuple[DataFrame, list[float]]:
    """df with pc, the centred projection, and the shares of variance. Each axis points to its largest entry."""
    mean = mean_vector(df.withColumnRenamed(vector, "_x"), "_x").select("mean").first()[0]
    centred = df.withColumn("_f", array_to_vector(F.zip_with(vector, literal(mean), lambda a, b: a.cast("double") - b)))
    model = PCA(k=k, inputCol="_f", outputCol="_pc").fit(centred)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    out = model.transform(centred).withColumn("pc", F.zip_with(vector_to_array("_pc"), literal(signs), lambda a, s: a * s)).drop("_f", "_pc")
    return out, model.explainedVariance.toArray().tolist()


def select_best_k(scores: dict[int, float]) -> int:
    """The first k of the greatest silhouette."""
    return max(sorted(scores), key=lambda k: scores[k])


# --- queries -------------------------------------------------------------------------------------------------------


def _e(s: SparkSession, d: str) -> DataFrame:
    return schema.table(s, d, "embeddings")


def _prototypes(e: DataFrame, where: str) -> DataFrame:
    """One row: an array of the first vectors by id that meet `where`, three at most."""
    p = e.filter(where).orderBy("vec_id").limit(3)
    return p.agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("p")).select(F.col("p.embedding").alias("protos"))


def _with_protos(s, d):
    e = _e(s, d)
    pos, neg = _prototypes(e, "label = 1").withColumnRenamed("protos", "pos"), _prototypes(e, "label = 2").withColumnRenamed("protos", "neg")
    return e.crossJoin(F.broadcast(pos)).crossJoin(F.broadcast(neg))  # a row of three vectors each


def _kmeans(s, d):
    labelled, centres = kmeans(_e(s, d), "embedding", 3)
    return labelled.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("k", F.lit(len(centres)))


def _silhouette(s, d):
    return silhouette(_e(s, d), "embedding", "label", "vec_id").select(F.round("silhouette", 4).alias("silhouette"))


def _pca(s, d):
    out, shares = pca(_e(s, d), "embedding")
    return out.groupBy("label").agg(*(F.round(F.avg(F.col("pc")[i]), 6).alias(f"pc{i + 1}") for i in range(3))).withColumn("share", F.lit(round(sum(shares), 6)))


QUERIES = {
    "a26_mean_vector": lambda s, d: mean_vector(_e(s, d), "embedding", "label").select("label", F.round(F.element_at("unit", 1), 6).alias("first"), F.round(F.element_at("unit", 64), 6).alias("last"), F.round(norm(F.col("unit")), 6).alias("length")),
    "f16_cosine": lambda s, d: _with_protos(s, d).select("vec_id", F.round(dot(F.col("embedding"), F.col("pos")[0]), 5).alias("cosine")),
    "f17_best_prototype": lambda s, d: _with_protos(s, d).select("vec_id", F.round(best_similarity(F.col("embedding"), F.col("pos")), 5).alias("score")),
    "f18_contrast": lambda s, d: _with_protos(s, d).select("vec_id", F.round(contrast(F.col("embedding"), F.col("pos"), F.col("neg")), 5).alias("score")),
    "f19_winner": lambda s, d: _with_protos(s, d).select("vec_id", winner(F.col("embedding"), F.col("pos")).alias("winner")),
    "f20_unit": lambda s, d: _e(s, d).select("vec_id", unit(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u")).select("vec_id", F.round(norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 5).alias("first")),
    "o03_nearest_vectors": lambda s, d: nearest(_e(s, d), _e(s, d).filter("vec_id < 4").select(F.col("vec_id").alias("centroid"), F.col("embedding").alias("c")), 6, "vec_id", "embedding").select("centroid", "vec_id", F.round("dist", 5).alias("dist"), "place"),
    "m04_kmeans": _kmeans,
    "m05_silhouette": _silhouette,
    "m06_pca": _pca,
}
P = "p AS (SELECT list(embedding ORDER BY vec_id)[1:3] AS pos FROM embeddings WHERE label = 1), q AS (SELECT list(embedding ORDER BY vec_id)[1:3] AS neg FROM embeddings WHERE label = 2), x AS (SELECT *, embedding::DOUBLE[] AS e, list_transform(pos, lambda v: list_inner_product(embedding::DOUBLE[], v::DOUBLE[])) AS s, list_transform(neg, lambda v: list_inner_product(embedding::DOUBLE[], v::DOUBLE[])) AS t FROM embeddings, p, q)"
SQL = {
    "a26_mean_vector": """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
      SELECT label, round(max(m / n) FILTER (i = 1), 6) AS first, round(max(m / n) FILTER (i = 64), 6) AS last, 1.0::DOUBLE AS length FROM m JOIN n USING (label) GROUP BY 1""",
    "f16_cosine": f"WITH {P} SELECT vec_id, round(s[1], 5) AS cosine FROM x",
    "f17_best_prototype": f"WITH {P} SELECT vec_id, round(list_max(s), 5) AS score FROM x",
    "f18_contrast": f"WITH {P} SELECT vec_id, round(list_max(s) - list_max(t), 5) AS score FROM x",
    "f19_winner": f"WITH {P} SELECT vec_id, (list_position(s, list_max(s)) - 1)::INT AS winner FROM x",
    "f20_unit": "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))) AS n FROM embeddings) SELECT vec_id, 1.0::DOUBLE AS length, round(embedding[1]::DOUBLE / n, 5) AS first FROM n",
    "o03_nearest_vectors": "WITH d AS (SELECT c.vec_id AS centroid, e.vec_id, 1 - list_inner_product(e.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS dist FROM embeddings e, embeddings c WHERE c.vec_id < 4), r AS (SELECT *, row_number() OVER (PARTITION BY centroid ORDER BY dist, vec_id)::INT AS place FROM d) SELECT centroid, vec_id, round(dist, 5) AS dist, place FROM r WHERE place <= 6",
}
SQL["m05_silhouette"] = """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, label AS c FROM embeddings ORDER BY md5(vec_id::VARCHAR || '|42'), vec_id LIMIT 10000),
  d AS (SELECT a.vec_id, a.c, b.c AS k, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM s a, s b GROUP BY 1, 2, 3),
  x AS (SELECT vec_id, max(CASE WHEN c = k THEN t / greatest(n - 1, 1) END) AS a, min(CASE WHEN c <> k THEN t / n END) AS o, max(CASE WHEN c = k THEN n END) AS n FROM d GROUP BY 1)
  SELECT round(avg(CASE WHEN n > 1 THEN (o - a) / greatest(greatest(a, o), 1e-12) ELSE 0 END), 4) AS silhouette FROM x"""
