"""Small files and saved epochs through Spark's own file systems, so that any path works that Spark can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path or URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder in spark.checkpoint.dir. Where that is unset, a temporary one serves a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Puts a written folder in the place of another, which goes to `old`.old until the new one is there."""
    fs, target = file_system(spark, old)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{old.rstrip('/')}.old")
    fs.delete(aside, True)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"{old} can't be moved")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(new), target):
        raise OSError(f"{new} can't be moved; the rows are there and in {aside}")
    fs.delete(aside, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file: configuration or a report."""
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def drop_epochs(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes the complete epochs but the newest."""
    for e in epochs(spark, path)[: -keep if keep else None]:
        fs, p = file_system(spark, f"{path.rstrip('/')}/epoch={e}")
        fs.delete(p, True)


def epochs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete epochs below a path."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    found = [(str(f.getPath().getName()), f.getPath()) for f in fs.listStatus(p)]
    done = lambda x: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))
    return sorted(int(m[1]) for name, at in found if (m := re.fullmatch(r"epoch=(\d+)", name)) and done(at))


def latest(spark: SparkSession, path: str, keep: int) -> list[int]:
    """The newest epochs, newest first."""
    return epochs(spark, path)[::-1][:keep]


class Kept:
    """Tables written to the shared folder to cut lineage between the rounds of an iteration; drop() removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n, self.live = spark, scratch(spark, name), 0, set()

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_path = path
        self.live.add(path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            fs, at = file_system(self.spark, df.kept_path)
            fs.delete(at, True)
            self.live.discard(df.kept_path)

    def last(self, df: DataFrame) -> DataFrame:
        """df written; all other tables are removed, as it reads none of them any more."""
        out = self.put(df)
        for path in self.live - {out.kept_path}:
            fs, at = file_system(self.spark, path)
            fs.delete(at, True)
        self.live = {out.kept_path}
        return out
