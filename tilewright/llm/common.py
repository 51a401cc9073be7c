"""Shared pieces: tables, the shared work folder, text and word definitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Collection, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside ASCII white space (0x20, 0x09-0x0D).
NOT_WORD = r"[\x20\x09-\x0D]+"
#: The same in DuckDB, A-Z lower-cased: a list of the words of `text`.
SQL_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = f"list_filter(regexp_split_to_array({SQL_FOLDED}, '{NOT_WORD}'), lambda x: x <> '')"
#: A Python worker handles at most about so many text bytes at once, whatever the Arrow batch holds.
CHUNK_BYTES = 8 << 20
#: Places of the bitmaps of among(), 4 MB in all, and of one of its rows.
PLACES, ROW_PLACES = 1 << 25, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, spark.checkpoint.dir. Where that is unset, a temporary one, as in tests: only with a local
    master, whose tasks all see it, else RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path or URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Stages:
    """Tables written to the shared folder to cut lineage; drop() removes those that nothing reads any more.

    A lost executor costs only the tasks that it ran: what a stage has written is read again from the shared folder. Tables that a
    result still reads stay there after it; clear() removes those when the result has been used.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.live: set[str] = set()

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.live.add(path)
        out._stage_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(df._stage_path)

    def clear(self, *keep: DataFrame, before: Collection[str] = ()) -> None:
        """Removes all tables but those in keep and those that were there before: a copy of `live` from then."""
        for path in self.live - {df._stage_path for df in keep} - set(before):
            self._delete(path)

    def _delete(self, path: str) -> None:
        fs, at = file_system(self.spark, path)
        fs.delete(at, True)
        self.live.discard(path)


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key stands in ids (key), and a few others, so a join has to follow; it then shuffles few rows in vain. A bitmap of
    hashed ids is broadcast, 4 MB at most however many there are: more ids let more rows through, none is lost."""
    place = F.pmod(F.xxhash64(key), F.lit(PLACES))
    part, at = unused("_part", rows.columns), unused("_at", rows.columns)
    bits = unused("_bits", rows.columns)
    maps = ids.select(place.alias(at)).groupBy(F.floor(F.col(at) / ROW_PLACES).alias(part)).agg(F.bitmap_construct_agg(F.col(at) % ROW_PLACES).alias(bits))
    both = rows.withColumn(at, place).withColumn(part, F.floor(F.col(at) / ROW_PLACES)).join(F.broadcast(maps), part)
    byte = F.expr(f"cast(conv(hex(substring({bits}, cast({at} % {ROW_PLACES} div 8 as int) + 1, 1)), 16, 10) as int)")
    return both.filter(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1).select(*(F.col(f"`{c}`") for c in rows.columns))


def words(text: Column) -> Column:
    """The words of a text as an array; null or no words: empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def byte_words(text: bytes) -> list[bytes]:
    """bytes.split() splits at exactly the ASCII white space of NOT_WORD; bytes.lower() maps A-Z only."""
    return text.lower().split()


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    if pa.types.is_null(column.type):
        return [None] * len(column)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about CHUNK_BYTES of text each, at least a row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_pylist() if batch.num_rows else []
        start = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= CHUNK_BYTES:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def unused(name: str, columns: Collection[str]) -> str:
    """name, with underscores behind it until no column has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learned: crc32 of the id as text, modulo 5, is 0. Null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
