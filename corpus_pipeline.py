"""A corpus in five steps: quality, near-duplicates, benchmark leaks, mixing and shards.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them again for the next one.

Defined results, stage by stage:

* quality: null texts count as empty; ties of the score are judged alike; repeated rows are judged alike.
* near_duplicates: null texts and texts without words have no near-duplicate and stay. Of a group the least id stays. Rows that
  repeat an id are one document: all stay or all go. Rows without an id always stay, as no id tells which of them would go.
* decontamination: null texts and texts without words stay.
* mixture: null texts have no words and are taken by the same rates; rows that repeat an id are taken equally often; a null source is
  a source of its own.
* shards: null texts are empty; repeated rows and rows without an id are rows like any other; equal texts lie together.

Columns of documents, whatever their names, go through all stages but the last. Empty tables give empty results. The last stage
writes the texts by shard below the shared folder and returns a digest that is read back from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import common, decontaminate, minhash, mixing, quality, sharding

SHINGLE = 5


def _apart(docs: DataFrame, *columns: str) -> DataFrame:
    """Whole rows as _row beside the columns in use, so that no other column can clash with what an operator adds."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the rule ensemble, fitted on the labelled rows of docs, takes for good."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(_apart(docs, "text"), model).filter(F.col("predicted") == 1).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group that five-word shingles link at a similarity of 0.8 or more."""
    groups = minhash.near_duplicates(docs, common.Stages(spark, "near"), k=SHINGLE)
    return docs.join(groups.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without the question and answer of a benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of its source says: not at all, once or twice."""
    mixed = mixing.mix(_apart(docs, "doc_id", "text", "source"), common.Stages(spark, "mix")).filter(F.col("copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the mix out to shards of equal row counts, moving the fewest bytes, and writes it."""
    return sharding.digest(docs, common.Stages(spark, "shards"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards),
]

#: The stages learn and search; their rows are held against brute-force versions in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = common.Stages(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        new = stages.put(stage(spark, docs, sf_dir))
        if k:
            stages.drop(docs)
        docs = new
    return docs
