"""The corpus pipeline: stages applied in order to documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir); docs is what the stage before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm._spark import Workspace
from engram.llm.decontamination import drop_contaminated
from engram.llm.mixing import mixed_copies
from engram.llm.ngram_join import keep_one_per_group
from engram.llm.quality_rules import keep_good
from engram.llm.queries import mix_levels, mix_weight
from engram.llm.sharding import shuffle_into_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go: null, empty and short texts among them. Rows are judged one by one, so repeated rows
    share their fate; an empty table stays empty, and columns of any name pass through. The same holds for every stage."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the smallest doc_id stays, with all its rows.
    Texts without words are no duplicates; rows of null doc_id stay."""
    return keep_one_per_group(docs, n=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated by benchmark items go; null and empty texts are clean, and an empty benchmark finds nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, min_share=20)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target weights take them; the budget is as large as all there is. Null levels form leaves of
    their own; which of equal rows comes first doesn't matter."""
    return mixed_copies(docs, mix_levels(), mix_weight(), budget_percent=100, max_epochs=3, seed=11)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in eight shards of equal size, with their slots. Columns of docs named shard or slot are replaced."""
    text = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return shuffle_into_shards(docs, [F.col("doc_id"), text], shards=8, seed=20)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("sharding", sharding),
]

#: Suffix-array verdicts and hypergeometric draws have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
