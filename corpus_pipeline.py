"""From raw documents to packed batches, in five stages over the operators of sparkloom.llm.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns
a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.jaccard_join import one_of_each
from sparkloom.llm.line_dedup import line_dedup
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.quality import keep_good
from sparkloom.llm.scratch import written
from sparkloom.llm.suffix_dedup import without_repeats


def _with_length(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars brought up to date, if it has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(spark, docs, sf_dir)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three-line windows that occurred before go."""
    return _with_length(line_dedup(docs, counts=False))


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return one_of_each(spark, docs, sf_dir)


def passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that also stand elsewhere go."""
    return _with_length(without_repeats(docs))


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of each document."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", passages), ("packing", packing)]
#: A trained classifier and hashed windows are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
    return docs
