"""Small helpers that several operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def settled(df: DataFrame) -> DataFrame:
    """`df` checkpointed to the folder that all executors share; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):  # a local folder is out of the executors' reach
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkloom-"))
    return df.checkpoint()


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in an order that the caller makes total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).filter("_n = 1").drop("_n")


def top(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n rows, without sorting the rest."""
    return df.orderBy(*order).limit(n)


def packed(df: DataFrame, tokens: Column, budget: int, order: list) -> DataFrame:
    """The longest prefix of the rows whose tokens fit the budget; the first row always stays.
    Every row costs a token at least, so that no more rows than the budget are looked at."""
    rows = top(df.withColumn("_tokens", F.greatest(tokens, F.lit(1))), max(1, budget), order)
    w = Window.orderBy(*order)
    rows = rows.withColumn("_sum", F.sum("_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return rows.filter((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_tokens", "_sum", "_n")
