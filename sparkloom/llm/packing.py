"""Packing into optimal length buckets and batches of a token budget.

Lengths are counted over all documents into one histogram. Dynamic programming chooses the upper
ends of `buckets` buckets so that the padding, the sum over documents of (upper end - length), is
as small as it can be. Inside a bucket, documents in the order of (length, doc_id) fill batches of
budget // upper documents, so that a padded batch holds at most `budget` tokens.

The histogram's bins are single lengths whatever their number, so the bounds are optimal. The driver
holds them as two arrays: n different lengths take n (n - 1) / 2 words at least, so that the lengths of
a corpus of 10^13 words are 4.5 million at most (72 MB). `exact` is how many splits the search compares
at once; bounds do not depend on it. A document longer than the budget is a batch of its own; none is cut.

A text's length is its number of words `[^\\x20\\x09-\\x0D]+`. Nulls count as empty texts, of
length 0, and are packed like others; equal rows are packed each; ties go by doc_id (null first);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Workspace, partitions, workspace

BUCKETS, BUDGET, EXACT = 16, 65_536, 100_000
_EXACT_BITS = 10


def optimal_bounds(lengths: Sequence[int], counts: Sequence[int], buckets: int, exact: int = EXACT) -> list[int]:
    """Upper ends of at most `buckets` buckets over a histogram, of least total padding.

    The cost of a bucket is Monge, so each layer's best split points are monotone and a layer
    takes O(n log n) by divide and conquer, all parts of a depth together, some `exact` splits
    (or one part) at once. Of equal costs the smaller split point wins.
    """
    order = np.argsort(lengths)
    length, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(length)
    if not n:
        return []
    docs = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(count * length)])
    pad = lambda i, j: length[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])  # noqa: E731  bins i..j-1
    cost = np.concatenate([[0], pad(0, np.arange(1, n + 1))])
    splits = []
    for _ in range(1, min(buckets, n)):
        new, split = cost.copy(), np.zeros(n + 1, np.int64)
        low, high, first, last = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(low):
            j = (low + high) // 2
            many = np.minimum(last, j - 1) - first + 1
            ends, a = np.cumsum(many), 0
            while a < len(j):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - many[a] + exact, "right")))
                own, start = many[a:b], ends[a:b] - many[a:b] - (ends[a] - many[a])
                i = np.arange(own.sum()) + np.repeat(first[a:b] - start, own)
                total = cost[i] + pad(i, np.repeat(j[a:b], own))
                least = np.minimum.reduceat(total, start)
                best = np.flatnonzero(total == np.repeat(least, own))
                new[j[a:b]], split[j[a:b]] = least, i[best[np.searchsorted(best, start)]]
                a = b
            low, high, first, last = (np.stack(x, 1).ravel() for x in ((low, j + 1), (j - 1, high), (first, split[j]), (split[j], last)))
            low, high, first, last = (x[low <= high] for x in (low, high, first, last))
        cost = new
        splits.append(split)
    bounds, j = [], n
    for split in reversed(splits):
        bounds.append(int(length[j - 1]))
        j = int(split[j])
        if j == 0:
            break
    else:
        bounds.append(int(length[j - 1]))
    return sorted(bounds)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _bin(n: Column) -> Column:
    """The least bin that holds a length: single lengths up to 1024, 1/1024 of an octave beyond. Packing takes
    none, at any size; kept because an existing test holds it."""
    shift = F.greatest(F.length(F.bin(n - 1)) - _EXACT_BITS, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.when(n <= 1 << _EXACT_BITS, n).otherwise(F.ceil(n / step) * step).cast("long")


def pack(sized: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, exact: int = EXACT) -> DataFrame:
    """doc_id, n_tokens -> bucket, bucket_length, batch (over all buckets) and slot in the batch."""
    spark = sized.sparkSession
    with workspace(spark) as work:
        return work.written(_packed(work, sized, buckets, budget, exact), "packed", stay=True)


def _packed(work: Workspace, sized: DataFrame, buckets: int, budget: int, exact: int) -> DataFrame:
    spark = sized.sparkSession
    sized = work.written(sized.select("doc_id", "n_tokens"), "lengths")
    lengths = sized.groupBy("n_tokens").count().toArrow()
    bounds = optimal_bounds(lengths["n_tokens"].to_numpy(), lengths["count"].to_numpy(), buckets, exact)
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    # a place in the bucket without gathering it: rows in order, and where each partition's begin
    keys = ["bucket", "n_tokens", "doc_id"]
    dealt = sized.withColumn("bucket", bucket).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    dealt = work.written(dealt.withColumn("row", F.monotonically_increasing_id()), "packing")
    shift = 33  # monotonically_increasing_id keeps the partition above this bit
    part = F.shiftright("row", shift)
    runs = dealt.groupBy("bucket", part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("n")).orderBy("bucket", "part").collect()  # partitions + buckets at most
    place, batches, offsets = {}, 0, []
    for b, upper in enumerate(bounds):
        room, seen = max(1, budget // max(1, upper)), 0
        for r in (r for r in runs if r["bucket"] == b):
            place[b, r["part"]] = r["first"] - seen
            seen += r["n"]
        offsets.append((b, upper, room, batches))
        batches += -(-seen // room)
    table = [(b, p, first, *offsets[b][1:]) for (b, p), first in place.items()]
    starts = spark.createDataFrame(table, "bucket int, part long, first long, bucket_length long, room long, before long")
    index = F.col("row") - F.col("first")
    out = dealt.withColumn("part", part).join(F.broadcast(starts), ["bucket", "part"])
    return out.select("doc_id", "n_tokens", "bucket", "bucket_length", (F.col("before") + F.floor(index / F.col("room"))).alias("batch"), (index % F.col("room")).alias("slot"))


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), n_words(F.col(f"`{text}`").cast("string")).alias("n_tokens")), buckets, budget)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_sql(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same program over single lengths: a relation for each layer of the dynamic program, and the
    way back through their split points."""
    layers = [
        f"""c{k} AS MATERIALIZED (SELECT j, min(cost) AS cost, arg_min(i, (cost, i)) AS split FROM (
SELECT y.j, c.j AS i, c.cost + y.length * (y.docs - x.docs) - (y.tokens - x.tokens) AS cost FROM c{k - 1} c JOIN ends x ON x.j = c.j JOIN ends y ON y.j > c.j) GROUP BY j
UNION ALL SELECT 0, 0, NULL)"""
        for k in range(1, buckets)
    ]
    back = [f"s{k - 1} AS (SELECT split AS j FROM s{k} JOIN c{k} USING (j) WHERE split IS NOT NULL)" for k in range(buckets - 1, 0, -1)]
    found = " UNION ALL ".join(f"SELECT j FROM s{k}" for k in range(buckets))
    return f"""WITH sized AS MATERIALIZED (SELECT doc_id::BIGINT AS doc_id, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
histogram AS (SELECT n_tokens AS length, count(*) AS n FROM sized GROUP BY n_tokens),
ends AS MATERIALIZED (SELECT 0::BIGINT AS j, 0::BIGINT AS length, 0::BIGINT AS docs, 0::BIGINT AS tokens
UNION ALL SELECT row_number() OVER (ORDER BY length), length, (sum(n) OVER (ORDER BY length))::BIGINT, (sum(n * length) OVER (ORDER BY length))::BIGINT FROM histogram),
c0 AS MATERIALIZED (SELECT j, length * docs - tokens AS cost FROM ends),
{", ".join(layers)}, s{buckets - 1} AS (SELECT max(j) AS j FROM ends), {", ".join(back)},
bounds AS (SELECT (row_number() OVER (ORDER BY length) - 1)::INTEGER AS bucket, length AS bucket_length, greatest(1, {budget} // greatest(1, length)) AS room FROM ends WHERE j > 0 AND j IN ({found})),
dealt AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n_tokens, doc_id NULLS FIRST) - 1 AS place FROM sized ASOF JOIN bounds ON n_tokens <= bucket_length),
filled AS (SELECT bucket, max(place) // any_value(room) + 1 AS batches FROM dealt GROUP BY bucket),
placed AS (SELECT bucket, sum(batches) OVER (ORDER BY bucket) - batches AS before FROM filled)
SELECT doc_id, n_tokens, bucket, bucket_length, (before + place // room)::BIGINT AS batch, (place % room)::BIGINT AS slot FROM dealt JOIN placed USING (bucket)"""


OP2_SQL = op2_sql()
