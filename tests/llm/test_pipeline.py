"""The stages against plain versions of the same steps."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import packing, quality


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    vocabulary = [a + b for a in ("ri", "mo", "under", "br") for b in ("ver", "ves", "old", "idge", "and")]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = sentence(70)
    rows = []
    for i in range(120):
        text = "\n".join(sentence(rng.randint(5, 40)) for _ in range(rng.randint(1, 5)))
        if i % 6 == 0:
            text = " ".join(["BUY!!", "$$$", "###"] * rng.randint(5, 40))
        elif i % 10 == 1:
            text += " " + passage
        rows.append((i, text, "en", "s", len(text)))
    rows += [(200, rows[1][1], "en", "s", 0), (201, rows[2][1] + " extra", "en", "s", 0), (202, None, None, None, None), (203, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    bad = {i for i in range(120) if i % 6 == 0}
    good = {r[0] for r in rows} - bad
    assert len(set(seen[0]) & bad) == 0 and good - {202, 203} <= set(seen[0])
    scores = {r["doc_id"]: r["score"] for r in quality.scored(spark.read.parquet(f"{tmp_path}/documents.parquet"), quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    assert set(seen[0]) == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    assert set(seen[1]) == set(seen[0]) and all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in seen[1].values())
    left_over = {i: r["text"] for i, r in seen[1].items()}
    assert 201 not in seen[2] or left_over[201] == "" or 2 not in seen[2] or left_over[2].split()[:5] != left_over[201].split()[:5]
    assert all(passage not in (r["text"] or "") for r in seen[3].values())
    assert set(seen[4]) == set(seen[3]) == set(seen[2])
    assert {i: r["n_tokens"] for i, r in seen[4].items()} == {i: len((r["text"] or "").split()) for i, r in seen[3].items()}


def test_run_equals_stages(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, f"some words {i % 3} here and there", "en", "s", 5) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_packing_of_many_lengths(spark, monkeypatch):
    """The last stage over more than 100,000 different lengths pads as little as can be."""
    import corpus_pipeline

    n = packing.EXACT + 500
    monkeypatch.setattr(packing, "n_words", lambda text: text.cast("long"))  # such texts would be too long for a test
    docs = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") + 1).cast("string").alias("text"))
    got = corpus_pipeline.packing(spark, docs, "").groupBy("bucket_length").agg(F.count("*").alias("n"), F.max("n_tokens").alias("longest")).collect()
    lengths = np.arange(1, n + 1)
    bounds = np.array(packing.optimal_bounds(lengths, np.ones(n, np.int64), packing.BUCKETS))
    assert sorted(r["bucket_length"] for r in got) == bounds.tolist() and all(r["longest"] == r["bucket_length"] for r in got)
    size = n // 16  # by arithmetic: n = 16 * size + rest, in buckets of size and size + 1 lengths
    rest = n - 16 * size
    assert (bounds[np.searchsorted(bounds, lengths)] - lengths).sum() == (16 - rest) * size * (size - 1) // 2 + rest * size * (size + 1) // 2
