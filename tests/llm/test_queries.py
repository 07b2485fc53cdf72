"""Registered queries and whole stages against plain versions and SQL."""

import collections
import hashlib
import os
import random

import duckdb
import pytest

from sparkloom.llm import byte_bpe, packing, quality

from test_text_operators import brute_components, brute_lines, brute_padding, corpus, frame, quality_table, repeated, words

SF = "/root/testdata/sf0.01"


def test_packing_equals_its_sql(spark, tmp_path):
    texts = [*corpus(), *("w " * n for n in (1027, 1500, 1501, 20_000, 70_000)), "", None]
    ids = [None if i % 17 == 3 else i // 2 for i in range(len(texts))]  # repeated and missing ids
    frame(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    con.execute("CREATE TABLE nothing AS SELECT * FROM documents LIMIT 0")
    got = packing.op2_packing(spark, str(tmp_path))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(con.execute(packing.OP2_SQL).fetchall())
    few = packing.op2_sql(3, 100)
    lengths = [len(words(t)) for t in texts]
    rows = con.execute(few).fetchall()
    assert sum(r[3] - r[1] for r in rows) == brute_padding(lengths, 3)
    assert sorted(map(str, map(tuple, packing.pack_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), 3, 100).collect()))) == sorted(map(str, rows))
    assert con.execute(packing.OP2_SQL.replace("FROM documents", "FROM nothing")).fetchall() == []


def test_packing_is_optimal_for_any_number_of_lengths(spark, tmp_path):
    """Lengths of one octave, that bins would not tell apart, against the SQL; `exact` changes no result."""
    rng = random.Random(5)
    lengths = [rng.randint(5000, 5060) for _ in range(60)] + [2050, 2051, 2052, 0]
    frame(spark, ["w " * n for n in lengths]).write.parquet(f"{tmp_path}/documents.parquet")
    sized = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = collections.Counter(con.execute(packing.op2_sql(5, 20_000)).fetchall())
    for exact in (1, 4, 1000):
        assert collections.Counter(map(tuple, packing.pack(sized, 5, 20_000, exact).collect())) == want


def test_byte_bpe_query(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    rng = random.Random(2)
    texts = [*corpus(), "".join(rng.choice("abcdefgh") for _ in range(50_000)), "é" * 9000, None, "same", "same"]
    ids = [None if i == 5 else i for i in range(len(texts))]
    frame(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load().ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in zip(ids, texts, strict=True):
        tokens = peer.encode_ordinary(t or "")
        want.append((i, len(tokens), sha(" ".join(map(str, tokens)).encode()), sha((t or "").encode())))
    assert collections.Counter(map(tuple, byte_bpe.op8_byte_bpe(spark, str(tmp_path)).collect())) == collections.Counter(want)


@pytest.mark.parametrize("letters", ["ab", "etaoin shrdlu", "aé😀"])
def test_one_tree_and_many_agree(letters):
    rng, bpe = random.Random(3), byte_bpe.load()
    for n in (2, 3, 7, 64, 65, 700):
        pieces = ["".join(rng.choice(letters) for _ in range(n)).encode() for _ in range(4)]
        width = 1 << (max(map(len, pieces)) - 1).bit_length()
        assert [bpe._tree(p, width) for p in pieces] == list(bpe._trees(pieces, width))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_quality_on_held_out_labels(spark):
    """Rows that the model never saw."""
    got = {r["doc_id"]: r for r in quality.op10_quality(spark, SF).filter("held_out").collect()}
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in got}
    assert len(y) > 30 and len(set(y.values())) == 2
    pairs = [(got[a]["score"] > got[b]["score"]) + 0.5 * (got[a]["score"] == got[b]["score"]) for a in y for b in y if y[a] == 1 and y[b] == 0]
    assert sum(pairs) / len(pairs) > 0.95
    assert sum(got[i]["predicted"] == v for i, v in y.items()) / len(y) > 0.95


def test_quality_learns_from_no_longer_documents(spark):
    docs, labels, _ = quality_table(spark, 40)
    long = frame(spark, ["BUY!! $$$ " * 5000], [1])  # labelled good, 157 passages
    both = docs.filter("doc_id <> 1").unionByName(long)
    a, b = (quality.fit(d, labels, longest=100) for d in (docs.filter("doc_id <> 1"), both))
    assert all((a.w[k] == b.w[k]).all() for k in a.w)
    assert quality.scored(both, b).filter("doc_id = 1").count() == 1


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage on its own input; columns whose names the stages use inside go through unchanged."""
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = [a + b for a in ("ri", "mo", "under", "br", "é") for b in ("ver", "ves", "old", "idge", "and")]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, block = sentence(90), "\n".join(sentence(12) for _ in range(4))
    texts = []
    for i in range(70):
        text = "\n".join(sentence(rng.randint(5, 40)) for _ in range(rng.randint(1, 5)))
        texts.append(" ".join(["BUY!!", "$$$"] * 30) if i % 7 == 0 else f"{text}\n{block}" if i % 5 == 1 else f"{text} {passage}" if i % 6 == 2 else text)
    for i in (1, 3, 9, 15):
        near = texts[i].split(" ")
        near[len(near) // 2] = "edit"
        texts += [" ".join(near), texts[i]]
    texts += [None, "", " \n\t", "ri", "under old " * 900]
    schema = "doc_id long, text string, _id long, _digest string, label string, digest string, n_chars long"
    spark.createDataFrame([(i, t, i, "d", "l", "x", len(t or "")) for i, t in enumerate(texts)], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0)) for i in range(70)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        ids = sorted(before)
        if k == 0:
            scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
            want = {i: t for i, t in before.items() if scores[i] >= quality.THRESHOLD}
            assert not set(want) & set(range(0, 70, 7)) and set(range(70)) - set(range(0, 70, 7)) <= set(want)
        elif k == 1:
            want = {i: kept for i, (kept, _, _) in zip(ids, brute_lines([(i, before[i]) for i in ids]), strict=True)}
        elif k == 2:
            label = {i: c for i, _, c, _ in brute_components([before[i] for i in ids], ids)}
            want = {i: t for i, t in before.items() if label[i] == i}
            assert len(want) < len(before)
        elif k == 3:
            raw = [(before[i] or "").encode() for i in ids]
            want = {i: bytes(b for b, g in zip(row, gone, strict=True) if not g).decode(errors="ignore") for i, row, gone in zip(ids, raw, repeated(raw, 200), strict=True)}
            assert want != before
        else:
            want = {i: len(words(t)) for i, t in before.items()}
            assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(want)
            assert sum(r["bucket_length"] - r["n_tokens"] for r in rows) == sum(r["bucket_length"] - r["n_tokens"] for r in packing.pack_documents(docs).collect())
            break
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert len(rows) == len(want) and {r["doc_id"]: r["text"] or "" for r in rows} == {i: t or "" for i, t in want.items()}
        assert all((r["_id"], r["_digest"], r["label"], r["digest"]) == (r["doc_id"], "d", "l", "x") for r in rows)
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f g"), (None, "a b c d e f g"), (1, "a b c d e f g"), (1, None), (1, "other text"), (1, "other text")]])
def test_run_on_odd_tables(spark, tmp_path, rows):
    """No documents, no labels, missing and repeated ids."""
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == ([(1, 0), (1, 2), (1, 7)] if rows else [])
