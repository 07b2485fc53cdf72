"""The registered analogues against brute force on small tables."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from sparkloom.operators import graph
from sparkloom.plans import analogues


def test_edge_weights_keep_frequent_names(spark, tmp_path):
    """A name in 21 documents and more is far from ubiquitous; all its edges stay."""
    texts = [("Widget one\nand Widget" if i < 3 else "a Widget here" if i < 40 else "Gadget alone") for i in range(60)]
    spark.createDataFrame([(i, "s", t, "en") for i, t in enumerate(texts)], "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = [Counter(w for w in re.findall("[A-Za-z]+", t) if len(w) >= 3) for t in texts]
    df = Counter(w for c in counts for w in c)
    defs = {(m[0], i) for i, t in enumerate(texts) for line in t.split("\n") if (m := re.match("[A-Z][a-z]+", line))}
    definers, want = Counter(n for n, _ in defs), Counter()
    for name, dst in defs:
        for src, c in enumerate(counts):
            if c[name] and src != dst and df[name] <= max(50, len(texts) // 10):
                want[src, dst] += math.sqrt(c[name]) * (math.log((len(texts) + 1) / (df[name] + 1)) + 1) / definers[name]
    got = {(r["src"], r["dst"]): r["weight"] for r in analogues.edge_weights(spark, str(tmp_path)).collect()}
    assert df["Widget"] == 40 and got == pytest.approx(dict(want), abs=1e-6)


def _mention_rows(n=500, names=40):
    """Documents that begin a line with some names and mention others; one word is everywhere, one id twice."""
    rng = random.Random(4)
    known = [f"N{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(names)]
    some = lambda k: [known[int(names * rng.random() ** 2)] for _ in range(k)]
    texts = ["\n".join([*(f"{w} begins" for w in some(rng.randint(0, 2))), "The " + " ".join(some(rng.randint(0, 3))) + " camelNaax Naaxes"]) for _ in range(n)]
    return [(i if i else 1, "s", t if i % 50 else None, "en") for i, t in enumerate(texts)]


@pytest.mark.parametrize("sources, targets", [(1 << 15, 1 << 20), (60, 25)])
def test_edge_weights_in_cells_equal_sql(spark, tmp_path, monkeypatch, sources, targets):
    monkeypatch.setattr(graph, "SOURCES", sources, raising=False)
    monkeypatch.setattr(graph, "TARGETS", targets, raising=False)
    monkeypatch.setattr(graph, "_ROWS", 100, raising=False)
    spark.createDataFrame(_mention_rows(), "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {(r["src"], r["dst"]): r["weight"] for r in analogues.edge_weights(spark, str(tmp_path)).collect()}
    want = {r[:2]: r[2] for r in con.execute(analogues.EDGE_WEIGHTS_SQL).fetchall()}
    assert len(want) > 1000 and got == pytest.approx(want, abs=1e-6)


def test_edges_do_not_travel(spark, tmp_path):
    """What is shuffled grows with mentions and definitions, not with the edges that they make."""
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in _stages(spark, store)}
    names = [f"N{chr(97 + i)}x" for i in range(8)]
    counts = spark.createDataFrame([(f"s{i}", name, 1 + i % 3) for i in range(150) for name in names], "doc string, name string, n long")
    definitions = spark.createDataFrame([(name, f"{'sd'[i % 2]}{i}") for i in range(150) for name in names], "name string, doc string")
    weights = spark.createDataFrame([(name, 1.5) for name in names], "name string, idf double")
    before = shuffled()
    edges = graph.mention_edges(counts, definitions, weights).collect()
    assert len(edges) == 150 * 150 - 75 and {(r["src"], r["dst"]) for r in edges} >= {("s0", "s2"), ("s1", "d1")}
    assert all(r["weight"] == pytest.approx(8 * math.sqrt(1 + int(r["src"][1:]) % 3) * 1.5 / 150) for r in edges)
    assert sum(n for k, n in shuffled().items() if k not in before) < len(edges) / 2


def _stages(spark, store):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = spark.sparkContext._jvm
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def test_scope_resolution_of_every_file(spark, tmp_path):
    parts = [(i, ("A.B", "A.B.C", "X")[i % 3], i % 7) for i in range(1, 121)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    namespaces = {k: f"{t}.s{size % 3}" for k, t, size in parts}
    want = {}
    for k, t, _ in parts:
        met = [p for p, n in namespaces.items() if f"{t}.s{k % 3}.x".startswith(n + ".")]
        if met:
            want[k] = (len(met), min(met))
    got = {r["file"]: (r["in_scope"], r["first"]) for r in analogues.scope_resolution(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 100


def test_call_tree_follows_every_edge(spark, tmp_path, monkeypatch):
    edges = spark.createDataFrame([(0, 1, 4), (1, 2, 6), (2, 3, 5), (3, 4, 9), (0, 5, 3)], "src int, dst int, weight long")
    monkeypatch.setattr(analogues, "nation_edges", lambda *_: edges)
    assert {r["node"]: r["depth"] for r in analogues.call_tree_bounded(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 5: 1}


def test_whole_tables(spark, tmp_path, monkeypatch):
    """Symbols of all tables, documents of all languages, and every definition."""
    for name, keys in (("region", "r_name string, r_regionkey long"), ("nation", "n_name string, n_nationkey long"), ("supplier", "s_name string, s_suppkey long, s_nationkey long"), ("customer", "c_name string, c_custkey long, c_nationkey long"), ("part", "p_name string, p_partkey long")):
        wide = "nationkey long" in keys and name != "nation"
        n = 150 if name == "customer" else 2
        spark.createDataFrame([(f"{name}{i}", i) + ((i % 2,) if wide else ()) for i in range(n)], keys).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(0, "s", "in the end", "en"), (1, "s", "sous the pont", "fr"), (2, "s", "über the, the", "de"), (3, "s", "thé other", "fr"), (4, "s", "the", None)], "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(analogues, "nation_edges", lambda *_: spark.createDataFrame([(0, 1, 2), (1, 0, 1)], "src long, dst long, weight long"))
    at = str(tmp_path)
    assert analogues.symbol_json(spark, at).count() == 158
    assert {r["doc_id"] for r in analogues.reference_scan(spark, at).collect()} == {0, 1, 2, 4}
    scores = analogues.definition_scores(spark, at).collect()
    assert len(scores) == 152 and sum(r["score"] for r in scores) == pytest.approx(1, abs=1e-4)
