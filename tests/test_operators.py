import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import names, text
from sparkloom.functions.code import code_only, only_outside_code
from sparkloom.operators import graph, relations, scalars, search
from sparkloom.operators import text as lines
from sparkloom.streaming import changes


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("name", "query", "tier"),
    [("Store", "store", 0), ("StoreTests", "store", 1), ("MyStore", "store", 2), ("GetUsersByRole", "GUBR", 3), ("GetUsersByRole", "gur", 3), ("HTTPServer", "HS", 9), ("a_bC", "abC", 3), ("x", "yy", 9)],
)
def test_tiers(spark, name, query, tier):
    assert one(spark, names.match_tier(F.col("n"), query), n=name) == tier


def test_fold_order(spark):
    got = spark.createDataFrame([("ab",), ("a_",), ("aB2",)], "n string").orderBy(names.folded(F.col("n"))).collect()
    assert [r[0] for r in got] == ["ab", "aB2", "a_"]


def test_lines_and_clip(spark):
    assert one(spark, text.lines(F.col("t")), t="a\r\nb\rc\n") == ["a", "b", "c"]
    assert one(spark, text.lines(F.col("t")), t="\n\n") == ["", ""]
    assert one(spark, text.clipped(F.col("t"), 10, "mm"), t="x" * 20 + "mm" + "y" * 20) == "… " + "x" * 5 + "mm" + "yyy" + " …"
    assert one(spark, text.clipped(F.col("t"), 10), t="x" * 11) == "x" * 10 + " …"
    assert one(spark, text.is_generated(F.col("t")), t="A.Designer.CS") and not one(spark, text.is_generated(F.col("t")), t="designer.cs")
    assert [one(spark, text.age(F.lit(s)), t="") for s in (89, 90, 5400, 172800)] == ["89s", "1m", "1h", "2d"]
    assert one(spark, text.mentions(F.col("t"), "User"), t="éUser") is False and one(spark, text.mentions(F.col("t"), "User"), t="a.User(") is True


@pytest.mark.parametrize(
    ("line", "outside"),
    [('x = "Foo";', True), ("Foo x;", False), ("int a; // Foo", True), ('$"{Foo} b"', False), ('$"{{Foo}}"', True), ('@"a""Foo"', True), ("'\"' + Foo", False), ('"a\\"Foo"', True), ('"x" + Foo', False)],
)
def test_code_or_not(line, outside):
    assert only_outside_code(line, "Foo") is outside


def test_code_only():
    assert code_only('a "b" c // d').split() == ["a", "c"]


def test_packing_and_budget(spark):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "i int, t int")
    assert [r["i"] for r in scalars.packed(df, F.col("t"), 35, ["i"]).orderBy("i").collect()] == [0, 1, 2]
    assert scalars.packed(df, F.col("t"), 5, ["i"]).count() == 1


def test_grouped_caps(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "x"), ("b", 1, "x"), ("c", 1, "x")], "path string, line_no int, line string")
    got = [(r["path"], r["line_no"]) for r in lines.grouped(df, "path", None, 2, 3).orderBy("file_rank", "line_no").collect()]
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_delta_and_precedence(spark):
    old = spark.createDataFrame([("A", 1), ("b", 1), ("c", 1)], "path string, mtime int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "path string, mtime int")
    assert {r["path"]: r["state"] for r in relations.delta(old, new, "path", "mtime").collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}
    assert {r["state"] for r in relations.delta(old.limit(0), new, "path", "mtime").collect()} == {"added"}
    assert sorted(r[0] for r in relations.with_precedence(old.select("path"), new.select("path"), "path").collect()) == ["A", "b", "c", "d"]


def test_innermost(spark):
    points = spark.createDataFrame([("f", 5), ("f", 9), ("g", 1)], "path string, line int")
    spans = spark.createDataFrame([("f", 1, 10, "outer", 0), ("f", 4, 6, "inner", 1), ("f", 4, 6, "later", 2)], "path string, s int, e int, name string, no int")
    got = {(r["path"], r["line"]): r["enclosing"] for r in relations.innermost(points, spans, ["path"], "line", "s", "e", "name", "no").collect()}
    assert got == {("f", 5): "inner", ("f", 9): "outer", ("g", 1): None}


def test_notes(spark):
    notes = spark.createDataFrame([(i, f"n {i % 60}") for i in range(100)] + [(100, "a \n b"), (101, "  ")], "seq int, note string")
    got = relations.recent_notes(notes).collect()
    assert len(got) == 50 and got[0]["note"] == "a b" and len({r["note"] for r in got}) == 50


def test_pagerank(spark):
    pairs = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "c", 3.0), ("d", "a", 1.0)]
    nodes, edges = spark.createDataFrame([(x,) for x in "abcde"], "node string"), spark.createDataFrame(pairs, "src string, dst string, weight double")
    for focus in (None, ["b"], ["zz"]):
        hits = [x for x in focus or [] if x in "abcde"]
        damping = 0.85 if focus is None else 0.5
        weight = {(s, d): w * (4 if d in (focus or []) else 1) for s, d, w in pairs}
        jump = {x: (x in hits) / len(hits) if hits else 0.2 for x in "abcde"}
        rank = dict(jump)
        for _ in range(200):
            out = {x: sum(w for (s, _), w in weight.items() if s == x) for x in "abcde"}
            loose = sum(r for x, r in rank.items() if not out[x])
            rank = {x: (1 - damping + damping * loose) * jump[x] + damping * sum(rank[s] * w / out[s] for (s, d), w in weight.items() if d == x) for x in "abcde"}
        got = {r["node"]: r["rank"] for r in graph.pagerank(nodes, edges, focus).collect()}
        assert got == pytest.approx(rank, abs=1e-5) and sum(got.values()) == pytest.approx(1)


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "src string, dst string")
    got = {r["node"]: r["depth"] for r in graph.closure(edges, spark.createDataFrame([("a",)], "node string"), 9).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2}


def test_nearest_names(spark):
    rows = spark.createDataFrame([(x,) for x in ("Widget", "widget", "WidgetFactory", "Wodget", "Other", "get")], "name string")
    assert [(r["name"], r["near"]) for r in search.nearest_names(rows, "Widget").collect()] == [("Widget", 0), ("WidgetFactory", 1), ("get", 2), ("Wodget", 3)]
    assert search.nearest_names(rows, "").count() == 0


@pytest.mark.parametrize(
    ("change", "path", "old", "want"),
    [
        ("changed", "a/x.cs", None, (True, False, False)), ("renamed", "a/x.txt", "a/x.cs", (True, False, False)), ("created", "folder", None, (True, True, False)), ("changed", "folder", None, (False, False, False)),
        ("changed", "bin/x.cs", None, (False, False, False)), ("changed", "dist/x.cs", None, (True, False, False)), ("changed", "w/tsconfig.json", None, (False, True, True)), ("deleted", "package-lock.json", None, (False, False, False)),
        ("changed", "x.SCSS", None, (False, True, False)), ("changed", ".next/x.ts", None, (False, False, False)),
    ],
)
def test_event_truth_table(spark, change, path, old, want):
    row = changes.classified(spark.createDataFrame([(change, path, old)], "change string, path string, old_path string")).first()
    assert (row["cs"], row["ts"], row["force_full"]) == want


def test_stream_debounce(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(t + datetime.timedelta(milliseconds=ms), "file", "changed", path, None) for ms, path in ((0, "a.cs"), (300, "b.cs"), (400, "package.json"), (1500, "c.cs"), (60_000, "z.cs"))]
    schema = "ts_event timestamp, kind string, change string, path string, old_path string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    bursts = changes.debounced(changes.scheduled(stream).withColumnRenamed("ts", "ts"))
    query = bursts.writeStream.format("memory").queryName("bursts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["segment"], r["events"], r["force_full"]) for r in spark.table("bursts").collect()}
    assert got == {("cs", 2, False), ("cs", 1, False), ("ts", 1, True)}


def test_branch_switch_and_overflow(spark):
    t = datetime.datetime(2024, 1, 1)
    schema = "ts_event timestamp, kind string, change string, path string, old_path string"
    for kind, want in (("head", {("cs", False), ("ts", True)}), ("overflow", {("cs", False), ("ts", False)})):
        rows = spark.createDataFrame([(t, kind, "changed", "x", None)], schema)
        assert {(r["segment"], r["force_full"]) for r in changes.scheduled(rows).collect()} == want


def test_stream_refresh(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    schema = "segment string, ts timestamp, force_full boolean"
    spark.createDataFrame([("cs", t, False), ("cs", t + datetime.timedelta(milliseconds=100), True), ("ts", t + datetime.timedelta(hours=1), False)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    query = changes.refresh_on(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda *a: seen.append(a), f"{tmp_path}/state", trigger="100 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert seen == [("cs", True)]


def test_entry_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
