import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import tools
from sparkloom.sources import csharp, scss, tree, typescript
from sparkloom.sources.index import Notes, Store, build

T0 = datetime.datetime(2024, 1, 1)
FILES = {
    "App.sln": 'Project("{X}") = "Core", "src\\Core\\Core.csproj", "{1}"\nProject("{X}") = "Core.Tests", "test\\Core.Tests\\Core.Tests.csproj", "{2}"\n',
    "src/Core/Core.csproj": "<Project></Project>",
    "test/Core.Tests/Core.Tests.csproj": '<Project><ProjectReference Include="..\\..\\src\\Core\\Core.csproj" /></Project>',
    "src/Loose/Loose.csproj": "<Project></Project>",
    "src/Loose/Lost.cs": "class Lost {}",
    "src/Core/IStore.cs": "namespace Acme.Core;\npublic interface IStore { int Load(string key); }\n",
    "src/Core/Store.cs": (
        "using System;\nusing Acme.Util;\nusing Alias = Acme.Other.Thing;\nnamespace Acme.Core;\npublic class Store : IStore, Base<int>\n{\n  public int Count;\n"
        "  public int Load(string key)\n  {\n    // IStore in a comment\n    try { Helper(); Helper(); } catch { }\n    return 1;\n  }\n  void Helper() { Deep(); }\n  void Deep() { Load(\"IStore\"); }\n}\n"
    ),
    "src/Core/Store.Part.cs": "namespace Acme.Core;\npublic partial class Cached : Store { }\n",
    "src/Core/More.cs": "namespace Acme.Core;\npublic class Deeper : Cached { IStore s; async void Go() { t.Wait(); throw new NotImplementedException(); } }\n",
    "src/Core/Model.designer.cs": "public class Model {}",
    "src/Core/obj/Tmp.cs": "class Tmp {}",
    "test/Core.Tests/StoreTests.cs": "namespace Acme.Tests;\npublic class StoreTests { void Works() { new Store().Load(\"x\"); IStore s = null; } }\n",
    "web/package.json": '{"name": "web", /* c */ "version": "1",}',
    "web/a/Widget.tsx": "export class Widget { render(x: any): void { console.log(x); } }\nexport default Widget;\n",
    "web/b/Page.tsx": "import { useState } from 'react';\nconst Page = () => <Widget style={{ a: 1 }} />;\n",
    "web/c.scss": "$gap: 1px;\n// .gone { }\n.box, .card { @include m; }\n@mixin m { color: red; }\n",
    "stray/x.ts": "export function stray() { return 1; }\n",
}


def frame(spark, files, mtime=T0, changed=()):
    rows = [(p, T0 + datetime.timedelta(days=1) if p in changed else mtime, c) for p, c in files.items()]
    return tree.tree(spark.createDataFrame(rows, "path string, mtime timestamp, content string"))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('index')}")
    assert store.current() is None
    assert store.refresh(frame(spark, FILES))
    return store.current()


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_projects_and_files(spark, index):
    owner = {r["path"]: r["project"] for r in index.files.collect()}
    assert owner["src/Core/Store.cs"] == "Core" and owner["web/a/Widget.tsx"] == "web" and owner["stray/x.ts"] == "ts:stray"
    assert not {"src/Loose/Lost.cs", "src/Core/Model.designer.cs", "src/Core/obj/Tmp.cs"} & owner.keys()
    assert set(names(index.projects)) == {"Core", "Core.Tests", "web"}
    row = tools.get_project_dependencies(index, "core").first()
    assert (row["references"], row["dependents"]) == ([], ["Core.Tests"])


def test_search_and_members(spark, index):
    found = tools.search_symbol(index, "store").collect()
    assert [r["name"] for r in found][:2] == ["Store", "StoreTests"] and {r["tier"] for r in found} == {0, 1, 2}
    assert names(tools.search_symbol(index, "store", kind="interface")) == ["IStore"]
    assert names(tools.search_symbol(index, "ST", kind="class"))[-1] == "StoreTests"
    with pytest.raises(ValueError):
        tools.search_symbol(index, "x", kind="nothing")
    assert names(tools.get_type_members(index, "Store")) == ["Deep", "Helper", "Load", "Count"]
    assert names(tools.did_you_mean(index, "Stroe")) == ["s", "Store", "stray"]


def test_text_and_references(spark, index):
    hits = tools.search_text(index, "IStore").collect()
    assert {r["path"] for r in hits} >= {"src/Core/Store.cs", "src/Core/IStore.cs"}
    facets = tools.reference_facets(index, "IStore").first()
    assert (facets["prod"], facets["test"], facets["non_code"], facets["generated"]) == (3, 1, 1, 0)
    with_lines = tools.with_context(index, tools.find_references(index, "Deep"), 1).collect()
    assert all(len(r["context"]) >= 2 for r in with_lines)


@pytest.mark.parametrize(
    ("pattern", "path"),
    [("empty-catch", "src/Core/Store.cs"), ("catch-all", "src/Core/Store.cs"), ("async-void", "src/Core/More.cs"), ("blocking-async", "src/Core/More.cs"), ("public-field", "src/Core/Store.cs"),
     ("not-implemented", "src/Core/More.cs"), ("inline-style", "web/b/Page.tsx"), ("console-log", "web/a/Widget.tsx"), ("any-type", "web/a/Widget.tsx"), ("default-export", "web/a/Widget.tsx")],
)
def test_structural(spark, index, pattern, path):
    assert names(tools.search_structural(index, pattern), "path") == [path]


def test_hierarchy_and_calls(spark, index):
    assert names(tools.get_class_hierarchy(index, "IStore")) == ["Store"]
    assert [(r["depth"], r["name"]) for r in tools.get_class_hierarchy(index, "IStore", transitive=True).collect()] == [(1, "Store"), (2, "Cached"), (3, "Deeper")]
    assert [(r["name"], r["times"]) for r in tools.callees(index, "Load").collect()] == [("Helper", 2)]
    assert {r["caller"] for r in tools.callers(index, "Load").collect()} == {"Deep", "Works"}
    trace = [(r["depth"], r["name"], r["already"]) for r in tools.trace_calls(index, "Load", depth=4).collect()]
    assert trace == [(0, "Load", False), (1, "Helper", False), (2, "Deep", False), (3, "Load", True)]


def test_source_outline_names(spark, index):
    row = tools.get_symbol_source(index, member="Helper").first()
    assert row["source"].strip() == "void Helper() { Deep(); }"
    assert names(tools.get_file_outline(index, "Store.cs")) == ["Store"]
    assert [(r["asked"], r["name"]) for r in tools.get_context_bundle(index, ["Deeper", "Widget"]).orderBy("asked").collect()] == [("Deeper", "Deeper"), ("Widget", "Widget")]
    assert [(r["full_name"], r["scope"]) for r in tools.resolve_bare_name(index, "Store.cs", "Alias").collect()] == [("Acme.Other.Thing", "alias")]
    assert [(r["full_name"], r["scope"]) for r in tools.resolve_bare_name(index, "StoreTests.cs", "Store").collect()] == [("Acme.Core.Store", "out")]
    dangling = {r["name"]: r["finding"] for r in tools.check_dangling_references(index, "Page.tsx").collect()}
    assert dangling == {"Widget": "missing", "useState": "unused"}
    places = spark.createDataFrame([("src/Core/Store.cs", 11), ("src/Core/Store.cs", 1)], "path string, line int")
    assert [(r["type"], r["member"]) for r in tools.enclosing_symbols(index, places).orderBy("line").collect()] == [(None, None), ("Store", "Load")]


def test_overviews(spark, index):
    ranked = names(tools.repo_map(index))
    assert ranked.index("IStore") < ranked.index("Deeper")
    assert tools.repo_info(index).first()["projects"] == 3
    assert set(tools.suggest_queries(index)) == {"projects", "files", "kinds"}
    assert "Store" in names(tools.get_task_context(index, "please change the store loading")["anchors"])
    assert "members" in tools.explain_symbol(index, "Store") and "callers" in tools.explain_symbol(index, "Load")
    assert tools.prepare_change(index, "Store")["derived"].count() == 2
    assert tools.get_onboarding(index)["map"].count() > 0


def test_delta_equals_full(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    store.refresh(frame(spark, FILES))
    first = store.info()["version"]
    assert not store.refresh(frame(spark, FILES)) and store.info()["version"] == first
    new = {k: v for k, v in FILES.items() if k != "src/Core/More.cs"} | {"src/Core/IStore.cs": "namespace Acme.Core;\npublic interface IStore2 { }\n", "web/New.ts": "export enum E { A }"}
    assert store.refresh(frame(spark, new, changed=("src/Core/IStore.cs", "web/New.ts")))
    assert store.info()["kind"] == "delta"
    key = ["path", "name", "kind", "start_line"]
    full = build(frame(spark, new, changed=("src/Core/IStore.cs", "web/New.ts"))).symbols.select(key)
    got = store.current().symbols.select(key)
    assert got.exceptAll(full).count() == 0 and full.exceptAll(got).count() == 0
    assert store.vacuum(0) == [first] and store.current().files.count() > 0


def test_one_segment(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    assert store.refresh(frame(spark, FILES), segment="ts")  # nothing published yet: both
    assert {r["lang"] for r in store.current().files.select("lang").collect()} == {"cs", "ts", "scss"}
    new = FILES | {"src/Core/IStore.cs": "namespace Acme.Core;\npublic interface IStore2 { }\n", "web/a/Widget.tsx": "export class Gadget { }\n", "web/package.json": '{"name": "other"}'}
    del new["web/c.scss"]
    tree_now = lambda: frame(spark, new, changed=("src/Core/IStore.cs", "web/a/Widget.tsx"))
    found = lambda: set(names(store.current().types))
    assert store.refresh(tree_now(), segment="cs") and not store.refresh(tree_now(), segment="cs")
    assert {"IStore2", "Widget", "gap"} <= found() and not {"IStore", "Gadget"} & found()
    assert "web" in names(store.current().projects) and "other" not in names(store.current().projects)
    assert store.refresh(tree_now(), segment="ts", full=True)
    assert store.info()["kind"] == "full" and {"IStore2", "Gadget"} <= found() and not {"Widget", "gap"} & found()
    assert "other" in names(store.current().projects) and store.current().references.count() == build(tree_now()).references.count()
    both = build(tree_now())
    assert set(names(both.types)) == found() and set(names(both.files, "path")) == set(names(store.current().files, "path"))


def test_words_of_code():
    from sparkloom.functions.code import code_words

    assert code_words('Foo a = "Foo"; // Foo\r\nFoo(\'F\', $"{Foo} Bar");\nx1') == {"Foo": 3, "a": 1, "x1": 1}
    assert code_words("") == {}


def test_csharp_shapes():
    out = csharp.parse(
        "[A] public record struct P(int X, List<string> Y);\nstatic class S { static int a, b = 2; event E<int> Ev; string N { get; } = \"}\"; S(int q) : base(q) { }\n"
        "int this[int i] => i; public static S operator +(S a, S b) => a; void I.M<T>(ref T t, params int[] r) where T : new() { void L() { G(); } throw new X(); } enum En { A = 1, [Z] B } }"
    )
    shapes = {t["name"]: t for t in out["types"]}
    assert shapes["P"]["kind"] == "RecordStruct" and [m["signature"] for m in shapes["P"]["members"]] == ["P(int, List<string>)"]
    assert [m["signature"] for m in shapes["S"]["members"]] == ["string N", "int a", "int b", "S(int)", "event E<int> Ev", "void M(T, int[])"]
    assert shapes["En"]["enum_values"] == "A, B" and shapes["En"]["is_nested"] and shapes["S"]["kind"] == "StaticClass"
    assert [(e["name"], e["enclosing_member"]) for e in out["events"] if e["kind"] == "call"] == [("G", "L")]


def test_wiring():
    out = csharp.parse(
        "class C { Lazy<IA> a = new Lazy<IA>(() => new A()); void M() { s.AddSingleton<IFoo, Foo>(); s.AddScoped<IBar>(p => new Bar()); s.AddTransient(typeof(I<>), typeof(X<>)); "
        "if (q) s.TryAddSingleton<IZ, Z>(); s.Replace(ServiceDescriptor.Scoped<IR, R>()); p.GetRequiredService<IFoo>(); } }"
    )
    got = [(r["kind"], r["service"], r["impl"], r["lifetime"], r["confidence"], r["conditional"]) for r in out["registrations"]]
    assert got == [
        ("LegacyNew", "IA", "A", None, "Resolved", False), ("DiGeneric", "IFoo", "Foo", "Singleton", "Resolved", False), ("DiFactory", "IBar", "Bar", "Scoped", "Resolved", False),
        ("DiOpenGeneric", "I<>", "X<>", "Transient", "Resolved", False), ("DiGeneric", "IZ", "Z", "Singleton", "Partial", True), ("DiReplace", "IR", "R", "Scoped", "Resolved", False),
        ("LocatorConsume", "IFoo", None, None, "Partial", False),
    ]


def test_typescript_and_scss():
    out = typescript.parse("namespace A.B { export abstract class C<T> { private x: number = 1; go(a: T): void { f(a); } } }\nexport const p = 1, q = () => 2;\nexport type U = 1 | 2;\nfunction* g() {}\n")
    assert [(t["name"], t["kind"], t["namespace"]) for t in out["types"]] == [("C", "AbstractClass", "A.B"), ("p", "Variable", None), ("q", "Variable", None), ("U", "TypeAlias", None), ("g", "Function", None)]
    assert [m["signature"] for m in out["types"][0]["members"]] == ["x: number", "go(a: T): void"]
    got = [(t["name"], t["kind"], t["start_line"]) for t in scss.parse("$a: url(http://x/.no); /* .c1 {\n*/ .c2 .c3 { }\n%ph { }\n@function f() { }\n.c2 { }")["types"]]
    assert got == [("a", "ScssVariable", 1), ("c2", "ScssSelector", 2), ("c3", "ScssSelector", 2), ("ph", "ScssPlaceholder", 3), ("f", "ScssFunction", 4)]
    assert typescript.parse("")["types"] == [] and csharp.parse("class {{{")["types"] == []


def test_render(spark, index, tmp_path):
    from sparkloom.plans import render

    text = render.dossier(tools.explain_symbol(index, "Store"))
    assert text.startswith("== type ==\nStore") and "== derived ==" in text
    short = render.dossier({"a": index.types.select("name"), "b": index.types.select("path")}, 510)
    assert "== a ==" in short and "(left out: b)" in short
    assert render.table(index.types.filter("false")) == "(none)"
    store, made = Store(spark, f"file://{tmp_path}/i"), []
    store.refresh(frame(spark, FILES))
    digest = render.Digest(store)
    for each in (digest, digest, render.Digest(store)):
        assert each.text(lambda i: made.append(1) or "x") == "x"
    assert made == [1]  # kept beside the store, not in memory
    store.refresh(frame(spark, FILES), full=True)
    assert digest.text(lambda i: "y") == "y"


def test_notes(spark, tmp_path):
    notes = Notes(Store(spark, f"file://{tmp_path}/i"))
    assert notes.recent().count() == 0
    for note in ("first", "second  line\n", "first"):
        notes.remember(note)
    assert names(notes.recent(), "note") == ["first", "second line"]


def test_watch_publishes_changes(spark, tmp_path):
    import time

    from sparkloom.streaming.changes import watch

    root = tmp_path / "tree"
    (root / "web").mkdir(parents=True)
    (root / "web/package.json").write_text('{"name": "web"}')
    (root / "web/a.ts").write_text("export class A {}")
    store = Store(spark, f"file://{tmp_path}/index")
    query = watch(store, lambda: tree.scan(spark, str(root)), f"{tmp_path}/state", "1 second")
    try:
        for wanted, content in ((["A"], None), (["A", "B"], "export class A {}\nexport class B {}")):
            if content:
                (root / "web/a.ts").write_text(content)
            for _ in range(60):
                index = store.current()
                if index and sorted(names(index.types)) == wanted:
                    break
                time.sleep(0.5)
            assert sorted(names(store.current().types)) == wanted
    finally:
        query.stop()


def test_repo_map_focus_has_no_cap(spark, monkeypatch):
    """A focus symbol that 1,200 files define: each of them gets the same teleport mass and boost."""
    from types import SimpleNamespace

    paths = [f"f{i:04}.cs" for i in range(1200)]
    files = spark.createDataFrame([(p, p) for p in [*paths, "z.cs"]], "name string, path string")
    edges = spark.createDataFrame([("z.cs", p, 1.0) for p in paths], "src string, dst string, weight double")
    definitions = spark.createDataFrame([(p, "Same", "Class", "class Same", 1, "P") for p in paths] + [("z.cs", "Other", "Class", "class Other", 1, "P")], "doc string, name string, kind string, signature string, start_line int, project string")
    monkeypatch.setattr(tools, "mention_graph", lambda _: (files.select(F.col("path").alias("node")), edges, definitions))
    monkeypatch.setattr(tools, "packed", lambda rows, *_: rows)
    scores = {r["doc"]: r["score"] for r in tools.repo_map(SimpleNamespace(files=files), ["Same"]).collect()}
    assert len(scores) == 1201 and scores["f1199.cs"] == pytest.approx(scores["f0000.cs"]) and scores["f1199.cs"] == pytest.approx(1 / 1200)


def test_scan_never_touches_what_is_skipped(spark, tmp_path):
    """A file that cannot be read, or is over the size limit, in a skipped folder or of no use to an index."""
    root = tmp_path / "w"
    for folder in ("src/a", "node_modules/x", ".git", "SRC/obj"):
        (root / folder).mkdir(parents=True)
    (root / "src/a/A.CS").write_text("class A {}")
    (root / "src/a/package.json").write_text('{"name": "p"}')
    for name in ("node_modules/x/big.ts", ".git/pack.cs", "SRC/obj/T.cs", "src/a/film.bin"):
        (root / name).write_text("x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = {r["path"]: r["content"] for r in tree.scan(spark, str(root)).collect()}
        assert set(got) == {"src/a/A.CS", "src/a/package.json"} and got["src/a/A.CS"] == "class A {}"
        assert names(tree.ts_projects(tree.scan(spark, f"file://{root}"))) == ["p"]
        assert tree.scan(spark, str(root / "node_modules/x"), ("x",)).filter("name = 'none'").count() == 0
        (root / "empty").mkdir()
        assert tree.scan(spark, str(root / "empty")).count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_loose_projects_and_aliases(spark):
    files = frame(spark, FILES | {"web/tsconfig.json": '{"compilerOptions": {"paths": {"@a/*": ["a/*"], "@b": ["b/x", "b/y"],}}} // end', "web/a/tsconfig.json": '{"compilerOptions": {"paths": {"@b": ["z"]}}}'})
    assert set(names(tree.solution_projects(files))) == {"Core", "Core.Tests"}
    assert set(names(tree.solution_projects(files, loose=True))) == {"Core", "Core.Tests", "Loose"}
    assert {r["alias"]: r["targets"] for r in tree.path_aliases(files).collect()} == {"@a/*": ["a/*"], "@b": ["b/x", "b/y"]}


def test_types_of_several_namespaces(spark):
    files = {
        "A.sln": 'Project("{X}") = "P", "p\\P.csproj", "{1}"\n', "p/P.csproj": "<Project></Project>", "p/a.cs": "namespace N.One;\nclass Foo : Base { void A() {}\n void A(int x) {} }\n",
        "p/b.cs": "namespace N.Two;\nclass Foo { void B() { try { } finally { throw new X(); } } }\nclass Base { }\n", "w/package.json": '{"name": "w"}', "w/a.tsx": "// @ts-ignore\nexport class Foo { c(): void { const k = <div className={`a ${x}`} />; } }\n",
    }
    index = build(frame(spark, files))
    got = [(r["name"], r["namespace"], r["ambiguous"]) for r in tools.get_type_members(index, "Foo", project="P").collect()]
    assert got == [("A", "N.One", True), ("A", "N.One", True), ("B", "N.Two", True)]
    assert [(r["name"], r["ambiguous"]) for r in tools.get_type_members(index, "Foo", namespace="two").collect()] == [("B", False)]
    assert [(r["base"], r["path"]) for r in tools.get_base_types(index, "Foo", "One").collect()] == [("Base", "p/b.cs")]
    bare = {(r["full_name"], r["scope"]) for r in tools.resolve_bare_name(index, "a.cs", "Foo").collect()}
    assert bare == {("N.One.Foo", "in"), ("N.Two.Foo", "out")}  # no TypeScript type
    overloads = tools.get_symbol_source(index, member="A", type_="Foo").collect()
    assert {r["signature"] for r in overloads} == {"void A()", "void A(int)"}
    for pattern, path in (("throw-in-finally", "p/b.cs"), ("classname-interp", "w/a.tsx"), ("ts-ignore", "w/a.tsx")):
        assert names(tools.search_structural(index, pattern), "path") == [path], pattern
    with pytest.raises(ValueError):
        tools.search_structural(index, "no-such")


def test_trace_with_bodies_and_task_context(spark, index):
    rows = tools.trace_calls(index, "Load", depth=2, include_bodies=True).collect()
    assert [(r["name"], r["path"]) for r in rows] == [("Load", "src/Core/IStore.cs"), ("Helper", "src/Core/Store.cs"), ("Deep", "src/Core/Store.cs")]
    assert rows[1]["source"].strip() == "void Helper() { Deep(); }"
    assert names(tools.search_summary(index, "Store"), "files")[0] >= 4
    context = tools.get_task_context(index, "please change the store loading")
    assert "anchors" in context and "Store: members" in context and "map" in context
    low = tools.get_task_context(index, "zzzz qqqq")
    assert list(low)[0] == "note" and "info" in low and "anchors" not in low
    assert names(tools.project_files(index, "web"), "name") == ["Widget.tsx", "Page.tsx", "c.scss"]


def test_scss_grammar():
    text = ".a,\n.b-é > .md\\:x:hover { $v : (k: \".no\"); @extend %q; width: .5em; /* .gone */ }\n@mixin  -m($x) { }\n@media (min: .3) { .z { a: url(//h/.n) } }\n[data-x=\".no\"] { }"
    got = [(t["name"], t["kind"], t["start_line"]) for t in scss.parse(text)["types"]]
    assert got == [("a", "ScssSelector", 1), ("b-é", "ScssSelector", 2), ("md:x", "ScssSelector", 2), ("v", "ScssVariable", 2), ("q", "ScssPlaceholder", 2), ("-m", "ScssMixin", 3), ("z", "ScssSelector", 4)]
    assert scss.parse("")["types"] == [] and scss.parse(".a { .b { /* never shut")["types"][1]["name"] == "b" and scss.parse("$")["types"] == []
