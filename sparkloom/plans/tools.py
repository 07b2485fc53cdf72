"""The queries over an index: each returns rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.code import outside_code
from ..functions.names import ancestors, folded, kind_filter, namespace_matches, same_name, simple_base_name
from ..functions.text import age, estimated_tokens, is_generated, line_matches, lines, mentions
from ..operators import graph, relations, search, text
from ..operators.scalars import first_of, packed, settled, top
from ..sources.index import Index, Store



def _in_project(df: DataFrame, project: str | None) -> DataFrame:
    return df.filter(same_name(F.col("project"), F.lit(project))) if project else df


# -- symbols


def search_symbol(index: Index, query: str, kind: str | None = None, project: str | None = None, detail: str = "compact", token_budget: int | None = None) -> DataFrame:
    """Ranked matches; `detail='full'` adds each row as JSON; with a budget as many as fit it."""
    shown = F.concat_ws(" ", "kind", "name", "path", F.coalesce("signature", F.lit("")))
    rows = search.search_within(index.symbols, query, token_budget, shown, kind, project) if token_budget else search.search_symbols(index.symbols, query, kind, project)
    if detail == "full":
        named = {"name": "name", "kind": "kind", "project": "project", "file": "file", "sourceFilePath": "path", "startLine": "start_line", "lineCount": "line_count", "namespace": "namespace", "signature": "signature", "parentType": "parent_type"}
        rows = rows.withColumn("json", F.to_json(F.struct(*(F.col(c).alias(n) for n, c in named.items()))))
    return rows


def did_you_mean(index: Index, query: str, n: int = 5) -> DataFrame:
    return search.nearest_names(index.symbols.select("name"), query, n)


def _named_types(index: Index, name: str, namespace: str | None, project: str | None) -> DataFrame:
    found = _in_project(index.types.filter(same_name(F.col("name"), F.lit(name))), project)
    return found.filter(namespace_matches(F.coalesce("namespace", F.lit("")), namespace)) if namespace else found


def resolved_type(index: Index, name: str, namespace: str | None = None, project: str | None = None) -> DataFrame:
    """Types of a name, parts merged: one row for each namespace, `ambiguous` if there are several.
    The part with bases, then the first line, gives the place."""
    found = _named_types(index, name, namespace, project).withColumn("key", F.lower("name"))
    place = ["name", "kind", "keyword", "project", "file", "path", "start_line", "line_count", "enum_values"]
    merged = relations.merged_parts(found, "key", "namespace", "base_types", "start_line", place, [F.col("base_types").isNull(), "start_line", "path"])
    return merged.select("name", "kind", "keyword", "namespace", "project", "file", "path", "start_line", "line_count", "enum_values", "parts", F.col("bases").alias("base_types"), "ambiguous")


def get_type_members(index: Index, name: str, kind: str | None = None, namespace: str | None = None, project: str | None = None) -> DataFrame:
    """Members of all parts of a type, by kind and in the order of the file. Types of several namespaces
    stay apart: their members come namespace by namespace, all marked `ambiguous`."""
    rows = _in_project(index.members.filter(same_name(F.col("parent_type"), F.lit(name))), project).filter(kind_filter(F.col("kind"), kind))
    if namespace:
        rows = rows.filter(namespace_matches(F.coalesce("namespace", F.lit("")), namespace))
    rows = first_of(rows, ["path", "start_line", "line_count", "name", "signature"], ["member_no"])
    rows = rows.withColumn("ambiguous", resolved_type(index, name, namespace, project).agg(F.count("*") > 1).scalar())
    kinds = F.array(*map(F.lit, ["Method", "Property", "Field", "Constructor", "Event"]))
    return rows.orderBy(F.lower(F.coalesce("namespace", F.lit(""))), F.array_position(kinds, F.col("kind")), "path", "type_no", "member_no")


def get_file_outline(index: Index, file: str, types_only: bool = False) -> DataFrame:
    """Types of a file with counts of their members; `types_only` leaves the members out."""
    found = index.types.join(matching_file(index, file).select("path"), "path", "left_semi")
    count = lambda k: F.size(F.filter("members", lambda m: m["kind"] == k))
    shown = found.select("path", "type_no", "name", "kind", "keyword", "base_types", "start_line", "line_count", "is_nested", "enum_values", "namespace", *(count(k).alias(f"n_{k.lower()}") for k in ("Constructor", "Property", "Field", "Event", "Method")), *([] if types_only else ["members"]))
    return shown.orderBy("type_no")


def matching_file(index: Index, file: str) -> DataFrame:
    """The file of a name: equal name, else equal path, else the first whose path holds it."""
    wanted, low = file.lower().replace("\\", "/"), F.lower("path")
    rank = F.when(F.lower("name") == wanted, 0).when(low == wanted, 1).when(low.contains(wanted), 2)
    return top(index.files.withColumn("_rank", rank).filter("_rank IS NOT NULL"), 1, ["_rank", "path"]).drop("_rank")


# -- text


def search_text(index: Index, query: str, project: str | None = None, is_regex: bool = False, ignore_case: bool = False, include_generated: bool = False, most: int = text.MAX, per_file: int = text.PER_FILE) -> DataFrame:
    literal = None if is_regex or ignore_case else query
    hits = _text_hits(index, lambda c: line_matches(c, query, is_regex, ignore_case), project, include_generated, literal)
    return text.grouped(hits, "path", F.col("generated"), per_file, most)


def _text_hits(index: Index, predicate, project, include_generated: bool, literal: str | None) -> DataFrame:
    files = _in_project(index.texts, project)
    return text.line_hits(files if include_generated else files.filter("NOT generated"), predicate, literal)


def search_summary(index: Index, query: str, project: str | None = None, is_regex: bool = False, ignore_case: bool = False, include_generated: bool = False) -> DataFrame:
    """The 12 files with most hits of a text search, with the number of all hits and files."""
    literal = None if is_regex or ignore_case else query
    return text.summary(_text_hits(index, lambda c: line_matches(c, query, is_regex, ignore_case), project, include_generated, literal), "path")


def find_references(index: Index, symbol: str, project: str | None = None, include_generated: bool = False, most: int = text.MAX, per_file: int = text.PER_FILE) -> DataFrame:
    return text.grouped(_text_hits(index, lambda c: mentions(c, symbol), project, include_generated, symbol), "path", F.col("generated"), per_file, most)


def reference_facets(index: Index, symbol: str, project: str | None = None) -> DataFrame:
    """True totals of references in production, test and generated files, and those in strings or
    comments only."""
    hits = _text_hits(index, lambda c: mentions(c, symbol), project, True, symbol).withColumn("quoted", outside_code(F.col("line"), symbol))
    files = text.counted(hits, ["path", "generated", "test"], ~F.col("quoted"))
    return text.facets(files, F.col("generated"), F.col("test"))


def with_context(index: Index, rows: DataFrame, around: int) -> DataFrame:
    """Hits (path, line_no) with the lines around each."""
    own = index.files.join(F.broadcast(rows.select("path").distinct()), "path", "left_semi").select("path", lines(F.col("text")).alias("_ls"))  # rows are capped
    first = F.greatest(F.lit(1), F.col("line_no") - around)
    return rows.join(own, "path").withColumn("context", F.slice("_ls", first, F.col("line_no") + around - first + 1)).drop("_ls")


# -- structure



def structural_patterns() -> dict[str, tuple[str, Column]]:
    kind = lambda k: F.col("kind") == k
    return {
        "empty-catch": ("cs", kind("catch") & F.col("is_empty")),
        "catch-all": ("cs", kind("catch") & (F.col("name").isNull() | F.col("name").isin("Exception", "System.Exception"))),
        "async-void": ("cs", kind("async-method")),
        "blocking-async": ("cs", kind("call") & F.col("is_access") & F.col("name").isin("Wait", "GetResult")),
        "public-field": ("cs", kind("field") & F.col("is_public") & ~F.col("is_fixed")),
        "throw-in-finally": ("cs", kind("throw") & F.col("in_finally")),
        "not-implemented": ("cs", kind("throw") & F.col("name").endswith("NotImplementedException")),
        "inline-style": ("ts", kind("jsx_attr") & (F.col("name") == "style") & (F.col("text") == "object")),
        "classname-interp": ("ts", kind("jsx_attr") & (F.col("name") == "className") & (F.col("text") == "template_string")),
        "ts-ignore": ("ts", kind("comment")),
        "default-export": ("ts", kind("export")),
        "console-log": ("ts", kind("call") & (F.col("receiver") == "console")),
        "any-type": ("ts", kind("predefined_type")),
    }


def search_structural(index: Index, pattern: str, project: str | None = None, most: int = 40, per_file: int = 5) -> DataFrame:
    """Places of a code shape in hand-written files, grouped by file."""
    known = structural_patterns()
    if pattern.strip().lower() not in known:
        raise ValueError(f"unknown pattern {pattern!r}; one of {', '.join(known)}")
    lang, shape = known[pattern.strip().lower()]
    hits = _in_project(index.events.filter((F.col("lang") == lang) & shape & ~is_generated(F.col("file"))), project)
    rows = text.grouped(hits.withColumnRenamed("line", "line_no").withColumn("line", F.lit(None).cast("string")), "path", None, per_file, most)
    return _with_line(index, rows)


def _with_line(index: Index, rows: DataFrame) -> DataFrame:
    """Rows under a cap with the text of their lines; only their files are split."""
    own = index.files.join(F.broadcast(rows.select("path").distinct()), "path", "left_semi").select("path", lines(F.col("text")).alias("_ls"))
    return rows.join(own, "path").withColumn("line", F.try_element_at("_ls", F.col("line_no"))).drop("_ls").orderBy("file_rank", "line_no")


# -- hierarchy and calls


def type_edges(index: Index) -> DataFrame:
    """src (a base's simple name, lower case), dst (the derived type's), and the derived type."""
    rows = index.types.select(F.explode("base_types").alias("base"), "name", "kind", "project", "file", "path", "start_line")
    return rows.select(F.lower(simple_base_name(F.col("base"))).alias("src"), F.lower("name").alias("dst"), "base", "name", "kind", "project", "file", "path", "start_line")


def get_class_hierarchy(index: Index, name: str, transitive: bool = False, depth: int = 25, most: int = 500, project: str | None = None) -> DataFrame:
    """Types derived from a name, by depth; each place once, at its least depth. `truncated` tells
    whether the caps cut anything. A base is known by its simple name alone; `project` keeps to derived
    types of one project."""
    edges = _in_project(type_edges(index), project)
    root = index.files.sparkSession.createDataFrame([(name.lower(),)], "node string")
    reach = graph.closure(edges.select("src", "dst").distinct(), root, (depth if transitive else 1) - 1 if transitive else 0)
    found = edges.join(reach.withColumnRenamed("node", "src"), "src").filter(F.col("dst") != name.lower())
    found = found.withColumn("depth", F.col("depth") + 1)
    found = first_of(found, ["path", "start_line", "dst"], ["depth", "src"])
    total = found.agg(F.count("*")).scalar()
    return top(found.select("depth", "name", "kind", "base", "project", "file", "path", "start_line", (total > most).alias("truncated")), most, ["depth", folded(F.col("name")), "path", "start_line"])


def get_base_types(index: Index, name: str, namespace: str | None = None, project: str | None = None) -> DataFrame:
    """The bases of a type as declared, each with the places that define a type of that simple name."""
    bases = resolved_type(index, name, namespace, project).select("namespace", "ambiguous", F.explode("base_types").alias("base")).withColumn("key", F.lower(simple_base_name(F.col("base"))))
    known = index.types.select(F.lower("name").alias("key"), F.col("kind").alias("base_kind"), "path", "start_line")
    return bases.join(known, "key", "left").drop("key").orderBy("namespace", "base", "path", "start_line")


def calls(index: Index, language: str = "both", project: str | None = None) -> DataFrame:
    langs = {"csharp": ["cs"], "typescript": ["ts"], "both": ["cs", "ts"]}[language]
    return _in_project(index.events.filter((F.col("kind") == "call") & F.col("lang").isin(langs) & ~is_generated(F.col("file"))), project)


def callers(index: Index, method: str, language: str = "both", project: str | None = None, most: int = 40, per_file: int = 5) -> DataFrame:
    hits = calls(index, language, project).filter(F.col("name") == method).withColumn("line_no", F.col("line")).withColumn("line", F.col("enclosing_member"))
    return text.grouped(hits, "path", None, per_file, most).withColumnRenamed("line", "caller")


def callees(index: Index, method: str, language: str = "both", project: str | None = None, most: int = 40) -> DataFrame:
    found = calls(index, language, project).filter((F.col("enclosing_member") == method) & (F.col("name") != method))
    return top(found.groupBy("name").agg(F.count("*").alias("times")), most, [F.desc("times"), "name"])


def trace_calls(index: Index, method: str, direction: str = "callees", depth: int = 3, project: str | None = None, most: int = 40, include_bodies: bool = False) -> DataFrame:
    """The call tree in depth-first order: no, depth, name, already (traced further up), the first place
    that defines the name (path, start_line, line_count) and, if wished, its source. Neighbours
    come in order of name. The walk is sequential, so it runs on the driver; it asks the cluster for
    the neighbours of all names it has met at once, and no more than `most` of each, since no more
    rows are shown."""
    depth, most = min(max(depth, 1), 6), min(max(most, 5), 200)
    ends = ("enclosing_member", "name") if direction == "callees" else ("name", "enclosing_member")
    defined = index.members.filter("kind = 'Method'").select(F.col("name").alias("dst")).unionByName(index.types.filter("kind = 'Function'").select(F.col("name").alias("dst")))
    edges = calls(index, "both", project).select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst")).filter("src <> dst")
    after: dict[str, list[str]] = {}
    while True:
        out, unknown = _walk(method, after, depth, most)
        if not unknown:
            break
        near = edges.filter(F.col("src").isin(unknown)).distinct()
        near = near.join(defined, "dst", "left_semi") if direction == "callees" else near
        rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        after |= {name: [] for name in unknown}
        for row in near.withColumn("n", rank).filter(F.col("n") <= most).collect():
            after[row["src"]].append(row["dst"])
    tree = index.files.sparkSession.createDataFrame(out, "no int, depth int, name string, already boolean")  # `most` rows
    sites = index.members.filter("kind = 'Method'").select("name", "path", "start_line", "line_count").unionByName(index.types.filter("kind = 'Function'").select("name", "path", "start_line", "line_count"))
    sites = first_of(_in_files(index, sites, project).join(F.broadcast(tree.select("name").distinct()), "name", "left_semi"), ["name"], ["path", "start_line"])
    tree = tree.join(sites, "name", "left")
    if include_bodies:
        own = index.files.join(F.broadcast(sites.select("path").distinct()), "path", "left_semi").select("path", lines(F.col("text")).alias("_ls"))
        tree = tree.join(own, "path", "left").withColumn("source", F.array_join(F.slice("_ls", F.col("start_line"), F.col("line_count")), "\n")).drop("_ls")
    return tree.select("no", "depth", "name", "already", "path", "start_line", "line_count", *(["source"] if include_bodies else [])).orderBy("no")


def _in_files(index: Index, rows: DataFrame, project: str | None) -> DataFrame:
    return rows.join(_in_project(index.files, project).select("path"), "path", "left_semi") if project else rows


def _walk(root: str, after: dict[str, list[str]], depth: int, most: int) -> tuple[list[tuple], list[str]]:
    """The rows of a depth-first walk, and the names whose neighbours it lacked."""
    out, unknown, seen, stack = [], [], set(), [(root, 0)]
    while stack and len(out) < most:
        name, d = stack.pop()
        already = name in seen
        out.append((len(out), d, name, already))
        if not already and d < depth:
            seen.add(name)
            if name not in after:
                unknown.append(name)
            stack += [(n, d + 1) for n in sorted(after.get(name, []), reverse=True)]
    return out, unknown


# -- source


def get_symbol_source(index: Index, file: str | None = None, start_line: int | None = None, line_count: int = 40, member: str | None = None, type_: str | None = None, namespace: str | None = None, project: str | None = None) -> DataFrame:
    """path, start_line, line_count, source of a range of a file, or of a member or type by name;
    whole types only up to 300 lines. Overloads come as rows, `start_line` picks one."""
    if file and start_line:
        spans = matching_file(index, file).select("path", F.lit(start_line).alias("start_line"), F.lit(line_count).alias("line_count"), F.col("name"))
    elif member:
        rows = _in_project(index.members.filter(F.col("name") == member), project)
        rows = rows.filter(same_name(F.col("parent_type"), F.lit(type_))) if type_ else rows
        rows = rows.filter(namespace_matches(F.coalesce("namespace", F.lit("")), namespace)) if namespace else rows
        rows = rows.filter(F.col("start_line") == start_line) if start_line else rows
        spans = first_of(rows, ["path", "start_line", "line_count"], ["type_no", "member_no"]).select("path", "start_line", "line_count", "signature")
    else:
        rows = _in_project(index.types.filter(same_name(F.col("name"), F.lit(type_ or ""))), project)
        rows = rows.filter(namespace_matches(F.coalesce("namespace", F.lit("")), namespace)) if namespace else rows
        spans = rows.filter("line_count <= 300").select("path", "start_line", "line_count", F.col("name"))
    own = index.files.select("path", lines(F.col("text")).alias("_ls"))
    return spans.join(own, "path").withColumn("source", F.array_join(F.slice("_ls", F.col("start_line"), F.col("line_count")), "\n")).drop("_ls").orderBy("path", "start_line")


def get_context_bundle(index: Index, symbols: list[str]) -> DataFrame:
    """The source of the best match of each name, each place once."""
    parts = [top(search.matching_symbols(index.symbols, s), 1, search.symbol_order()).withColumn("asked", F.lit(s)) for s in symbols]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = first_of(rows, ["path", "start_line", "line_count"], ["asked"])
    own = index.files.select("path", lines(F.col("text")).alias("_ls"))
    return rows.join(own, "path").withColumn("source", F.array_join(F.slice("_ls", F.col("start_line"), F.col("line_count")), "\n")).select("asked", "name", "kind", "path", "start_line", "line_count", "source")


# -- orientation


def mention_graph(index: Index) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and definitions of the graph of files that mention types of others; generated
    files are no part of it."""
    files = index.files.filter(~is_generated(F.col("name")))
    types = index.types.filter(~is_generated(F.col("file")))
    known = types.filter(F.rlike("name", F.lit(r"^\p{Lu}")) & (F.length("name") >= 3)).select("name", F.col("path").alias("doc")).distinct()
    counts = files.select(F.col("path").alias("doc"), F.explode("words").alias("name", "n")).join(known.select("name").distinct(), "name", "left_semi")  # counted when the file was parsed
    weights = graph.term_weights(counts, files.count())
    members = index.members.filter(~is_generated(F.col("file"))).select(F.col("path").alias("doc"), "name", "kind", "signature", "start_line", "project")
    shown = types.select(F.col("path").alias("doc"), "name", "kind", F.concat_ws(" ", "keyword", "name").alias("signature"), "start_line", "project")
    return files.select(F.col("path").alias("node")), graph.mention_edges(counts, known, weights), shown.unionByName(members)


def repo_map(index: Index, focus: list[str] | None = None, token_budget: int = 2000, project: str | None = None) -> DataFrame:
    """The definitions that matter most, by rank over the mention graph, as many as fit the budget.
    Focus words name files (in any case) or symbols (exactly)."""
    nodes, edges, definitions = mention_graph(index)
    hits = None
    if focus:
        low = [f.lower() for f in focus]
        by_file = index.files.filter(F.lower("name").isin(low) | F.lower("path").isin(low)).select(F.col("path").alias("node"))
        by_name = definitions.filter(F.col("name").isin(focus)).select(F.col("doc").alias("node"))
        found = settled(by_file.union(by_name).join(nodes, "node", "left_semi").distinct())
        hits = found if found.limit(1).count() else None
    scores = graph.definition_scores(graph.pagerank(nodes, edges, hits), definitions)
    scores = _in_project(scores, project)
    budget = min(max(token_budget, 50), 20_000) - 40
    return packed(scores, estimated_tokens(F.concat_ws(" ", "doc", "signature")), budget, [F.desc("score"), "doc", "start_line", "name"])


def repo_info(index: Index, store: Store | None = None, now: float | None = None) -> DataFrame:
    """Counts, and the age of the last build."""
    n = index.files.agg(F.count("*").alias("files"), F.sum(F.size("types")).alias("types"), F.sum(F.aggregate("types", F.lit(0), lambda a, t: a + F.size(t["members"]))).alias("members"))
    entry = store.info() if store else None
    since = F.lit(None).cast("string") if not entry or now is None else age(F.lit(now - entry["when"]))
    return n.withColumn("projects", index.projects.agg(F.count("*")).scalar()).withColumn("build", F.lit(entry["kind"] if entry else "none")).withColumn("age", since)


def project_files(index: Index, project: str, most: int = 200) -> DataFrame:
    """The files of a project with their numbers of types and members, and how many there are."""
    rows = _in_project(index.files, project).select("path", "name", "lang", F.size("types").alias("types"), F.aggregate("types", F.lit(0), lambda a, t: a + F.size(t["members"])).alias("members"))
    return top(rows.withColumn("total", rows.agg(F.count("*")).scalar()), most, ["path"])


def suggest_queries(index: Index) -> dict[str, DataFrame]:
    """Where to look first: the largest projects, the files with most symbols, the kinds of types."""
    per_file = index.files.select("project", "path", F.size("types").alias("types"), F.aggregate("types", F.lit(0), lambda a, t: a + F.size(t["members"])).alias("members"))
    return {
        "projects": top(per_file.groupBy("project").agg(F.count("*").alias("files")), 10, [F.desc("files"), "project"]),
        "files": top(per_file.withColumn("symbols", F.col("types") + F.col("members")), 10, [F.desc("symbols"), "path"]),
        "kinds": index.types.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind"),
    }


def get_onboarding(index: Index, notes: DataFrame | None = None) -> dict[str, DataFrame]:
    """A first overview: counts, projects, a small map and recent notes."""
    out = {"info": repo_info(index), "projects": index.projects.orderBy("name"), "map": repo_map(index, token_budget=1500)}
    return out | ({"notes": relations.recent_notes(notes)} if notes is not None else {})


_STOP = {"this", "that", "with", "from", "have", "when", "what", "where", "which", "will", "would", "should", "could", "into", "then", "than", "make", "need", "want", "code", "please", "there", "their", "about", "some"}


def task_words(task: str) -> list[str]:
    """Words of a task that may name code: four letters or digits and more, no common words."""
    words = ("".join(c for c in w if c.isalnum()) for w in task.split())
    return list(dict.fromkeys(w for w in words if len(w) >= 4 and w.lower() not in _STOP))


def task_anchors(index: Index, task: str, most: int = 6) -> DataFrame:
    """Types whose names hold words of a task: those that hold most of them, short names first."""
    words = [w.lower() for w in task_words(task)]
    score = sum((F.lower("name").contains(w).cast("int") for w in words), F.lit(0))
    anchors = first_of(index.types.withColumn("score", score).filter("score > 0"), [F.lower("name")], ["path", "start_line"])
    return top(anchors.select("name", "kind", "path", "start_line", "score"), most, [F.desc("score"), F.length("name"), "name"])


def get_task_context(index: Index, task: str, most: int = 6, dossiers: int = 2) -> dict[str, DataFrame]:
    """What a task is about: types whose names hold its words, the dossiers of the first of them, and the
    map around them. Where no name holds a word, the answer is of low confidence: the onboarding alone."""
    anchors = task_anchors(index, task, most)
    names = [r["name"] for r in anchors.collect()]  # `most` rows
    if not names:
        low = index.files.sparkSession.createDataFrame([("low confidence: no type is named like a word of the task",)], "note string")
        return {"note": low} | get_onboarding(index)
    out = {"anchors": anchors}
    for name in names[:dossiers]:
        out |= {f"{name}: {section}": rows for section, rows in explain_symbol(index, name).items()}
    return out | {"map": repo_map(index, names, 1500)}


def explain_symbol(index: Index, symbol: str, namespace: str | None = None, project: str | None = None) -> dict[str, DataFrame]:
    """All about a name: for a type its members, hierarchy, source and references; for a member its
    source, references and calls. Sections are lazy; render what a budget allows in this order."""
    if resolved_type(index, symbol, namespace, project).limit(1).count():
        return {
            "type": resolved_type(index, symbol, namespace, project), "members": get_type_members(index, symbol, None, namespace, project), "bases": get_base_types(index, symbol, namespace, project), "derived": get_class_hierarchy(index, symbol),
            "registrations": registrations(index, symbol), "source": get_symbol_source(index, type_=symbol, namespace=namespace, project=project), "references": find_references(index, symbol, project), "facets": reference_facets(index, symbol, project),
        }
    return {
        "source": get_symbol_source(index, member=symbol, namespace=namespace, project=project), "references": find_references(index, symbol, project), "callers": callers(index, symbol, "both", project),
        "callees": callees(index, symbol, "both", project),
    }


def registrations(index: Index, symbol: str) -> DataFrame:
    """Wiring in which a type is the service or its implementation."""
    wanted = F.lit(symbol)
    named = same_name(simple_base_name(F.col("service")), wanted) | F.coalesce(same_name(simple_base_name(F.col("impl")), wanted), F.lit(False))
    return index.registrations.filter(named).orderBy("path", "start_line")


def prepare_change(index: Index, symbol: str, namespace: str | None = None, project: str | None = None) -> dict[str, DataFrame]:
    """What a change of a name touches: its definition, references, derived types and callers."""
    defined = search.matching_symbols(index.symbols, symbol, None, project).filter(F.col("name") == symbol)
    return {"definition": defined, "references": find_references(index, symbol, project, most=60, per_file=5), "derived": get_class_hierarchy(index, symbol, True), "callers": callers(index, symbol, "both", project)}


# -- projects and names


def get_project_dependencies(index: Index, project: str, full: bool = False) -> DataFrame:
    """references and dependents of a project; dependents up to 15 unless `full`."""
    rows = relations.edge_lists(index.references)
    none = F.array().cast("array<string>")
    mine = index.projects.filter(same_name(F.col("name"), F.lit(project))).select("name").join(rows, same_name(F.col("name"), F.col("node")), "left")
    dependents = F.coalesce("dependents", none)
    return mine.select("name", F.coalesce("references", none).alias("references"), dependents if full else F.slice(dependents, 1, 15).alias("dependents"), F.size(dependents).alias("n_dependents"))


def resolve_bare_name(index: Index, file: str, identifier: str) -> DataFrame:
    """C# types that a bare name in a file can mean: an alias alone, else those in scope (the file's
    namespace, those around it, and its usings), else those out of scope."""
    here = matching_file(index, file).select(F.coalesce("namespace", F.lit("")).alias("own"), "usings", F.try_element_at("aliases", F.lit(identifier)).alias("alias"))
    scope = here.select("own", "alias", F.array_distinct(F.concat(F.array(F.lit("")), ancestors(F.col("own")), "usings")).alias("scope"))
    named = index.types.filter((F.col("lang") == "cs") & (F.col("name") == identifier)).select(F.coalesce("namespace", F.lit("")).alias("namespace"), "name", "path").distinct()
    by_alias = scope.filter("alias IS NOT NULL").select(F.col("alias").alias("full_name"), F.lit(None).cast("string").alias("path"), F.lit("alias").alias("scope"))
    full = F.concat_ws(".", F.when(F.col("namespace") != "", F.col("namespace")), F.col("name"))
    met = named.join(F.broadcast(scope.filter("alias IS NULL")))  # one row, the file
    direct = met.select(full.alias("full_name"), "path", F.when(F.array_contains("scope", F.col("namespace")), "in").otherwise("out").alias("scope"))
    return by_alias.unionByName(direct).orderBy("scope", "full_name", "path")


def check_dangling_references(index: Index, file: str) -> DataFrame:
    """Of a TypeScript file: names (in Pascal case) used without an import though a file defines
    them, with up to five definers; and imports that are never used."""
    here = matching_file(index, file)
    pascal = F.rlike("name", F.lit(r"^\p{Lu}\w*\p{Ll}"))
    used = here.select(F.explode("uses").alias("u")).select("u.name", "u.line")
    imported = here.select(F.explode("imports").alias("i")).select("i.name", "i.line")
    declared = here.select(F.explode("types").alias("t")).select("t.name")
    path = here.select("path")
    elsewhere = index.types.filter(F.col("lang") == "ts").join(path, "path", "left_anti").groupBy("name").agg(F.slice(F.sort_array(F.collect_set("path")), 1, 5).alias("definers"))
    found = relations.unused_and_missing(used, imported, declared, elsewhere.filter(pascal).select("name"))
    return found.join(elsewhere, "name", "left").orderBy("finding", "line", "name")


def enclosing_symbols(index: Index, places: DataFrame) -> DataFrame:
    """Places (path, line) with the innermost type and member around them."""
    types = index.types.select("path", "start_line", (F.col("start_line") + F.col("line_count")).alias("end"), "name", F.col("type_no").alias("no"))
    members = index.members.select("path", "start_line", (F.col("start_line") + F.col("line_count")).alias("end"), "name", (F.col("type_no") * 100_000 + F.col("member_no")).alias("no"))
    typed = relations.innermost(places, types, ["path"], "line", "start_line", "end", "name", "no").withColumnsRenamed({"enclosing": "type", "enclosing_start": "type_start"})
    return relations.innermost(typed, members, ["path"], "line", "start_line", "end", "name", "no").withColumnsRenamed({"enclosing": "member", "enclosing_start": "member_start"})
