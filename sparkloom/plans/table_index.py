"""An index over the table part, and the tools over it, beside SQL that states the same program.

A part is a file of its brand's project. It declares a type named by one word of the part's name, with
the other word as base, two members, a call, a catch clause, a use and an import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import relative_path
from ..sources.index import SCHEMA, Index
from . import tools


def table_index(spark: SparkSession, sf_dir: str) -> Index:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    odd, cs, word = F.col("p_partkey") % 2 == 1, F.col("p_partkey") % 4 != 3, F.split("p_name", " ")
    first, second = F.initcap(F.element_at(word, 1)), F.initcap(F.element_at(word, 2))
    part = part.withColumns({"own": F.when(odd, first).otherwise(second), "base": F.when(odd, second).otherwise(first), "namespace": F.when(cs, F.col("p_type")), "file": F.concat(F.lit("f"), "p_partkey", F.when(cs, ".cs").otherwise(".ts"))})
    text, number, yes = (lambda v: F.lit(v).cast("string")), (lambda v: F.lit(v).cast("int")), (lambda v: F.lit(v).cast("boolean"))
    member = lambda name, kind, sign, line: F.struct(name.alias("name"), text(kind).alias("kind"), text("void").alias("return_type"), sign.alias("signature"), number(line).alias("start_line"), number(1).alias("line_count"))
    method = F.concat("own", F.lit("All"))
    members = F.array(member(method, "Method", F.concat(F.lit("void "), method, F.lit("()")), 2), member(F.lit("Size"), "Property", F.lit("int Size"), 3))
    type_ = F.struct(
        F.col("own").alias("name"), F.when(F.col("p_size") % 5 == 0, "Interface").otherwise("Class").alias("kind"), text("class").alias("keyword"), F.when(F.col("p_partkey") % 3 != 0, F.array("base")).alias("base_types"),
        number(1).alias("start_line"), number(3).alias("line_count"), yes(False).alias("is_nested"), text(None).alias("enum_values"), "namespace", members.alias("members"),
    )

    def event(kind, line, name, empty):
        return F.struct(
            text(kind).alias("kind"), number(line).alias("line"), name.alias("name"), text(None).alias("text"), F.col("own").alias("enclosing_type"), method.alias("enclosing_member"), yes(False).alias("is_access"),
            text(None).alias("receiver"), empty.alias("is_empty"), yes(False).alias("in_finally"), yes(False).alias("is_public"), yes(False).alias("is_fixed"),
        )

    alias = F.when(F.col("p_size") == 1, F.create_map(F.lit("Ring"), F.lit("Other.Ring"))).otherwise(F.create_map().cast("map<string,string>"))
    files = part.select(
        F.concat_ws("/", "p_brand", "file").alias("path"), F.col("file").alias("name"), F.col("p_brand").alias("project"), F.col("p_brand").alias("project_dir"), F.when(cs, "cs").otherwise("ts").alias("lang"),
        F.lit(None).cast("timestamp").alias("mtime"), F.concat_ws("\n", "p_name", "p_type", F.concat(F.lit("// "), "p_name")).alias("text"), "namespace", F.when(F.col("p_size") % 2 == 0, F.array(F.lit("SMALL"))).otherwise(F.array().cast("array<string>")).alias("usings"),
        alias.alias("aliases"), F.array(type_).alias("types"), F.array(event("call", 2, F.concat("base", F.lit("All")), yes(False)), event("catch", 1, text(None), F.col("p_size") % 2 == 0)).alias("events"),
        F.array().cast(_type(spark, "registrations")).alias("registrations"), F.array(F.struct(F.lit("Gone").alias("name"), F.lit("m").alias("module"), number(1).alias("line"))).alias("imports"),
        F.array(F.struct(F.col("base").alias("name"), number(2).alias("line"))).alias("uses"), _counted(F.regexp_extract_all(F.concat_ws(" ", "p_name", "p_type"), F.lit(r"[\p{L}_][\p{L}\p{Nd}_]*"), 0)).alias("words"),
    )
    projects = part.select(F.col("p_brand").alias("name"), F.col("p_brand").alias("dir"), F.lit("cs").alias("segment")).distinct()
    references = part.select(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), (F.col("p_size") % 25 + 1).cast("string")).alias("dst")).filter("src <> dst").distinct()
    return Index(files, projects, references)


def _counted(words: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.size(F.filter(words, lambda x: x == w)))))


def _type(spark, column: str) -> str:
    return spark.createDataFrame([], SCHEMA).schema[column].dataType.simpleString()


_FILES = """WITH RECURSIVE p AS (SELECT *, string_split(p_name, ' ') AS w FROM part),
c AS (SELECT *, upper(w[1][1]) || w[1][2:] AS a, upper(w[2][1]) || w[2][2:] AS b, p_partkey % 4 <> 3 AS cs FROM p),
f AS (SELECT p_partkey, p_size, p_name, p_type, p_brand AS project, CASE WHEN p_partkey % 2 = 1 THEN a ELSE b END AS own, CASE WHEN p_partkey % 2 = 1 THEN b ELSE a END AS other, cs,
  CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 1 THEN b ELSE a END END AS base, CASE WHEN cs THEN p_type END AS namespace, 'f' || p_partkey || CASE WHEN cs THEN '.cs' ELSE '.ts' END AS name,
  p_brand || '/f' || p_partkey || CASE WHEN cs THEN '.cs' ELSE '.ts' END AS path, CASE WHEN p_size % 5 = 0 THEN 'Interface' ELSE 'Class' END AS kind FROM c)"""
QUERIES, ORACLE_SQL = {}, {}


def _registered(sql: str):
    """Registers a query under its name, with the SQL that follows the files."""

    def add(query):
        QUERIES[query.__name__] = query
        ORACLE_SQL[query.__name__] = f"{_FILES}{sql}"
        return query

    return add


@_registered(""", g AS (SELECT *, count(DISTINCT lower(coalesce(namespace, ''))) OVER () > 1 AS ambiguous FROM f WHERE lower(own) = 'ring')
SELECT own || 'All' AS name, 'Method' AS kind, path, 2 AS start_line, namespace, ambiguous FROM g UNION ALL SELECT 'Size', 'Property', path, 3, namespace, ambiguous FROM g""")
def index_type_members(spark, sf_dir) -> DataFrame:
    return tools.get_type_members(table_index(spark, sf_dir), "ring").select("name", "kind", "path", "start_line", "namespace", "ambiguous")


@_registered("""SELECT own || 'All' AS name, path FROM f WHERE own = 'Bolt' AND lower(namespace) = 'small'""")
def index_members_of_namespace(spark, sf_dir) -> DataFrame:
    return tools.get_type_members(table_index(spark, sf_dir), "Bolt", "method", "small").select("name", "path")


@_registered(""", g AS (SELECT lower(coalesce(namespace, '')) AS ns, count(*)::BIGINT AS parts, min(namespace) AS namespace, arg_min(path, (base IS NULL, path)) AS path, coalesce(array_to_string(list_sort(list(DISTINCT base)), ','), '') AS bases FROM f WHERE own = 'Ring' GROUP BY 1)
SELECT namespace, parts, path, bases, count(*) OVER () > 1 AS ambiguous FROM g""")
def index_resolved_type(spark, sf_dir) -> DataFrame:
    return tools.resolved_type(table_index(spark, sf_dir), "RING").select("namespace", "parts", "path", F.array_join("base_types", ",").alias("bases"), "ambiguous")


@_registered(""", e AS (SELECT DISTINCT lower(base) AS src, lower(own) AS dst FROM f WHERE base IS NOT NULL), reach AS (SELECT 'small' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM reach JOIN e ON node = src WHERE depth < 6),
n AS (SELECT node, min(depth) AS depth FROM reach GROUP BY node), d AS (SELECT path, own, kind, base, n.depth + 1 AS depth FROM f JOIN n ON lower(base) = node WHERE lower(own) <> 'small')
SELECT depth::INTEGER AS depth, own AS name, kind, base, path, (SELECT count(*) FROM d) > 500 AS truncated FROM d ORDER BY depth, upper(own), path LIMIT 500""")
def index_hierarchy(spark, sf_dir) -> DataFrame:
    return tools.get_class_hierarchy(table_index(spark, sf_dir), "Small", True, 6).select("depth", "name", "kind", "base", "path", "truncated")


@_registered(""", d AS (SELECT lower(coalesce(namespace, '')) AS ns, min(namespace) AS namespace, list(DISTINCT base) AS bs FROM f WHERE own = 'Ring' GROUP BY 1), b AS (SELECT namespace, unnest(bs) AS base FROM d)
SELECT b.namespace, b.base, f.path FROM b LEFT JOIN f ON lower(f.own) = lower(b.base) WHERE b.base IS NOT NULL""")
def index_base_types(spark, sf_dir) -> DataFrame:
    return tools.get_base_types(table_index(spark, sf_dir), "Ring").select("namespace", "base", "path")


@_registered(""", h AS (SELECT path, own || 'All' AS caller FROM f WHERE other = 'Ring'), r AS (SELECT *, row_number() OVER (ORDER BY path) AS file_rank FROM h)
SELECT path, caller, 1::BIGINT AS matches, file_rank::INTEGER AS file_rank FROM r WHERE file_rank <= 40""")
def index_callers(spark, sf_dir) -> DataFrame:
    return tools.callers(table_index(spark, sf_dir), "RingAll").select("path", "caller", "matches", "file_rank")


@_registered("""SELECT other || 'All' AS name, count(*)::BIGINT AS times FROM f WHERE own = 'Ring' GROUP BY 1 ORDER BY times DESC, name LIMIT 40""")
def index_callees(spark, sf_dir) -> DataFrame:
    return tools.callees(table_index(spark, sf_dir), "RingAll")


@_registered("""SELECT path, 0 AS type_no, own AS name, kind, 0 AS n_constructor, 1 AS n_property, 0 AS n_field, 0 AS n_event, 1 AS n_method FROM f WHERE name = 'f7.ts'""")
def index_file_outline(spark, sf_dir) -> DataFrame:
    return tools.get_file_outline(table_index(spark, sf_dir), "F7.ts", True).select("path", "type_no", "name", "kind", "n_constructor", "n_property", "n_field", "n_event", "n_method")


@_registered(""", r AS (SELECT path, p_name, row_number() OVER (ORDER BY path) AS file_rank FROM f WHERE cs AND p_size % 2 = 0)
SELECT path, 1 AS line_no, p_name AS line, file_rank::INTEGER AS file_rank FROM r WHERE file_rank <= 40""")
def index_structural(spark, sf_dir) -> DataFrame:
    return tools.search_structural(table_index(spark, sf_dir), "empty-catch").select("path", "line_no", "line", "file_rank")


@_registered("""SELECT count(*)::BIGINT AS files, count(*)::BIGINT AS types, 2 * count(*)::BIGINT AS members, count(DISTINCT project)::BIGINT AS projects, 'none' AS build FROM f""")
def index_info(spark, sf_dir) -> DataFrame:
    return tools.repo_info(table_index(spark, sf_dir)).select("files", "types", "members", "projects", "build")


@_registered("""SELECT path, cs, n FROM (SELECT path, CASE WHEN cs THEN 'cs' ELSE 'ts' END AS cs, count(*) OVER ()::BIGINT AS n FROM f WHERE lower(project) = 'brand#3') ORDER BY path LIMIT 200""")
def index_project_files(spark, sf_dir) -> DataFrame:
    return tools.project_files(table_index(spark, sf_dir), "brand#3").select("path", F.col("lang").alias("cs"), F.col("total").alias("n"))


@_registered("""SELECT kind, count(*)::BIGINT AS n FROM f GROUP BY kind""")
def index_kinds(spark, sf_dir) -> DataFrame:
    return tools.suggest_queries(table_index(spark, sf_dir))["kinds"]


@_registered("""SELECT project, count(*)::BIGINT AS files FROM f GROUP BY project ORDER BY files DESC, project LIMIT 10""")
def index_top_projects(spark, sf_dir) -> DataFrame:
    return tools.suggest_queries(table_index(spark, sf_dir))["projects"]


@_registered("""SELECT project, path, 3 AS symbols FROM f ORDER BY path LIMIT 10""")
def index_top_files(spark, sf_dir) -> DataFrame:
    return tools.suggest_queries(table_index(spark, sf_dir))["files"].select("project", "path", "symbols")


@_registered(""", e AS (SELECT DISTINCT project AS src, 'Brand#' || (p_size % 25 + 1) AS dst FROM f WHERE project <> 'Brand#' || (p_size % 25 + 1)), d AS (SELECT list_sort(list(src)) AS l FROM e WHERE dst = 'Brand#3')
SELECT 'Brand#3' AS name, (SELECT array_to_string(list_sort(list(dst)), ',') FROM e WHERE src = 'Brand#3') AS "references", array_to_string(l[1:15], ',') AS dependents, len(l)::INTEGER AS n_dependents FROM d""")
def index_project_dependencies(spark, sf_dir) -> DataFrame:
    found = tools.get_project_dependencies(table_index(spark, sf_dir), "brand#3")
    return found.select("name", F.array_join("references", ",").alias("references"), F.array_join("dependents", ",").alias("dependents"), "n_dependents")


@_registered(""", h AS (SELECT namespace, p_size FROM f WHERE name = 'f8.cs'), t AS (SELECT DISTINCT namespace, own, path FROM f WHERE cs AND own = 'Bolt')
SELECT t.namespace || '.Bolt' AS full_name, path, CASE WHEN t.namespace = h.namespace OR (h.p_size % 2 = 0 AND t.namespace = 'SMALL') THEN 'in' ELSE 'out' END AS scope FROM t, h""")
def index_bare_name(spark, sf_dir) -> DataFrame:
    return tools.resolve_bare_name(table_index(spark, sf_dir), "f8.cs", "Bolt")


@_registered(""", h AS (SELECT * FROM f WHERE name = 'f3.ts'), d AS (SELECT own, list_sort(list(DISTINCT path))[1:5] AS l FROM f WHERE NOT cs AND name <> 'f3.ts' GROUP BY own)
SELECT h.other AS name, 'missing' AS finding, 2 AS line, array_to_string(l, ',') AS definers FROM h JOIN d ON d.own = h.other WHERE h.other <> h.own UNION ALL SELECT 'Gone', 'unused', 1, NULL FROM h""")
def index_dangling(spark, sf_dir) -> DataFrame:
    return tools.check_dangling_references(table_index(spark, sf_dir), "f3.ts").select("name", "finding", "line", F.array_join("definers", ",").alias("definers"))


@_registered("""SELECT path, line::INTEGER AS line, CASE WHEN line <= 3 THEN own END AS type, CASE line WHEN 2 THEN own || 'All' WHEN 3 THEN 'Size' END AS member FROM f, (SELECT unnest([1, 2, 3, 4]) AS line)""")
def index_enclosing(spark, sf_dir) -> DataFrame:
    index = table_index(spark, sf_dir)
    places = index.files.select("path", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("line"))
    return tools.enclosing_symbols(index, places).select("path", "line", "type", "member")


@_registered(""", s AS (SELECT own AS name, kind, project, name AS file, path, 1 AS line, 3 AS n, namespace, NULL::VARCHAR AS signature, NULL::VARCHAR AS parent FROM f
  UNION ALL SELECT own || 'All', 'Method', project, name, path, 2, 1, namespace, 'void ' || own || 'All()', own FROM f UNION ALL SELECT 'Size', 'Property', project, name, path, 3, 1, namespace, 'int Size', own FROM f),
t AS (SELECT *, CASE WHEN lower(name) = 'ring' THEN 0 WHEN starts_with(lower(name), 'ring') THEN 1 WHEN contains(lower(name), 'ring') THEN 2 END AS tier FROM s)
SELECT name, kind, path, tier::INTEGER AS tier, count(*) OVER ()::BIGINT AS total, '{"name":"' || name || '","kind":"' || kind || '","project":"' || project || '","file":"' || file || '","sourceFilePath":"' || path || '","startLine":' || line || ',"lineCount":' || n
  || coalesce(',"namespace":"' || namespace || '"', '') || coalesce(',"signature":"' || signature || '"', '') || coalesce(',"parentType":"' || parent || '"', '') || '}' AS json
FROM t WHERE tier IS NOT NULL ORDER BY tier, parent IS NOT NULL, upper(name), path, line LIMIT 50""")
def index_search_symbol(spark, sf_dir) -> DataFrame:
    return tools.search_symbol(table_index(spark, sf_dir), "ring", detail="full").select("name", "kind", "path", "tier", "total", "json")


_LINES = """, l AS (SELECT path, project, cs, unnest([p_name, p_type, '// ' || p_name]) AS line, unnest([1, 2, 3]) AS line_no FROM f)"""


@_registered(_LINES + """, h AS (SELECT * FROM l WHERE contains(line, 'ring')), n AS (SELECT path, count(*) AS matches FROM h GROUP BY path ORDER BY matches DESC, path LIMIT 30), r AS (SELECT *, row_number() OVER (ORDER BY matches DESC, path) AS file_rank FROM n)
SELECT path, matches::BIGINT AS matches, line_no::INTEGER AS line_no, line FROM h JOIN r USING (path) ORDER BY file_rank, line_no LIMIT 30""")
def index_search_text(spark, sf_dir) -> DataFrame:
    return tools.search_text(table_index(spark, sf_dir), "ring").select("path", "matches", "line_no", "line")


@_registered(_LINES + """, n AS (SELECT path, count(*) AS matches FROM l WHERE contains(lower(line), 'ring') GROUP BY path)
SELECT path, matches::BIGINT AS matches, (SELECT sum(matches) FROM n)::BIGINT AS total, (SELECT count(*) FROM n)::BIGINT AS files FROM n ORDER BY matches DESC, path LIMIT 12""")
def index_search_summary(spark, sf_dir) -> DataFrame:
    return tools.search_summary(table_index(spark, sf_dir), "RING", ignore_case=True)


@_registered(_LINES + """, h AS (SELECT path, line_no, line FROM l WHERE regexp_matches(line, '^hot .*r$') ORDER BY path, line_no), n AS (SELECT path, count(*) AS m FROM h GROUP BY path ORDER BY m DESC, path LIMIT 30)
SELECT path, line_no::INTEGER AS line_no, (SELECT string_agg(line, '|' ORDER BY line_no) FROM l WHERE l.path = h.path AND l.line_no BETWEEN h.line_no - 1 AND h.line_no + 1) AS context FROM h JOIN n USING (path)""")
def index_regex_context(spark, sf_dir) -> DataFrame:
    index = table_index(spark, sf_dir)
    return tools.with_context(index, tools.search_text(index, "^hot .*r$", is_regex=True), 1).select("path", "line_no", F.array_join("context", "|").alias("context"))


@_registered(""", h AS (SELECT path FROM f WHERE regexp_matches(p_name, '(^| )ring( |$)') ORDER BY path)
SELECT path, 1 AS line_no, 1::BIGINT AS matches FROM h ORDER BY path LIMIT 30""")
def index_references(spark, sf_dir) -> DataFrame:
    return tools.find_references(table_index(spark, sf_dir), "ring").select("path", "line_no", "matches")


@_registered("""SELECT count(*)::BIGINT AS prod, 0::BIGINT AS test, 0::BIGINT AS generated, 0::BIGINT AS non_code, count(*)::BIGINT AS total, count(*)::BIGINT AS files FROM f WHERE regexp_matches(p_name, '(^| )ring( |$)')""")
def index_reference_facets(spark, sf_dir) -> DataFrame:
    return tools.reference_facets(table_index(spark, sf_dir), "ring")


@_registered("""SELECT path, 2 AS start_line, 1 AS line_count, 'void RingAll()' AS signature, p_type AS source FROM f WHERE own = 'Ring' AND lower(project) = 'brand#4'""")
def index_member_source(spark, sf_dir) -> DataFrame:
    return tools.get_symbol_source(table_index(spark, sf_dir), member="RingAll", project="Brand#4").select("path", "start_line", "line_count", "signature", "source")


@_registered(""", s AS (SELECT 'Ring' AS asked, own AS name, path, p_name || chr(10) || p_type || chr(10) || '// ' || p_name AS source FROM f WHERE own = 'Ring' ORDER BY path LIMIT 1), b AS (SELECT 'BoltAll' AS asked, own || 'All' AS name, path, p_type AS source FROM f WHERE own = 'Bolt' ORDER BY path LIMIT 1)
SELECT * FROM s UNION ALL SELECT * FROM b""")
def index_context_bundle(spark, sf_dir) -> DataFrame:
    return tools.get_context_bundle(table_index(spark, sf_dir), ["Ring", "BoltAll"]).select("asked", "name", "path", "source")


@_registered(""", g AS (SELECT lower(own) AS key, arg_min(own, path) AS name, arg_min(kind, path) AS kind, min(path) AS path FROM f GROUP BY 1), s AS (SELECT *, (contains(key, 'ring'))::INTEGER + (contains(key, 'widget'))::INTEGER + (contains(key, 'gear'))::INTEGER AS score FROM g)
SELECT name, kind, path, score FROM s WHERE score > 0 ORDER BY score DESC, length(name), name LIMIT 6""")
def index_task_anchors(spark, sf_dir) -> DataFrame:
    return tools.task_anchors(table_index(spark, sf_dir), "please change the ring, widget and gear").select("name", "kind", "path", "score")


@_registered("""SELECT path, name AS below FROM f""")
def index_relative_paths(spark, sf_dir) -> DataFrame:
    index = table_index(spark, sf_dir)
    return index.files.select("path", relative_path(F.replace("path", F.lit("/"), F.lit("\\")), F.col("project")).alias("below"))
