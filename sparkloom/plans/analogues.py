"""The operators on the driver's tables, beside SQL that states the same program.

The tables hold no source code, so these are analogues: symbols are region, nation, supplier,
customer and part names; files are documents; projects are their sources; lines are split texts;
edges lead from customers' to suppliers' nations through orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ancestors, initials, kind_filter, simple_base_name, subsequence
from ..functions.text import age, base_name, clipped, estimated_tokens, folder_key, is_generated, is_test, lines
from ..operators import graph, relations, search, text
from ..operators.scalars import first_of, settled, top
from ..sources import tree
from ..streaming.changes import classified, debounced_batch

SYMBOLS_SQL = """
WITH symbols AS (
  SELECT r_name AS name, 'Class' AS kind, 'region' AS project, NULL::VARCHAR AS parent_type, r_regionkey::BIGINT AS start_line FROM region
  UNION ALL SELECT n_name, 'Interface', 'nation', NULL, n_nationkey FROM nation
  UNION ALL SELECT s_name, 'Property', 'supplier', 'nation', s_suppkey FROM supplier
  UNION ALL SELECT c_name, 'Method', 'customer', 'nation', c_custkey FROM customer
  UNION ALL SELECT p_name, 'Field', 'part', 'brand', p_partkey FROM part
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name, column, kind, key, parent):
        return table(spark, sf_dir, name).select(
            F.col(column).alias("name"), F.lit(kind).alias("kind"), F.lit(name).alias("project"), F.lit(f"{name}.cs").alias("file"), F.lit(f"/{name}.cs").alias("path"),
            F.col(key).cast("long").alias("start_line"), F.lit(1).alias("line_count"), F.lit(None).cast("string").alias("namespace"), F.col(column).alias("signature"), F.lit(parent).cast("string").alias("parent_type"),
        )

    out = part("region", "r_name", "Class", "r_regionkey", None)
    for one in (("nation", "n_name", "Interface", "n_nationkey", None), ("supplier", "s_name", "Property", "s_suppkey", "nation"), ("customer", "c_name", "Method", "c_custkey", "nation"), ("part", "p_name", "Field", "p_partkey", "brand")):
        out = out.unionByName(part(*one))
    return out


_TIER_SQL = "CASE WHEN lower(name) = lower('{q}') THEN 0 WHEN starts_with(lower(name), lower('{q}')) THEN 1 WHEN contains(lower(name), lower('{q}')) THEN 2 END"


def symbol_search(spark, sf_dir):
    return search.search_symbols(symbols(spark, sf_dir), "an").select("name", "kind", "project", "tier", "start_line", "total")


SYMBOL_SEARCH_SQL = f"""{SYMBOLS_SQL}, tiers AS (SELECT *, {_TIER_SQL.format(q="an")} AS tier FROM symbols)
SELECT name, kind, project, tier::INTEGER AS tier, start_line, count(*) OVER ()::BIGINT AS total FROM tiers WHERE tier IS NOT NULL
ORDER BY tier, parent_type IS NOT NULL, upper(name), '/' || project || '.cs', start_line LIMIT 50"""


def symbol_search_budget(spark, sf_dir):
    line = F.concat_ws(" ", "kind", "name", "project")
    return search.search_within(symbols(spark, sf_dir), "er", 400, line).select("name", "kind", "project", "tier", "start_line")


SYMBOL_SEARCH_BUDGET_SQL = f"""{SYMBOLS_SQL}, tiers AS (SELECT *, {_TIER_SQL.format(q="er")} AS tier FROM symbols),
runs AS (SELECT *, sum(greatest(1, ceil(length(concat_ws(' ', kind, name, project)) / 4.0))) OVER w AS used, row_number() OVER w AS n
  FROM tiers WHERE tier IS NOT NULL WINDOW w AS (ORDER BY tier, parent_type IS NOT NULL, upper(name), '/' || project || '.cs', start_line ROWS UNBOUNDED PRECEDING))
SELECT name, kind, project, tier::INTEGER AS tier, start_line FROM runs WHERE used <= 400 OR n = 1"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang")


_LINES_SQL = r"""split AS (SELECT doc_id, source, lang, string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, source, lang, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no, len(ls) AS n FROM split),
kept AS (SELECT * FROM lines WHERE NOT (line = '' AND line_no = n))"""


def text_search_faceted(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    hits = text.line_hits(documents(spark, sf_dir), lambda c: F.lower(c).contains("the "))
    files = text.counted(hits, ["source", "doc_id"], ~F.ltrim("line").startswith("//")).join(labels, "doc_id", "left")
    per = files.groupBy("source").agg(
        F.count("*").alias("files"), F.sum("matches").alias("matches"), F.sum("non_code").alias("non_code"),
        F.coalesce(F.sum(F.when(F.col("quality").isNull(), F.col("matches"))), F.lit(0)).alias("unlabelled"),
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("matches"))), F.lit(0)).alias("toxic"),
        F.coalesce(F.sum(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("matches"))), F.lit(0)).alias("good"),
    )
    return per


TEXT_SEARCH_SQL = f"""WITH {_LINES_SQL}, files AS (
  SELECT source, doc_id, count(*) AS matches, count(*) FILTER (starts_with(ltrim(line), '//')) AS non_code FROM kept WHERE contains(lower(line), 'the ') GROUP BY ALL)
SELECT source, count(*)::BIGINT AS files, sum(matches)::BIGINT AS matches, sum(non_code)::BIGINT AS non_code,
  coalesce(sum(matches) FILTER (quality IS NULL), 0)::BIGINT AS unlabelled, coalesce(sum(matches) FILTER (toxic = 1), 0)::BIGINT AS toxic,
  coalesce(sum(matches) FILTER (quality = 1 AND toxic = 0), 0)::BIGINT AS good
FROM files LEFT JOIN labels USING (doc_id) GROUP BY source"""


def reference_scan(spark, sf_dir):
    from ..functions.text import mentions

    return text.counted(text.line_hits(documents(spark, sf_dir), lambda c: mentions(c, "the"), "the"), ["doc_id"]).select("doc_id", "matches")


REFERENCE_SCAN_SQL = rf"""WITH {_LINES_SQL}
SELECT doc_id, count(*)::BIGINT AS matches FROM kept WHERE NOT starts_with(ltrim(line), '//') AND regexp_matches(line, '(^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])the($|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])') GROUP BY doc_id"""


def grouped_caps(spark, sf_dir):
    hits = text.line_hits(documents(spark, sf_dir), lambda c: c.contains("tion"), "tion")
    return text.grouped(hits, "doc_id").select("doc_id", "file_rank", "matches", "line_no", "in_file")


GROUPED_CAPS_SQL = f"""WITH {_LINES_SQL}, hits AS (SELECT doc_id, line_no FROM kept WHERE contains(line, 'tion')),
files AS (SELECT doc_id, count(*) AS matches FROM hits GROUP BY doc_id ORDER BY matches DESC, doc_id LIMIT 30),
ranked AS (SELECT *, row_number() OVER (ORDER BY matches DESC, doc_id) AS file_rank FROM files),
samples AS (SELECT doc_id, file_rank, matches, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS in_file FROM hits JOIN ranked USING (doc_id))
SELECT doc_id, file_rank::INTEGER AS file_rank, matches::BIGINT AS matches, line_no::INTEGER AS line_no, in_file::INTEGER AS in_file FROM samples WHERE in_file <= 3 ORDER BY file_rank, line_no LIMIT 30"""


def did_you_mean(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    return search.nearest_names(names, "bold", 20)


DID_YOU_MEAN_SQL = """WITH names AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), q AS (SELECT 'bold' AS q),
scored AS (SELECT name, abs(length(name) - 4) AS delta, levenshtein(lower(name), q) AS d,
  CASE WHEN lower(name) = q THEN 0 WHEN starts_with(lower(name), q) OR starts_with(q, lower(name)) THEN 1 WHEN contains(lower(name), q) OR contains(q, lower(name)) THEN 2
       WHEN abs(length(name) - 4) <= 1 AND levenshtein(lower(name), q) <= 1 THEN 3 END AS near FROM names, q WHERE length(name) > 0)
SELECT name, near::INTEGER AS near, (CASE near WHEN 0 THEN 0 WHEN 3 THEN d ELSE delta END)::INTEGER AS distance FROM scored WHERE near IS NOT NULL
ORDER BY near, distance, delta, name LIMIT 20"""


def range_enclosing(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    opens = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("opened"), F.expr("ts + INTERVAL 3 DAYS").alias("closed"), F.col("event_id").alias("signup"))
    others = events.filter("event_type <> 'signup'")
    return relations.innermost(others, opens, ["user_id"], "ts", "opened", "closed", "signup", "signup").select("event_id", "user_id", F.col("enclosing").alias("signup"))


RANGE_ENCLOSING_SQL = """WITH opens AS (SELECT user_id, ts AS opened, ts + INTERVAL 3 DAY AS closed, event_id AS signup FROM events WHERE event_type = 'signup'),
met AS (SELECT e.event_id, e.user_id, o.signup, row_number() OVER (PARTITION BY e.event_id ORDER BY o.opened DESC NULLS LAST, o.signup) AS n
  FROM events e LEFT JOIN opens o ON e.user_id = o.user_id AND e.ts >= o.opened AND e.ts < o.closed WHERE e.event_type <> 'signup')
SELECT event_id, user_id, signup FROM met WHERE n = 1"""


def kind_distribution(spark, sf_dir):
    small = lambda n: F.count_if(F.col("p_size") <= n)
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("parts"), small(10).alias("small"), F.count_if(F.col("p_size") > 40).alias("large"), F.count_distinct("p_brand").alias("brands"))


KIND_DISTRIBUTION_SQL = """SELECT p_type, count(*)::BIGINT AS parts, count(*) FILTER (p_size <= 10)::BIGINT AS small, count(*) FILTER (p_size > 40)::BIGINT AS large,
  count(DISTINCT p_brand)::BIGINT AS brands FROM part GROUP BY p_type"""


def top_groups(spark, sf_dir):
    counts = documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("files"), F.sum(F.size(lines(F.col("text")))).alias("lines"))
    return top(counts, 10, [F.desc("files"), F.desc("lines"), "source"])


TOP_GROUPS_SQL = f"""WITH {_LINES_SQL}, n AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
SELECT source, count(*)::BIGINT AS files, coalesce(sum(n), 0)::BIGINT AS lines FROM documents LEFT JOIN n USING (doc_id) GROUP BY source ORDER BY files DESC, lines DESC, source LIMIT 10"""

_CUT = "2024-01-15"


def _stamps(spark, sf_dir, before: bool):
    events = table(spark, sf_dir, "events").filter((F.col("ts") < _CUT) if before else (F.col("ts") >= "2024-01-05"))
    return events.groupBy(F.concat(F.lit("User"), "user_id").alias("path")).agg(F.unix_micros(F.to_timestamp(F.max("ts"))).alias("stamp"))


def delta_snapshot(spark, sf_dir):
    return relations.delta(_stamps(spark, sf_dir, True), _stamps(spark, sf_dir, False), "path", "stamp")


DELTA_SNAPSHOT_SQL = f"""WITH a AS (SELECT 'User' || user_id AS path, max(ts) AS stamp FROM events WHERE ts < '{_CUT}' GROUP BY 1),
b AS (SELECT 'User' || user_id AS path, max(ts) AS stamp FROM events WHERE ts >= '2024-01-05' GROUP BY 1)
SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.stamp IS DISTINCT FROM b.stamp THEN 'changed' ELSE 'same' END AS state
FROM a FULL JOIN b ON lower(a.path) = lower(b.path)"""


def copy_forward(spark, sf_dir):
    base, now = _stamps(spark, sf_dir, True), _stamps(spark, sf_dir, False)
    states = relations.delta(base, now, "path", "stamp")
    return relations.copied_forward(base, states, "path", now.join(states.filter("state IN ('added', 'changed')"), "path", "left_semi"))


COPY_FORWARD_SQL = f"""WITH a AS (SELECT 'User' || user_id AS path, epoch_us(max(ts)) AS stamp FROM events WHERE ts < '{_CUT}' GROUP BY 1),
b AS (SELECT 'User' || user_id AS path, epoch_us(max(ts)) AS stamp FROM events WHERE ts >= '2024-01-05' GROUP BY 1) SELECT path, stamp FROM b"""


def segment_union(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.regexp_replace("s_name", "Supplier", "Firm").alias("name"), F.lit("cs").alias("segment"))
    customers = table(spark, sf_dir, "customer").select(F.upper(F.regexp_replace("c_name", "Customer", "Firm")).alias("name"), F.lit("ts").alias("segment"))
    return relations.with_precedence(suppliers, customers, "name")


SEGMENT_UNION_SQL = """WITH s AS (SELECT replace(s_name, 'Supplier', 'Firm') AS name FROM supplier), c AS (SELECT upper(replace(c_name, 'Customer', 'Firm')) AS name FROM customer)
SELECT name, 'cs' AS segment FROM s UNION ALL SELECT name, 'ts' FROM c WHERE lower(name) NOT IN (SELECT lower(name) FROM s)"""


def unused_and_missing(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), "text")
    used = text.line_hits(docs, lambda c: c.contains("ing "), "ing ").groupBy("name").agg(F.min("line_no").cast("int").alias("line"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), "quality", "toxic")
    imported = labels.filter("quality = 1").select("name", F.lit(0).alias("line"))
    return relations.unused_and_missing(used, imported, labels.filter("quality = 0").select("name"), docs.select("name"))


UNUSED_AND_MISSING_SQL = f"""WITH {_LINES_SQL}, used AS (SELECT doc_id, min(line_no)::INTEGER AS line FROM kept WHERE contains(line, 'ing ') GROUP BY doc_id)
SELECT doc_id::VARCHAR AS name, 'missing' AS finding, line FROM used WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IN (0, 1))
UNION ALL SELECT doc_id::VARCHAR, 'unused', 0 FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM used)"""


def partial_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), 1).alias("name"), F.col("p_brand").alias("namespace"), F.array("p_type").alias("bases"), F.col("p_partkey").alias("start"))
    return relations.merged_parts(parts, "name", "namespace", "bases", "start").select("name", "namespace", "parts", F.array_join("bases", ",").alias("bases"), "first", "ambiguous")


PARTIAL_MERGE_SQL = """WITH p AS (SELECT string_split(p_name, ' ')[1] AS name, p_brand AS namespace, p_type, p_partkey FROM part),
g AS (SELECT name, min(namespace) AS namespace, count(*)::BIGINT AS parts, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS bases, min(p_partkey) AS first FROM p GROUP BY name, lower(namespace))
SELECT *, count(*) OVER (PARTITION BY name) > 1 AS ambiguous FROM g"""


def _words():
    return F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), 0)


def idf_terms(spark, sf_dir):
    found = documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(_words())).alias("name"))
    n = table(spark, sf_dir, "documents").count()
    return graph.term_weights(found, n).select("name", "df", F.round("idf", 6).alias("idf"))


_MENTIONS_SQL = """mentions AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents),
df AS (SELECT name, count(DISTINCT doc)::BIGINT AS df FROM mentions WHERE length(name) >= 3 GROUP BY name),
n AS (SELECT count(*) AS n FROM documents),
weights AS (SELECT name, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n WHERE df <= greatest(50, n // 10))"""

IDF_TERMS_SQL = f"WITH {_MENTIONS_SQL} SELECT name, df, round(idf, 6) AS idf FROM weights"


def edge_weights(spark, sf_dir):
    """Definers of a name: the documents that begin a line with it."""
    first = text.exploded_lines(documents(spark, sf_dir)).select(F.col("doc_id").alias("doc"), F.regexp_extract("line", "^([A-Z][a-z]+)", 1).alias("name")).filter("name <> ''").distinct()
    first = settled(first)  # read several times, like the counts
    likely = F.regexp_extract_all(F.col("text"), F.lit("(?<![A-Za-z])[A-Z][a-z]+(?![A-Za-z])"), 0)  # no other word can be such a name
    words = documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.explode(likely).alias("name"))
    found = settled(graph.mention_counts(words).join(first.select("name").distinct(), "name", "left_semi"))
    weights = graph.term_weights(found, table(spark, sf_dir, "documents").count())
    rounded = F.floor(F.col("weight") * 1e6 + 0.5) / 1e6  # as SQL rounds; all weights are positive
    return graph.mention_edges(found, first, weights).select("src", "dst", rounded.alias("weight"))


EDGE_WEIGHTS_SQL = rf"""WITH {_LINES_SQL}, {_MENTIONS_SQL},
defs AS (SELECT DISTINCT doc_id AS dst, regexp_extract(line, '^([A-Z][a-z]+)', 1) AS name FROM kept WHERE regexp_matches(line, '^[A-Z][a-z]+')),
definers AS (SELECT name, count(*) AS definers FROM defs GROUP BY name),
counts AS (SELECT doc, name, count(*) AS n FROM mentions GROUP BY doc, name)
SELECT doc AS src, dst, round(sum(sqrt(n) * idf / definers), 6) AS weight FROM counts JOIN weights USING (name) JOIN definers USING (name) JOIN defs USING (name)
WHERE doc <> dst GROUP BY doc, dst"""


def nation_edges(spark, sf_dir) -> DataFrame:
    """Edges between nations whose lineitems are more than the average pair's."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    by_order = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n"))
    met = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    pairs = met.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("n").alias("weight"))
    return pairs.filter(F.col("weight") > pairs.agg(F.avg("weight")).scalar()).filter("src <> dst")


_NATION_EDGES_SQL = """pairs AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
raw AS (SELECT src, dst, weight::DOUBLE AS weight FROM pairs WHERE weight > (SELECT avg(weight) FROM pairs) AND src <> dst)"""
_STEPS = 12


def _ranks_sql(damping: float, teleport: str, weight: str) -> str:
    """Unrolled power iteration."""
    out = [f"""WITH {_NATION_EDGES_SQL}, edges AS (SELECT src, dst, {weight} AS weight FROM raw),
totals AS (SELECT src, sum(weight) AS total FROM edges GROUP BY src), start AS (SELECT n_nationkey AS node, {teleport} AS jump FROM nation), r0 AS (SELECT node, jump, jump AS rank FROM start)"""]
    for i in range(_STEPS):
        out.append(f"""c{i} AS (SELECT dst AS node, sum(rank * weight / total) AS came FROM edges JOIN totals USING (src) JOIN r{i} ON node = src GROUP BY dst),
l{i} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{i} WHERE node NOT IN (SELECT src FROM totals)),
r{i + 1} AS (SELECT r.node, r.jump, (1 - {damping} + {damping} * loose) * r.jump + {damping} * coalesce(came, 0) AS rank FROM r{i} r LEFT JOIN c{i} USING (node), l{i})""")
    return ",\n".join(out) + f"\nSELECT node, round(rank, 6) AS rank FROM r{_STEPS}"


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


def pagerank_nations(spark, sf_dir):
    return graph.pagerank(_nodes(spark, sf_dir), nation_edges(spark, sf_dir), iterations=_STEPS, tolerance=0).select("node", F.round("rank", 6).alias("rank"))


def pagerank_focus(spark, sf_dir):
    return graph.pagerank(_nodes(spark, sf_dir), nation_edges(spark, sf_dir), focus=[3, 7], iterations=_STEPS, tolerance=0).select("node", F.round("rank", 6).alias("rank"))


def definition_scores(spark, sf_dir):
    """A nation's rank shared among its suppliers (as methods) and customers (as properties)."""
    ranks = graph.pagerank(_nodes(spark, sf_dir), nation_edges(spark, sf_dir), iterations=_STEPS, tolerance=0)
    defs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_name").alias("name"), F.lit("Method").alias("kind"))
    defs = defs.unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_name").alias("name"), F.lit("Property").alias("kind")))
    return graph.definition_scores(ranks, defs).select("doc", "name", F.round("score", 6).alias("score"))


DEFINITION_SCORES_SQL = f"""WITH ranks AS ({_ranks_sql(0.85, "1.0 / (SELECT count(*) FROM nation)", "weight").replace("round(rank, 6)", "rank")}),
defs AS (SELECT s_nationkey AS doc, s_name AS name, 1.0 AS w FROM supplier UNION ALL SELECT c_nationkey, c_name, 0.6 FROM customer)
SELECT doc, name, round(rank * w / sum(w) OVER (PARTITION BY doc), 6) AS score FROM defs JOIN ranks ON node = doc"""


def transitive_closure(spark, sf_dir):
    """region -> nation -> customer -> order, by depth from one region."""
    def edge(frame, src, dst, a, b):
        return frame.select(F.concat(F.lit(a), F.col(src)).alias("src"), F.concat(F.lit(b), F.col(dst)).alias("dst"))

    edges = edge(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "r", "n")
    edges = edges.union(edge(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "n", "c")).union(edge(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "c", "o"))
    return graph.closure(edges, spark.createDataFrame([("r1",)], "node string"), 5)


TRANSITIVE_CLOSURE_SQL = """WITH RECURSIVE edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
reach AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM reach JOIN edges ON node = src WHERE depth < 5)
SELECT node, min(depth)::INTEGER AS depth FROM reach GROUP BY node"""


def call_tree_bounded(spark, sf_dir):
    edges = nation_edges(spark, sf_dir).select("src", "dst")
    return graph.closure(edges, spark.createDataFrame([(0,)], "node int"), 3)


CALL_TREE_BOUNDED_SQL = f"""WITH RECURSIVE {_NATION_EDGES_SQL}, edges AS (SELECT src, dst FROM raw),
reach AS (SELECT 0 AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM reach JOIN edges ON node = src WHERE depth < 3)
SELECT node::INTEGER AS node, min(depth)::INTEGER AS depth FROM reach GROUP BY node"""


def edge_lists(spark, sf_dir):
    edges = nation_edges(spark, sf_dir).select(F.lpad(F.col("src").cast("string"), 2, "0").alias("src"), F.lpad(F.col("dst").cast("string"), 2, "0").alias("dst"))
    return relations.edge_lists(edges).select("node", F.array_join(F.slice("references", 1, 15), ",").alias("references"), F.array_join(F.slice("dependents", 1, 15), ",").alias("dependents"))


EDGE_LISTS_SQL = f"""WITH {_NATION_EDGES_SQL}, e AS (SELECT lpad(src::VARCHAR, 2, '0') AS src, lpad(dst::VARCHAR, 2, '0') AS dst FROM raw),
f AS (SELECT src AS node, list_sort(list_distinct(list(dst)))[1:15] AS l FROM e GROUP BY src), b AS (SELECT dst AS node, list_sort(list_distinct(list(src)))[1:15] AS l FROM e GROUP BY dst)
SELECT coalesce(f.node, b.node) AS node, coalesce(array_to_string(f.l, ','), '') AS "references", coalesce(array_to_string(b.l, ','), '') AS dependents FROM f FULL JOIN b ON f.node = b.node"""


def debounce_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("segment"), F.to_timestamp("ts").alias("ts"), (F.col("event_type") == "error").alias("force_full"))
    out = debounced_batch(events, "30 minutes")
    return out.select("segment", F.unix_micros("first").alias("first_us"), "events", "force_full")


DEBOUNCE_SESSIONS_SQL = """WITH marked AS (SELECT user_id, ts, event_type = 'error' AS full_, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id AS segment, epoch_us(min(ts)) AS first_us, count(*)::BIGINT AS events, bool_or(full_) AS force_full FROM runs GROUP BY user_id, run"""


def event_classify(spark, sf_dir):
    """Events as file changes: the type names the change, the page's path the file."""
    names = F.create_map(*(F.lit(x) for kv in {"signup": "created", "purchase": "changed", "error": "deleted", "view": "renamed", "click": "changed"}.items() for x in kv))
    ext = F.element_at(F.array(*map(F.lit, ["a.cs", "b.ts", "package.json", "notes.md", "src", "c.scss", "bin/x.cs", "dist/y.ts", "tsconfig.json", "w.csproj"])), (F.col("event_id") % 10 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select("event_id", F.element_at(names, F.col("event_type")).alias("change"), ext.alias("path"), F.lit(None).cast("string").alias("old_path"))
    return classified(events).select("event_id", "cs", "ts", "force_full")


EVENT_CLASSIFY_SQL = """WITH e AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'view' THEN 'renamed' ELSE 'changed' END AS change, event_id % 10 AS k FROM events)
SELECT event_id, k IN (0, 9) OR (k = 4 AND change <> 'changed') AS cs, k IN (1, 2, 5, 8) OR (k = 4 AND change <> 'changed') AS ts, k IN (2, 8) AS force_full FROM e"""


def notes_recent(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat_ws("  ", "event_type", (F.col("user_id") % 40).cast("string")).alias("note"))
    return relations.recent_notes(events)


NOTES_RECENT_SQL = """SELECT max(event_id) AS seq, event_type || ' ' || (user_id % 40) AS note FROM events GROUP BY 2 ORDER BY seq DESC LIMIT 50"""


def initials_match(spark, sf_dir):
    camel = F.regexp_replace(F.initcap("p_name"), " ", "")
    rows = table(spark, sf_dir, "part").select("p_partkey", camel.alias("name"), initials(camel).alias("initials"))
    return rows.filter(subsequence(F.col("initials"), "RW")).select("p_partkey", "name", "initials")


INITIALS_MATCH_SQL = r"""WITH n AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])) AS ws FROM part),
i AS (SELECT p_partkey, array_to_string(ws, '') AS name, array_to_string(list_transform(ws, lambda w: w[1]), '') AS initials FROM n)
SELECT * FROM i WHERE regexp_matches(initials, '(?i)^.*R.*W')"""


def clip_lines(spark, sf_dir):
    hits = text.line_hits(documents(spark, sf_dir), lambda c: c.contains("and"), "and")
    return hits.select("doc_id", "line_no", clipped(F.col("line"), 60, "and").alias("clipped"), estimated_tokens(F.col("line")).alias("tokens"))


CLIP_LINES_SQL = f"""WITH {_LINES_SQL}, h AS (SELECT doc_id, line_no, line, length(line) AS size, strpos(line, 'and') AS pos FROM kept WHERE contains(line, 'and')),
s AS (SELECT *, least(size, greatest(0, pos - 31) + 60) AS e FROM h), b AS (SELECT *, greatest(0, e - 60) AS st FROM s)
SELECT doc_id, line_no::INTEGER AS line_no, CASE WHEN size <= 60 THEN line ELSE CASE WHEN st > 0 THEN '… ' ELSE '' END || substr(line, st + 1, 60) || CASE WHEN e < size THEN ' …' ELSE '' END END AS clipped,
  ceil(size / 4.0)::BIGINT AS tokens FROM b"""


def path_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"))
    return first_of(pages, [F.col("host")], ["page_id"]).select("page_id", "host", base_name(F.col("url")).alias("base"), folder_key(F.col("url")).alias("key"))


PATH_DEDUP_SQL = """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM p)
SELECT page_id, host, string_split(url, '/')[-1] AS base, upper(sha1(lower(url)))[1:12] AS key FROM r WHERE n = 1"""


def text_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return relations.first_wins(docs, F.col("digest"), "doc_id")


TEXT_DEDUP_SQL = """WITH r AS (SELECT doc_id, source, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source, digest FROM r WHERE n = 1"""

_PATHS = ["a/Form.Designer.cs", "b/Reference.cs", "c/T.g.cs", "x/Store.cs", "tests/Store.cs", "x/StoreTests.cs", "x/latest/Store.cs", "x/AssemblyInfo.cs", "x/temporarygeneratedfile_1.cs", "Test/y.cs"]
_PROJECTS = ["Core", "Core.Tests", "Acme.Test", "Contest", "Acme.Testing"]


def file_facets(spark, sf_dir):
    """Generated and test files, by rules on names; paths and projects are made from event ids."""
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick(_PATHS, F.col("event_id")).alias("path"), pick(_PROJECTS, F.col("user_id")).alias("project"))
    name = base_name(F.col("path"))
    return rows.select("event_id", is_generated(name).alias("generated"), is_test(F.col("project"), name, F.col("path")).alias("test"))


FILE_FACETS_SQL = f"""WITH e AS (SELECT event_id, {_PATHS!r}[event_id % 10 + 1] AS path, {_PROJECTS!r}[user_id % 5 + 1] AS project FROM events),
n AS (SELECT *, lower(string_split(path, '/')[-1]) AS name, list_transform(string_split(path, '/')[:-2], lambda p: lower(p)) AS folders, string_split(project, '.')[-1] AS tail FROM e)
SELECT event_id, name LIKE '%.designer.cs' OR name LIKE '%.g.cs' OR name LIKE '%.g.i.cs' OR name LIKE '%.generated.cs' OR name IN ('reference.cs', 'assemblyinfo.cs')
  OR name LIKE 'temporarygeneratedfile\\_%.cs' ESCAPE '\\' OR name LIKE '%.assemblyattributes.cs' AS generated,
  tail LIKE '%Tests' OR tail = 'Test' OR name LIKE '%tests.cs' OR list_has_any(folders, ['test', 'tests']) AS test FROM n"""


def age_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", age(F.floor("o_totalprice")).alias("age"))


AGE_FORMAT_SQL = """WITH s AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 90 THEN s || 's' WHEN s // 60 < 90 THEN (s // 60) || 'm' WHEN s // 3600 < 48 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM s"""


def scope_resolution(spark, sf_dir):
    """Parts as types in namespaces of their brand and type; a name is in scope of a customer's
    segment when its namespace is one of those around a.b of the segment and key."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", "p_type", F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))).alias("namespace"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), ancestors(F.concat_ws(".", "p_type", F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")), F.lit("x"))).alias("scope"))
    held = parts.groupBy("namespace").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))  # so that a file meets namespaces, not parts
    met = files.select("file", F.explode("scope").alias("namespace")).join(held, "namespace")
    return met.groupBy("file").agg(F.sum("n").alias("in_scope"), F.min("first").alias("first"))


SCOPE_RESOLUTION_SQL = """WITH p AS (SELECT p_partkey, p_type || '.s' || (p_size % 3) AS namespace FROM part),
f AS (SELECT p_partkey AS file, p_type || '.s' || (p_partkey % 3) || '.x' AS own FROM part),
n AS (SELECT namespace, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY namespace)
SELECT file, sum(n)::BIGINT AS in_scope, min(first) AS first FROM f JOIN n ON own = namespace OR starts_with(own, namespace || '.') GROUP BY file"""


def base_type_names(spark, sf_dir):
    """Simple names of bases made from part names: namespace and type arguments go."""
    base = F.concat(F.lit("Acme."), F.initcap(F.element_at(F.split("p_name", " "), 1)), F.lit("<"), F.col("p_type"), F.lit(", A.B>"))
    return table(spark, sf_dir, "part").groupBy(simple_base_name(base).alias("base")).agg(F.count("*").alias("derived"))


BASE_TYPE_NAMES_SQL = """SELECT upper(w[1]) || lower(w[2:]) AS base, count(*)::BIGINT AS derived FROM (SELECT string_split(p_name, ' ')[1] AS w FROM part) GROUP BY 1"""


def name_disambiguation(spark, sf_dir):
    """Folders of pages as TypeScript projects, each with a package file that has no name."""
    folders = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://(.*)/[^/]*$", 1).alias("dir")).distinct()
    files = tree.tree(folders.select(F.concat("dir", F.lit("/package.json")).alias("path"), F.lit(None).cast("timestamp").alias("mtime"), F.lit("{}").alias("content")))
    return tree.ts_projects(files).select("dir", "name")


NAME_DISAMBIGUATION_SQL = """WITH f AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://(.*)/[^/]*$', 1) AS dir FROM pages), n AS (SELECT dir, string_split(dir, '/')[-1] AS name FROM f)
SELECT dir, CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN name || ' [' || dir || ']' ELSE name END AS name FROM n"""


def symbol_json(spark, sf_dir):
    """Symbols as compact JSON."""
    return symbols(spark, sf_dir).select(F.to_json(F.struct("name", "kind", "project", F.col("start_line").alias("startLine"))).alias("json"))


SYMBOL_JSON_SQL = f"""{SYMBOLS_SQL} SELECT to_json({{'name': name, 'kind': kind, 'project': project, 'startLine': start_line}})::VARCHAR AS json FROM symbols"""


def kind_filtered(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    found = rows.filter(kind_filter(F.col("kind"), "class")).unionByName(rows.filter(kind_filter(F.col("kind"), "property")))
    return found.groupBy("project", "kind").agg(F.count("*").alias("n"))


KIND_FILTERED_SQL = f"""{SYMBOLS_SQL} SELECT project, kind, count(*)::BIGINT AS n FROM symbols WHERE kind IN ('Class', 'Property') GROUP BY ALL"""

_UNIFORM = "1.0 / (SELECT count(*) FROM nation)"
QUERIES = {
    f.__name__: f
    for f in (
        symbol_search, symbol_search_budget, text_search_faceted, reference_scan, grouped_caps, did_you_mean, range_enclosing, kind_distribution, top_groups, delta_snapshot, copy_forward,
        segment_union, unused_and_missing, partial_merge, idf_terms, edge_weights, pagerank_nations, pagerank_focus, definition_scores, transitive_closure, call_tree_bounded, edge_lists,
        debounce_sessions, event_classify, notes_recent, initials_match, clip_lines, path_dedup, text_dedup, file_facets, age_format, scope_resolution, base_type_names, name_disambiguation,
        symbol_json, kind_filtered,
    )
}
ORACLE_SQL = {
    "symbol_search": SYMBOL_SEARCH_SQL, "symbol_search_budget": SYMBOL_SEARCH_BUDGET_SQL, "text_search_faceted": TEXT_SEARCH_SQL, "reference_scan": REFERENCE_SCAN_SQL,
    "grouped_caps": GROUPED_CAPS_SQL, "did_you_mean": DID_YOU_MEAN_SQL, "range_enclosing": RANGE_ENCLOSING_SQL, "kind_distribution": KIND_DISTRIBUTION_SQL, "top_groups": TOP_GROUPS_SQL,
    "delta_snapshot": DELTA_SNAPSHOT_SQL, "copy_forward": COPY_FORWARD_SQL, "segment_union": SEGMENT_UNION_SQL, "unused_and_missing": UNUSED_AND_MISSING_SQL, "partial_merge": PARTIAL_MERGE_SQL,
    "idf_terms": IDF_TERMS_SQL, "edge_weights": EDGE_WEIGHTS_SQL, "pagerank_nations": _ranks_sql(0.85, _UNIFORM, "weight"),
    "pagerank_focus": _ranks_sql(0.5, "CASE WHEN n_nationkey IN (3, 7) THEN 0.5 ELSE 0.0 END", "CASE WHEN dst IN (3, 7) THEN 4 * weight ELSE weight END"),
    "definition_scores": DEFINITION_SCORES_SQL, "transitive_closure": TRANSITIVE_CLOSURE_SQL, "call_tree_bounded": CALL_TREE_BOUNDED_SQL, "edge_lists": EDGE_LISTS_SQL,
    "debounce_sessions": DEBOUNCE_SESSIONS_SQL, "event_classify": EVENT_CLASSIFY_SQL, "notes_recent": NOTES_RECENT_SQL, "initials_match": INITIALS_MATCH_SQL, "clip_lines": CLIP_LINES_SQL,
    "path_dedup": PATH_DEDUP_SQL, "text_dedup": TEXT_DEDUP_SQL, "file_facets": FILE_FACETS_SQL, "age_format": AGE_FORMAT_SQL, "scope_resolution": SCOPE_RESOLUTION_SQL,
    "base_type_names": BASE_TYPE_NAMES_SQL, "name_disambiguation": NAME_DISAMBIGUATION_SQL, "symbol_json": SYMBOL_JSON_SQL, "kind_filtered": KIND_FILTERED_SQL,
}
