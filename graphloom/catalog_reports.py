"""Registered queries of reports, search, links, exports, rules, streams and snapshots' upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _UC, _calls, _labels
from .functions import scalars as X
from .operators import analytics as A
from .operators import relations as R
from .operators import reports as P
from .operators import traversal as T
from .registry import graph_query, table_query

# ---- calls: chains, hierarchies, reach

_DAG = _UC + ", e AS MATERIALIZED (SELECT DISTINCT a.component AS src, b.component AS dst FROM c JOIN s a ON a.id = c.src JOIN s b ON b.id = c.dst WHERE a.component <> b.component), up(id, len) AS (SELECT component, 0 FROM s UNION SELECT src, len + 1 FROM up JOIN e ON dst = up.id WHERE len < 20), d AS (SELECT id, max(len) AS chain FROM up GROUP BY id)"


@graph_query("SELECT s.id, chain FROM s JOIN d ON d.id = s.component", _DAG)
def call_chain_depth(g):
    return P.chain_depths(g.nodes, _calls(g), _labels(g))


@graph_query("SELECT s.id, coalesce(n, 0) AS out_calls, chain, coalesce(n, 0) + chain AS score FROM s JOIN d ON d.id = s.component LEFT JOIN (SELECT src, count(*) AS n FROM c GROUP BY src) o ON src = s.id WHERE coalesce(n, 0) + chain > 0", _DAG)
def hotspots(g):
    return P.hotspots(g.nodes, _calls(g), _labels(g))


@graph_query("SELECT kind, count(*) AS nodes, coalesce(sum(o.n), 0) AS out_calls, coalesce(sum(i.n), 0) AS in_calls FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY src) o ON src = id LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY dst) i ON dst = id GROUP BY kind")
def complexity_aggregate(g):
    d = g.nodes.select("id", "kind").join(A.degrees(g, "calls"), "id", "left")
    return d.groupBy("kind").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("fan_out"), F.lit(0)).alias("out_calls"), F.coalesce(F.sum("fan_in"), F.lit(0)).alias("in_calls"))


_TREE = "r(id, level) AS (SELECT id, 0 FROM nodes WHERE id = 4000000007 UNION SELECT src, level + 1 FROM r JOIN edges ON dst = id WHERE kind = 'calls' AND level < 2), m AS (SELECT id, min(level) AS level FROM r GROUP BY id)"


@graph_query("SELECT DISTINCT a.level, b.id AS parent, a.id FROM m a JOIN edges ON src = a.id AND kind = 'calls' JOIN m b ON b.id = dst AND b.level = a.level - 1 UNION ALL SELECT 0, NULL, 4000000007", _TREE)
def call_hierarchy(g):
    back = g.of("calls").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return P.hierarchy(g.nodes.filter("id = 4000000007"), back, 2)


@graph_query("SELECT a.id AS a, b.id AS b, EXISTS (SELECT 1 FROM w WHERE w.a = a.id AND w.place = b.id) AS reaches FROM nodes a, nodes b WHERE a.id IN (3000000001, 3000000002, 6000000003) AND b.id BETWEEN 4000000000 AND 4000000010", "w(a, place) AS (SELECT id, id FROM nodes WHERE id IN (3000000001, 3000000002, 6000000003) UNION SELECT a, dst FROM w JOIN edges ON src = place WHERE kind = 'calls')")
def can_reach(g):
    a = g.nodes.filter("id in (3000000001, 3000000002, 6000000003)").select(F.col("id").alias("a"))
    return P.reach_pairs(a.join(g.nodes.filter("id between 4000000000 and 4000000010").select(F.col("id").alias("b"))), g.of("calls"))


@graph_query("SELECT id, depth, ancestor FROM a", "a(id, depth, ancestor) AS (SELECT dst, 1, src FROM edges WHERE kind = 'contains' UNION ALL SELECT id, depth + 1, src FROM a JOIN edges ON dst = ancestor WHERE kind = 'contains')")
def scope_ancestors(g):
    return P.ancestors(g.nodes, g.of("contains"))


_E = "(visibility IN ('public','pub') OR name = 'main' OR name LIKE 'test\\_%' ESCAPE '\\' OR name LIKE '%\\_test' ESCAPE '\\' OR kind IN ('export','test'))"
_CLOSE = f"r(id) AS (SELECT id FROM nodes WHERE {_E} UNION SELECT dst FROM r JOIN edges ON src = id WHERE kind IN ('calls','references','imports','inherits','implements','type_of'))"


@graph_query(f"SELECT id FROM nodes WHERE visibility = 'private' AND NOT {_E} AND id NOT IN (SELECT id FROM r)", _CLOSE)
def unused_private(g):
    reach = T.closure(g.nodes.filter(R.is_entry_point()), g.of(*R.USES))
    return g.nodes.filter((F.col("visibility") == "private") & ~R.is_entry_point()).join(reach, "id", "left_anti").select("id")


# ---- reports

_O = "SELECT 'summary' AS section, 'nodes' AS item, count(*) AS n FROM nodes UNION ALL SELECT 'summary', 'edges', count(*) FROM edges UNION ALL SELECT 'hubs', name, n FROM (SELECT name, count(*) AS n FROM edges JOIN nodes ON id = dst WHERE edges.kind IN ('calls','references') AND nodes.kind IN ('function','method','struct','class','trait') GROUP BY id, nodes.kind, name ORDER BY n DESC, nodes.kind, name, id LIMIT 3) h UNION ALL SELECT 'issues', 'duplicate_bodies', count(*) FROM (SELECT body_hash FROM nodes WHERE body_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1) d UNION ALL SELECT 'issues', 'uncalled', count(*) FROM nodes WHERE kind = 'function' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'calls')"


@graph_query(_O)
def overview(g):
    one = lambda s, i, d: d.agg(F.count("*").alias("n")).select(F.lit(s).alias("section"), F.lit(i).alias("item"), "n")
    hubs = A.hubs(g, n=3).select(F.lit("hubs").alias("section"), F.col("name").alias("item"), F.col("fan_in").alias("n"))
    twins = g.nodes.filter("body_hash is not null").groupBy("body_hash").count().filter("count > 1")
    idle = R.without_incoming(g.nodes.filter("kind = 'function'"), g.of("calls"))
    return one("summary", "nodes", g.nodes).unionByName(one("summary", "edges", g.edges)).unionByName(hubs).unionByName(one("issues", "duplicate_bodies", twins)).unionByName(one("issues", "uncalled", idle))


@graph_query("SELECT 'nodes' AS what, lang AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'files', lang, count(DISTINCT path) FROM nodes GROUP BY 2")
def graph_stats_split(g):
    by = lambda w, d, c, n: d.groupBy(F.col(c).alias("value")).agg(n.alias("n")).select(F.lit(w).alias("what"), "value", "n")
    return by("nodes", g.nodes, "lang", F.count("*")).unionByName(by("edges", g.edges, "kind", F.count("*"))).unionByName(by("files", g.nodes, "lang", F.countDistinct("path")))


# ---- similarity of shapes

_SK = "t AS (SELECT DISTINCT p_name AS name FROM part), sh AS MATERIALIZED (SELECT name, list_distinct(list_transform(range(1, greatest(length(name) - 2, 1) + 1), lambda i: substr(name, i, 3))) AS tri FROM t), ln AS MATERIALIZED (SELECT name, md5(name) AS hash, list_transform(range(0, 64), lambda k: list_min(list_transform(tri, lambda x: CAST('0x' || substr(md5(k || ':' || x), 1, 8) AS BIGINT)))) AS lanes FROM sh)"


def _shapes(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("id")).distinct()
    return names.select("id", F.md5("id").alias("hash"), P.sketch(X.trigrams(F.col("id"))).alias("lanes"))


@table_query(f"WITH {_SK} SELECT name AS id, list_sum(lanes) AS lanes_sum FROM ln")
def shape_sketches(spark, sf_dir):
    return _shapes(spark, sf_dir).select("id", F.aggregate("lanes", F.lit(0).cast("long"), lambda a, x: a + x).alias("lanes_sum"))


@table_query(f"WITH {_SK} SELECT a, b, jaccard FROM (SELECT x.name AS a, y.name AS b, len(list_filter(range(1, 65), lambda i: x.lanes[i] = y.lanes[i])) / 64.0 AS jaccard, len(list_filter(range(0, 16), lambda k: x.lanes[k * 4 + 1 : k * 4 + 4] = y.lanes[k * 4 + 1 : k * 4 + 4])) AS bands FROM ln x JOIN ln y ON x.name < y.name) p WHERE bands > 0 AND jaccard >= 0.25")
def minhash_lsh(spark, sf_dir):
    return P.lsh_pairs(_shapes(spark, sf_dir), floor=0.25)


@table_query(f"WITH {_SK} SELECT b.name AS id, b.hash = a.hash AS exact, len(list_filter(range(1, 65), lambda i: a.lanes[i] = b.lanes[i])) / 64.0 AS jaccard FROM ln a JOIN ln b ON a.name = (SELECT min(name) FROM t) WHERE len(list_filter(range(0, 16), lambda k: a.lanes[k * 4 + 1 : k * 4 + 4] = b.lanes[k * 4 + 1 : k * 4 + 4])) > 0 ORDER BY exact DESC, jaccard DESC, id LIMIT 25")
def structural_neighbours(spark, sf_dir):
    s = _shapes(spark, sf_dir)
    probe = s.orderBy("id").limit(1).select(F.col("hash").alias("h"), F.col("lanes").alias("p"))
    j = s.join(F.broadcast(probe))
    same = F.size(F.filter(F.zip_with("lanes", "p", lambda x, y: x == y), lambda e: e))
    share = [F.slice("lanes", k * 4 + 1, 4) == F.slice("p", k * 4 + 1, 4) for k in range(16)]
    any_ = share[0]
    for x in share[1:]:
        any_ = any_ | x
    return j.filter(any_).select("id", (F.col("hash") == F.col("h")).alias("exact"), (same / 64).alias("jaccard")).orderBy(F.desc("exact"), F.desc("jaccard"), "id").limit(25)


@graph_query("SELECT kind, id, score FROM (SELECT kind, id, round(1 - levenshtein(name, 'order_7') * 1.0 / greatest(length(name), 7), 6) AS score FROM nodes WHERE kind = 'function') x WHERE score >= 0.7 ORDER BY score DESC, id LIMIT 20")
def search_similar(g):
    n = g.nodes.filter("kind = 'function'").withColumn("score", F.round(X.levenshtein_similarity(F.col("name"), F.lit("order_7")), 6))
    return n.filter("score >= 0.7").select("kind", "id", "score").orderBy(F.desc("score"), "id").limit(20)


_FZ = "t AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, list_distinct(list_transform(range(1, greatest(length(name) - 2, 1) + 1), lambda i: substr(name, i, 3))) AS x, ['sma', 'mal', 'all', 'll ', 'l r', ' ri', 'rin', 'ing'] AS q FROM t)"


@table_query(f"WITH {_FZ} SELECT name, round(1 - levenshtein(name, 'small ring') * 1.0 / greatest(length(name), 10), 6) AS score FROM (SELECT name FROM c WHERE len(list_intersect(x, q)) * 1.0 / len(list_distinct(list_concat(x, q))) >= 0.1 ORDER BY len(list_intersect(x, q)) DESC, name LIMIT 1000) k WHERE 1 - levenshtein(name, 'small ring') * 1.0 / greatest(length(name), 10) >= 0.6")
def fuzzy_search(spark, sf_dir):
    """Candidates by shared trigrams first, the 1,000 with most; then the matcher on those alone."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct().withColumn("x", X.trigrams(F.col("name"))).withColumn("q", X.trigrams(F.lit("small ring")))
    few = names.filter(X.jaccard(F.col("x"), F.col("q")) >= 0.1).orderBy(F.desc(F.size(F.array_intersect("x", "q"))), "name").limit(1000)
    score = X.levenshtein_similarity(F.col("name"), F.lit("small ring"))
    return few.filter(score >= 0.6).select("name", F.round(score, 6).alias("score"))


# ---- links and resolution

@table_query("SELECT a.page_id AS request, min(b.page_id) AS endpoint FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+', '/', 'g'), '(.)/$', '\\1') AS path FROM pages) a JOIN (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+', '/', 'g'), '(.)/$', '\\1') AS path FROM pages) b ON a.path = b.path GROUP BY 1")
def http_links(spark, sf_dir):
    """Each request with the first endpoint of its normalised path."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.url_path(F.col("url")).alias("path"))
    return p.join(p.groupBy("path").agg(F.min("page_id").alias("endpoint")), "path").select(F.col("page_id").alias("request"), "endpoint")


@graph_query("SELECT d.id AS declaration, f.id AS target FROM nodes d JOIN nodes f ON 'Java_' || replace(d.name, '_', '_1') = 'Java_' || replace(f.name, '_', '_1') WHERE d.lang = 'java' AND f.lang IN ('c','cpp') AND d.id <> f.id UNION SELECT d.id, f.id FROM nodes d JOIN nodes f ON d.name = f.name WHERE d.lang = 'rust' AND f.lang IN ('c','cpp')")
def ffi_links(g):
    """Declarations of Java by their mangled name, of Rust by the bare one, with the C functions so named."""
    mangled = lambda c: F.concat(F.lit("Java_"), F.replace(c, F.lit("_"), F.lit("_1")))
    key = F.when(F.col("lang") == "java", mangled(F.col("name"))).otherwise(F.col("name"))
    d = g.nodes.filter("lang in ('java', 'rust')").select(F.col("id").alias("declaration"), key.alias("key"))
    c = g.nodes.filter("lang in ('c', 'cpp')")
    f = c.select(F.col("id").alias("target"), mangled(F.col("name")).alias("key")).unionByName(c.select(F.col("id").alias("target"), F.col("name").alias("key")))
    return d.join(f, "key").select("declaration", "target").distinct()


@graph_query("SELECT src, dst, 'type_match' AS outcome FROM sites JOIN able ON able.path = sites.path WHERE n <= 4 UNION ALL SELECT DISTINCT src, CAST(NULL AS BIGINT), 'promiscuous' FROM sites JOIN able ON able.path = sites.path WHERE n > 4", "sites AS (SELECT DISTINCT src, path FROM edges JOIN nodes ON id = src WHERE edges.kind = 'calls' AND resolved_via = 'binding_plane'), able AS (SELECT id AS dst, path, count(*) OVER (PARTITION BY path) AS n FROM nodes WHERE address_taken)")
def indirect_calls(g):
    return P.resolve_indirect(g.of("calls"), g.nodes.select("id", "path", "address_taken"))


# ---- search and navigation

@graph_query("SELECT id FROM nodes WHERE contains(name, 'ring') ORDER BY name, id LIMIT 100")
def pattern_search(g):
    return g.nodes.filter(F.col("name").contains("ring")).orderBy("name", "id").limit(100).select("id")


@graph_query("SELECT id, path, start_line FROM nodes WHERE kind = 'function' AND visibility = 'private' ORDER BY path, start_line, id LIMIT 20 OFFSET 0")
def semantic_search(g):
    from .plans.boolean import run_boolean

    hits = g.nodes.join(run_boolean(g, "kind:function AND visibility:private"), "id", "left_semi")
    return hits.select("id", "path", "start_line").orderBy("path", "start_line", "id").limit(20)


@graph_query("SELECT 'name' AS stage, id FROM nodes WHERE name = 'order_77' UNION ALL SELECT 'contains', id FROM nodes WHERE contains(name, 'order_77') AND (SELECT count(*) FROM nodes WHERE name = 'order_77') < 2")
def hybrid_search(g):
    """Exact names; where they are fewer than asked, names that contain the text too."""
    exact = g.nodes.filter("name = 'order_77'").select(F.lit("name").alias("stage"), "id")
    few = exact.agg((F.count("*") < 2).alias("few"))
    more = g.nodes.filter(F.col("name").contains("order_77")).join(F.broadcast(few)).filter("few").select(F.lit("contains").alias("stage"), "id")
    return exact.unionByName(more)


@graph_query("SELECT path, container, id, sum(tokens) OVER (PARTITION BY path ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT n.path, coalesce(c.name, '') AS container, n.id, n.start_line, CAST(greatest(1, ceil(ceil(strlen(n.qualified_name) / 4.0) * 6 / 5.0)) AS BIGINT) AS tokens FROM nodes n LEFT JOIN edges e ON e.dst = n.id AND e.kind = 'contains' LEFT JOIN nodes c ON c.id = e.src WHERE n.kind = 'method') x QUALIFY running <= 200")
def hierarchical_search(g):
    """Hits by file and container, each file cut off where its token budget is used up."""
    from pyspark.sql import Window

    up = g.of("contains").join(g.nodes.select(F.col("id").alias("src"), F.col("name").alias("container")), "src").select(F.col("dst").alias("id"), "container")
    hit = g.nodes.filter("kind = 'method'").join(up, "id", "left").withColumn("container", F.coalesce("container", F.lit(""))).withColumn("tokens", X.token_estimate(F.col("qualified_name")))
    w = Window.partitionBy("path").orderBy("start_line", "id").rowsBetween(Window.unboundedPreceding, 0)
    return hit.withColumn("running", F.sum("tokens").over(w)).filter("running <= 200").select("path", "container", "id", "running")


@graph_query("SELECT 'definition' AS what, id, path, start_line FROM nodes WHERE id = 4000000007 UNION ALL SELECT DISTINCT 'reference', n.id, n.path, n.start_line FROM edges JOIN nodes n ON n.id = src WHERE dst = 4000000007 AND edges.kind IN ('calls','references','imports')")
def definition_and_references(g):
    own = g.nodes.filter("id = 4000000007").select(F.lit("definition").alias("what"), "id", "path", "start_line")
    refs = R.with_outgoing(g.nodes, g.of("calls", "references", "imports").filter("dst = 4000000007"))
    return own.unionByName(refs.select(F.lit("reference").alias("what"), "id", "path", "start_line"))


@graph_query("SELECT 'out' AS side, kind, count(*) AS n, min(dst) AS example FROM edges WHERE src = 6000000011 GROUP BY kind UNION ALL SELECT 'in', kind, count(*), min(src) FROM edges WHERE dst = 6000000011 GROUP BY kind")
def explain_symbol(g):
    side = lambda s, mine, other: g.edges.filter(f"{mine} = 6000000011").groupBy("kind").agg(F.count("*").alias("n"), F.min(other).alias("example")).select(F.lit(s).alias("side"), "kind", "n", "example")
    return side("out", "src", "dst").unionByName(side("in", "dst", "src"))


@graph_query("SELECT path, count(*) AS symbols, min(start_line) AS first_line FROM nodes GROUP BY path")
def list_files(g):
    return g.nodes.groupBy("path").agg(F.count("*").alias("symbols"), F.min("start_line").alias("first_line"))


@graph_query("SELECT src, dst, kind, count(*) AS facts, min(seq) AS first_seq, max(seq) AS last_seq FROM edges WHERE kind IN ('calls','references') GROUP BY ALL")
def provenance(g):
    return g.of("calls", "references").groupBy("src", "dst", "kind").agg(F.count("*").alias("facts"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@table_query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(callers|callees|imports|exports|returns)[(:]|(impl|duplicates|unused|circular|kind|visibility|async|static):|scope\\.|@|::') THEN 'semantic' WHEN regexp_matches(text, 'TODO|FIXME|HACK|XXX|NOTE|BUG|^\\^|\\$$|\\\\[bwdsWDS]|//|^#|/\\*') THEN 'text' ELSE 'hybrid' END AS kind FROM conversations")
def classify_queries(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", X.query_kind(F.col("text")).alias("kind"))


@table_query("SELECT doc_id, line, round(greatest(0, 5 + CASE WHEN n > 1 THEN 2 * n ELSE 0 END - CASE WHEN regexp_matches(ltrim(lower(text)), '^(//|/\\*|#)') THEN 1 ELSE 0 END + (1000 - least(line, 1000)) / 1000.0 * 2), 6) AS score FROM (SELECT doc_id, text, line, len(regexp_extract_all(lower(text), 'license')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) a) x WHERE n > 0")
def rank_text_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    n = F.regexp_count(F.lower("text"), F.lit("license"))
    return d.filter(n > 0).select("doc_id", (F.col("pos") + 1).alias("line"), F.round(X.text_rank(F.lower("text"), n, F.col("pos") + 1, F.lit(""), F.lit(1)), 6).alias("score"))


# ---- exports

@graph_query("SELECT id, concat_ws(',', name, qualified_name, kind, path, start_line, end_line, coalesce(lang, '')) AS line FROM nodes WHERE kind IN ('class','module','method')")
def csv_export(g):
    cols = ["name", "qualified_name", "kind", "path", "start_line", "end_line", "lang"]
    return g.nodes.filter("kind in ('class', 'module', 'method')").select("id", P.csv_lines(g.nodes, cols).alias("line"))


@graph_query("SELECT src, dst, 'n' || src || '[\"' || a.name || '\"] -->|' || e.kind || '| n' || dst || '[\"' || b.name || '\"]' AS line FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE e.kind = 'exports'")
def diagram_mermaid(g):
    return P.diagram(g.of("exports"), g.nodes, "mermaid").withColumn("line", F.trim("line"))


@graph_query("SELECT src, dst, '\"' || a.name || '\" -> \"' || b.name || '\" [label=\"' || e.kind || '\"];' AS line FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE e.kind IN ('exports','wraps')")
def diagram_dot(g):
    return P.diagram(g.of("exports", "wraps"), g.nodes, "dot").withColumn("line", F.trim("line"))


@graph_query("SELECT 'graph_nodes{kind=\"' || kind || '\"} ' || count(*) AS line FROM nodes GROUP BY kind UNION ALL SELECT 'graph_edges{kind=\"' || kind || '\"} ' || count(*) FROM edges GROUP BY kind")
def openmetrics(g):
    line = lambda m, d: d.groupBy("kind").agg(F.count("*").alias("n")).select(F.format_string(f'{m}{{kind="%s"}} %d', "kind", "n").alias("line"))
    return line("graph_nodes", g.nodes).unionByName(line("graph_edges", g.edges))


@graph_query("SELECT id, 'b2Zmc2V0OjQw' AS next_cursor FROM nodes WHERE kind = 'function' ORDER BY path, name, id LIMIT 20 OFFSET 20")
def page_by_cursor(g):
    rows, token = X.page(g.nodes.filter("kind = 'function'").orderBy("path", "name", "id").select("id"), "b2Zmc2V0OjIw", 20)
    return rows.withColumn("next_cursor", F.lit(token))


# ---- rules

_PACK = """
schema = 2
[[rule]]
name = "private-callers"
node = "edge_traversal"
severity = "warning"
from = "kind:method visibility:private"
emit = "targets"
kinds = ["calls"]
[[rule]]
name = "twins"
node = "similar_to"
[[rule]]
name = "exports"
node = "relation_edges"
kinds = ["exports"]
[[rule]]
name = "flask-routes"
node = "scan"
plan = "framework:flask has:caller"
[[rule]]
name = "blue-references"
node = "references_at"
target = "kind:struct name:blue*"
"""


@graph_query("SELECT DISTINCT 'private-callers' AS rule, 'warning' AS severity, dst AS id, src AS witness FROM edges JOIN nodes n ON n.id = src WHERE edges.kind = 'calls' AND n.kind = 'method' AND visibility = 'private' UNION ALL SELECT 'twins', 'info', id, w FROM (SELECT id, min(id) OVER (PARTITION BY body_hash) AS w FROM nodes WHERE body_hash IS NOT NULL) t WHERE id <> w UNION ALL SELECT DISTINCT 'exports', 'info', src, dst FROM edges WHERE kind = 'exports' UNION ALL SELECT 'flask-routes', 'info', id, NULL FROM nodes WHERE framework = 'flask' AND id IN (SELECT dst FROM edges WHERE kind = 'calls') UNION ALL SELECT DISTINCT 'blue-references', 'info', src, dst FROM edges JOIN nodes t ON t.id = dst WHERE edges.kind = 'references' AND t.kind = 'struct' AND t.name LIKE 'blue%'")
def rule_run(g):
    return P.run_rules(g, P.load_rules(_PACK))


@graph_query("SELECT 'cycles' AS rule, 'error' AS severity, id, component AS witness FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM s) x WHERE n > 1", _UC)
def rule_cycles(g):
    return P.run_rule(g, P.Rule("cycles", "cycle_witness", "error"))


@graph_query("SELECT DISTINCT 'near' AS rule, 'info' AS severity, src AS id, dst AS witness FROM edges WHERE kind = 'contains' AND src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m)", "m AS (SELECT id FROM nodes WHERE kind = 'class' AND name = 'NATION_12' UNION SELECT dst FROM edges JOIN nodes n ON n.id = src WHERE edges.kind = 'contains' AND n.kind = 'class' AND n.name = 'NATION_12' UNION SELECT src FROM edges JOIN nodes n ON n.id = dst WHERE edges.kind = 'contains' AND n.kind = 'class' AND n.name = 'NATION_12')")
def rule_subgraph(g):
    return P.run_rule(g, P.Rule("near", "subgraph", args={"from": "kind:class name:NATION_12", "kinds": ["contains"]}))


# ---- upkeep and streams

@graph_query("SELECT id, name FROM nodes WHERE path <> 'ASIA/NATION_12' OR path IS NULL UNION ALL SELECT id + 500000, name || '_again' FROM nodes WHERE path = 'ASIA/NATION_12'")
def replace_file(g):
    """A file's nodes go and the new ones of the file come."""
    new = g.nodes.filter("path = 'ASIA/NATION_12'").select((F.col("id") + 500_000).alias("id"), F.concat("name", F.lit("_again")).alias("name"), "path")
    return A.replace_files(g.nodes.select("id", "name", "path"), new, "path").select("id", "name")


@table_query("SELECT count(*) AS operations, count(*) FILTER (l_returnflag = 'R') * 1.0 / count(*) > 0.2 AS by_tombstones, count(*) > 1000 AS by_operations FROM lineitem")
def compaction_triggers(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.when(F.col("l_returnflag") == "R", "remove").otherwise("add").alias("op"))
    return A.compaction(li, operations=1000, tombstones=0.2)


@table_query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY")
def prune_events(spark, sf_dir):
    from .streaming.merge import prune

    return prune(spark.read.parquet(f"{sf_dir}/events.parquet"), 30).select("event_id")


@table_query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_stream_counts(spark, sf_dir):
    from .streaming.merge import weekly_counts

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return weekly_counts(src.select(F.col("ts").cast("timestamp").alias("ts"), "event_type"))


@table_query("SELECT DISTINCT strftime(ts, '%G-W%V') AS week, strftime(date_trunc('week', ts), '%Y-%m-%d') AS first_day, strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS last_day FROM events")
def week_ranges(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), "ts"), F.extract(F.lit("WEEK"), "ts"))
    return e.select(week.alias("week")).distinct().select("week", *X.week_range(F.col("week")))


@graph_query("SELECT id, 'complete' AS status FROM nodes WHERE kind = 'class'")
def guarded_query(g):
    """A result under a row cap, with what became of it."""
    return A.guarded(g.nodes.filter("kind = 'class'").select("id").orderBy("id"), 10_000)


@graph_query("SELECT id, 'truncated' AS status FROM nodes WHERE kind = 'function' ORDER BY id LIMIT 100")
def guarded_query_truncated(g):
    return A.guarded(g.nodes.filter("kind = 'function'").select("id").orderBy("id"), 100)
