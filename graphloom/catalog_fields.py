"""Registered queries of node predicates, plan trees, the boolean language's fields and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as X
from .operators import relations as R
from .plans import ir
from .plans.boolean import run_boolean
from .plans.text import run_plan
from .registry import graph_query


@graph_query("SELECT id FROM nodes WHERE kind = 'function' AND address_taken")
def address_taken(g):
    return run_plan(g, "kind:function address_taken:true")


@graph_query("SELECT id FROM nodes WHERE kind = 'function' AND NOT callsite_promiscuous AND name LIKE 'order%'")
def callsite_promiscuous(g):
    return run_plan(g, "kind:function callsite_promiscuous:false name:order*")


@graph_query("SELECT id, address_taken, callsite_promiscuous FROM nodes WHERE address_taken OR callsite_promiscuous")
def flagged_sets(g):
    return g.nodes.filter("address_taken or callsite_promiscuous").select("id", "address_taken", "callsite_promiscuous")


@graph_query("SELECT id FROM nodes WHERE framework = 'flask'")
def framework_routes(g):
    return run_plan(g, "framework:flask")


@graph_query("SELECT id FROM nodes WHERE EXISTS (SELECT 1 FROM edges JOIN nodes s ON s.id = src WHERE edges.kind = 'contains' AND dst = nodes.id AND s.kind = 'class')")
def scope_kind(g):
    return run_plan(g, "scope:class")


@graph_query("SELECT id FROM nodes WHERE NOT is_definition")
def is_definition(g):
    return run_plan(g, "is_definition:false")


@graph_query("SELECT id, is_unsafe IS NOT NULL AS marked FROM nodes WHERE kind = 'method'")
def is_unsafe(g):
    """false asks for what is not recorded as unsafe."""
    m = g.nodes.filter("kind = 'method'")
    yes = m.join(run_plan(g, "kind:method is_unsafe:true"), "id", "left_semi").select("id", F.lit(True).alias("marked"))
    return yes.unionByName(m.join(run_plan(g, "kind:method is_unsafe:false"), "id", "left_semi").select("id", F.lit(False).alias("marked")))


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges JOIN nodes t ON t.id = dst WHERE edges.kind = 'type_of' AND context = 'return' AND t.name = (SELECT min(name) FROM nodes WHERE kind = 'class'))")
def returns_exact(g):
    name = g.nodes.filter("kind = 'class'").agg(F.min("name")).first()[0]
    return R.returning(g, g.nodes, name).select("id")


@graph_query("SELECT id, cfg IN ('unix', 'all(unix, feature_a)', 'all(feature_a,unix)') AS has_flag, cfg IN ('all(unix, feature_a)', 'all(feature_a,unix)') AS same_set, cfg = 'all(unix, feature_a)' AS same_bytes FROM nodes WHERE cfg IS NOT NULL")
def cfg_modes(g):
    c = F.col("cfg")
    return g.nodes.filter("cfg is not null").select("id", R.cfg_matches(c, "unix").alias("has_flag"), R.cfg_matches(c, "all(feature_a, unix)").alias("same_set"), R.cfg_matches(c, '"all(unix, feature_a)"').alias("same_bytes"))


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges WHERE kind = 'wraps' AND context = 'errors')")
def wraps_kind(g):
    return run_plan(g, "wraps:errors")


@graph_query("SELECT id FROM nodes WHERE kind = 'method' AND regexp_matches(name, '(?i)CUSTOMER#0+1')")
def name_regex_flags(g):
    return run_plan(g, "kind:method name~=/CUSTOMER#0+1/i")


@graph_query("SELECT id FROM (SELECT id FROM (SELECT dst AS id FROM edges WHERE kind = 'calls' AND src IN (SELECT id FROM nodes WHERE kind = 'method' AND visibility = 'private') UNION SELECT id FROM nodes WHERE kind = 'struct' AND name LIKE 'blue%') a EXCEPT SELECT id FROM nodes WHERE is_async) b ORDER BY id LIMIT 10000")
def chain_setop(g):
    p = ir.scan("method").filter("visibility", "private").traverse("forward", "calls", 1).union(ir.scan("struct").filter("name", "blue*")).difference(ir.scan().filter("async", "true"))
    return ir.run(g, p, 20_000)


@graph_query("SELECT id FROM nodes WHERE kind = 'function' ORDER BY id LIMIT 1000")
def plan_default_limit(g):
    return ir.run(g, ir.scan("function"))


@graph_query("SELECT 0 AS plan, id FROM nodes WHERE kind = 'function' AND visibility = 'private' UNION ALL SELECT 1, id FROM nodes WHERE kind = 'function' AND visibility = 'private' AND address_taken UNION ALL SELECT 2, id FROM nodes WHERE kind = 'class'")
def batch_plans(g):
    base = ir.scan("function").filter("visibility", "private")
    a, b, c = ir.run_batch(g, [base, base.filter("address_taken", "true"), ir.scan("class")])
    tag = lambda k, d: d.select(F.lit(k).alias("plan"), "id")
    return tag(0, a).unionByName(tag(1, b)).unionByName(tag(2, c))


@graph_query("SELECT id FROM nodes WHERE string_split(path, '/')[1] = 'ASIA'")
def field_repo(g):
    return run_boolean(g, "repo:ASIA")


@graph_query("SELECT DISTINCT dst AS id FROM edges JOIN nodes p ON p.id = src WHERE edges.kind = 'contains' AND p.name = 'NATION_12'")
def field_parent(g):
    return run_boolean(g, "parent:NATION_12")


@graph_query("SELECT id FROM r WHERE top IN (SELECT id FROM nodes WHERE name = 'ASIA') AND id <> top", "r(id, top) AS (SELECT id, id FROM nodes WHERE name = 'ASIA' UNION SELECT dst, top FROM r JOIN edges ON src = id WHERE kind = 'contains')")
def field_scope_ancestor(g):
    return run_boolean(g, "scope.ancestor:ASIA")


@graph_query("SELECT DISTINCT id FROM nodes JOIN edges ON dst = id AND edges.kind = 'contains' WHERE src IN (SELECT id FROM nodes WHERE kind = 'class') AND nodes.kind = 'method'")
def field_scope_type(g):
    return run_boolean(g, "scope.type:class AND kind:method")


@graph_query("SELECT id FROM nodes WHERE is_static OR (kind = 'function' AND start_line >= 100 AND end_line < 140)")
def field_static_numeric(g):
    return run_boolean(g, "static:true OR (kind:function AND start_line>=100 AND end_line<140)")


@graph_query("SELECT id FROM nodes WHERE body_hash IN (SELECT body_hash FROM nodes GROUP BY 1 HAVING count(*) > 1)")
def field_duplicates(g):
    return run_boolean(g, "duplicates:body")


@graph_query("SELECT id FROM nodes n WHERE kind = 'function' AND NOT EXISTS (SELECT 1 FROM edges WHERE dst = n.id AND kind IN ('calls','references','imports','inherits','implements','type_of'))")
def field_unused(g):
    return run_boolean(g, "kind:function AND unused:true")


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges WHERE kind = 'calls' AND dst IN (SELECT id FROM nodes WHERE kind = 'function' AND visibility = 'private' AND id IN (SELECT dst FROM edges WHERE kind = 'imports')))")
def nested_subquery(g):
    return run_boolean(g, "callees:(kind:function AND visibility:private AND imported:true)")


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges WHERE kind = 'calls' AND resolved_via = 'type_match') AND NOT address_taken")
def field_resolved_via(g):
    return run_boolean(g, "resolved_via:type_match AND NOT address_taken:true")


@graph_query("SELECT id FROM nodes WHERE kind = 'function' AND name = 'order_7'")
def variables_whole_names(g):
    """A variable's value is one value: it neither ends early nor brings in syntax."""
    return run_boolean(g, "kind:$k AND name:$kk AND lang:c", {"k": "function", "kk": "order_7"}).join(g.nodes.filter("name = 'order_7'"), "id", "left_semi")


@graph_query("SELECT id, CASE WHEN qualified_name = 'order_7' THEN 0 WHEN qualified_name LIKE '%::order_7' THEN 1 END AS tier FROM nodes WHERE qualified_name = 'order_7' OR qualified_name LIKE '%::order_7'")
def symbol_lookup(g):
    """Exact name first, else what ends with it at a separator."""
    q = F.col("qualified_name")
    return g.nodes.filter(R.segment_match(q, "order_7")).select("id", F.when(q == "order_7", 0).otherwise(1).alias("tier"))


@graph_query("SELECT id, kind, name, qualified_name, path, regexp_replace(path, '^ASIA/', '') AS relative_path, start_line, end_line, visibility, signature, is_async, is_static, lang, CASE WHEN name = '' THEN NULL ELSE coalesce(qualified_name, name) END AS display FROM nodes WHERE kind IN ('method','class')")
def match_projection(g):
    return g.nodes.filter("kind in ('method', 'class')").select("id", "kind", "name", "qualified_name", "path", X.relative_path(F.col("path"), "ASIA").alias("relative_path"), "start_line", "end_line", "visibility", "signature", "is_async", "is_static", "lang", F.when(F.col("name") != "", F.coalesce("qualified_name", "name")).alias("display"))


@graph_query("SELECT id, '[path]' AS path, regexp_replace(name, '[0-9]+', '[number]', 'g') AS name, md5(qualified_name) AS qualified_name FROM nodes WHERE kind = 'method'")
def redacted(g):
    return X.redact(g.nodes.filter("kind = 'method'").select("id", "path", "name", "qualified_name"), {"path": "hide", "name": "numbers", "qualified_name": "hash"})


@graph_query("SELECT id, round(1 - (row_number() OVER (ORDER BY fan DESC, id) - 1) / 50.0 * 0.5, 3) AS rank_score FROM (SELECT dst AS id, count(*) AS fan FROM edges WHERE kind = 'calls' GROUP BY 1 ORDER BY fan DESC, id LIMIT 50) x")
def rank_scores(g):
    """1 down to about 1/2 by place among the 50 most called."""
    from pyspark.sql import Window

    top = g.of("calls").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan")).orderBy(F.desc("fan"), "id").limit(50)
    place = F.row_number().over(Window.orderBy(F.desc("fan"), "id")) - 1  # 50 rows
    return top.select("id", F.round(1 - place / 50 * 0.5, 3).alias("rank_score"))


@graph_query("SELECT id, path, start_line, name, kind, row_number() OVER (ORDER BY kind, name, path, start_line, id) AS place FROM nodes WHERE kind IN ('class','module') ORDER BY place")
def sort_by_kind(g):
    from pyspark.sql import Window

    few = g.nodes.filter("kind in ('class', 'module')").select("id", "path", "start_line", "name", "kind")
    return few.withColumn("place", F.row_number().over(Window.orderBy(*X.sort_fields("kind")))).orderBy("place")


@graph_query("SELECT a.lang AS from_lang, b.lang AS to_lang, e.kind, count(*) AS n FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.lang <> b.lang GROUP BY 1, 2, 3")
def cross_language_edges(g):
    k = g.nodes.select("id", "lang")
    e = g.edges.join(k.select(F.col("id").alias("src"), F.col("lang").alias("from_lang")), "src").join(k.select(F.col("id").alias("dst"), F.col("lang").alias("to_lang")), "dst")
    return e.filter("from_lang <> to_lang").groupBy("from_lang", "to_lang", "kind").agg(F.count("*").alias("n"))
