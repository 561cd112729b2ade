"""Queries over the call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.code import ENTRY_POINTS, is_test
from lodestar.operators import graph
from lodestar.plans.registry import query
from lodestar.sources import tables
from lodestar.sources.tables import table

EDGES = """
sup AS (SELECT s_suppkey, s_nationkey, 'nation/' || n_name AS s_file, 's' || s_suppkey AS s_fn FROM supplier JOIN nation ON s_nationkey = n_nationkey),
lines AS (SELECT 'seg/' || c_mktsegment AS c_file, 'c' || c_custkey AS c_fn, 'brand/' || p_brand AS p_file, 'p' || p_partkey AS p_fn, s_file, s_fn, c_nationkey = s_nationkey AS home, l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN sup ON l_suppkey = s_suppkey),
call_edge AS (SELECT c_file AS src_file, c_fn AS src_func, p_file AS dst_file, p_fn AS dst_func FROM lines UNION SELECT p_file, p_fn, s_file, s_fn FROM lines UNION SELECT s_file, s_fn, c_file, c_fn FROM lines WHERE home
  UNION SELECT 'label/quality', 'q' || quality, 'doc/' || source, 'd' || doc_id FROM labels JOIN documents USING (doc_id)),
back_edge AS (SELECT DISTINCT s_file AS src_file, s_fn AS src_func, p_file AS dst_file, p_fn AS dst_func FROM lines WHERE l_returnflag = 'R'),
fn AS (SELECT 'seg/' || c_mktsegment AS file, 'c' || c_custkey AS name FROM customer UNION ALL SELECT 'brand/' || p_brand, 'p' || p_partkey FROM part UNION ALL SELECT s_file, s_fn FROM sup UNION ALL SELECT 'doc/' || source, 'd' || doc_id FROM documents)
"""
WITH = "WITH RECURSIVE" + EDGES
REACH = """, reach AS (SELECT s_file AS file, s_fn AS func, 0 AS depth FROM sup WHERE s_suppkey = 1
  UNION SELECT src_file, src_func, depth + 1 FROM reach JOIN call_edge ON dst_file = file AND dst_func = func WHERE depth < 3),
nearest AS (SELECT file, func, min(depth) AS depth FROM reach GROUP BY ALL) """
ENTRY = "(" + " OR ".join(f"contains(name, '{p}') OR contains(file, '{p}')" for p in ENTRY_POINTS) + " OR regexp_matches(name, '^__.*__$'))"
DEAD = f""", dead AS (SELECT file, name FROM fn WHERE NOT {ENTRY} AND NOT EXISTS (SELECT 1 FROM call_edge WHERE dst_file = file AND dst_func = name) AND NOT EXISTS (SELECT 1 FROM call_edge WHERE src_file = file AND src_func = name)) """


def supplier_one(spark, d):
    return tables.functions(spark, d).where("name = 's1'").select("file", F.col("name").alias("func"))


@query(WITH + REACH + "SELECT file, func, depth FROM nearest")
def impact_reach(spark, d):
    return graph.reach(tables.call_edges(spark, d), supplier_one(spark, d), 3)


@query(WITH + REACH + "SELECT depth, count(*) AS n_functions FROM nearest GROUP BY depth")
def impact_depths(spark, d):
    return impact_reach(spark, d).groupBy("depth").agg(F.count("*").alias("n_functions"))


@query(WITH + """, one AS (SELECT DISTINCT src_file || ':' || src_func AS caller, dst_file || ':' || dst_func AS callee FROM call_edge),
tree AS (SELECT callee AS func, [callee] AS p, 0 AS depth, false AS again FROM (SELECT DISTINCT callee FROM one) WHERE callee LIKE '%:s1'
  UNION ALL SELECT caller, list_append(p, caller), depth + 1, list_contains(p, caller) FROM tree JOIN one ON callee = func WHERE NOT again AND depth < 3)
SELECT array_to_string(p, '>') AS path, func, depth, coalesce(n, 0) AS caller_count, again OR depth = 3 AS truncated FROM tree LEFT JOIN (SELECT callee, count(*) AS n FROM one GROUP BY callee) ON callee = func""")
def impact_tree(spark, d):
    return graph.impact_tree(tables.call_edges(spark, d), "s1", 3)


@query(WITH + "SELECT DISTINCT src_file, src_func FROM call_edge WHERE dst_func = 's1'")
def direct_callers(spark, d):
    return graph.direct_callers(tables.call_edges(spark, d), "s1")


@query(WITH + "SELECT dst_file, dst_func, count(*) AS n_callers, string_agg(src_file || ':' || src_func, ',' ORDER BY src_file || ':' || src_func) AS callers FROM call_edge GROUP BY ALL")
def reverse_index(spark, d):
    return graph.reverse_index(tables.call_edges(spark, d))


CONTEXT = """, names AS (SELECT DISTINCT src_func, dst_func FROM call_edge), ctx AS (SELECT 'c1' AS name, 0 AS depth UNION SELECT dst_func, depth + 1 FROM ctx JOIN names ON src_func = name WHERE depth < 2),
found AS (SELECT name, min(depth) AS depth FROM ctx GROUP BY name) """


@query(WITH + CONTEXT + "SELECT name, depth FROM found")
def context_bfs(spark, d):
    return graph.context(tables.call_edges(spark, d), "c1", 2)


@query(WITH + CONTEXT + """, calls AS (SELECT src_func, list(dst_func ORDER BY dst_func) AS c FROM names GROUP BY src_func)
SELECT name, depth, repeat('  ', least(depth, row_number() OVER (ORDER BY depth, name) - 1)::int) || name || coalesce(' -> ' || array_to_string(c[1:5], ', ') || CASE WHEN len(c) > 5 THEN ' (+' || (len(c) - 5) || ' more)' ELSE '' END, '') AS text FROM found LEFT JOIN calls ON src_func = name""")
def context_render(spark, d):
    edges = tables.call_edges(spark, d)
    return graph.render(graph.context(edges, "c1", 2), edges)


@query(WITH + "SELECT file, string_agg(name, ',' ORDER BY name) AS exports, count(*) AS n_exports FROM fn GROUP BY file")
def module_exports(spark, d):
    return tables.functions(spark, d).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("exports"), F.count("*").alias("n_exports"))


@query(WITH + DEAD + "SELECT file, name FROM dead")
def dead_code(spark, d):
    return graph.dead_code(tables.functions(spark, d), tables.call_edges(spark, d))


@query(WITH + DEAD + """SELECT f.file, coalesce(dead, 0) AS dead, total, round(coalesce(dead, 0) / greatest(total, 1) * 100, 1) AS percent
FROM (SELECT file, count(*) AS total FROM fn GROUP BY file) f LEFT JOIN (SELECT file, count(*) AS dead FROM dead GROUP BY file) x ON x.file = f.file""")
def dead_summary(spark, d):
    return graph.dead_summary(tables.functions(spark, d), tables.call_edges(spark, d))


LAYERS = """, ends AS (SELECT src_file AS file, src_func AS func, 1 AS o, 0 AS i FROM call_edge UNION ALL SELECT dst_file, dst_func, 0, 1 FROM call_edge),
deg AS (SELECT file, func, sum(o)::bigint AS calls_out, sum(i)::bigint AS calls_in FROM ends GROUP BY ALL) """


@query(WITH + LAYERS + "SELECT *, CASE WHEN calls_in = 0 THEN 'entry' WHEN calls_out = 0 THEN 'leaf' ELSE 'middle' END AS layer FROM deg")
def arch_layers(spark, d):
    return graph.layers(tables.call_edges(spark, d))


@query(WITH + """, crossing AS (SELECT split_part(src_file, '/', 1) AS a, split_part(dst_file, '/', 1) AS b FROM call_edge),
u AS (SELECT a AS directory, 1 AS o, 0 AS i, 0 AS f FROM crossing WHERE a <> b UNION ALL SELECT b, 0, 1, 0 FROM crossing WHERE a <> b UNION ALL SELECT split_part(file, '/', 1), 0, 0, 1 FROM fn),
s AS (SELECT directory, sum(o)::bigint AS calls_out, sum(i)::bigint AS calls_in, sum(f)::bigint AS function_count FROM u GROUP BY directory)
SELECT *, CASE WHEN calls_out / greatest(calls_in, 1) > 2 THEN 'HIGH' WHEN calls_out / greatest(calls_in, 1) < 0.5 THEN 'LOW' ELSE 'MIDDLE' END AS layer FROM s""")
def arch_directories(spark, d):
    return graph.directories(tables.call_edges(spark, d), tables.functions(spark, d))


@query(WITH + """, e AS (SELECT src_file, dst_file FROM call_edge UNION SELECT src_file, dst_file FROM back_edge)
SELECT DISTINCT x.src_file AS file_a, x.dst_file AS file_b FROM e x JOIN e y ON x.src_file = y.dst_file AND x.dst_file = y.src_file WHERE x.src_file < x.dst_file""")
def circular_deps(spark, d):
    return graph.circular(tables.call_edges(spark, d).unionByName(tables.back_edges(spark, d)))


@query(WITH + "SELECT * FROM call_edge WHERE starts_with(src_file, 'brand/Brand#1') OR starts_with(dst_file, 'brand/Brand#1')")
def calls_subtree(spark, d):
    return tables.call_edges(spark, d).where(F.col("src_file").startswith("brand/Brand#1") | F.col("dst_file").startswith("brand/Brand#1"))


@query(WITH + "SELECT * FROM call_edge WHERE src_file = 'nation/NATION_6'")
def edges_for_file(spark, d):
    return tables.call_edges(spark, d).where("src_file = 'nation/NATION_6'")


@query(WITH + "SELECT * FROM call_edge UNION SELECT * FROM back_edge")
def warm_union(spark, d):
    return tables.call_edges(spark, d).unionByName(tables.back_edges(spark, d)).distinct()


@query(WITH + """, calls AS (SELECT src_func AS name, list(DISTINCT dst_func ORDER BY dst_func)[1:5] AS c FROM call_edge GROUP BY src_func), callers AS (SELECT dst_func AS name, list(DISTINCT src_func ORDER BY src_func)[1:5] AS c FROM call_edge GROUP BY dst_func)
SELECT file, fn.name, coalesce(array_to_string(calls.c, ','), '') AS calls, coalesce(array_to_string(callers.c, ','), '') AS called_by FROM fn LEFT JOIN calls ON calls.name = fn.name LEFT JOIN callers ON callers.name = fn.name""")
def unit_neighbours(spark, d):
    edges = tables.call_edges(spark, d)
    five = lambda a, b, n: edges.groupBy(F.col(a).alias("name")).agg(F.array_join(F.slice(F.array_sort(F.collect_set(b)), 1, 5), ",").alias(n))
    both = tables.functions(spark, d).join(five("src_func", "dst_func", "calls"), "name", "left").join(five("dst_func", "src_func", "called_by"), "name", "left")
    return both.select("file", "name", F.coalesce("calls", F.lit("")).alias("calls"), F.coalesce("called_by", F.lit("")).alias("called_by"))


SITES = """, site AS (SELECT 'f' || (o_custkey % 97) AS file, 'c' || o_custkey AS caller, 'l' || (o_orderkey % 41) AS target FROM orders),
binding AS (SELECT DISTINCT 'f' || (l_suppkey % 97) AS file, 'l' || (l_orderkey % 41) AS local_name, 'm' || (l_partkey % 7) || '.n' || (l_partkey % 13) AS module, 'p' || (l_partkey % 29) AS orig_name FROM lineitem),
idx AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'm' || (p_partkey % 7) || '.n' || (p_partkey % 13) ELSE 'x' || (p_partkey % 11) END AS module, CASE WHEN p_size % 3 = 0 THEN 'n' || (p_partkey % 13) ELSE 'z' || (p_partkey % 5) END AS simple_module, 'p' || (p_partkey % 29) AS name, 'src/' || p_brand || '/' || (p_partkey % 19) || '.py' AS file FROM part)"""


def sites(spark, d):
    part = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    own = table(spark, d, "orders").select(part("f", "o_custkey", 97).alias("file"), F.concat(F.lit("c"), "o_custkey").alias("caller"), part("l", "o_orderkey", 41).alias("target"))
    dotted = F.concat(part("m", "l_partkey", 7), F.lit("."), part("n", "l_partkey", 13))
    bindings = table(spark, d, "lineitem").select(part("f", "l_suppkey", 97).alias("file"), part("l", "l_orderkey", 41).alias("local_name"), dotted.alias("module"), part("p", "l_partkey", 29).alias("orig_name"))
    module = F.when(F.col("p_size") % 2 == 0, F.concat(part("m", "p_partkey", 7), F.lit("."), part("n", "p_partkey", 13))).otherwise(part("x", "p_partkey", 11))
    simple = F.when(F.col("p_size") % 3 == 0, part("n", "p_partkey", 13)).otherwise(part("z", "p_partkey", 5))
    index = table(spark, d, "part").select(module.alias("module"), simple.alias("simple_module"), part("p", "p_partkey", 29).alias("name"), F.concat(F.lit("src/"), "p_brand", F.lit("/"), (F.col("p_partkey") % 19).cast("string"), F.lit(".py")).alias("file"))
    return own, bindings, index


@query("WITH" + SITES[1:] + """, short AS (SELECT simple_module, name, min(file) AS f FROM idx GROUP BY ALL), long AS (SELECT module, name, min(file) AS f FROM idx GROUP BY ALL)
SELECT DISTINCT s.file AS src_file, caller AS src_func, coalesce(short.f, long.f) AS dst_file, orig_name AS dst_func FROM site s JOIN binding b ON s.file = b.file AND target = local_name
LEFT JOIN short ON short.simple_module = split_part(b.module, '.', 2) AND short.name = orig_name LEFT JOIN long ON long.module = b.module AND long.name = orig_name WHERE coalesce(short.f, long.f) IS NOT NULL""")
def resolve_calls(spark, d):
    own, bindings, index = sites(spark, d)
    return graph.resolve_calls(own, bindings, index)


@query("WITH" + SITES[1:] + """, want AS (SELECT DISTINCT file, caller, 'p' || (o % 29) AS target, 'Brand#' || (1 + o % 5) AS package FROM (SELECT 'f' || (o_custkey % 97) AS file, 'c' || o_custkey AS caller, o_orderkey AS o FROM orders))
SELECT DISTINCT w.file AS src_file, caller AS src_func, target AS dst_func, dst_file FROM (SELECT w.file, caller, target, package, min(i.file) AS dst_file FROM want w JOIN idx i ON i.name = target AND contains(i.file, package) GROUP BY ALL) w""")
def resolve_theta_first(spark, d):
    _, _, index = sites(spark, d)
    o = F.col("o_orderkey")
    want = table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 97).cast("string")).alias("file"), F.concat(F.lit("c"), "o_custkey").alias("caller"), F.concat(F.lit("p"), (o % 29).cast("string")).alias("target"), F.concat(F.lit("Brand#"), (1 + o % 5).cast("string")).alias("package"))
    return graph.resolve_first(want, index)


@query(WITH + """, gone AS (SELECT DISTINCT src_file FROM back_edge WHERE src_file < 'nation/NATION_2')
SELECT * FROM call_edge WHERE src_file NOT IN (SELECT src_file FROM gone) UNION SELECT b.* FROM back_edge b JOIN gone g ON g.src_file = b.src_file""")
def patch_edges(spark, d):
    fresh = tables.back_edges(spark, d)
    changed = fresh.where("src_file < 'nation/NATION_2'").select(F.col("src_file").alias("file")).distinct()
    return graph.patch(tables.call_edges(spark, d), changed, fresh)


@query(WITH + """, t AS (SELECT CASE WHEN starts_with(src_file, 'seg/') THEN 'tests/' || src_func || '.py' ELSE src_file END AS src_file, src_func, CASE WHEN starts_with(dst_file, 'seg/') THEN 'tests/' || dst_func || '.py' ELSE dst_file END AS dst_file, dst_func FROM call_edge),
hit AS (SELECT file, func, 0 AS depth FROM (SELECT src_file AS file, src_func AS func FROM t UNION SELECT dst_file, dst_func FROM t) WHERE file = 'nation/NATION_6'
  UNION SELECT src_file, src_func, depth + 1 FROM hit JOIN t ON dst_file = file AND dst_func = func WHERE depth < 2)
SELECT file, func, min(depth) AS depth FROM hit WHERE starts_with(file, 'tests/') GROUP BY ALL""")
def change_impact(spark, d):
    tested = lambda f, n: F.when(F.col(f).startswith("seg/"), F.concat(F.lit("tests/"), n, F.lit(".py"))).otherwise(F.col(f)).alias(f)
    edges = tables.call_edges(spark, d).select(tested("src_file", "src_func"), "src_func", tested("dst_file", "dst_func"), "dst_func")
    return graph.change_impact(edges, spark.createDataFrame([("nation/NATION_6",)], "file string"), is_test(F.col("file")), depth=2)
