"""Queries over flow inside functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import flow
from lodestar.plans.registry import query
from lodestar.sources import tables

EVENTS = """
ev AS (SELECT user_id AS fn_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, (props::json->>'$.k')::int AS k,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'definition' WHEN event_type = 'error' THEN 'update' ELSE 'use' END AS ref_type FROM events),
ref AS (SELECT fn_id, line, 'v' || k AS name, ref_type, k % 10 AS block FROM ev),
cfg AS (SELECT DISTINCT fn_id, src, dst FROM (SELECT fn_id, block AS src, lead(block) OVER (PARTITION BY fn_id ORDER BY line) AS dst FROM ref) WHERE dst IS NOT NULL),
seen AS (SELECT *, max(CASE WHEN ref_type <> 'use' THEN line END) OVER (PARTITION BY fn_id, name ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_line FROM ref),
du AS (SELECT fn_id, name AS var, def_line, line AS use_line FROM seen WHERE ref_type <> 'definition' AND def_line IS NOT NULL),
pdg AS (SELECT fn_id, src, dst, 'control' AS dep_type, '' AS label FROM cfg WHERE src <> dst
  UNION ALL SELECT du.fn_id, a.block, b.block, 'data', var FROM du JOIN ref a ON a.fn_id = du.fn_id AND a.line = def_line JOIN ref b ON b.fn_id = du.fn_id AND b.line = use_line WHERE a.block <> b.block)
"""
WITH = "WITH RECURSIVE" + EVENTS


def facts(spark, d):
    refs, owner, control = tables.var_refs(spark, d), tables.numbered_events(spark, d).select("fn_id", "line", "block"), tables.transitions(spark, d)
    return refs, owner, control, flow.dependence_edges(control, flow.def_use(refs), owner)


def seeds(spark, d, last: bool):
    rows = tables.numbered_events(spark, d)
    return rows.groupBy("fn_id").agg((F.max_by if last else F.min_by)("block", "line").alias("node"))


def slice_sql(backward: bool, variable: str | None = None) -> str:
    order, (a, b) = ("max_by", ("dst", "src")) if backward else ("min_by", ("src", "dst"))
    kept = f"WHERE dep_type = 'control' OR label = '{variable}'" if variable else ""
    return WITH + f""", graph AS (SELECT DISTINCT fn_id, {a} AS a, {b} AS b FROM pdg {kept}),
closed AS (SELECT fn_id, {order}(block, line) AS node FROM ref GROUP BY fn_id UNION SELECT c.fn_id, b FROM closed c JOIN graph g ON g.fn_id = c.fn_id AND a = node)
SELECT r.fn_id, line FROM closed c JOIN ref r ON r.fn_id = c.fn_id AND block = node"""


@query(WITH + "SELECT * FROM du")
def def_use_linear(spark, d):
    return flow.def_use(tables.var_refs(spark, d))


@query(WITH + "SELECT fn_id, name, count(*) AS n_refs, string_agg(ref_type || ':' || line, ',' ORDER BY line) AS refs FROM ref GROUP BY ALL")
def variables(spark, d):
    return flow.variables(tables.var_refs(spark, d))


@query(WITH + "SELECT fn_id, line, (line - 1) // 8 AS block_id FROM ref")
def line_to_block(spark, d):
    lines = tables.numbered_events(spark, d).select("fn_id", "line")
    blocks = lines.groupBy("fn_id", F.floor((F.col("line") - 1) / 8).alias("block_id")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    return flow.lines_to_blocks(lines, blocks)


@query(WITH + "SELECT * FROM pdg")
def pdg_edges(spark, d):
    return facts(spark, d)[3]


@query(WITH + """SELECT fn_id, count(DISTINCT block) AS nodes, coalesce(max(c), 0) AS control_edges, coalesce(max(x), 0) AS data_edges, count(DISTINCT name) AS variables, coalesce(max(c2), 0) + 1 AS complexity
FROM ref LEFT JOIN (SELECT fn_id AS f, sum((dep_type = 'control')::int)::bigint AS c, sum((dep_type = 'data')::int)::bigint AS x FROM pdg GROUP BY fn_id) ON f = fn_id LEFT JOIN (SELECT fn_id AS g, sum(n - 1)::bigint AS c2 FROM (SELECT fn_id, src, count(*) AS n FROM cfg GROUP BY ALL) GROUP BY fn_id) ON g = fn_id GROUP BY fn_id""")
def pdg_summary(spark, d):
    refs, owner, control, edges = facts(spark, d)
    nodes = refs.join(owner, ["fn_id", "line"]).groupBy("fn_id").agg(F.countDistinct("block").alias("nodes"), F.countDistinct("name").alias("variables"))
    kinds = edges.groupBy("fn_id").agg(F.count_if(F.col("dep_type") == "control").alias("control_edges"), F.count_if(F.col("dep_type") == "data").alias("data_edges"))
    # decisions: ways out of a block beyond the first
    every = control.groupBy("fn_id", "src").agg((F.count("*") - 1).alias("more")).groupBy("fn_id").agg(F.sum("more").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.join(kinds, "fn_id", "left").join(every, "fn_id", "left").select("fn_id", "nodes", zero("control_edges").alias("control_edges"), zero("data_edges").alias("data_edges"), "variables", (zero("n") + 1).alias("complexity"))


@query(slice_sql(True))
def slice_backward(spark, d):
    _, owner, _, edges = facts(spark, d)
    return flow.sliced(seeds(spark, d, True), edges, owner)


@query(slice_sql(False))
def slice_forward(spark, d):
    _, owner, _, edges = facts(spark, d)
    return flow.sliced(seeds(spark, d, False), edges, owner, backward=False)


@query(slice_sql(True, "v7"))
def slice_variable(spark, d):
    _, owner, _, edges = facts(spark, d)
    return flow.sliced(seeds(spark, d, True), edges, owner, variable="v7")


@query(WITH + """, here AS (SELECT fn_id, block FROM ref WHERE line = 5)
SELECT p.fn_id, 'out' AS direction, src, dst, dep_type, label FROM pdg p JOIN here h ON h.fn_id = p.fn_id AND src = block UNION ALL SELECT p.fn_id, 'in', src, dst, dep_type, label FROM pdg p JOIN here h ON h.fn_id = p.fn_id AND dst = block""")
def line_dependencies(spark, d):
    _, owner, _, edges = facts(spark, d)
    here = owner.where("line = 5").select("fn_id", "block")
    side = lambda c, name: edges.join(here.withColumnRenamed("block", c), ["fn_id", c]).select("fn_id", F.lit(name).alias("direction"), "src", "dst", "dep_type", "label")
    return side("src", "out").unionByName(side("dst", "in"))


@query(WITH + """, lastdef AS (SELECT fn_id, block, name, max(line) AS line FROM ref WHERE ref_type <> 'use' GROUP BY ALL),
flows AS (SELECT fn_id, block, name, line FROM lastdef
  UNION SELECT f.fn_id, c.dst, f.name, f.line FROM flows f JOIN cfg c ON c.fn_id = f.fn_id AND c.src = f.block WHERE NOT EXISTS (SELECT 1 FROM lastdef l WHERE l.fn_id = c.fn_id AND l.block = c.dst AND l.name = f.name)),
arrives AS (SELECT DISTINCT f.fn_id, c.dst AS block, f.name, f.line FROM flows f JOIN cfg c ON c.fn_id = f.fn_id AND c.src = f.block),
uses AS (SELECT *, max(CASE WHEN ref_type <> 'use' THEN line END) OVER (PARTITION BY fn_id, block, name ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM ref)
SELECT fn_id, name AS var, own AS def_line, line AS use_line FROM uses WHERE ref_type <> 'definition' AND own IS NOT NULL
UNION ALL SELECT u.fn_id, u.name, a.line, u.line FROM uses u JOIN arrives a ON a.fn_id = u.fn_id AND a.block = u.block AND a.name = u.name WHERE u.ref_type <> 'definition' AND u.own IS NULL""")
def reaching_defs(spark, d):
    refs, owner, control, _ = facts(spark, d)
    return flow.reaching_definitions(refs, owner, control)
