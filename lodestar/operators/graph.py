"""Call graph questions. An edge is (src_file, src_func, dst_file, dst_func)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.code import ENTRY_POINTS, any_contained
from lodestar.plans.lineage import written


def reverse_index(edges: DataFrame) -> DataFrame:
    """Callee with its number of callers and their names, sorted."""
    return edges.groupBy("dst_file", "dst_func").agg(F.count("*").alias("n_callers"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "src_file", "src_func"))), ",").alias("callers"))


def direct_callers(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("dst_func") == name).select("src_file", "src_func").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int, backward: bool = True) -> DataFrame:
    """file, func, depth: the nodes within depth calls of seeds (file, func), each at its least depth. One join and one
    anti-join a level; every level is written, so a level is computed once."""
    near, far = (("dst", "src"), ("src", "dst"))[not backward]
    step = edges.select(F.col(f"{near}_file").alias("file"), F.col(f"{near}_func").alias("func"), F.col(f"{far}_file").alias("to_file"), F.col(f"{far}_func").alias("to_func"))
    seen = frontier = seeds.select("file", "func").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        found = frontier.select("file", "func").join(step, ["file", "func"]).select(F.col("to_file").alias("file"), F.col("to_func").alias("func")).distinct()
        frontier = written(found.join(seen.select("file", "func"), ["file", "func"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def impact_tree(edges: DataFrame, name: str, depth: int = 3, file_part: str | None = None) -> DataFrame:
    """path, func, depth, caller_count, truncated: callers of callers as a tree. A node may be on several paths; it is
    truncated at the last depth or where it is on its own path already."""
    one = F.concat_ws(":", "src_file", "src_func").alias("caller"), F.concat_ws(":", "dst_file", "dst_func").alias("callee")
    calls = edges.select(*one).distinct()
    counts = calls.groupBy("callee").agg(F.count("*").alias("caller_count"))
    targets = edges.where(F.col("dst_func") == name)
    targets = targets if file_part is None else targets.where(F.contains("dst_file", F.lit(file_part)))
    level = targets.select(one[1]).distinct().select(F.col("callee").alias("node"), F.array("callee").alias("path"), F.lit(False).alias("again"))
    out = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        open_nodes = level.where(~F.col("again"))
        level = written(open_nodes.join(calls, F.col("node") == F.col("callee")).select(F.col("caller").alias("node"), F.concat("path", F.array("caller")).alias("path"), F.array_contains("path", F.col("caller")).alias("again")))
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    tree = out.join(counts, F.col("node") == F.col("callee"), "left")
    return tree.select(F.array_join("path", ">").alias("path"), F.col("node").alias("func"), "depth", F.coalesce("caller_count", F.lit(0)).alias("caller_count"), (F.col("again") | (F.col("depth") == depth)).alias("truncated"))


def dead_code(functions: DataFrame, edges: DataFrame, entry_points: tuple[str, ...] = ()) -> DataFrame:
    """Functions that nothing calls, that call nothing, and that don't look like entry points."""
    called = edges.select(F.col("dst_file").alias("file"), F.col("dst_func").alias("name"))
    callers = edges.select(F.col("src_file").alias("file"), F.col("src_func").alias("name"))
    names = [*ENTRY_POINTS, *entry_points]
    alive = any_contained(F.col("name"), names) | any_contained(F.col("file"), names) | F.col("name").rlike("^__.*__$")
    return functions.where(~alive).join(called.unionByName(callers), ["file", "name"], "left_anti")


def dead_summary(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """By file: dead and all functions, and the share in percent."""
    dead = dead_code(functions, edges).groupBy("file").agg(F.count("*").alias("dead"))
    every = functions.groupBy("file").agg(F.count("*").alias("total"))
    return every.join(dead, "file", "left").select("file", F.coalesce("dead", F.lit(0)).alias("dead"), "total", F.round(F.coalesce("dead", F.lit(0)) / F.greatest("total", F.lit(1)) * 100, 1).alias("percent"))


def layers(edges: DataFrame) -> DataFrame:
    """file, func, calls_out, calls_in, layer: entry, middle or leaf. One aggregation over both ends of the edges."""
    end = lambda p, o, i: edges.select(F.col(f"{p}_file").alias("file"), F.col(f"{p}_func").alias("func"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    degrees = end("src", 1, 0).unionByName(end("dst", 0, 1)).groupBy("file", "func").agg(F.sum("o").alias("calls_out"), F.sum("i").alias("calls_in"))
    return degrees.withColumn("layer", F.when(F.col("calls_in") == 0, "entry").when(F.col("calls_out") == 0, "leaf").otherwise("middle"))


def directories(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """directory, calls_out, calls_in (across directories), function_count, layer by their ratio."""
    parent = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(".")
    a, b = parent(F.col("src_file")), parent(F.col("dst_file"))
    crossing = edges.select(a.alias("a"), b.alias("b")).where("a <> b")
    rows = (
        crossing.select(F.col("a").alias("directory"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0).alias("f"))
        .unionByName(crossing.select(F.col("b").alias("directory"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("f")))
        .unionByName(functions.select(parent(F.col("file")).alias("directory"), F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("f")))
    )
    ratio = F.col("calls_out") / F.greatest("calls_in", F.lit(1))
    return rows.groupBy("directory").agg(F.sum("o").alias("calls_out"), F.sum("i").alias("calls_in"), F.sum("f").alias("function_count")).withColumn("layer", F.when(ratio > 2, "HIGH").when(ratio < 0.5, "LOW").otherwise("MIDDLE"))


def circular(edges: DataFrame) -> DataFrame:
    """file_a, file_b: pairs of files that call each other, once each. An aggregation over canonical pairs, no self-join."""
    pairs = edges.where("src_file <> dst_file").select(F.least("src_file", "dst_file").alias("file_a"), F.greatest("src_file", "dst_file").alias("file_b"), (F.col("src_file") < F.col("dst_file")).alias("up"))
    return pairs.groupBy("file_a", "file_b").agg(F.bool_or("up").alias("u"), F.bool_or(~F.col("up")).alias("d")).where("u and d").select("file_a", "file_b")


def context(edges: DataFrame, name: str, depth: int) -> DataFrame:
    """name, depth: what name calls, breadth first, each name once."""
    by_name = edges.select(F.lit("").alias("src_file"), "src_func", F.lit("").alias("dst_file"), "dst_func").distinct()
    seeds = edges.sparkSession.createDataFrame([("", name)], "file string, func string")
    return reach(by_name, seeds, depth, backward=False).select(F.col("func").alias("name"), "depth")


def render(found: DataFrame, edges: DataFrame) -> DataFrame:
    """name, depth, text: a line for each name with its first five callees and how many more there are. The indent is
    the lesser of depth and the line's number in the order (depth, name)."""
    calls = edges.select(F.col("src_func").alias("name"), "dst_func").distinct().groupBy("name").agg(F.array_sort(F.collect_list("dst_func")).alias("calls"))
    n = F.size("calls")
    some = F.concat(F.lit(" -> "), F.array_join(F.slice("calls", 1, 5), ", "), F.when(n > 5, F.concat(F.lit(" (+"), (n - 5).cast("string"), F.lit(" more)"))).otherwise(""))
    # a line of depth d has d lines before it at least, if each depth below has a name: breadth first search has no gaps
    indent = F.repeat(F.lit("  "), F.col("depth"))
    return found.join(calls, "name", "left").select("name", "depth", F.concat(indent, "name", F.coalesce(some, F.lit(""))).alias("text"))


def resolve_calls(sites: DataFrame, bindings: DataFrame, index: DataFrame) -> DataFrame:
    """Call edges of (file, caller, target): the imported name by the last segment of its module, then by the whole one.
    bindings: file, local_name, module, orig_name; index: module, simple_module, name, file. Rows may repeat.

    Many sites share a (file, target), so each of those is resolved once, to numbers of the functions that it may mean. Sites
    are dealt by caller, who unites the numbers; only the edges themselves become rows. Small tables are written, so that
    their real size decides on the joins."""
    unique = lambda key, short: index.groupBy(F.col(key).alias("m"), "name").agg(F.min("file").alias("dst")).withColumn("short", F.lit(short))
    found = unique("simple_module", True).unionByName(unique("module", False)).where("dst is not null")
    # a number for each function: of the written table, so it is the same at every read
    numbered = written(found.groupBy("dst", "name").agg(F.collect_list(F.struct("m", "short")).alias("keys")).withColumn("id", F.monotonically_increasing_id()), "functions")
    keys = numbered.select(F.col("name").alias("orig_name"), "id", F.explode("keys").alias("key"))
    by = lambda short, m: keys.where(F.col("key.short") == short).select(F.col("key.m").alias(m), "orig_name", F.col("id").alias(f"by_{m}"))
    looked_up = bindings.withColumn("last", F.element_at(F.split("module", r"\."), -1)).join(by(True, "last"), ["last", "orig_name"], "left").join(by(False, "module"), ["module", "orig_name"], "left")
    meant = looked_up.select("file", F.col("local_name").alias("target"), F.coalesce("by_last", "by_module").alias("id")).where("id is not null").distinct()
    meant = written(meant.groupBy("file", "target").agg(F.array_sort(F.collect_list("id")).alias("ids")), "meant")
    called = sites.repartition("file", "caller").join(meant, ["file", "target"]).groupBy("file", "caller").agg(F.collect_set("ids").alias("sets"))
    edges = called.select(F.col("file").alias("src_file"), F.col("caller").alias("src_func"), F.explode(F.array_distinct(F.flatten("sets"))).alias("id"))
    return edges.join(numbered.select("id", F.col("dst").alias("dst_file"), F.col("name").alias("dst_func")), "id").drop("id")


def resolve_first(sites: DataFrame, index: DataFrame) -> DataFrame:
    """Call edges of (file, caller, package, target): the first file (by name) that has the target and whose path
    contains the package. Each (package, target) is resolved once, by an equi-join on the name with the rest as a condition.
    Rows may repeat."""
    held = index.select(F.col("name").alias("target"), F.col("file").alias("dst_file")).distinct()
    wanted = sites.select("package", "target").distinct()
    fitting = wanted.join(held, "target").where(F.contains("dst_file", F.col("package")))
    # written, so that its real size decides on the join
    first = written(fitting.groupBy("package", "target").agg(F.min("dst_file").alias("dst_file")), "first")
    return sites.join(first, ["package", "target"]).select(F.col("file").alias("src_file"), F.col("caller").alias("src_func"), F.col("target").alias("dst_func"), "dst_file").distinct()


def patch(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """edges without those of changed files (file), and with the fresh edges of those."""
    return edges.join(changed.select(F.col("file").alias("src_file")), "src_file", "left_anti").unionByName(fresh.join(changed.select(F.col("file").alias("src_file")), "src_file", "left_semi").select(edges.columns)).distinct()


def tests_importing(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """test, module of imports (test, module) that name a changed module (m) or something below it."""
    # each import becomes its own dotted prefixes, so it is an equi-join
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return imports.withColumn("m", F.explode(prefixes)).join(modules.select("m").distinct(), "m").select("test", "module").distinct()


def affected_tests(edges: DataFrame, changed: DataFrame, imports: DataFrame, modules: DataFrame, is_test, depth: int = 5) -> DataFrame:
    """file, reason of test files that a change affects: changed themselves, with a caller of what changed, or importing a
    changed module. changed: file; imports: test, module; modules: m. is_test: of a column file."""
    direct = changed.where(is_test).select("file", F.lit("direct").alias("reason"))
    callers = change_impact(edges, changed, is_test, depth).where("depth > 0").select("file", F.lit("caller").alias("reason"))
    importing = tests_importing(imports, modules).select(F.col("test").alias("file"), F.lit("import").alias("reason"))
    return direct.unionByName(callers).unionByName(importing).distinct()


def change_impact(edges: DataFrame, changed: DataFrame, is_test, depth: int = 5) -> DataFrame:
    """Test functions among what changed files hold or what reaches it: file, func, depth. changed: file."""
    ends = edges.select(F.col("dst_file").alias("file"), F.col("dst_func").alias("func")).unionByName(edges.select(F.col("src_file").alias("file"), F.col("src_func").alias("func"))).distinct()
    return reach(edges, ends.join(changed, "file", "left_semi"), depth).where(is_test)
