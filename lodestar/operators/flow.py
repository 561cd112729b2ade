"""Flow inside functions: definitions and uses, dependence, slices. Functions are small and many: what is a window or a
join over all functions stays one; a fixpoint runs by function in a grouped map."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def def_use(refs: DataFrame) -> DataFrame:
    """fn_id, var, def_line, use_line by position: a use sees the last definition on an earlier line. Updates define and
    use. refs: fn_id, seq, name, ref_type, line."""
    defines = F.when(F.col("ref_type") != "use", F.col("line"))
    before = Window.partitionBy("fn_id", "name").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    seen = refs.withColumn("def_line", F.max(defines).over(before))
    return seen.where("ref_type <> 'definition' and def_line is not null").select("fn_id", F.col("name").alias("var"), "def_line", F.col("line").alias("use_line"))


def variables(refs: DataFrame) -> DataFrame:
    """fn_id, name, references in order."""
    one = F.concat_ws(":", "ref_type", F.col("line").cast("string"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "seq", one.alias("ref")))), lambda x: x["ref"])
    return refs.groupBy("fn_id", "name").agg(F.count("*").alias("n_refs"), F.array_join(ordered, ",").alias("refs"))


def lines_to_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """fn_id, line, block_id of lines in [start_line, end_line]: ranges become their lines, so it is an equi-join."""
    owned = blocks.select("fn_id", "block_id", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    return lines.join(owned, ["fn_id", "line"])


def dependence_edges(control: DataFrame, def_uses: DataFrame, owner: DataFrame) -> DataFrame:
    """fn_id, src, dst, dep_type, label. control: fn_id, src, dst; owner: fn_id, line, block. No edges to oneself."""
    at = lambda x: owner.select("fn_id", F.col("line").alias(f"{x}_line"), F.col("block").alias(x))
    data = def_uses.withColumnsRenamed({"def_line": "src_line", "use_line": "dst_line"}).join(at("src"), ["fn_id", "src_line"]).join(at("dst"), ["fn_id", "dst_line"])
    return control.select("fn_id", "src", "dst", F.lit("control").alias("dep_type"), F.lit("").alias("label")).unionByName(data.select("fn_id", "src", "dst", F.lit("data").alias("dep_type"), F.col("var").alias("label"))).where("src <> dst")


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """fn_id, node: seeds and all that they reach, inside each function. seeds: fn_id, node; edges: fn_id, src, dst."""

    def close(key, start: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        after = defaultdict(list)
        for a, b in zip(graph.src, graph.dst):
            after[a].append(b)
        seen, todo = set(start.node), list(start.node)
        while todo:
            for b in after[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return pd.DataFrame({"fn_id": [key[0]] * len(seen), "node": sorted(seen)})

    return seeds.groupBy("fn_id").cogroup(edges.select("fn_id", "src", "dst").distinct().groupBy("fn_id")).applyInPandas(close, "fn_id long, node int")


def sliced(seeds: DataFrame, edges: DataFrame, owner: DataFrame, backward: bool = True, variable: str | None = None) -> DataFrame:
    """fn_id, line: the lines that affect (or are affected by) the seeds' blocks. A variable only limits data edges."""
    used = edges if variable is None else edges.where((F.col("dep_type") == "control") | (F.col("label") == variable))
    used = used.select("fn_id", F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else used
    return reachable(seeds, used).join(owner.select("fn_id", "line", F.col("block").alias("node")), ["fn_id", "node"]).select("fn_id", "line")


def reaching_definitions(refs: DataFrame, owner: DataFrame, control: DataFrame) -> DataFrame:
    """fn_id, var, def_line, use_line along control flow: in = union over predecessors, out = own last definitions and
    what they don't replace; inside a block by position. A grouped map by function."""
    rows = refs.join(owner.select("fn_id", "line", "block"), ["fn_id", "line"]).select("fn_id", "line", "seq", "name", "ref_type", "block")

    def solve(key, own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["line", "seq"])
        before = defaultdict(set)
        for a, b in zip(graph.src, graph.dst):
            before[b].add(a)
        last: dict = defaultdict(dict)  # of a block and variable
        for line, name, kind, block in zip(own["line"], own["name"], own["ref_type"], own["block"]):
            if kind != "use":
                last[block][name] = line
        blocks = set(own.block) | set(graph.src) | set(graph.dst)
        into = {b: set() for b in blocks}
        out = {b: {(v, line) for v, line in last[b].items()} for b in blocks}
        changed = True
        while changed:
            changed = False
            for b in sorted(blocks):
                into[b] = set().union(*(out[p] for p in before[b])) if before[b] else set()
                new = {(v, line) for v, line in last[b].items()} | {d for d in into[b] if d[0] not in last[b]}
                if new != out[b]:
                    out[b], changed = new, True
        found = []
        for block, part in own.groupby("block"):
            live: dict = {}
            for line, same in part.groupby("line"):
                for name, kind in zip(same["name"], same["ref_type"]):
                    if kind != "definition":
                        defs = [live[name]] if name in live else sorted(d for v, d in into[block] if v == name)
                        found += [(key[0], name, d, line) for d in defs]
                live.update({n: line for n, k in zip(same["name"], same["ref_type"]) if k != "use"})
        return pd.DataFrame(found, columns=["fn_id", "var", "def_line", "use_line"])

    return rows.groupBy("fn_id").cogroup(control.groupBy("fn_id")).applyInPandas(solve, "fn_id long, var string, def_line long, use_line long")
