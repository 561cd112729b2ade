"""Facts of Python source: one grouped pass over files, one row for each fact.

``facts(files)`` maps a table (path, content) to rows (path, kind, fact) with the fact as JSON; ``of_kind`` gives a kind
as a table with its schema. Parsing is the only opaque step: it runs where the file was read, and everything after it is
relational. A file that does not parse gives one ``error`` fact and no other.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schema of each kind, without the path.
KINDS = {
    "function": "name string, qualified_name string, class string, line int, end_line int, params array<string>, returns string, docstring string, is_async boolean, decorators array<string>",
    "class": "name string, line int, end_line int, bases array<string>, docstring string",
    "import": "local_name string, module string, orig_name string, is_from boolean, level int",
    "call": "caller string, call_type string, target string",
    "var_ref": "fn string, seq int, name string, ref_type string, line int, col int",
    "cfg_block": "fn string, block_id int, type string, start_line int, end_line int",
    "cfg_edge": "fn string, src int, dst int, edge_type string",
    "complexity": "fn string, cyclomatic int",
    "error": "message string",
}
FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
COMPREHENSION = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


class Flow:
    """Blocks and edges of one function, and its decision points."""

    def __init__(self, fn: str, node: ast.AST):
        self.fn, self.blocks, self.edges, self.decisions = fn, [], [], 0
        start = self.block("entry", node.lineno)
        self.exit = self.block("exit", node.end_lineno)
        self.loops: list[tuple[int, int]] = []
        if (last := self.body(node.body, start)) is not None:
            self.edge(last, self.exit, "unconditional")

    def block(self, kind: str, line: int, end: int | None = None) -> int:
        self.blocks.append([kind, line, end or line])
        return len(self.blocks) - 1

    def edge(self, a: int, b: int, kind: str) -> None:
        self.edges.append((a, b, kind))

    def grow(self, at: int, node: ast.AST, end: int | None = None) -> None:
        b = self.blocks[at]
        b[1], b[2] = min(b[1], node.lineno), max(b[2], end or node.end_lineno)

    def conditions(self, node: ast.AST) -> None:
        """Each condition of a comprehension is a decision."""
        self.decisions += sum(len(g.ifs) for x in ast.walk(node) if isinstance(x, COMPREHENSION) for g in x.generators)

    def body(self, statements: list[ast.stmt], at: int | None) -> int | None:
        """The block where control goes on, or None."""
        for s in statements:
            if at is None:
                at = self.block("dead", s.lineno)
            at = self.statement(s, at)
        return at

    def statement(self, s: ast.stmt, at: int) -> int | None:
        if isinstance(s, (*FUNCTION, ast.ClassDef)):
            self.grow(at, s, s.lineno)
            return at
        if isinstance(s, ast.If):
            return self.branch(s, at)
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            return self.loop(s, at)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            self.grow(at, s, s.lineno)
            for item in s.items:
                self.conditions(item)
            return self.body(s.body, at)
        if isinstance(s, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            return self.attempt(s, at)
        if isinstance(s, ast.Match):
            return self.match(s, at)
        self.grow(at, s)
        self.conditions(s)
        if isinstance(s, ast.Assert):
            self.decisions += 1
            after = self.block("body", s.end_lineno)
            self.edge(at, after, "assert_pass")
            self.edge(at, self.exit, "assert_fail")
            return after
        if isinstance(s, (ast.Return, ast.Raise)):
            self.edge(at, self.exit, "return" if isinstance(s, ast.Return) else "exception")
            return None
        if isinstance(s, (ast.Break, ast.Continue)) and self.loops:
            head, after = self.loops[-1]
            self.edge(at, after if isinstance(s, ast.Break) else head, "break" if isinstance(s, ast.Break) else "continue")
            return None
        return at

    def join(self, ends: list[int | None], line: int) -> int | None:
        live = [e for e in ends if e is not None]
        if not live:
            return None
        after = self.block("merge", line)
        for e in live:
            self.edge(e, after, "unconditional")
        return after

    def branch(self, s: ast.If, at: int) -> int | None:
        self.grow(at, s, s.test.end_lineno)
        self.decisions += 1
        self.conditions(s.test)
        yes = self.block("branch", s.body[0].lineno)
        self.edge(at, yes, "true")
        ends = [self.body(s.body, yes)]
        if s.orelse:
            no = self.block("branch", s.orelse[0].lineno)
            self.edge(at, no, "false")
            return self.join([*ends, self.body(s.orelse, no)], s.end_lineno)
        after = self.join(ends, s.end_lineno)
        after = self.block("merge", s.end_lineno) if after is None else after
        self.edge(at, after, "false")
        return after

    def loop(self, s, at: int) -> int:
        self.decisions += 1
        test = s.test if isinstance(s, ast.While) else s.iter
        self.conditions(test)
        head = self.block("loop_header", s.lineno, test.end_lineno)
        self.edge(at, head, "unconditional")
        inside, after = self.block("loop_body", s.body[0].lineno), self.block("merge", s.end_lineno)
        named = ("true", "false") if isinstance(s, ast.While) else ("iterate", "exhausted")
        self.edge(head, inside, named[0])
        self.loops.append((head, after))
        end = self.body(s.body, inside)
        self.loops.pop()
        if end is not None:
            self.edge(end, head, "back_edge")
        if s.orelse:
            other = self.block("branch", s.orelse[0].lineno)
            self.edge(head, other, named[1])
            if (end := self.body(s.orelse, other)) is not None:
                self.edge(end, after, "unconditional")
        else:
            self.edge(head, after, named[1])
        return after

    def attempt(self, s, at: int) -> int | None:
        tried = self.block("try", s.body[0].lineno)
        self.edge(at, tried, "unconditional")
        end = self.body(s.body, tried)
        ends = []
        for h in s.handlers:
            self.decisions += 1
            caught = self.block("except", h.lineno)
            self.edge(tried, caught, "exception")
            ends.append(self.body(h.body, caught))
        if s.orelse and end is not None:
            other = self.block("else", s.orelse[0].lineno)
            self.edge(end, other, "no_exception")
            end = self.body(s.orelse, other)
        after = self.join([end, *ends], s.end_lineno)
        if s.finalbody:
            last = self.block("finally", s.finalbody[0].lineno)
            self.edge(tried if after is None else after, last, "unconditional")
            end = self.body(s.finalbody, last)
            return None if after is None else end
        return after

    def match(self, s: ast.Match, at: int) -> int | None:
        self.grow(at, s, s.subject.end_lineno)
        ends: list[int | None] = []
        open_end = True
        for c in s.cases:
            self.decisions += 1 + (c.guard is not None)
            block = self.block("case", c.body[0].lineno)
            self.edge(at, block, "case")
            ends.append(self.body(c.body, block))
            open_end &= not (c.guard is None and isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None)
        return self.join([*ends, at] if open_end else ends, s.end_lineno)


def references(node: ast.AST) -> Iterator[tuple[str, str, int, int]]:
    """(name, definition, update or use, line, column) of one function, in order of evaluation; nested functions and
    classes only define their name."""
    a = node.args
    for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
        yield p.arg, "definition", p.lineno, p.col_offset

    def walk(x: ast.AST) -> Iterator[tuple[str, str, int, int]]:
        if isinstance(x, (*FUNCTION, ast.ClassDef)):
            yield x.name, "definition", x.lineno, x.col_offset
            return
        if isinstance(x, ast.Name):
            if x.id not in ("_", "__"):
                yield x.id, "use" if isinstance(x.ctx, ast.Load) else "definition", x.lineno, x.col_offset
            return
        if isinstance(x, ast.AugAssign):
            yield from walk(x.value)
            if isinstance(x.target, ast.Name):
                yield x.target.id, "use", x.lineno, x.target.col_offset
                yield x.target.id, "update", x.lineno, x.target.col_offset
            else:
                yield from walk(x.target)
            return
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            for n in x.names:
                yield n.asname or n.name.split(".")[0], "definition", x.lineno, x.col_offset
            return
        if isinstance(x, ast.Assign):
            order = [x.value, *x.targets]
        elif isinstance(x, ast.AnnAssign):
            order = [*([x.value] if x.value else []), *([x.target] if x.value or not isinstance(x.target, ast.Name) else [])]
        elif isinstance(x, (ast.For, ast.AsyncFor)):
            order = [x.iter, x.target, *x.body, *x.orelse]
        elif isinstance(x, ast.NamedExpr):
            order = [x.value, x.target]
        elif isinstance(x, COMPREHENSION):
            order = [y for g in x.generators for y in (g.iter, g.target, *g.ifs)] + ([x.key, x.value] if isinstance(x, ast.DictComp) else [x.elt])
        elif isinstance(x, ast.Lambda):
            order = [x.body]
        else:
            order = list(ast.iter_child_nodes(x))
            if isinstance(x, ast.ExceptHandler) and x.name:
                yield x.name, "definition", x.lineno, x.col_offset
            if isinstance(x, (ast.MatchAs, ast.MatchStar)) and x.name:
                yield x.name, "definition", x.lineno, x.col_offset
        for y in order:
            yield from walk(y)

    for s in node.body:
        yield from walk(s)


def calls(node: ast.AST, caller: str, local: set[str], own_class: str | None) -> Iterator[dict]:
    """Calls inside a node: to names of the file, to other names, to attributes of a name, and names of the file that are
    passed on."""
    for x in ast.walk(node):
        if not isinstance(x, ast.Call):
            continue
        f = x.func
        if isinstance(f, ast.Name):
            yield {"caller": caller, "call_type": "intra" if f.id in local else "direct", "target": f.id}
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            if f.value.id in ("self", "cls") and own_class and f"{own_class}.{f.attr}" in local:
                yield {"caller": caller, "call_type": "intra", "target": f"{own_class}.{f.attr}"}
            elif caller != "<module>":
                yield {"caller": caller, "call_type": "attr", "target": f"{f.value.id}.{f.attr}"}
        for arg in [*x.args, *(k.value for k in x.keywords)]:
            if isinstance(arg, ast.Name) and arg.id in local:
                yield {"caller": caller, "call_type": "ref", "target": arg.id}


def extract(content: str) -> Iterator[tuple[str, dict]]:
    """(kind, fact) of one file."""
    try:
        tree = ast.parse(content.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError) as e:
        yield "error", {"message": str(e)}
        return
    owner = {id(m): c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for m in c.body if isinstance(m, FUNCTION)}
    found = [x for x in ast.walk(tree) if isinstance(x, FUNCTION)]
    qualified = {id(x): f"{owner[id(x)]}.{x.name}" if id(x) in owner else x.name for x in found}
    local = {*qualified.values(), *(x.name for x in ast.walk(tree) if isinstance(x, ast.ClassDef))}
    for c in ast.walk(tree):
        if isinstance(c, ast.ClassDef):
            yield "class", {"name": c.name, "line": c.lineno, "end_line": c.end_lineno, "bases": [b for b in map(dotted, c.bases) if b], "docstring": ast.get_docstring(c)}
        elif isinstance(c, ast.Import):
            for n in c.names:
                yield "import", {"local_name": n.asname or n.name, "module": n.name, "orig_name": None, "is_from": False, "level": 0}
        elif isinstance(c, ast.ImportFrom):
            for n in c.names:
                yield "import", {"local_name": n.asname or n.name, "module": c.module or "", "orig_name": n.name, "is_from": True, "level": c.level}
    top = ast.Module([s for s in tree.body if not isinstance(s, (*FUNCTION, ast.ClassDef))], [])
    for fact in calls(top, "<module>", local, None):
        yield "call", fact
    for x in found:
        name = qualified[id(x)]
        a = x.args
        params = [p.arg for p in [*a.posonlyargs, *a.args]] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [p.arg for p in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
        yield "function", {"name": x.name, "qualified_name": name, "class": owner.get(id(x)), "line": x.lineno, "end_line": x.end_lineno, "params": params, "returns": ast.unparse(x.returns) if x.returns else None, "docstring": ast.get_docstring(x), "is_async": isinstance(x, ast.AsyncFunctionDef), "decorators": [ast.unparse(d) for d in x.decorator_list]}
        for fact in calls(ast.Module(x.body, []), name, local, owner.get(id(x))):
            yield "call", fact
        for seq, (var, kind, line, col) in enumerate(references(x)):
            yield "var_ref", {"fn": name, "seq": seq, "name": var, "ref_type": kind, "line": line, "col": col}
        flow = Flow(name, x)
        for i, (kind, line, end) in enumerate(flow.blocks):
            yield "cfg_block", {"fn": name, "block_id": i, "type": kind, "start_line": line, "end_line": end}
        for src, dst, kind in flow.edges:
            yield "cfg_edge", {"fn": name, "src": src, "dst": dst, "edge_type": kind}
        yield "complexity", {"fn": name, "cyclomatic": flow.decisions + 1}


def facts(files: DataFrame) -> DataFrame:
    """path, kind, fact (JSON) of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, kind, json.dumps(f)) for p, c in zip(batch["path"], batch["content"]) for kind, f in extract(c or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "fact"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, fact string")


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    """The facts of a kind: path and the fields of KINDS."""
    return found.where(F.col("kind") == kind).select("path", F.from_json("fact", KINDS[kind]).alias("f")).select("path", "f.*")


def call_edges(found: DataFrame) -> DataFrame:
    """src_file, src_func, dst_file, dst_func: calls inside files, imported names and attributes of imported modules.

    A module is known by its dotted path and by its last segment; where several files fit, the first by name counts."""
    from lodestar.functions.code import module_name
    from lodestar.operators.graph import resolve_calls

    call, imports, functions = of_kind(found, "call").distinct(), of_kind(found, "import"), of_kind(found, "function")
    inside = call.where("call_type in ('intra', 'ref')").select(F.col("path").alias("src_file"), F.col("caller").alias("src_func"), F.col("path").alias("dst_file"), F.col("target").alias("dst_func"))
    module = module_name(F.col("path"))
    index = functions.select(module.alias("module"), F.element_at(F.split(module, r"\."), -1).alias("simple_module"), F.col("qualified_name").alias("name"), F.col("path").alias("file"))
    # a relative import drops the file's last parts; its module then is below what is left
    base = F.array_join(F.slice(F.split(module_name(F.col("path")), r"\."), 1, F.greatest(F.lit(0), F.size(F.split(module_name(F.col("path")), r"\.")) - F.col("level"))), ".")
    full = F.when(F.col("level") > 0, F.concat_ws(".", F.when(base != "", base), F.when(F.col("module") != "", F.col("module")))).otherwise(F.col("module"))
    bindings = imports.select(F.col("path").alias("file"), "local_name", full.alias("module"), "orig_name", "is_from")
    direct = call.where("call_type = 'direct'").select(F.col("path").alias("file"), "caller", "target")
    named = resolve_calls(direct, bindings.where("is_from").drop("is_from"), index)
    attr = call.where("call_type = 'attr'").select(F.col("path").alias("file"), "caller", F.split("target", r"\.").alias("t")).select("file", "caller", F.get("t", F.lit(0)).alias("head"), F.get("t", F.lit(1)).alias("orig_name"))
    through = attr.join(bindings.where("not is_from").select("file", F.col("local_name").alias("head"), "module"), ["file", "head"])
    sites = through.select("file", "caller", F.concat_ws(".", "head", "orig_name").alias("target"), "module", "orig_name")
    attributes = resolve_calls(sites.select("file", "caller", "target").distinct(), sites.select("file", F.col("target").alias("local_name"), "module", "orig_name").distinct(), index)
    return inside.unionByName(named).unionByName(attributes).distinct()
