"""Queries over real source code: a small tree, kept here as a table, with answers worked out by hand.

The tree is the fixture; scan, extraction, resolution, graph and flow run on it as on any table (path, content).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import code
from lodestar.operators import diagnostics, flow, graph
from lodestar.plans.registry import query
from lodestar.sources import python_source, tables

CORE = '''import pkg.util as u
from .util import clean

LIMIT = 3


class Store:
    def add(self, item):
        """Add one."""
        if item and LIMIT:
            self.items.append(clean(item))
        else:
            u.warn(item)
        return self.size()

    def size(self):
        return len(self.items)


def load(rows):
    store = Store()
    n = 0
    for row in rows:
        n += 1
        store.add(row)
    return n


def unused():
    return 0
'''
UTIL = """def clean(text):
    return text.strip()


def warn(text):
    try:
        print(clean(text))
    except ValueError:
        raise
"""
TEST = """from pkg.core import load


def test_load():
    assert load([1]) == 1
"""
TREE = [("pkg/__init__.py", ""), ("pkg/core.py", CORE), ("pkg/util.py", UTIL), ("tests/test_core.py", TEST), ("node_modules/x.py", "def hidden():\n    pass\n"), ("bad.py", "def (\n"), ("notes.txt", "no code")]


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a table written out."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def files(spark):
    tree = spark.createDataFrame(TREE, "path string, content string")
    return tree.where(tables.is_source(F.col("path")) & F.col("path").rlike(r"\.py$"))


def facts(spark):
    return python_source.facts(files(spark))


def of(spark, kind):
    return python_source.of_kind(facts(spark), kind)


@query(values("path", [("bad.py",), ("pkg/__init__.py",), ("pkg/core.py",), ("pkg/util.py",), ("tests/test_core.py",)]))
def code_scan(spark, d):
    return files(spark).select("path")


FUNCTIONS = [
    ("pkg/core.py", "Store.add", 8, 14, "def add(self, item)", "Add one."), ("pkg/core.py", "Store.size", 16, 17, "def size(self)", None),
    ("pkg/core.py", "load", 20, 26, "def load(rows)", None), ("pkg/core.py", "unused", 29, 30, "def unused()", None),
    ("pkg/util.py", "clean", 1, 2, "def clean(text)", None), ("pkg/util.py", "warn", 5, 9, "def warn(text)", None),
    ("tests/test_core.py", "test_load", 4, 5, "def test_load()", None),
]


@query(values("path, qualified_name, line, end_line, signature, docstring", FUNCTIONS))
def code_functions(spark, d):
    head = code.signature(F.lit("python"), F.col("name"), F.col("params"), F.col("returns"), F.col("is_async"))
    return of(spark, "function").select("path", "qualified_name", "line", "end_line", head.alias("signature"), "docstring")


@query(values("path, functions, classes", [("pkg/core.py", "load,unused", "Store(add,size)"), ("pkg/util.py", "clean,warn", ""), ("tests/test_core.py", "test_load", "")]))
def code_modules(spark, d):
    """Structure by file: functions, and classes with their methods."""
    found = of(spark, "function")
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    methods = found.where("class is not null").groupBy("path", "class").agg(listed("name").alias("m"))
    classes = methods.groupBy("path").agg(listed(F.concat("class", F.lit("("), "m", F.lit(")"))).alias("classes"))
    names = found.groupBy("path").agg(listed(F.when(F.col("class").isNull(), F.col("name"))).alias("functions"))
    return names.join(classes, "path", "left").select("path", "functions", F.coalesce("classes", F.lit("")).alias("classes"))


@query(values("path, local_name, module, orig_name, level", [("pkg/core.py", "u", "pkg.util", None, 0), ("pkg/core.py", "clean", "util", "clean", 1), ("tests/test_core.py", "load", "pkg.core", "load", 0)]))
def code_imports(spark, d):
    return of(spark, "import").select("path", "local_name", "module", "orig_name", "level")


EDGES = [
    ("pkg/core.py", "Store.add", "pkg/core.py", "Store.size"), ("pkg/core.py", "Store.add", "pkg/util.py", "clean"),
    ("pkg/core.py", "Store.add", "pkg/util.py", "warn"), ("pkg/core.py", "load", "pkg/core.py", "Store"),
    ("pkg/util.py", "warn", "pkg/util.py", "clean"), ("tests/test_core.py", "test_load", "pkg/core.py", "load"),
]


@query(values("src_file, src_func, dst_file, dst_func", EDGES))
def code_call_edges(spark, d):
    return python_source.call_edges(facts(spark))


@query(values("file, func, depth", [("pkg/util.py", "clean", 0), ("pkg/util.py", "warn", 1), ("pkg/core.py", "Store.add", 1)]))
def code_impact(spark, d):
    seed = spark.createDataFrame([("pkg/util.py", "clean")], "file string, func string")
    return graph.reach(python_source.call_edges(facts(spark)), seed, 3)


@query(values("file, name", [("pkg/core.py", "unused")]))
def code_dead(spark, d):
    found = facts(spark)
    functions = python_source.of_kind(found, "function").select(F.col("path").alias("file"), F.col("qualified_name").alias("name"))
    return graph.dead_code(functions, python_source.call_edges(found))


@query(values("file, reason", [("tests/test_core.py", "caller"), ("tests/test_core.py", "import")]))
def code_affected_tests(spark, d):
    found = facts(spark)
    imports = python_source.of_kind(found, "import").where(code.is_test(F.col("path"))).select(F.col("path").alias("test"), "module")
    changed, modules = spark.createDataFrame([("pkg/core.py",)], "file string"), spark.createDataFrame([("pkg.core",)], "m string")
    return graph.affected_tests(python_source.call_edges(found), changed, imports, modules, code.is_test(F.col("file")))


@query(values("path, fn, cyclomatic", [("pkg/core.py", "Store.add", 2), ("pkg/core.py", "Store.size", 1), ("pkg/core.py", "load", 2), ("pkg/core.py", "unused", 1), ("pkg/util.py", "clean", 1), ("pkg/util.py", "warn", 2), ("tests/test_core.py", "test_load", 2)]))
def code_complexity(spark, d):
    return of(spark, "complexity")


@query(values("fn, edge_type, n", [("Store.add", "false", 1), ("Store.add", "return", 1), ("Store.add", "true", 1), ("Store.add", "unconditional", 2), ("load", "back_edge", 1), ("load", "exhausted", 1), ("load", "iterate", 1), ("load", "return", 1), ("load", "unconditional", 1)]))
def code_control_flow(spark, d):
    return of(spark, "cfg_edge").where("path = 'pkg/core.py' and fn in ('Store.add', 'load')").groupBy("fn", "edge_type").agg(F.count("*").alias("n"))


@query(values("var, def_line, use_line", [("rows", 20, 23), ("store", 21, 25), ("row", 23, 25), ("n", 22, 24), ("n", 22, 24), ("n", 24, 26)]))
def code_def_use(spark, d):
    refs = of(spark, "var_ref").where("path = 'pkg/core.py' and fn = 'load'")
    return flow.def_use(refs.select(F.col("fn").alias("fn_id"), "seq", "name", "ref_type", "line")).select("var", "def_line", "use_line")


@query(values("path", [("bad.py",)]))
def code_errors(spark, d):
    return of(spark, "error").select("path")


#: One finding of each checker, as it prints it, and the row it must become.
PRINTED = [
    ("tsc", "a.ts(3,4): error TS2304: No name.", ("a.ts", 3, 4, "error", "No name.", "TS2304")),
    ("go vet", "a.go:3:4: unreachable code", ("a.go", 3, 4, "error", "unreachable code", None)),
    ("javac", "A.java:7: warning: old call", ("A.java", 7, 0, "warning", "old call", None)),
    ("gcc", "a.c:5:6: error: no such file", ("a.c", 5, 6, "error", "no such file", None)),
    ("kotlinc", "a.kt:1:2: warning: never used", ("a.kt", 1, 2, "warning", "never used", None)),
    ("swiftc", "a.swift:8:9: error: missing return", ("a.swift", 8, 9, "error", "missing return", None)),
    ("dotnet", "a.cs(2,5): warning CS0168: not used", ("a.cs", 2, 5, "warning", "not used", "CS0168")),
    ("scalac", "a.scala:4: error: not found", ("a.scala", 4, 0, "error", "not found", None)),
    ("mix", "** (CompileError) lib/a.ex:7: boom", ("lib/a.ex", 7, 0, "error", "boom", "CompileError")),
]
JSON_OUTPUT = [
    ("pyright", '{"generalDiagnostics":[{"file":"a.py","severity":"error","message":"m","rule":"r","range":{"start":{"line":4,"character":2}}}]}', ("a.py", 5, 3, "error", "m", "r")),
    ("ruff", '[{"filename":"a.py","code":"F401","message":"m","location":{"row":2,"column":1}}]', ("a.py", 2, 1, "warning", "m", "F401")),
    ("golangci-lint", '{"Issues":[{"FromLinter":"errcheck","Text":"m","Pos":{"Filename":"a.go","Line":3,"Column":2}}]}', ("a.go", 3, 2, "warning", "m", "errcheck")),
    ("rubocop", '{"files":[{"path":"a.rb","offenses":[{"severity":"fatal","message":"m","cop_name":"C","location":{"line":1,"column":2}}]}]}', ("a.rb", 1, 2, "error", "m", "C")),
    ("phpstan", '{"files":{"a.php":{"messages":[{"message":"m","line":5}]}}}', ("a.php", 5, 0, "error", "m", None)),
    ("ktlint", '[{"file":"a.kt","errors":[{"line":1,"column":2,"message":"m","rule":"r"}]}]', ("a.kt", 1, 2, "warning", "m", "r")),
    ("swiftlint", '[{"file":"a.swift","line":1,"character":2,"severity":"Error","reason":"m","rule_id":"r"}]', ("a.swift", 1, 2, "error", "m", "r")),
    ("credo", '{"issues":[{"filename":"a.ex","line_no":1,"column":2,"message":"m","check":"C"}]}', ("a.ex", 1, 2, "warning", "m", "C")),
]
CARGO = '{"reason":"compiler-message","message":{"level":"warning","message":"m","code":{"code":"c"},"spans":[{"file_name":"a.rs","line_start":1,"column_start":2,"is_primary":true}]}}'
CHECKSTYLE = '<checkstyle><file name="A.java"><error line="1" severity="error" message="m" source="s"/><error line="2" severity="warning" message="n" source="t"/></file><file name="B.java"/></checkstyle>'
CPPCHECK = '<results><errors><error id="i" severity="style" msg="m"><location file="a.c" line="3"/></error></errors></results>'
FOUND = [(*row, tool) for tool, _, row in PRINTED + JSON_OUTPUT] + [
    ("a.rs", 1, 2, "warning", "m", "c", "cargo"), ("a.rs", 1, 2, "warning", "m", "c", "clippy"),
    ("A.java", 1, 0, "error", "m", "s", "checkstyle"), ("A.java", 2, 0, "warning", "n", "t", "checkstyle"), ("a.c", 3, 0, "style", "m", "i", "cppcheck"),
]


@query(values("file, line, column, severity, message, rule, source", FOUND).replace("line, column,", 'line, "column",'))
def diag_all_tools(spark, d):
    """Every checker's output, by its own parser."""
    text = lambda t: spark.createDataFrame([(t,), (None,), ("nothing of the kind",)] if t[0] not in "<[{" else [(t,)], "text string")
    found = diagnostics.from_cargo(text(CARGO)).unionByName(diagnostics.from_cargo(text(CARGO), tool="clippy"))
    for tool, printed, _ in PRINTED:
        found = found.unionByName(diagnostics.from_lines(text(printed), tool))
    for tool, output, _ in JSON_OUTPUT:
        found = found.unionByName(diagnostics.from_json_output(text(output), tool))
    return found.unionByName(diagnostics.from_xml_output(text(CHECKSTYLE), "checkstyle")).unionByName(diagnostics.from_xml_output(text(CPPCHECK), "cppcheck"))
