"""Kernels on hand-made facts, with answers worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from lodestar.functions import code, ignore
from lodestar.operators import batches, diagnostics, flow, graph, store, vectors
from lodestar.sources import python_source
from lodestar.streaming import dirty

EDGES = [("a.py", "f", "b.py", "g"), ("b.py", "g", "c.py", "h"), ("c.py", "h", "a.py", "f"), ("a.py", "f", "c.py", "h"), ("d.py", "x", "d.py", "x")]
EDGE = "src_file string, src_func string, dst_file string, dst_func string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_impact_tree_repeats_nodes_on_other_paths(spark):
    tree = graph.impact_tree(spark.createDataFrame(EDGES, EDGE), "h", 3)
    found = {r["path"]: (r["depth"], r["caller_count"], r["truncated"]) for r in tree.collect()}
    assert found["c.py:h"] == (0, 2, False)
    assert found["c.py:h>b.py:g>a.py:f"] == (2, 1, False)
    assert found["c.py:h>a.py:f>c.py:h"] == (2, 2, True)
    assert found["c.py:h>b.py:g>a.py:f>c.py:h"] == (3, 2, True)


def test_reach_is_least_depth_in_both_directions(spark):
    edges = spark.createDataFrame(EDGES, EDGE)
    seed = spark.createDataFrame([("c.py", "h")], "file string, func string")
    assert rows(graph.reach(edges, seed, 5), "func", "depth") == [("f", 1), ("g", 1), ("h", 0)]
    assert rows(graph.reach(edges, seed, 5, backward=False), "func", "depth") == [("f", 1), ("g", 2), ("h", 0)]


def test_dead_code_skips_entries_dunders_and_callers(spark):
    names = [("a.py", "f"), ("z.py", "lonely"), ("z.py", "main"), ("app/x.py", "y"), ("z.py", "mapper"), ("z.py", "__init__"), ("d.py", "x")]
    dead = graph.dead_code(spark.createDataFrame(names, "file string, name string"), spark.createDataFrame(EDGES, EDGE))
    assert rows(dead, "name") == [("lonely",)]  # "app" in "mapper" reads as an entry point


def test_layers_and_circular(spark):
    edges = spark.createDataFrame([*EDGES[:1], ("b.py", "k", "a.py", "m"), ("a.py", "f", "a.py", "q")], EDGE)
    assert rows(graph.layers(edges), "func", "layer") == [("f", "entry"), ("g", "leaf"), ("k", "entry"), ("m", "leaf"), ("q", "leaf")]
    assert rows(graph.circular(edges), "file_a", "file_b") == [("a.py", "b.py")]


def test_def_use_same_line_and_update(spark):
    refs = [("f", 0, "x", "definition", 1), ("f", 1, "x", "use", 2), ("f", 2, "x", "update", 2), ("f", 3, "x", "use", 3), ("f", 4, "y", "use", 3)]
    df = spark.createDataFrame(refs, "fn_id string, seq int, name string, ref_type string, line long")
    assert rows(flow.def_use(df), "var", "def_line", "use_line") == [("x", 1, 2), ("x", 1, 2), ("x", 2, 3)]


def test_identifier_words_and_paths(spark):
    df = spark.createDataFrame([("getUserData", "src/utils/async.ts"), ("XMLParser", "node_modules/@types/react/i.d.ts"), ("_private_method", "vendor/github.com/pkg/errors/e.go")], "n string, p string")
    assert [r[0] for r in df.select(code.identifier_words(F.col("n"))).collect()] == ["get user data", "xml parser", "private method"]
    assert [r[0] for r in df.select(code.package_key(F.col("p"))).collect()] == ["src", "@types/react", "github.com/pkg/errors"]
    assert [r[0] for r in df.select(code.module_matches(F.col("p"), F.lit("@/utils/async"))).collect()] == [True, False, False]


def test_token_estimate(spark):
    df = spark.createDataFrame([("",), ("Hello world",), ("漢字",), ("😀",), ("éé",), (None,)], "t string")
    assert [r[0] for r in df.select(code.token_estimate(F.col("t"))).collect()] == [0, 2, 3, 3, 1, 0]


def test_texts_are_cut_at_the_token_limit_only(spark):
    texts = ["a" * 32_771, "a" * 40_000, "é" * 20_000, "ab漢" * 3 + "x" * 50_000, "z" * 500, "", "😀" * 3000]
    most = [32_771, 32_771, 16_385, 9 + 32_771 - 24, 500, 0, 2730]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(map(tuple, df.select("i", code.truncated_to_tokens(F.col("t"), 8192)).collect()))
    assert [got[i] for i in range(len(texts))] == [t[:n] for t, n in zip(texts, most)]
    assert df.select(F.max(code.token_estimate(code.truncated_to_tokens(F.col("t"), 8192)))).first()[0] == 8192


def test_chunks_cover_and_stop_at_the_end(spark):
    text = "".join(chr(97 + i % 26) for i in range(3801))
    got = spark.createDataFrame([(text,), ("",)], "t string").select(code.chunks(F.col("t"), 2000, 200)).collect()
    assert [(c["start"], len(c["chunk"])) for c in got[0][0]] == [(0, 2000), (1800, 2000), (3600, 201)]
    assert [c["chunk"] for c in got[1][0]] == [""]


def test_savings(spark):
    df = spark.createDataFrame([(1000, 100), (0, 0)], "raw long, compact long")
    assert [r[0] for r in df.select(store.savings(F.col("raw"), F.col("compact"))).collect()] == [90.0, 0.0]


def test_snapshot_time_travel(spark):
    log = spark.createDataFrame([(1, "e", "add"), (2, "e", "remove"), (3, "e", "add"), (1, "g", "add"), (2, "g", "add"), (2, "g", "remove")], "layer int, edge_id string, op string")
    assert rows(store.snapshot(log), "edge_id", "layer") == [("e", 3)]
    assert rows(store.snapshot(log, F.col("layer") <= 1), "edge_id") == [("e",), ("g",)]


def test_diagnostic_formats(spark):
    one = lambda text: spark.createDataFrame([(text,)], "text string")
    got = lambda df: [tuple(r) for r in df.select("file", "line", "column", "severity", "message", "rule").collect()]
    assert got(diagnostics.from_lines(one("a.ts(3,4): error TS2304: No name."), "tsc")) == [("a.ts", 3, 4, "error", "No name.", "TS2304")]
    assert got(diagnostics.from_lines(one("** (Err) lib/a.ex:7: boom"), "mix")) == [("lib/a.ex", 7, 0, "error", "boom", "Err")]
    assert got(diagnostics.from_json_output(one('[{"filename":"a.py","code":"F401","message":"m","location":{"row":2,"column":1}}]'), "ruff")) == [("a.py", 2, 1, "warning", "m", "F401")]
    assert got(diagnostics.from_json_output(one('{"files":{"a.php":{"messages":[{"message":"m","line":5}]}}}'), "phpstan")) == [("a.php", 5, 0, "error", "m", None)]
    cargo = '{"reason":"compiler-message","message":{"level":"warning","message":"m","code":{"code":"c"},"spans":[{"file_name":"a.rs","line_start":1,"column_start":2,"is_primary":true}]}}'
    assert got(diagnostics.from_cargo(one(cargo))) == [("a.rs", 1, 2, "warning", "m", "c")]
    xml = '<checkstyle><file name="A.java"><error line="1" severity="error" message="m" source="s"/><error line="2" severity="warning" message="n" source="t"/></file><file name="B.java"/></checkstyle>'
    assert got(diagnostics.from_xml_output(one(xml), "checkstyle")) == [("A.java", 1, 0, "error", "m", "s"), ("A.java", 2, 0, "warning", "n", "t")]
    cpp = '<results><errors><error id="i" severity="style" msg="m"><location file="a.c" line="3"/></error></errors></results>'
    assert got(diagnostics.from_xml_output(one(cpp), "cppcheck")) == [("a.c", 3, 0, "style", "m", "i")]


SOURCE = '''
import util as u
from .lib import helper

class C(Base):
    def m(self, x):
        """Doc."""
        total = 0
        for i in x:
            if i > 0 and i < 9:
                total += i
            else:
                continue
        return self.n(total)

    def n(self, y):
        try:
            return u.work(helper(y))
        except ValueError as e:
            raise

def top(a, *rest, k=1):
    b = [z for z in rest if z]
    return top(b, key=C)
'''


def test_python_facts(spark):
    files = [("pkg/a.py", SOURCE), ("pkg/lib.py", "def helper(q):\n    return q\n"), ("util.py", "def work(q):\n    pass\n"), ("bad.py", "def (")]
    found = python_source.facts(spark.createDataFrame(files, "path string, content string")).cache()
    assert rows(python_source.of_kind(found, "function").where("path = 'pkg/a.py'"), "qualified_name", "line") == [("C.m", 6), ("C.n", 16), ("top", 22)]
    assert dict(rows(python_source.of_kind(found, "complexity").where("path = 'pkg/a.py'"), "fn", "cyclomatic")) == {"C.m": 3, "C.n": 2, "top": 2}
    assert rows(python_source.of_kind(found, "error"), "path") == [("bad.py",)]
    edges = rows(python_source.call_edges(found), "src_file", "src_func", "dst_file", "dst_func")
    assert ("pkg/a.py", "C.m", "pkg/a.py", "C.n") in edges
    assert ("pkg/a.py", "C.n", "pkg/lib.py", "helper") in edges
    assert ("pkg/a.py", "C.n", "util.py", "work") in edges
    assert ("pkg/a.py", "top", "pkg/a.py", "C") in edges
    refs = rows(python_source.of_kind(found, "var_ref").where("fn = 'C.m' and name = 'total'"), "seq", "ref_type", "line")
    assert [(k, line) for _, k, line in refs] == [("definition", 8), ("use", 11), ("update", 11), ("use", 14)]
    kinds = {r[0] for r in rows(python_source.of_kind(found, "cfg_edge").where("fn = 'C.m'"), "edge_type")}
    assert {"iterate", "exhausted", "back_edge", "continue", "true", "false", "return"} <= kinds


def test_streams_equal_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    data = [(i % 2, f"p{i % 47}", base + dt.timedelta(minutes=i)) for i in range(120)] + [(0, "late", base + dt.timedelta(days=2))]
    schema = "project long, path string, ts timestamp"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def ran(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    batch = store.triggers(spark.createDataFrame([(*r, i) for i, r in enumerate(data)], schema + ", event_id long"), 20)
    assert rows(ran(dirty.reindex_triggers(stream, 20), "t1"), "project", "trigger") == rows(batch, "project", "trigger")
    sessions = ran(dirty.idle_sessions(stream, "30 minutes", "1 hour"), "t2")
    assert (0, 60) in rows(sessions, "project", "n_events")


def test_top_k_of_every_query_across_blocks(spark):
    found = {i: [((i * 7 + j * 3) % 11 - 4) / 10 for j in range(4)] for i in range(90)}
    units = spark.createDataFrame(list(found.items()), "vec_id long, embedding array<float>")
    got = vectors.top_k_each(units, units.where("vec_id % 10 = 0"), 5, rows=8)
    score = lambda a, b: round(min(1.0, max(0.0, sum(x * y for x, y in zip(found[a], found[b])))), 6)
    assert rows(got, "query_id", "vec_id") == sorted((q, u) for q in range(0, 90, 10) for u in sorted(found, key=lambda u: (-score(q, u), u))[:5])
    assert vectors.top_k_each(units.limit(0), units.limit(0), 5).count() == 0


def test_a_trigger_clears_the_dirty_paths(spark):
    base = dt.datetime(2024, 1, 1)
    paths = ["a", "b", "a", "c", "a", None, "b", "b", "c", "a"]
    data = [(p, path, base + dt.timedelta(minutes=i), i) for p in (1, 2) for i, path in enumerate(paths)]
    events = spark.createDataFrame(data, "project long, path string, ts timestamp, event_id long")
    # a b c | a b c | a
    assert rows(store.triggers(events, 3), "project", "trigger", "at") == [(p, n, base + dt.timedelta(minutes=at)) for p in (1, 2) for n, at in ((1, 3), (2, 8))]
    assert store.triggers(events.limit(0), 3).count() == 0


def test_memory_of_a_batch_by_hand(spark):
    df = spark.createDataFrame([(512, 8), (512, 0), (0, 8)], "n long, b long")
    got = [tuple(r) for r in df.select(vectors.batch_memory(df.n, df.b), vectors.batch_memory(df.n, df.b, flash=True)).collect()]
    others = 8 * 512 * 1024 + 8 * 512 * 3072 * 2 + 8 * 512 * 1024 * 2 + 8 * 1024 + 2 * 8 * 512 * 1024
    assert got == [(int((8 * 16 * 512 * 512 + others) * 2 * 1.15), int((8 * 16 * 512 * 64 * 2 + others) * 2 * 1.15)), (0, 0), (None, None)]


def test_token_batches_equal_one_pass(spark):
    sizes = [(i * 37) % 19 for i in range(300)] + [0] * 50 + [7] * 200 + [120, 100, 101] + [100] * 3
    items = spark.createDataFrame([*enumerate(sizes), (len(sizes), None)], "doc_id long, tokens long")
    expected, batch, total = [], -1, None
    for size, i in sorted(((t or 0, i) for i, t in [*enumerate(sizes), (len(sizes), None)]), key=lambda x: (-x[0], x[1])):
        if total is None or total + size > 100:
            batch, total = batch + 1, 0
        total += size
        expected.append((i, size, batch))
    assert rows(batches.token_budget(items, 100), "doc_id", "tokens", "batch") == sorted(expected)
    assert batches.token_budget(items.limit(0), 100).count() == 0


IGNORE_CASES = [
    (["build/"], "build/a.o", True), (["build/"], "x/build/y/z", True), (["build/"], "build", False), (["/build/"], "x/build/y", False),
    (["*.log"], "a/b.log", True), (["*.log"], "a/b.log.txt", False), (["*.log"], "b.log/c", True), (["a/*.c"], "x/a/b.c", False), (["a/*.c"], "a/b/c.c", False),
    (["a/**/z"], "a/z", True), (["a/**/z"], "a/b/c/z", True), (["**/z"], "q/z", True), (["**/z"], "z", True), (["a/**"], "a/b/c", True), (["a/**"], "a", False),
    (["*.py", "!keep.py"], "x/keep.py", False), (["!keep.py", "*.py"], "keep.py", True), (["# no", "", "  "], "# no", False), (["\\#x"], "#x", True), (["\\!x"], "!x", True),
    (["[ab]?.t"], "ax.t", True), (["[!ab]?.t"], "ax.t", False), (["a.b+"], "a.b+", True), (["a.b+"], "axbb", False), (["x  "], "x", True), ([], "x", False),
]


def test_ignore_patterns(spark):
    df = spark.createDataFrame([(p,) for _, p, _ in IGNORE_CASES], "path string")
    for patterns, path, expected in IGNORE_CASES:
        found = df.where(df.path == path).select(ignore.is_ignored(df.path, patterns)).first()[0]
        assert found == expected, (patterns, path)
    assert df.select(ignore.is_ignored(df.path, ignore.DEFAULT_PATTERNS)).where("false").count() == 0
    assert [r[0] for r in spark.createDataFrame([(".env",), ("pkg/__pycache__/a.pyc",), ("src/a.py",), (None,)], "path string").select(ignore.is_ignored(F.col("path"), ignore.DEFAULT_PATTERNS)).collect()] == [True, True, False, None]


def most_rows(df) -> int:
    """The most rows that an operator of df's plan gave, once it has run."""

    def walk(plan) -> int:
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return walk(plan.plan())
        own, below = plan.metrics().get("numOutputRows"), plan.children()
        return max([own.get().value() if own.isDefined() else 0, *(walk(below.apply(i)) for i in range(below.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_calls_of_shared_targets_are_resolved_once(spark):
    sites = spark.range(300).selectExpr("'a.py' file", "concat('f', id) caller", "'t' target")
    modules = spark.range(301).selectExpr("concat('p', id, '.m') module", "'m' simple_module", "'g' name", "'m.py' file")
    bindings = modules.selectExpr("'a.py' file", "'t' local_name", "module", "name orig_name")
    found = graph.resolve_calls(sites, bindings, modules)
    assert sorted(map(tuple, found.collect())) == sorted(("a.py", f"f{i}", "m.py", "g") for i in range(300))
    assert 300 <= most_rows(found) <= 1000  # not a row for each site and binding


def test_calls_by_short_and_whole_modules_with_nulls_and_repeats(spark):
    sites = spark.createDataFrame([("a", "f", "t"), ("a", "f", "t"), ("a", "f", "u"), ("a", None, "t"), (None, "f", "t"), ("a", "g", "none")], "file string, caller string, target string")
    bound = [("a", "t", "p.m", "h"), ("a", "t", "p.m", "h"), ("a", "u", "q.m", "h"), ("a", "u", "q.k", "h"), ("a", "t", "q.x", "k"), ("a", "t", None, "h"), ("a", "u", "p.m", None), (None, "t", "p.m", "h")]
    bindings = spark.createDataFrame(bound, "file string, local_name string, module string, orig_name string")
    index = [("p.m", "m", "h", "2.py"), ("q.m", "m", "h", "1.py"), ("q.k", "z", "h", "3.py"), ("q.k", "z", "h", "4.py"), ("q.x", "x", "k", None), (None, None, "h", "0.py"), ("p.m", "m", None, "0.py")]
    found = graph.resolve_calls(sites, bindings, spark.createDataFrame(index, "module string, simple_module string, name string, file string"))
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "f", "1.py", "h"), ("a", "f", "3.py", "h"), ("a", None, "1.py", "h")]


def test_first_files_of_shared_targets_are_found_once(spark):
    sites = spark.range(300).selectExpr("'a.py' file", "concat('f', id) caller", "'t' target", "'lib' package")
    index = spark.range(1, 301).selectExpr("'t' name", "concat('lib', id, '.py') file")
    found = graph.resolve_first(sites, index)
    assert sorted(map(tuple, found.collect())) == sorted(("a.py", f"f{i}", "t", "lib1.py") for i in range(300))
    assert 300 <= most_rows(found) <= 1000  # not a row for each site and file


def test_first_files_with_nulls_and_repeats(spark):
    sites = [("a", "f", "t", "x"), ("a", "f", "t", "x"), ("a", "f", "t", "y"), ("a", "f", "t", "1"), ("a", None, "t", ""), (None, "f", "t", "y"), ("a", "g", "t", None), ("a", "g", None, "x"), ("a", "g", "u", "x")]
    index = [("t", "y/1"), ("t", "x/2"), ("t", "x/2"), ("t", "x/1"), ("t", None), (None, "x/0"), ("u", "y/0")]
    found = graph.resolve_first(spark.createDataFrame(sites, "file string, caller string, target string, package string"), spark.createDataFrame(index, "name string, file string"))
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "f", "t", "x/1"), ("a", "f", "t", "y/1"), ("a", None, "t", "x/1"), (None, "f", "t", "y/1")]
