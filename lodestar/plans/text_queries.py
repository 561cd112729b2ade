"""Queries over texts, names and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import code, ignore
from lodestar.operators import graph
from lodestar.plans.registry import query
from lodestar.sources import tables
from lodestar.sources.tables import table

DOCS = "docs AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, text, lang, source FROM documents)"
STRIP = r"regexp_replace({}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
LICENSE = "(license|Public)"


def lines(spark, d):
    parts = F.split("text", "\n")
    return tables.document_paths(spark, d).select("path", parts.alias("all"), F.posexplode(parts).alias("i", "content"))


def stripped(c):
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


@query(f"WITH {DOCS}, l AS (SELECT path, string_split(text, chr(10)) AS a FROM docs), x AS (SELECT path, unnest(a) AS content, unnest(range(1, len(a) + 1)) AS line FROM l) SELECT path, line, {STRIP.format('content')} AS content FROM x WHERE regexp_matches(content, '{LICENSE}')")
def regex_search(spark, d):
    return lines(spark, d).where(F.col("content").rlike(LICENSE)).select("path", (F.col("i") + 1).cast("long").alias("line"), stripped("content").alias("content"))


@query(f"WITH {DOCS}, l AS (SELECT path, string_split(text, chr(10)) AS a FROM docs), x AS (SELECT path, a, unnest(a) AS content, unnest(range(1, len(a) + 1)) AS line FROM l) SELECT path, line, array_to_string(a[greatest(1, line - 1):line + 1], chr(10)) AS context FROM x WHERE regexp_matches(content, '{LICENSE}')")
def regex_search_context(spark, d):
    first = F.greatest(F.lit(0), F.col("i") - 1)
    near = F.slice("all", first + 1, F.col("i") + 2 - first)
    return lines(spark, d).where(F.col("content").rlike(LICENSE)).select("path", (F.col("i") + 1).cast("long").alias("line"), F.array_join(near, "\n").alias("context"))


def tags_sql(text: str) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches(lower({text}), '(^|[^A-Za-z0-9_])({w})([^A-Za-z0-9_]|$)') THEN '{t}' END" for t, w in sorted(code.TAGS.items()))
    return f"concat_ws(',', {each})"


@query(f"SELECT doc_id, {tags_sql('text')} AS tags FROM documents")
def semantic_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(code.semantic_tags(F.col("text")), ",").alias("tags"))


def count_sql(words: str) -> str:
    return f"len(list_filter(string_split(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g'), ' '), lambda t: t IN ({', '.join(repr(w) for w in words.split('|'))})))"


@query(f"SELECT doc_id, list_max(list_transform(string_split(text, chr(10)), lambda l: length(replace(regexp_extract(l, '^([ \\t]*)[^ \\t]', 1), chr(9), '    ')) // 4)) AS depth, {count_sql(code.BRANCHES)} AS branches, {count_sql(code.LOOPS)} AS loops FROM documents")
def text_complexity(spark, d):
    return table(spark, d, "documents").select("doc_id", code.max_depth(F.col("text")).alias("depth"), code.count_words(F.col("text"), code.BRANCHES).alias("branches"), code.count_words(F.col("text"), code.LOOPS).alias("loops"))


ESTIMATE = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, floor(length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')) / 4 + (length({0}) - length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g'))) / 2))::bigint END"


@query(f"SELECT doc_id, {ESTIMATE.format('text')} AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", code.token_estimate(F.col("text")).alias("tokens"))


@query(f"WITH {DOCS}, n AS (SELECT path, text, greatest(1, ceil((length(text) - 2000) / 1800) + 1)::int AS n FROM docs), c AS (SELECT path, text, unnest(range(0, n)) AS chunk_index FROM n) SELECT path, chunk_index::bigint AS chunk_index, (chunk_index * 1800)::bigint AS start, length(substring(text, chunk_index * 1800 + 1, 2000)) AS n_chars, sha1(substring(text, chunk_index * 1800 + 1, 2000)) AS sha1 FROM c")
def chunk_documents(spark, d):
    cut = tables.document_paths(spark, d).select("path", F.explode(code.chunks(F.col("text"), 2000, 200)).alias("c"))
    return cut.select("path", F.col("c.chunk_index").cast("long").alias("chunk_index"), F.col("c.start").cast("long").alias("start"), F.length("c.chunk").cast("long").alias("n_chars"), F.sha1("c.chunk").alias("sha1"))


@query("WITH n AS (SELECT p_partkey, replace(p_type, ' ', '_') || upper(left(p_name, 2)) || initcap AS name FROM (SELECT *, upper(left(p_brand, 1)) || lower(substring(p_brand, 2)) AS initcap FROM part)) SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(name, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))) AS words FROM n")
def identifier_words(spark, d):
    name = F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.upper(F.substring("p_name", 1, 2)), F.upper(F.substring("p_brand", 1, 1)), F.lower(F.substring("p_brand", 2, 100)))
    return table(spark, d, "part").select("p_partkey", code.identifier_words(name).alias("words"))


MOST_TOKENS = 8192
UNIT = f"{DOCS}, u AS (SELECT doc_id, concat_ws(chr(10), 'Name: ' || path, 'Language: ' || lang, CASE WHEN {tags_sql('text')} <> '' THEN 'Tags: ' || {tags_sql('text')} END, 'Code:', text) AS t FROM docs JOIN embeddings ON doc_id = vec_id), l AS (SELECT doc_id, t FROM u WHERE {ESTIMATE.format('t')} > {MOST_TOKENS}), c AS (SELECT doc_id, unnest(range(1, length(t) + 1)) AS i, unnest(string_split(t, '')) AS c FROM l), w AS (SELECT doc_id, i, sum(CASE WHEN unicode(c) < 128 THEN 1 ELSE 2 END) OVER (PARTITION BY doc_id ORDER BY i) AS w FROM c), n AS (SELECT doc_id, max(i) AS n FROM w WHERE w // 4 <= {MOST_TOKENS} GROUP BY doc_id)"


@query(f"WITH {UNIT} SELECT doc_id, CASE WHEN n IS NULL THEN t ELSE left(t, n) END AS unit_text FROM u LEFT JOIN n USING (doc_id)")
def embedding_text(spark, d):
    units = tables.document_paths(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    tags = F.array_join(code.semantic_tags(F.col("text")), ",")
    whole = F.concat_ws("\n", F.concat(F.lit("Name: "), "path"), F.concat(F.lit("Language: "), "lang"), F.when(tags != "", F.concat(F.lit("Tags: "), tags)), F.lit("Code:"), "text")
    return units.select("doc_id", whole.alias("whole")).select("doc_id", code.truncated_to_tokens(F.col("whole"), MOST_TOKENS).alias("unit_text"))


PATHS = "paths AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'src/' || source || '/mod' || doc_id || '.py' WHEN 1 THEN 'tests/' || source || '/a' || doc_id || '.py' WHEN 2 THEN 'node_modules/@scope/' || source || '/i' || doc_id || '.js' WHEN 3 THEN 'node_modules/' || source || '/i' || doc_id || '.test.ts' WHEN 4 THEN '.venv/lib/site-packages/' || source || '/__init__.py' WHEN 5 THEN 'vendor/github.com/' || source || '/p' || doc_id || '/x_test.go' WHEN 6 THEN 'vendor/' || source || '/y' || doc_id || '.rb' WHEN 7 THEN 'lib/' || lang || '/generated/' || doc_id || '.rs' ELSE source || '/test_' || doc_id || '.py' END AS path FROM documents)"


def paths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr("CASE doc_id % 9 WHEN 0 THEN 'src/' || source || '/mod' || doc_id || '.py' WHEN 1 THEN 'tests/' || source || '/a' || doc_id || '.py' WHEN 2 THEN 'node_modules/@scope/' || source || '/i' || doc_id || '.js' WHEN 3 THEN 'node_modules/' || source || '/i' || doc_id || '.test.ts' WHEN 4 THEN '.venv/lib/site-packages/' || source || '/__init__.py' WHEN 5 THEN 'vendor/github.com/' || source || '/p' || doc_id || '/x_test.go' WHEN 6 THEN 'vendor/' || source || '/y' || doc_id || '.rb' WHEN 7 THEN 'lib/' || lang || '/generated/' || doc_id || '.rs' ELSE source || '/test_' || doc_id || '.py' END").alias("path"))


@query(f"WITH {PATHS} SELECT doc_id, doc_id % 9 IN (1, 3, 5, 8) AS is_test FROM paths")
def is_test(spark, d):
    return paths(spark, d).select("doc_id", code.is_test(F.col("path")).alias("is_test"))


@query(f"WITH {PATHS} SELECT doc_id, CASE WHEN doc_id % 9 BETWEEN 2 AND 6 THEN 'durable' ELSE 'volatile' END AS durability FROM paths")
def durability_split(spark, d):
    return paths(spark, d).select("doc_id", F.when(code.is_durable(F.col("path")), "durable").otherwise("volatile").alias("durability"))


@query("SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'src' WHEN 1 THEN 'tests' WHEN 2 THEN '@scope/' || source WHEN 3 THEN source WHEN 4 THEN source WHEN 5 THEN 'github.com/' || source || '/p' || doc_id WHEN 6 THEN source WHEN 7 THEN 'lib' ELSE source END AS package FROM documents")
def package_key(spark, d):
    return paths(spark, d).select("doc_id", code.package_key(F.col("path")).alias("package"))


@query(f"WITH {PATHS} SELECT doc_id, replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM paths")
def module_names(spark, d):
    return paths(spark, d).select("doc_id", code.module_name(F.col("path")).alias("module"))


@query(f"WITH {PATHS} SELECT doc_id, path FROM paths WHERE (path LIKE 'src/%' OR path LIKE 'lib/%' OR path LIKE 'vendor/%') AND path NOT LIKE '%/generated/%' AND path NOT LIKE '%.rb'")
def workspace_filter(spark, d):
    return paths(spark, d).where(code.in_workspace(F.col("path"), ["src", "lib", "vendor"], ["**/generated/**", "*.rb"]))


@query(f"WITH {PATHS} SELECT doc_id, path FROM paths WHERE doc_id % 9 IN (0, 1, 7, 8) AND regexp_matches(path, '\\.(py|rs)$')")
def scan_filter(spark, d):
    return paths(spark, d).where(tables.is_source(F.col("path")) & F.col("path").rlike(r"\.(py|rs)$"))


@query("SELECT lang, n_files FROM (SELECT lang, count(*) AS n_files FROM documents GROUP BY lang) ORDER BY n_files DESC, lang LIMIT 1")
def detect_language(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "lang").limit(1)


TREE = "p AS (SELECT DISTINCT string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS a FROM pages), e AS (SELECT DISTINCT array_to_string(a[1:i-1], '/') AS parent, a[i] AS name, i = len(a) AS is_file FROM (SELECT a, unnest(range(2, len(a) + 1)) AS i FROM p))"


@query(f"WITH {TREE} SELECT parent, count(*) AS n_children, string_agg(name, ',' ORDER BY is_file, lower(name), name) AS children FROM e GROUP BY parent")
def file_tree(spark, d):
    parts = table(spark, d, "pages").select(F.split(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/").alias("a")).distinct()
    each = parts.where(F.size("a") > 1).select("a", F.explode(F.sequence(F.lit(2), F.size("a"))).alias("i"))
    entries = each.select(F.array_join(F.slice("a", 1, F.col("i") - 1), "/").alias("parent"), F.get("a", F.col("i") - 1).alias("name"), (F.col("i") == F.size("a")).alias("is_file")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("is_file", F.lower("name").alias("low"), "name")))
    return entries.groupBy("parent").agg(F.count("*").alias("n_children"), F.array_join(F.transform(ordered, lambda x: x["name"]), ",").alias("children"))


IMPORTS = "imp AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS file, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS module FROM pages)"
NORMAL = "regexp_replace(regexp_replace(regexp_replace({}, '^(@/|~/|\\./|\\.\\./|src/|lib/|app/|packages/)+', ''), '(?i)\\.(" + code.EXTENSIONS + ")$', ''), '/index$', '')"


@query(f"WITH {IMPORTS}, n AS (SELECT *, {NORMAL.format('module')} AS m FROM imp) SELECT file, module FROM n WHERE contains(module, 'src/the') OR m = 'the' OR ends_with(m, '/the') OR starts_with(m, 'the/')")
def importers(spark, d):
    return tables.page_imports(spark, d).where(code.module_matches(F.lit("src/the"), F.col("module")))


@query(f"WITH {IMPORTS}, t AS (SELECT DISTINCT 'tests/' || file AS test, lower(ltrim(module, '/')) || '.' || left(lower(ltrim(module, '/')), 1) AS module FROM imp), c AS (SELECT 'the' AS m UNION SELECT 'and' UNION SELECT 'of.o') SELECT DISTINCT test, module FROM t JOIN c ON module = m OR starts_with(module, m || '.')")
def tests_importing(spark, d):
    low = F.lower(F.regexp_replace("module", "^/+", ""))
    tests = tables.page_imports(spark, d).select(F.concat(F.lit("tests/"), "file").alias("test"), F.concat_ws(".", low, F.substring(low, 1, 1)).alias("module")).distinct()
    return graph.tests_importing(tests, spark.createDataFrame([("the",), ("and",), ("of.o",)], "m string"))


NESTED = "SELECT o_custkey AS file, o_orderkey AS name, o_orderpriority AS params, o_orderstatus AS kind FROM orders"


def modules(spark, d):
    """Orders as functions of a module: one row a file with nested functions."""
    o = table(spark, d, "orders")
    return o.groupBy(F.concat(F.lit("f"), "o_custkey").alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("name"), F.col("o_orderpriority").alias("params"), F.col("o_orderstatus").alias("kind")))).alias("functions"))


@query("SELECT 'f' || o_custkey AS file, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey) AS functions, count(*) AS n FROM orders GROUP BY o_custkey")
def code_structure(spark, d):
    return modules(spark, d).select("file", F.array_join(F.transform("functions", lambda f: f["name"].cast("string")), ",").alias("functions"), F.size("functions").cast("long").alias("n"))


@query("SELECT 'f' || o_custkey AS file, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey) AS functions FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def extract_filter(spark, d):
    chosen = F.filter("functions", lambda f: f["kind"] == "P")
    return modules(spark, d).withColumn("chosen", chosen).where(F.size("chosen") > 0).select("file", F.array_join(F.transform("chosen", lambda f: f["name"].cast("string")), ",").alias("functions"))


LANGS = ["python", "typescript", "go", "rust", "java", "ruby", "php"]


@query("""WITH s AS (SELECT p_partkey, ['python', 'typescript', 'go', 'rust', 'java', 'ruby', 'php'][(p_partkey % 7 + 1)::int] AS l, 'f' || p_partkey || '(a, b)' AS f, CASE WHEN p_size % 2 = 0 THEN 'int' END AS r FROM part)
SELECT p_partkey, CASE l WHEN 'python' THEN 'def ' || f || coalesce(' -> ' || r, '') WHEN 'typescript' THEN 'function ' || f || coalesce(': ' || r, '') WHEN 'go' THEN 'func ' || f || coalesce(' ' || r, '') WHEN 'rust' THEN 'fn ' || f || coalesce(' -> ' || r, '') WHEN 'java' THEN coalesce(r || ' ', '') || f WHEN 'ruby' THEN 'def ' || f ELSE 'function ' || f END AS signature FROM s""")
def signatures(spark, d):
    lang = F.get(F.array(*map(F.lit, LANGS)), (F.col("p_partkey") % 7).cast("int"))
    own = code.signature(lang, F.concat(F.lit("f"), "p_partkey"), F.array(F.lit("a"), F.lit("b")), F.when(F.col("p_size") % 2 == 0, "int"), F.lit(False))
    return table(spark, d, "part").select("p_partkey", own.alias("signature"))


#: French texts but those whose number ends in 7; German ones whose number begins with 1; two-digit numbers that end in 2.
IGNORED = ["# an example", "*.fr", "!*7.fr", "/*/1*.de", "**/?2.*"]


@query("SELECT source || '/' || doc_id || '.' || lang AS path, (lang = 'fr' AND doc_id % 10 <> 7) OR (lang = 'de' AND left(doc_id::varchar, 1) = '1') OR (doc_id BETWEEN 10 AND 99 AND doc_id % 10 = 2) AS ignored FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def ignored_paths(spark, d):
    paths = tables.document_paths(spark, d).where("lang is not null and source is not null")
    return paths.select("path", ignore.is_ignored(F.col("path"), IGNORED).alias("ignored"))
