"""Tables, files, and the views that let ordinary tables stand in for code facts.

The kernels in ``lodestar.operators`` only see the schemas of code facts; these views (and ``python_source`` for real
code) feed them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import ignore
from lodestar.plans.lineage import once

#: Directories that hold no source of the project itself.
SKIPPED = ["node_modules", "__pycache__", ".git", ".svn", ".hg", "dist", "build", ".next", ".nuxt", "coverage", ".tox", "venv", ".venv", "env", ".env", "vendor", ".cache"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_files(spark: SparkSession, root: str, extensions: list[str], largest: int = 5_000_000, ignored: list[str] | None = None) -> DataFrame:
    """path, size, mtime, content of the source files under root; size and extension prune before contents are read. ignored:
    lines of an ignore file (``ignore.patterns_of``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}").load(root)
    binary = F.instr(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), "\0") > 0
    inside = F.regexp_replace("path", rf"^(?:[a-z0-9]+:)?/*{re.escape(root.split(':')[-1].strip('/'))}/", "")
    return files.where((F.col("length") <= largest) & is_source(inside) & ~ignore.is_ignored(inside, ignored or [])).where(~binary).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def is_source(path: Column, skip_hidden: bool = True) -> Column:
    """No part of the path is skipped or hidden."""
    parts = F.split(path, "/")
    bad = lambda x: x.isin(SKIPPED) | (x.startswith(".") if skip_hidden else F.lit(False))
    return ~F.exists(parts, bad)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s_suppkey, s_nationkey, file, func."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", "s_nationkey", F.concat(F.lit("nation/"), "n_name").alias("s_file"), F.concat(F.lit("s"), "s_suppkey").alias("s_func"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the functions of its customer, part and supplier."""
    t = lambda n: table(spark, sf_dir, n)
    part = t("part").select("p_partkey", F.concat(F.lit("brand/"), "p_brand").alias("p_file"), F.concat(F.lit("p"), "p_partkey").alias("p_func"))
    names = F.concat(F.lit("seg/"), "c_mktsegment").alias("c_file"), F.concat(F.lit("c"), "c_custkey").alias("c_func")
    customer = t("customer").select("c_custkey", "c_nationkey", *names)
    orders = t("orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.join(suppliers(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))


def _edge(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(f"{a}_file").alias("src_file"), F.col(f"{a}_func").alias("src_func"), F.col(f"{b}_file").alias("dst_file"), F.col(f"{b}_func").alias("dst_func"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_file, src_func, dst_file, dst_func, from all lines: customers call parts, parts suppliers, suppliers the
    customers of their own nation; labels call documents. Built once in an application, by callee."""

    def build() -> DataFrame:
        lines = shipments(spark, sf_dir)
        docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), "source").alias("d_file"), F.concat(F.lit("d"), "doc_id").alias("d_func"))
        labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("label/quality").alias("q_file"), F.concat(F.lit("q"), "quality").alias("q_func"))
        families = [_edge(lines, "c", "p"), _edge(lines, "p", "s"), _edge(lines.where("c_nationkey = s_nationkey"), "s", "c")]
        whole = _edge(labels.join(docs, "doc_id"), "q", "d")
        for family in families:
            whole = whole.unionByName(family)
        return whole.distinct()

    return once(spark, f"call_edges of {sf_dir}", build)


def back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More edges: suppliers call the parts that came back. With call_edges they make files that call each other."""
    return once(spark, f"back_edges of {sf_dir}", lambda: _edge(shipments(spark, sf_dir).where("l_returnflag = 'R'"), "s", "p").distinct())


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, name: every customer, part, supplier and document. Documents without a label are called by nothing."""
    t = lambda n: table(spark, sf_dir, n)
    named = lambda df, a, b, p: df.select(F.concat(F.lit(a[0]), a[1]).alias("file"), F.concat(F.lit(p), b).alias("name"))
    first = named(t("customer"), ("seg/", "c_mktsegment"), "c_custkey", "c").unionByName(named(t("part"), ("brand/", "p_brand"), "p_partkey", "p"))
    more = suppliers(spark, sf_dir).select(F.col("s_file").alias("file"), F.col("s_func").alias("name"))
    return first.unionByName(more).unionByName(named(t("documents"), ("doc/", "source"), "doc_id", "d"))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a function: fn_id, line, k, kind of reference, block. Numbered once in an application."""
    return once(spark, f"numbered_events of {sf_dir}", lambda: _numbered(spark, sf_dir))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "definition").when(F.col("event_type") == "error", "update").otherwise("use")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("fn_id"), F.row_number().over(in_order).cast("long").alias("line"), k.alias("k"), kind.alias("ref_type"), (k % 10).alias("block"), "ts", "event_id", "event_type", "value")


def var_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_id, seq, name, ref_type, line, col."""
    return numbered_events(spark, sf_dir).select("fn_id", F.col("line").alias("seq"), F.concat(F.lit("v"), "k").alias("name"), "ref_type", "line", F.lit(0).alias("col"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn_id, src, dst: control edges between the blocks of consecutive lines."""
    after = F.lead("block").over(Window.partitionBy("fn_id").orderBy("line"))
    return numbered_events(spark, sf_dir).select("fn_id", F.col("block").alias("src"), after.alias("dst")).where("dst is not null").distinct()


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang")).alias("path"), "text", "lang", "source")


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, module: links of pages as imports, one row for each."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("file"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("module"))
