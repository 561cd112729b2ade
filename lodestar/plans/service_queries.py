"""Queries over vectors, versioned edges, statistics, diagnostics and event streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import code
from lodestar.operators import batches, diagnostics, store, vectors
from lodestar.plans.registry import query
from lodestar.plans.text_queries import ESTIMATE, tags_sql
from lodestar.sources import tables
from lodestar.sources.tables import table

DOT = "list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda z: z[1] * z[2]))"

def search(spark, d, chosen):
    units = table(spark, d, "embeddings")
    return vectors.top_k_each(units, units.where(chosen), 10)


ALL = f"scored AS (SELECT q.vec_id AS query_id, e.vec_id, round(least(1.0, greatest(0.0, {DOT})), 6) AS score FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q), top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10)"


@query(f"WITH {ALL} SELECT query_id, vec_id, score FROM top")
def vector_topk(spark, d):
    return search(spark, d, "vec_id % 100 = 0")


@query(f"WITH {ALL} SELECT query_id, vec_id, score, lang, {tags_sql('text')} AS tags FROM top LEFT JOIN documents ON doc_id = vec_id")
def vector_topk_expand(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "text")
    return vector_topk(spark, d).join(docs, "vec_id", "left").select("query_id", "vec_id", "score", "lang", F.array_join(code.semantic_tags(F.col("text")), ",").alias("tags"))


@query("WITH t AS (SELECT vec_id, embedding[1:16]::double[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM t) SELECT vec_id, round(v[1] / n, 6) AS first, round(list_sum(list_transform(v, lambda x: x / n)), 5) AS total FROM n")
def vector_truncate(spark, d):
    v = vectors.truncated(F.col("embedding"), 16)
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


MEMORY = "CASE WHEN n > 0 THEN floor(({} + 8 * n * 1024 + 8 * n * 3072 * 2 + 8 * n * 1024 * 2 + 8 * 1024 + 2 * 8 * n * 1024) * 2 * 1.15::double)::bigint END"


@query(f"WITH t AS (SELECT doc_id, {ESTIMATE.format('text')}::double AS n FROM documents) SELECT doc_id, {MEMORY.format('8 * 16 * n * n')} AS bytes, {MEMORY.format('8 * 16 * n * 64 * 2')} AS flash_bytes FROM t")
def batch_memory(spark, d):
    tokens = table(spark, d, "documents").select("doc_id", code.token_estimate(F.col("text")).alias("n"))
    return tokens.select("doc_id", vectors.batch_memory(F.col("n"), F.lit(8)).alias("bytes"), vectors.batch_memory(F.col("n"), F.lit(8), flash=True).alias("flash_bytes"))


BUDGET = 65536


@query(
    f"WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, tokens, row_number() OVER (ORDER BY tokens DESC, doc_id) AS n FROM (SELECT doc_id, ({ESTIMATE.format('text')})::bigint AS tokens FROM documents)), "
    "walk AS (SELECT 0::bigint AS n, 0::bigint AS doc_id, 0::bigint AS tokens, 0::bigint AS batch, 0::bigint AS total UNION ALL "
    f"SELECT t.n, t.doc_id, t.tokens, w.batch + (w.n > 0 AND w.total + t.tokens > {BUDGET})::bigint, CASE WHEN w.n > 0 AND w.total + t.tokens > {BUDGET} THEN t.tokens ELSE w.total + t.tokens END FROM walk w JOIN t ON t.n = w.n + 1) "
    "SELECT doc_id, tokens, batch FROM walk WHERE n > 0"
)
def token_batches(spark, d):
    return batches.token_budget(table(spark, d, "documents").select("doc_id", code.token_estimate(F.col("text")).alias("tokens")), BUDGET)


@query("SELECT count(*) AS total_files, count(DISTINCT sha1(text)) AS unique_hashes, count(*) - count(DISTINCT sha1(text)) AS dedup_savings FROM documents")
def dedup_stats(spark, d):
    h = F.count_distinct(F.sha1("text"))
    return table(spark, d, "documents").agg(F.count("*").alias("total_files"), h.alias("unique_hashes"), (F.count("*") - h).alias("dedup_savings"))


@query("SELECT sha1(text) AS content_hash, count(*) AS n_files, min(source || '/' || doc_id || '.' || lang) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_groups(spark, d):
    return store.duplicates(tables.document_paths(spark, d))


LOG = "log AS (SELECT date_trunc('quarter', o_orderdate) AS layer, 'c' || (o_custkey % 400) AS edge_id, CASE WHEN o_orderstatus = 'F' THEN 'remove' ELSE 'add' END AS op FROM orders), last AS (SELECT edge_id, arg_max({'op': op, 'layer': layer}, {'layer': layer, 'r': (op = 'remove')::int}) AS l FROM log "


def edge_log(spark, d):
    return table(spark, d, "orders").select(F.date_trunc("quarter", "o_orderdate").alias("layer"), F.concat(F.lit("c"), (F.col("o_custkey") % 400).cast("string")).alias("edge_id"), F.when(F.col("o_orderstatus") == "F", "remove").otherwise("add").alias("op"))


@query(f"WITH {LOG} GROUP BY edge_id) SELECT edge_id, strftime(l.layer, '%Y-%m-%d') AS layer FROM last WHERE l.op = 'add'")
def layer_snapshot(spark, d):
    return store.snapshot(edge_log(spark, d)).select("edge_id", F.date_format("layer", "yyyy-MM-dd").alias("layer"))


@query(f"WITH {LOG} WHERE layer <= timestamp '1995-06-30' GROUP BY edge_id) SELECT edge_id, strftime(l.layer, '%Y-%m-%d') AS layer FROM last WHERE l.op = 'add'")
def layer_at_time(spark, d):
    return store.snapshot(edge_log(spark, d), F.col("layer") <= F.lit("1995-06-30").cast("timestamp")).select("edge_id", F.date_format("layer", "yyyy-MM-dd").alias("layer"))


@query(f"WITH {LOG} GROUP BY edge_id) SELECT count(*) AS edges_before, count(*) FILTER (l.op = 'add') AS edges_after, strftime(max(l.layer) FILTER (l.op = 'add'), '%Y-%m-%d') AS newest FROM last")
def layer_compact(spark, d):
    live = store.snapshot(edge_log(spark, d)).agg(F.count("*").alias("edges_after"), F.date_format(F.max("layer"), "yyyy-MM-dd").alias("newest"))
    before = edge_log(spark, d).agg(F.count_distinct("edge_id").alias("edges_before"))
    one = F.lit(1)
    return before.withColumn("k", one).join(live.withColumn("k", one), "k").drop("k")


SESSION = f"s AS (SELECT conv_id, sum({ESTIMATE.format('text')})::bigint AS raw, coalesce(sum({ESTIMATE.format('text')}) FILTER (role = 'user'), 0)::bigint AS compact, count(*) AS requests FROM conversations GROUP BY conv_id)"


def sessions(spark, d):
    n = code.token_estimate(F.col("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(n).alias("raw"), F.coalesce(F.sum(F.when(F.col("role") == "user", n)), F.lit(0)).alias("compact"), F.count("*").alias("requests"))


@query(f"WITH {SESSION} SELECT conv_id, raw, compact, raw - compact AS savings, CASE WHEN raw > 0 THEN round((raw - compact) / raw * 100, 2) ELSE 0.0 END AS percent FROM s")
def session_savings(spark, d):
    return sessions(spark, d).select("conv_id", "raw", "compact", (F.col("raw") - F.col("compact")).alias("savings"), store.savings(F.col("raw"), F.col("compact")).alias("percent"))


@query(f"WITH {SESSION} SELECT sum(raw)::bigint AS raw, sum(compact)::bigint AS compact, sum(requests)::bigint AS requests FROM s")
def session_totals(spark, d):
    return sessions(spark, d).agg(F.sum("raw").alias("raw"), F.sum("compact").alias("compact"), F.sum("requests").alias("requests"))


@query("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def recent_sessions(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").select("user_id", "event_id", n.cast("long").alias("n")).where("n <= 3")


@query("WITH s AS (SELECT event_type AS hook, count(*) AS invocations, count(*) FILTER (value >= 10) AS successes FROM events GROUP BY event_type), m AS (SELECT event_type AS hook, key || '=' || sum(v)::bigint AS one FROM (SELECT event_type, unnest(['k', 'events', 'user_' || (user_id % 3)]) AS key, unnest([(props::json->>'$.k')::bigint, 1, user_id]) AS v FROM events) GROUP BY event_type, key) SELECT hook, invocations, successes, invocations - successes AS failures, CASE WHEN invocations = 0 THEN 100.0 ELSE round(100.0 * successes / invocations, 2) END AS success_rate, (SELECT string_agg(one, ',' ORDER BY one) FROM m WHERE m.hook = s.hook) AS metrics FROM s")
def hook_stats(spark, d):
    of_user = F.concat(F.lit("user_"), (F.col("user_id") % 3).cast("string"))
    more = F.create_map(F.lit("events"), F.lit(1).cast("bigint"), of_user, F.col("user_id"))
    metrics = F.map_concat(F.from_json("props", "map<string,bigint>"), more)
    calls = table(spark, d, "events").select(F.col("event_type").alias("hook"), (F.col("value") >= 10).alias("success"), metrics.alias("metrics"))
    one = F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return store.hook_stats(calls).withColumn("metrics", F.array_join(F.array_sort(one), ","))


@query("WITH daily AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT event_type, day, n, greatest(0, n - lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY day)) AS delta FROM daily) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, delta FROM d WHERE delta > 0")
def hook_deltas(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    delta = F.greatest(F.lit(0), F.col("n") - F.lag("n", 1, 0).over(Window.partitionBy("event_type").orderBy("day")))
    return daily.withColumn("delta", delta).where("delta > 0").select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "delta")


FOUND = "f AS (SELECT 'src/u' || user_id || '.c' AS file, event_id::int AS line, (props::json->>'$.k')::int AS col, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, event_type AS message FROM events WHERE event_type IN ('error', 'purchase'))"


def compiler_output(spark, d):
    """Events as lines that a C compiler would print."""
    severity = F.when(F.col("event_type") == "error", "error").otherwise("warning")
    text = F.format_string("src/u%d.c:%d:%s: %s: %s", "user_id", "event_id", F.get_json_object("props", "$.k"), severity, "event_type")
    return diagnostics.from_lines(table(spark, d, "events").where("event_type in ('error', 'purchase')").select(text.alias("text")), "gcc")


@query(f"WITH {FOUND} SELECT count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count, count(DISTINCT file) AS file_count FROM f")
def diag_counts(spark, d):
    return diagnostics.counts(compiler_output(spark, d))


@query(f"WITH {FOUND} SELECT file, line, upper(severity[1]) || ' ' || file || ':' || line || ':' || col || ': ' || message AS text FROM f")
def diag_render(spark, d):
    text = diagnostics.rendered(*map(F.col, ("severity", "file", "line", "column", "message", "rule")))
    return compiler_output(spark, d).select("file", "line", text.alias("text"))


@query("SELECT 'u' || user_id || '.py' AS file, (props::json->>'$.k')::int + 1 AS line, event_id::int + 1 AS column, event_type AS severity, event_type AS message, 'r' || (event_id % 7) AS rule FROM events")
def diag_parse_json(spark, d):
    one = F.struct(F.format_string("u%d.py", "user_id").alias("file"), F.col("event_type").alias("severity"), F.col("event_type").alias("message"), F.format_string("r%d", F.col("event_id") % 7).alias("rule"), F.struct(F.struct(F.get_json_object("props", "$.k").cast("int").alias("line"), F.col("event_id").cast("int").alias("character")).alias("start")).alias("range"))
    outputs = table(spark, d, "events").select(F.to_json(F.struct(F.array(one).alias("generalDiagnostics"))).alias("text"))
    return diagnostics.from_json_output(outputs, "pyright").drop("source")


def file_events(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("project"), F.get_json_object("props", "$.k").alias("path"), "ts", "event_id")


@query(
    "WITH RECURSIVE f AS MATERIALIZED (SELECT user_id % 20 AS project, props::json->>'$.k' AS path, ts, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events WHERE props::json->>'$.k' IS NOT NULL), "
    "walk AS (SELECT DISTINCT project, 0::bigint AS n, []::varchar[] AS dirty, 0::bigint AS trigger, NULL::timestamp AS fired FROM f UNION ALL "
    "SELECT f.project, f.n, CASE WHEN list_contains(w.dirty, f.path) THEN w.dirty WHEN len(w.dirty) = 19 THEN []::varchar[] ELSE list_append(w.dirty, f.path) END, "
    "w.trigger + (NOT list_contains(w.dirty, f.path) AND len(w.dirty) = 19)::bigint, CASE WHEN NOT list_contains(w.dirty, f.path) AND len(w.dirty) = 19 THEN f.ts END FROM walk w JOIN f ON f.project = w.project AND f.n = w.n + 1) "
    "SELECT project, trigger, strftime(fired, '%Y-%m-%d %H:%M:%S') AS at FROM walk WHERE fired IS NOT NULL"
)
def reindex_triggers(spark, d):
    return store.triggers(file_events(spark, d), 20).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("WITH g AS (SELECT user_id AS project, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < interval 6 hours THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT project, ts, sum(fresh) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT project, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events FROM s GROUP BY project, n")
def idle_sessions(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("project"), "ts")
    return store.idle_sessions(events, "6 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
