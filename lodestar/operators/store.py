"""Versioned edges, content hashes, statistics of sessions and hooks, sessions of events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot(log: DataFrame, until: Column | None = None) -> DataFrame:
    """edge_id and layer of the edges that live at a layer: added, and not removed in that or a later layer.

    log: layer, edge_id, op ('add' or 'remove'). The last operation of an edge decides, a removal before an addition of
    its layer; one aggregation, no anti-join with an inequality.
    """
    own = log if until is None else log.where(until)
    last = own.groupBy("edge_id").agg(F.max_by(F.struct("op", "layer"), F.struct("layer", (F.col("op") == "remove").cast("int"))).alias("last"))
    return last.where("last.op = 'add'").select("edge_id", F.col("last.layer").alias("layer"))


def duplicates(files: DataFrame) -> DataFrame:
    """content_hash, n_files, first: contents that several files have. files: path, text."""
    return files.groupBy(F.sha1("text").alias("content_hash")).agg(F.count("*").alias("n_files"), F.min("path").alias("first")).where("n_files > 1")


def savings(raw: Column, compact: Column) -> Column:
    return F.when(raw > 0, F.round((raw - compact) / raw * 100, 2)).otherwise(0.0)


def hook_stats(calls: DataFrame) -> DataFrame:
    """hook, invocations, successes, failures, success_rate (100 where nothing was counted), metrics (sums by key).
    calls: hook, success, metrics (a map). Entries are summed before they meet in a map, so its size is the keys'."""
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    rate = F.when(F.count("*") == 0, 100.0).otherwise(F.round(100.0 * ok / F.count("*"), 2))
    totals = calls.groupBy("hook").agg(F.count("*").alias("invocations"), ok.alias("successes"), (F.count("*") - ok).alias("failures"), rate.alias("success_rate"))
    sums = calls.select("hook", F.explode("metrics")).groupBy("hook", "key").agg(F.sum("value").alias("value"))
    maps = sums.groupBy("hook").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metrics"))
    return totals.join(maps, "hook", "left")


def triggers(events: DataFrame, threshold: int) -> DataFrame:
    """project, trigger, at: each time that a project's distinct dirty paths since its last trigger reach threshold; a
    trigger clears them. events: project, path, ts, event_id. Null paths do not count.

    Where a trigger falls depends on all before it, so a project's events go by in their order; what is held is fewer than
    threshold paths, whatever their number (the sort spills).
    """
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, dirty, done = None, set(), 0
        for batch in batches:
            places, numbers = [], []
            for i, (own, path) in enumerate(zip(batch.column("project").to_pylist(), batch.column("path").to_pylist())):
                if own != project:
                    project, dirty, done = own, set(), 0
                dirty.add(path)
                if len(dirty) == threshold:
                    done, dirty = done + 1, set()
                    places.append(i)
                    numbers.append(done)
            fired = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([fired.column("project"), pa.array(numbers, pa.int64()), fired.column("ts")], names=["project", "trigger", "at"])

    ordered = events.where("path is not null").select("project", "path", "ts", "event_id").repartition("project").sortWithinPartitions("project", "ts", "event_id")
    return ordered.mapInArrow(run, f"project {kinds['project']}, trigger long, at {kinds['ts']}")


def idle_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """project, start, n_events of runs of events without a pause of gap."""
    return events.groupBy("project", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("project", F.col("w.start").alias("start"), "n_events")
