"""File events as streams: rebuild triggers and idle sessions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def reindex_triggers(events: DataFrame, threshold: int = 20) -> DataFrame:
    """project, trigger, n_paths of a stream (project, path, ts): a row each time a project's distinct dirty paths
    since its last trigger reach threshold; a trigger clears them. Null paths do not count. State: fewer than threshold
    paths of a project."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, dirty = state.get if state.exists else (0, [])
        dirty = list(dirty)
        out: list[tuple[Any, int, int]] = []
        rows = pd.concat(list(batches)).sort_values(["ts", "path"])
        for path in rows["path"].dropna():
            if path in dirty:
                continue
            dirty.append(path)
            if len(dirty) == threshold:
                done += 1
                out.append((key[0], done, threshold))
                dirty = []
        state.update((done, dirty))
        yield pd.DataFrame(out, columns=["project", "trigger", "n_paths"])

    return events.groupBy("project").applyInPandasWithState(step, "project long, trigger long, n_paths long", "done long, dirty array<string>", "append", GroupStateTimeout.NoTimeout)


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """project, start, end, n_events of sessions that ended; events later than late are dropped."""
    return events.withWatermark("ts", late).groupBy("project", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def append_deltas(stream: DataFrame, path: str, checkpoint: str):
    """Hook statistics by batch, appended to a table; the query's checkpoint makes each batch count once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("hook").agg(F.count("*").alias("invocations"), F.count_if("success").alias("successes")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
