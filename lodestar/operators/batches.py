"""Batches of texts for a model: longest first, each filled up to a budget of tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.lineage import written


def filled(runs: Iterable[tuple[int, int]], budget: int) -> Iterator[tuple[int, int, int, int]]:
    """(size, batch, first, each) of runs (size, number of items), largest size first: the first items of the run go to
    batch, which was open; the others follow in new ones, each so many."""
    batch, total = -1, budget + 1
    for size, items in runs:
        room = 0 if total > budget else (budget - total) // size if size else items
        first, each = min(items, room), max(1, budget // size) if size else items
        yield size, batch, first, each
        rest = items - first
        if rest:
            new = -(-rest // each)
            batch, total = batch + new, (rest - (new - 1) * each) * size
        else:
            total += first * size


def token_budget(items: DataFrame, budget: int = 65536, key: str = "doc_id") -> DataFrame:
    """key, tokens, batch (from 0). items: key, tokens; in the order of tokens (most first; null as 0), then key, an item
    goes to the open batch, or opens the next one if the batch would exceed budget. An item above budget is alone.

    Items of one size are alike, so the plan is made on the histogram of sizes, which has budget + 2 rows at most; ranks
    are counted by range of the order, so that a size that many items have is many tasks.
    """
    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
    sized = items.select(F.col(key), tokens.alias("tokens"), F.least(tokens, F.lit(budget + 1)).alias("size"))
    placed = written(sized.repartitionByRange(F.desc("tokens"), key).withColumn("part", F.spark_partition_id()), "placed")
    counts = written(placed.groupBy("size", "part").count(), "counts")
    runs = [(r["size"], r["n"]) for r in counts.groupBy("size").agg(F.sum("count").alias("n")).orderBy(F.desc("size")).collect()]
    plan = items.sparkSession.createDataFrame(list(filled(runs, budget)), "size long, open long, first long, each long")
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("size", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part", "size").orderBy(F.desc("tokens"), key)) - 1
    ranked = placed.withColumn("inside", inside).join(starts, ["size", "part"]).join(plan, "size").withColumn("rank", F.col("start") + F.col("inside"))
    batch = F.when(F.col("rank") < F.col("first"), F.col("open")).otherwise(F.col("open") + 1 + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    return ranked.select(key, "tokens", batch.cast("long").alias("batch"))
