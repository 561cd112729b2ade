"""Scoring of unit vectors: exact inner products, truncation, memory of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def truncated(v: Column, dims: int) -> Column:
    """The first dims values, of unit length again."""
    short = F.transform(F.slice(v, 1, dims), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(short, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(short, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def in_blocks(vectors: DataFrame, prefix: str, rows: int, key: str, vector: str) -> tuple[DataFrame, int]:
    """One row for each block of about rows vectors: block, ids, values end to end; and the number of blocks."""
    n = max(1, -(-vectors.count() // rows))
    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(f"{prefix}_block")
    packed = vectors.groupBy(block).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))).alias("c"))
    return packed.select(f"{prefix}_block", F.transform("c", lambda x: x["k"]).alias(f"{prefix}_ids"), F.flatten(F.transform("c", lambda x: x["v"])).alias(f"{prefix}_values")), n


def top_k_each(units: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", rows: int = 1024) -> DataFrame:
    """query_id, key, score: for each row of queries the k units of the highest inner product (clipped to 0..1), ties by
    key. Every block of queries meets every block of units; of a pair of blocks only what can be among the k goes on."""
    u, n = in_blocks(units.where(F.col(vector).isNotNull()), "u", rows, key, vector)
    q, _ = in_blocks(queries.where(F.col(vector).isNotNull()), "q", rows, key, vector)
    pairs = u.join(q.withColumn("u_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), "u_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                u_ids, u_values, q_ids, q_values = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("u_ids", "u_values", "q_ids", "q_values"))
                scores = np.clip(q_values.astype(np.float64).reshape(len(q_ids), -1) @ u_values.astype(np.float64).reshape(len(u_ids), -1).T, 0, 1)
                least = np.partition(scores, -min(k, len(u_ids)), axis=1)[:, -min(k, len(u_ids))]
                a, b = np.nonzero(scores >= least[:, None] - 2e-6)  # more than rounding can exchange
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a], pa.int64()), pa.array(u_ids[b], pa.int64()), pa.array(scores[a, b])], names=["query_id", key, "score"])

    found = pairs.select("u_ids", "u_values", "q_ids", "q_values").mapInArrow(run, f"query_id long, {key} long, score double").withColumn("score", F.round("score", 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def batch_memory(tokens: Column, batch: Column, flash: bool = False, hidden: int = 1024, heads: int = 16, inner_size: int = 3072, output: int = 1024, bytes_each: int = 2, margin: float = 1.15) -> Column:
    """Estimated bytes of a batch whose longest text has that many tokens: attention (all pairs of tokens by head, or with
    flash two buffers of the tokens), input, gate and up of the inner layer, residuals, output, keys and values. An empty
    batch needs none; null where there is no token. Sizes are those of the default model of 0.6B parameters."""
    n, b = tokens.cast("double"), batch.cast("double")
    attention = b * n * (2 * hidden) if flash else b * heads * n * n
    values = attention + b * n * hidden + b * n * (2 * inner_size) + b * n * (2 * hidden) + b * output + b * n * (2 * hidden)
    return F.when(b == 0, 0).when(n > 0, F.floor(values * bytes_each * margin)).cast("long")
