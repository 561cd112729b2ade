"""SimHash fingerprints of 128 bits, and the search for all fingerprints within a Hamming radius.

Terms are runs of three words of the lower-cased text (all words as one term if there are fewer; a word of over 32
characters counts as its runs of five characters). Each occurrence of a term votes on all bits, so a term weighs as
often as it occurs. A bit is set if more votes are for it than against. Equal texts have equal fingerprints; a text
without terms has all bits clear.

The search cuts fingerprints into radius + 2 blocks and keeps one table for each two of them, permuted so that these are
in front as the key: two fingerprints that differ in at most radius bits agree in two whole blocks at least, so equal keys
find every pair. A table's rows are split by ``salt``, and queries are repeated for each split, so that a key that very
many fingerprints share is not one task.

Null or empty text: as a text without terms. Null doc_id: last in the order of ids. Rows with one id go by their text.
Very long texts: whole. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Memo, held, parts_of, stored, texts

WORDS, BITS, LONG_WORD, RUN = 3, 128, 32, 5
#: +1 for each set bit of a byte, -1 for each clear one, highest bit first.
VOTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) * 2 - 1
#: Odd multipliers that mix words into terms.
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]


def hash_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


def scrambled(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * by
    return h ^ (h >> np.uint64(32))


def terms(text: str) -> np.ndarray:
    """64-bit hashes of the terms, one for each occurrence."""
    words = text.lower().split()
    if any(len(w) > LONG_WORD for w in words):
        words = [x for w in words for x in ([w] if len(w) <= LONG_WORD else [w[i : i + RUN] for i in range(len(w) - RUN + 1)])]
    h = np.fromiter(map(held(Memo, hash_of).__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) * MIX[0] + h[i : i + n] * MIX[1]
    return out


def fingerprints(batch: list[str]) -> np.ndarray:
    """A row of BITS / 8 bytes for each text."""
    found = [terms(t) for t in batch]
    doc = np.repeat(np.arange(len(found)) * 256, [len(x) for x in found])
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    both = np.stack([scrambled(h, MIX[2]), scrambled(h, MIX[3])], axis=1).view(np.uint8).reshape(-1, BITS // 8)
    out = np.empty((len(batch), BITS // 8), np.uint8)
    for j in range(BITS // 8):
        votes = np.bincount(doc + both[:, j], minlength=256 * len(batch)).reshape(-1, 256) @ VOTES
        out[:, j] = np.packbits(votes > 0, axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, by rows."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "text", 1_000_000):
                found = [x.tobytes().hex() for x in fingerprints(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def block_keys(fingerprint_column: str, radius: int):
    """The keys of the permuted tables: (numbers of the two blocks, their bits), blocks of whole hexadecimal digits."""
    n = radius + 2
    edges = [round(i * BITS / 4 / n) for i in range(n + 1)]
    block = [F.substring(fingerprint_column, a + 1, b - a) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.concat(F.lit(f"{i},{j}:"), block[i], block[j]) for i, j in itertools.combinations(range(n), 2)])


def distance(a: str, b: str):
    """Differing bits of two hexadecimal columns, in SQL."""
    part = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    return sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(BITS // 32)), F.lit(0))


def search(queries: DataFrame, all_rows: DataFrame, radius: int = 3, salt: int = 16) -> DataFrame:
    """query_fp, fingerprint, distance: for each distinct fingerprint of queries all distinct ones of all_rows within
    radius. Both have a column fingerprint; equal fingerprints count once, so a group of copies costs one row."""

    def side(df: DataFrame, name: str, split) -> DataFrame:
        own = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return own.withColumn("split", split).withColumn("key", F.explode(block_keys(name, radius)))

    first = side(queries, "query_fp", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    second = side(all_rows, "fingerprint", F.pmod(F.hash("fingerprint"), F.lit(salt)))
    found = first.join(second, ["key", "split"]).withColumn("distance", distance("query_fp", "fingerprint"))
    return found.where(F.col("distance") <= radius).drop("key", "split").distinct()


def with_next(docs: DataFrame, bytes_in_bucket: int = 24_000_000, least: int = 48, most: int = 100_000) -> DataFrame:
    """doc_id, text in buckets of neighbouring ids, each bucket one partition and in descending order of doc_id, with
    bucket and helper; a last row of each bucket with helper = 1 repeats the next bucket's first row (the very first row
    after the very last one). Null ids come last; rows with one id go by their text.

    The order is global but no task sees all rows. Buckets have about equal bytes: quantiles of the ids, four times as
    many as buckets, are put together by their bytes. There are ``most`` buckets at most (larger ones then), and for each
    one id goes to the driver and back, so both are bounded.
    """
    spark, own = docs.sparkSession, texts(docs)
    sized = own.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    n = min(most, max(least, -(-total // bytes_in_bucket)))
    fine = [i / (4 * n) for i in range(1, 4 * n)]
    edges = np.unique(np.array(sized.dropna().approxQuantile("doc_id", fine, 0.1 / n), dtype=np.float64)).astype(np.int64)

    def place(doc_id: pd.Series, of: np.ndarray) -> pd.Series:
        known = doc_id.notna()
        out = np.zeros(len(doc_id), np.int64)
        out[known] = np.searchsorted(of, doc_id[known].to_numpy().astype(np.int64), side="right") + 1
        return pd.Series(out)

    @F.pandas_udf("long")
    def fine_of(doc_id: pd.Series) -> pd.Series:
        return place(doc_id, edges)

    # largest ids first, as the order goes; null ids (0) are a bucket of their own
    tops = sized.groupBy(fine_of("doc_id").alias("at")).agg(F.max("doc_id").alias("top"), F.sum("size").alias("size")).collect()
    coarse, heads, filled = {}, [], 0
    for r in sorted(tops, key=lambda r: -r["at"]):
        if not heads or r["at"] == 0 or filled + r["size"] > max(bytes_in_bucket, total / n):
            heads.append(r["top"])
            filled = 0
        coarse[r["at"]] = len(heads) - 1
        filled += r["size"]
    bucket_at = np.array([coarse.get(i, 0) for i in range(len(edges) + 2)], np.int64)

    @F.pandas_udf("long")
    def bucket_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(bucket_at[place(doc_id, edges).to_numpy()])

    following = [(b, heads[(b + 1) % len(heads)]) for b in range(len(heads))]
    helpers = F.broadcast(spark.createDataFrame(following, "bucket long, head long"))  # a row for each bucket
    rows = own.withColumn("bucket", bucket_of("doc_id")).select("bucket", F.lit(0).alias("helper"), "doc_id", "text")
    more = own.join(helpers, own["doc_id"].eqNullSafe(helpers["head"])).select("bucket", F.lit(1).alias("helper"), "doc_id", "text")
    placed = rows.unionByName(more).repartitionById(max(1, len(heads)), F.col("bucket").cast("int"))
    return placed.sortWithinPartitions("bucket", "helper", F.col("doc_id").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text, and the text whose last third is the next document's start, as fingerprints: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def results(rows: list[tuple[int, str]], following: list[tuple[str, int]]) -> pa.RecordBatch:
        """rows: id and text, and at the end the texts that only follow; following: text after each row, its index."""
        kept = [r for r, f in zip(rows, following) if f is not None]
        edits = [t[: len(t) - len(t) // 3] + f[0][: len(t) // 3] for (_, t), f in zip(rows, following) if f is not None]
        found = fingerprints([t for _, t in rows] + edits)
        at = [i for i, f in enumerate(following) if f is not None]
        own, edit, after = found[at], found[len(rows) :], found[[following[i][1] for i in at]]
        shown = lambda a: [x.tobytes().hex() for x in a]
        digests = [hashlib.sha256(e.encode()).hexdigest() for e in edits]
        columns = [[i for i, _ in kept], [len(t) for _, t in kept], digests, shown(own), shown(edit), likeness(own, edit), likeness(own, after)]
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        following: list[tuple[str, int] | None] = []
        last = None  # bucket and helper of the last row
        size = 0
        for batch in batches:
            for bucket, helper, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last == (bucket, 1):
                    continue  # more rows with the id of the next bucket's first
                if last is not None and last[0] == bucket:
                    following[-1] = (text, len(rows))
                rows.append((doc_id, text))
                following.append(None)
                last = (bucket, helper)
                size += len(text)
                if len(rows) > 128 or size > 4_000_000:
                    yield results(rows, following)
                    rows, following, size = rows[-1:], [None], len(text)
        if rows:
            yield results(rows, following)

    return with_next(docs).mapInArrow(run, schema)


def fingerprinted(docs: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """edited_fingerprints, and near_documents: for each document whose id is divisible by every, how many other
    documents have a fingerprint within radius, from the search against all; null for the others."""
    found = stored(edited_fingerprints(docs), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    times = found.groupBy("fingerprint").agg(F.count("*").alias("times"))
    near = search(found.where(asked), times, radius).join(times, "fingerprint").groupBy("query_fp").agg(F.sum("times").alias("n"))
    both = found.join(near, asked & (F.col("fingerprint") == F.col("query_fp")), "left")
    return both.select(*found.columns, (F.col("n") - 1).alias("near_documents"))
