"""What the operators share: reading tables, written intermediate tables, memos in Python workers, maps by batch."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.lineage import discard  # noqa: F401
from lodestar.plans.lineage import written as stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, null as empty; all other columns are pruned in the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_crc(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; the folds of the queries. A null id is in no fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


class Memo(dict):
    """function's results by argument, for one Python worker. Bounded: when it is full, its entries become the older
    generation, which goes at the next time; what is asked for meanwhile moves over. Results of long arguments are not
    kept."""

    def __init__(self, function: Callable, entries: int = 100_000, longest: int = 80):
        super().__init__()
        self.function, self.entries, self.longest = function, entries, longest
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_held: dict[tuple, object] = {}
_idle: threading.Timer | None = None
#: Seconds without a task after which a Python worker gives up what it holds; the tasks of a stage follow one another faster.
IDLE_S = 0.2


def held(make: Callable, *of):
    """make(*of), kept in a Python worker until something else is asked for, or the worker is idle. A worker outlives a
    stage, so the tokenizers and memos of all the operators that it served would add up; this way it holds those of one."""
    key = (make, of)
    found = _held.get(key)
    if found is None:
        if _held:
            release()
        found = _held[key] = make(*of)
    return found


def release() -> None:
    """Gives what is held back to the machine. Memos and their owners refer to each other, so they go only by collection."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def working() -> Iterator[None]:
    """Around a worker's task: some time after it, if no other follows, the worker releases what it holds. Spark keeps
    more workers than run at a time, by turns, beside an executor's other stages."""
    global _idle
    if _idle:
        _idle.cancel()
    try:
        yield
    finally:
        _idle = threading.Timer(IDLE_S, release)
        _idle.daemon = True
        _idle.start()


def tended(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, as such a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working():
            yield from run(batches)

    return task


KINDS = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}
#: Characters or bytes of input that a call of rows() gets at most, unless one row alone has more.
BATCH_BYTES = 8_000_000


def parts_of(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices of about most bytes of a column, so that lists of Python objects stay small."""
    size = batch.column(column).nbytes
    rows = batch.num_rows if size <= most else max(1, batch.num_rows * most // size)
    for at in range(0, batch.num_rows, max(1, rows)):
        yield batch.slice(at, rows)


def verdicts(values: pa.Array, judge: Callable[[list], Iterable[bool]]) -> pa.Array:
    """judge's answers for the texts of an Arrow column, slice by slice."""
    whole = pa.RecordBatch.from_arrays([values], names=["text"])
    with working():
        return pa.array([x for part in parts_of(whole, "text") for x in judge(part.column(0).to_pylist())], pa.bool_())


def map_texts(df: DataFrame, schema: str, rows: Callable[[list, list], Iterable[tuple]], first: str = "doc_id", second: str = "text") -> DataFrame:
    """df's (first, second) columns through rows(), batch by batch; no shuffle. schema: names and types of KINDS."""
    fields = [(n, KINDS[k]) for n, k in (x.split(" ", 1) for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, second):
                out = list(zip(*rows(part.column(first).to_pylist(), part.column(second).to_pylist())))
                columns = out or [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    return df.select(first, second).mapInArrow(tended(run), schema)


def sieve(found: DataFrame, most_bits: int = 27) -> Callable[[Column], Column]:
    """A test of a column of 64-bit hashes: true for all hashes of found (its only column) and for about one of a hundred
    others. What fails it matches nothing and needs no shuffle; an exact join decides on the rest. All workers get a bitmap of
    16 to 32 bits a hash, two of them set; at most 16 MB, beyond four million hashes more others pass."""
    spark, h = found.sparkSession, F.col(found.columns[0])
    bits = min(most_bits, max(10, (16 * found.count()).bit_length()))
    place = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    places = found.select(F.explode(F.array(place(0), place(32))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def maybe(values: pa.Array) -> pa.Array:
        h, six, one = values.to_numpy(zero_copy_only=False).view(np.uint64), np.uint64(6), np.uint64(1)
        hits = [(shared.value[p >> six] >> (p & np.uint64(63))) & one for p in (x & np.uint64((1 << bits) - 1) for x in (h, h >> np.uint64(32)))]
        return pa.array((hits[0] & hits[1]).astype(bool))

    return maybe
