"""Near-duplicate groups by SetSketch registers.

A document is its set of distinct word shingles. A register is the logarithm, to a base close to one, of the least
exponential value that any shingle draws for it, truncated to 16 bits: such registers of two sets merge by their
maximum, and are equal about as often as the sets overlap. Bands of registers are the keys by which candidates meet;
pairs of candidates are estimated from their registers by likelihood and, if that leaves a chance, confirmed on the full
sets. 40 bands of 6 registers miss a pair of similarity 0.8 in 5 of a million cases, one of 0.85 in 4 of a billion.

Copies (equal sets) are one node. Inside a bucket, members are first compared with one of them, then a drawn member of
each component with that of the first component. At last, whatever is still apart in a bucket is compared completely,
in blocks of members: what is outside of the bucket's largest component against everything. Blocks give a row for two
linked components, not for a pair of documents, so no list of pairs is made and no link between components is lost.

Null or empty text, or no word: no shingle, linked with nothing. Null doc_id: linked with nothing, kept. Rows that
repeat a doc_id: each goes by its own text. Ties: the least doc_id names a component and is its document to keep. Very
long texts: whole, as one set; memory is a few times the text. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Memo, discard, held, map_texts, sieve, stored, tended

BANDS, BAND_ROWS = 40, 6
REGISTERS = BANDS * BAND_ROWS
#: SetSketch's parameters: base of the exponential spacing, rate, largest register.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 2
_rng = np.random.default_rng(20210601)
MULTIPLIERS = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
#: Odd multipliers for mixing.
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * C
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many words; of all words if there are fewer. Letters A to Z are
    lowered, words end at ASCII white space."""
    found = text.encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(held(Memo, xxhash.xxh3_64_intdigest).__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.full(n, 0 if k == words else k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) * A + h[i : i + n] * B
    return np.unique(mixed(out))


def registers(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS values of 16 bits. The largest of uniform draws u is the least of exponential ones, -ln u."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    top = np.zeros(REGISTERS, np.uint32)
    work = np.empty((128, REGISTERS), np.uint32)
    for at in range(0, len(x), 128):
        part = x[at : at + 128, None]
        own = work[: len(part)]
        np.multiply(part, MULTIPLIERS, out=own)
        own += OFFSETS
        np.maximum(top, own.max(axis=0), out=top)
    return of_largest(top)


def of_largest(top: np.ndarray) -> np.ndarray:
    least = -np.log((top.astype(np.float64) + 1) / (2.0**32 + 1)) / RATE
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number included."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * B
    for column in values.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        out = mixed((out ^ column) * A + column)
    return out.view(np.int64)


def similarity(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of sets of known sizes n and m, by rows of registers: maximum likelihood of the
    numbers of registers that are larger in a, larger in b, equal (Ertl's joint estimation)."""
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - up - down
    u = (n / np.maximum(n + m, 1))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    j = np.linspace(0, 1, 401)[None, :] * np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    first, second = p(u - v * j), p(v - u * j)
    likelihood = up * np.log(first) + down * np.log(second) + same * np.log(np.maximum(1 - first - second, 1e-12))
    return j[np.arange(len(j)), likelihood.argmax(axis=1)]


def keyed(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """at (doc_id and row), text: null text as empty. row tells rows of one doc_id apart; 0 where that is of no use."""
    at = F.struct(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0) if row is None else row).cast("long").alias("row"))
    return docs.select(at.alias("at"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def signatures(docs: DataFrame, words: int, row: Column | None = None) -> DataFrame:
    """doc_id, row, n_shingles, s1 and s2 (128 bits of the set; null for an empty set or doc_id), keys."""

    def rows(ats, batch):
        for at, t in zip(ats, batch):
            s = shingle_set(t, words)
            if not len(s) or at["doc_id"] is None:
                yield at["doc_id"], at["row"], len(s), None, None, []
                continue
            yield at["doc_id"], at["row"], len(s), *digest(s), band_keys(registers(s)).tolist()

    return map_texts(keyed(docs, row), "doc_id long, row long, n_shingles long, s1 long, s2 long, keys array<long>", rows, first="at")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """s1, s2, shingles (sorted hashes, as bytes) of every row."""

    def rows(ats, batch):
        for t in batch:
            s = shingle_set(t, words)
            yield *digest(s), s.tobytes()

    return map_texts(keyed(docs), "s1 long, s2 long, shingles binary", rows, first="at")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, margin: float = 0.16) -> DataFrame:
    """The links among pairs (a, b). The estimate only rules out what is margin (six deviations) below the bound."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"{x}_set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                first, second = ([np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] for c in (2, 3))
                likely = similarity(np.stack(list(map(registers, first))), np.array(list(map(len, first))), np.stack(list(map(registers, second))), np.array(list(map(len, second))))
                kept = []
                for x, y, s in zip(first, second, likely):
                    inter = len(np.intersect1d(x, y, assume_unique=True)) if 100 * s >= percent - 100 * margin else 0
                    kept.append(100 * inter >= percent * (len(x) + len(y) - inter))
                yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(tended(run), "a long, b long").distinct()


def block_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """A link (a, b) for each two components that are linked between left and right, lists of (component, set)."""
    sets, n = [s for _, s in left + right], len(left)
    shingle, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    times = np.bincount(place, minlength=len(shingle))
    both = np.zeros((n, len(right)), np.float32)
    # frequent shingles by matrix products, some thousands at a time; rare ones by their few pairs; single ones not at all
    frequent = np.flatnonzero(times > 16)
    column = np.full(len(shingle), -1)
    column[frequent] = np.arange(len(frequent))
    for at in range(0, len(frequent), 4096):
        mine = (column[place] >= at) & (column[place] < at + 4096)
        there = np.zeros((len(sets), min(4096, len(frequent) - at)), np.float32)
        there[owner[mine], column[place[mine]] - at] = 1
        both += there[:n] @ there[n:].T
    rare = np.flatnonzero((times[place] > 1) & (times[place] <= 16))
    rare = rare[np.argsort(place[rare], kind="stable")]
    for gap in range(1, 16):
        first, second = rare[:-gap], rare[gap:]
        one = place[first] == place[second]
        a, b = owner[first[one]], owner[second[one]]
        across = (a < n) & (b >= n)  # owners ascend inside a shingle
        np.add.at(both, (a[across], b[across] - n), 1)
    size = np.array(list(map(len, sets)), np.float64)
    name = np.array([c for c, _ in left + right])
    linked = (100 * both >= percent * (size[:n, None] + size[None, n:] - both)) & (name[:n, None] != name[None, n:])
    a, b = np.nonzero(linked)
    pairs = np.unique(np.sort(np.stack([name[:n][a], name[n:][b]], axis=1), axis=1), axis=0)
    return list(map(tuple, pairs.tolist()))


def links_in_blocks(apart: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) between all components that meet in a bucket, from complete comparison of their members' full sets.

    apart: key, id, component, of buckets with several components. In each bucket, what is outside of its largest
    component is compared with everything, in blocks of about block by block members; a task holds one block, whatever
    the bucket's size, and gives a row for each two components that it finds linked, not for each pair.
    """
    sized = stored(apart.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.max("count").alias("inside"), F.sum("count").alias("all")), "sized")
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    placed = apart.join(sized, "key").withColumn("out", F.col("component") != F.col("largest")).withColumn("outs", chunks(F.col("all") - F.col("inside"))).withColumn("ins", chunks(F.col("inside")))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int")
    spot = lambda l, r, side: F.struct(l.alias("l"), r.alias("r"), F.lit(side).alias("side"))
    others = F.sequence(F.lit(0), F.col("outs") - 1)
    # right blocks below zero are of the largest component
    inside = F.transform(F.sequence(F.lit(1), F.col("ins")), lambda i: spot(F.col("own"), -i, 0))
    outside = F.transform(F.filter(others, lambda x: x >= F.col("own")), lambda x: spot(F.col("own"), x, 0))
    below = F.transform(F.filter(others, lambda x: x <= F.col("own")), lambda x: spot(x, F.col("own"), 1))
    at_right = F.transform(others, lambda x: spot(x, -1 - F.col("own"), 1))
    spread = placed.withColumn("own", own).select("key", "id", "component", F.explode(F.when(F.col("out"), F.concat(inside, outside, below)).otherwise(at_right)).alias("at"))
    rows = spread.select("key", "at.*", "component", "id").join(sets, "id").select("key", "l", "r", "side", "component", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> pa.RecordBatch:
            found = block_links(*group, percent) if all(group) else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        now, group = None, ([], [])
        for batch in batches:
            for key, l, r, side, component, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (key, l, r):
                    yield ended()
                    now, group = (key, l, r), ([], [])
                group[side].append((component, np.frombuffer(shingles, np.uint64)))
        yield ended()

    return rows.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r").mapInArrow(tended(run), "a long, b long").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its least node) of each node of edges (a, b), by alternating large and small stars. Minima are
    written tables, so that a node with very many edges is a join that can be split, not one task."""
    ends = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = stored(ends.distinct(), "edges")
    state = None
    for _ in range(most):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least")
        large = stored(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("least")), "least")
        small = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        after = stored(small.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "edges")
        discard(pairs, near, large, least)
        pairs = after
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def grouped(docs: DataFrame, words: int, percent: int, row: Column | None = None, draws: int = 1) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows (without keys); and s1, s2, component, component_id of every distinct set: a number of its
    component, and the least doc_id there. A set is one node, whatever its rows' ids are."""
    signed = stored(signatures(docs, words, row), "signed")
    of_set = [F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")]
    # a number for each node: of the written table, so it is the same at every read
    nodes = signed.where("s1 is not null").groupBy("s1", "s2").agg(*of_set).withColumn("id", F.monotonically_increasing_id())
    nodes = stored(nodes, "nodes")
    banded = nodes.select("id", "n", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    members = stored(banded.join(stored(shared.select("key", "first"), "buckets"), "key"), "members")
    wanted = stored(members.select("id").distinct().join(nodes.select("id", "s1", "s2", "doc"), "id"), "wanted")
    # most texts are in no bucket with others: they aren't shuffled
    own = F.xxhash64(F.col("doc_id").cast("long"))
    read = docs.where(sieve(wanted.select(F.xxhash64("doc")))(own)).join(wanted.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = full_sets(read, words).dropDuplicates(["s1", "s2"]).join(wanted.select("s1", "s2", "id"), ["s1", "s2"])
    sets = stored(sets.select("id", "shingles"), "sets")
    discard(wanted)

    sizes_fit = F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")
    links = tested = None
    label = docs.sparkSession.createDataFrame([], "node long, component long")

    def compare(pairs: DataFrame) -> int:
        """Adds the links among new pairs (a < b) and relabels; the number of links."""
        nonlocal links, tested, label
        pairs = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = stored(confirmed(pairs, sets, percent), "links")
        n = found.count()
        if n:
            links = found if links is None else links.unionByName(found)
            before, label = label, stored(components(links), "labels")
            discard(before)
        return n

    def labelled() -> DataFrame:
        """Members of buckets that hold more than one component."""
        now = members.join(label.withColumnRenamed("node", "id"), "id", "left")
        now = stored(now.select("key", "id", "n", F.coalesce("component", "id").alias("component")), "labelled")
        mixed_buckets = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        return now.join(stored(mixed_buckets, "mixed"), "key")

    first_sizes = nodes.select(F.col("id").alias("first"), F.col("n").alias("m"))
    starts = members.where("first < id").groupBy("id", "n").agg(F.min("first").alias("first"))
    compare(starts.join(first_sizes, "first").where(sizes_fit).select(F.col("first").alias("a"), F.col("id").alias("b")))
    for draw in range(draws):
        one = F.min_by(F.struct("id", "n"), F.xxhash64("id", "key", F.lit(draw))).alias("one")
        drawn = stored(labelled().groupBy("key", "component", "low").agg(one), "drawn")
        if drawn.isEmpty():
            break
        base = drawn.where("component = low").select("key", F.col("one.id").alias("base"), F.col("one.n").alias("m"))
        others = drawn.where("component > low").select("key", F.col("one.id").alias("id"), F.col("one.n").alias("n"))
        pairs = others.join(base, "key").where(sizes_fit)
        if not compare(pairs.select(F.least("id", "base").alias("a"), F.greatest("id", "base").alias("b"))):
            break
    apart = stored(labelled(), "apart")
    if not apart.isEmpty():
        crossing = stored(links_in_blocks(apart.select("key", "id", "component"), sets, percent), "crossing")
        if not crossing.isEmpty():
            label = stored(components(crossing if links is None else links.unionByName(crossing)), "labels")
    discard(members, sets, apart)

    linked = label.join(nodes.select(F.col("id").alias("node"), "doc"), "node")
    least = linked.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_node = label.join(least, "component").select(F.col("node").alias("id"), "component", "component_id")
    named = nodes.select("id", "s1", "s2", "doc").join(of_node, "id", "left")
    named = named.select("s1", "s2", F.coalesce("component", "id").alias("component"), F.coalesce("component_id", "doc").alias("component_id"))
    return signed.drop("keys"), named


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    signed, named = grouped(docs, words, percent)
    found = signed.join(named, ["s1", "s2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the row with the least doc_id (then the least hash of
    all its columns; of exact repeats one), and all rows without an id or a word."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    signed, named = grouped(docs, words, percent, row)
    rows = stored(signed.where("s1 is not null").join(named, ["s1", "s2"]).select("component", "doc_id", "row"), "rows")
    several = rows.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("chosen"), F.count("*").alias("n")).where("n > 1")
    chosen = (F.col("doc_id") == F.col("chosen.doc_id")) & (F.col("row") == F.col("chosen.row"))
    decided = rows.join(several.drop("n"), "component").groupBy("doc_id", "row").agg(F.bool_or(chosen).alias("once"), F.count("*").alias("n"))
    # names that no column of docs has
    decided = stored(decided.where("not once or n > 1").select(F.col("doc_id").alias("__id"), F.col("row").alias("__of"), "once"), "decided")
    # most rows are in no group: they stay without a shuffle
    maybe = sieve(decided.select(F.xxhash64("__id", "__of")))(F.xxhash64(F.col("doc_id").cast("long"), row))
    own = docs.where(maybe).withColumn("__row", row)
    same = (F.col("doc_id") == F.col("__id")) & (F.col("__row") == F.col("__of"))
    single = docs.where(~maybe).unionByName(own.join(decided, same, "left_anti").select(docs.columns))
    repeats = decided.where("once")
    if repeats.isEmpty():
        return single
    return single.unionByName(own.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "__row"]).select(docs.columns))
