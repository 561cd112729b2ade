"""Token counts from pre-token frequencies.

The pieces of this vocabulary hold a space mark only at their start (or nothing but marks), so merges never cross from a
letter to a mark: a text falls into pre-tokens (marks and what follows up to the next mark) that tokenise on their own.

One pass makes the table of distinct pre-tokens with the number of documents that have them; the pieces of each are
counted once, there. A second pass makes each document's pre-token frequencies and joins them to that table: the frequent
pre-tokens, at most ``frequent`` of at most ``longest`` characters (a bound of some megabytes), are broadcast and joined
where the document is read; what is left, if anything, is joined by a shuffle of the rare pre-tokens only. So no frequent
word is a hot key, and no list of ids is made.

Null or empty text: 0 tokens, 0 bytes. Null doc_id: passed through. Repeated rows: each counts. Very long texts and
pre-tokens: whole. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import held, map_texts, parts_of, stored, texts

MARK = "▁"


class Pieces:
    """How many pieces a pre-token has."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in p.lstrip(MARK) for p in map(self.model.id_to_piece, range(self.model.get_piece_size()))):
            raise ValueError("a piece has a space mark after other characters: pre-tokens of this model aren't independent")
        self.pre_token = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def pre_tokens(self, text: str) -> list[str]:
        return self.pre_token.findall(MARK + text.replace(" ", MARK)) if text else []

    def counts(self, pre_tokens: list[str]) -> list[int]:
        """The model puts a mark before what it encodes, so the first one is left out; a lone mark is one piece."""
        ids = self.model.encode([p[1:].replace(MARK, " ") for p in pre_tokens], num_threads=1)
        return [1 if p == MARK else len(x) for p, x in zip(pre_tokens, ids)]


def pieces(path: str) -> Pieces:
    return held(Pieces, path)


def pre_token_table(docs: DataFrame, path: str, entries: int = 400_000) -> DataFrame:
    """pre_token, n_docs, n_pieces of every distinct pre-token. Occurrences are counted in a task before the shuffle; a
    task holds entries of them at most, then passes them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own = Counter(), pieces(path)

        def flushed() -> pa.RecordBatch:
            out = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(out, names=["pre_token", "n"])

        for batch in batches:
            for part in parts_of(batch, "text"):
                for t in part.column("text").to_pylist():
                    found.update(set(own.pre_tokens(t)))
                    if len(found) > entries:
                        yield flushed()
        yield flushed()

    distinct = texts(docs).mapInArrow(run, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n_docs"))

    def counted(names, batch):
        return zip(batch, names, pieces(path).counts(batch))

    return map_texts(distinct, "pre_token string, n_docs long, n_pieces long", counted, first="n_docs", second="pre_token")


def frequent_counts(counted: DataFrame, frequent: int, longest: int) -> tuple[dict[str, int], bool]:
    """Pieces of the pre-tokens that most documents have, at most so many; and if others are left."""
    level = F.floor(8 * F.log2("n_docs")).cast("int")
    short = F.length("pre_token") <= longest
    sizes = sorted(((r[0], r[1]) for r in counted.where(short).groupBy(level).count().collect()), reverse=True)  # 512 rows at most
    total = counted.count()
    least, n = None, 0
    for at, size in sizes:
        if n + size > frequent:
            break
        least, n = at, n + size
    if least is None:
        return {}, total > 0
    found = counted.where(short & (level >= least)).select("pre_token", "n_pieces").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist())), n < total


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, frequent: int = 400_000, longest: int = 80) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens)."""
    counted = stored(pre_token_table(docs, path), "pre_tokens")
    known, others = frequent_counts(counted, frequent, longest)
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most frequent entries of at most longest characters

    def rows(ids, values):
        of, own = shared.value, pieces(path)
        for i, t in zip(ids, values):
            n, rare = 0, []
            for p, times in Counter(own.pre_tokens(t)).items():
                if p in of:
                    n += times * of[p]
                else:
                    rare.append((p, times))
            yield i, len(t.encode()), n, [p for p, _ in rare], [k for _, k in rare]

    schema = "doc_id long, n_bytes long, n_known long, rare array<string>, times array<int>"
    found = map_texts(texts(docs), schema, rows)
    total = F.col("n_known")
    if others:
        # a number for each row, of the written table, so it is the same at both reads
        found = stored(found.withColumn("row", F.monotonically_increasing_id()), "frequencies")
        pairs = found.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        joined = pairs.select("row", F.col("x.rare").alias("pre_token"), F.col("x.times").alias("times")).join(counted, "pre_token")
        sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("n_pieces")).alias("n_rare"))
        found = found.join(sums, "row", "left")
        total = total + F.coalesce("n_rare", F.lit(0))
    return found.select("doc_id", "n_bytes", total.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
