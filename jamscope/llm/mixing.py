"""Mix sources to target weights: blocks of words, drawn per output shard.

The words of a source, document after document, are packed into blocks of a
fixed length: ``block_words`` at most, less for a small source or a small target,
so that either has some ``MOST_SHARE`` blocks, of one word if need be.  A
source's target in words gives its number of draws, so its total misses the
target by a block at most, or half a word where blocks are words.  The
draws of a source are spread over the output shards by multinomial counts, so
the totals of a source are exact and a shard's mix is random.  Draw ``k`` of a
source takes block ``permutation(k)``: one keyed permutation of all its blocks
after the other, so no block is used more often than ``ceil(draws / blocks)``
times.  Blocks and draws meet in a join by index.

A shard computes its counts, and how many draws of each source lie before it,
from the seed alone by halving the range of shards; nothing about single blocks
passes the driver, and lost tasks come back the same.

A hot source is one sequence of words, but no task holds it: its documents are
summed in buckets, then the buckets.  Buckets have a bounded number of rows.

Defined results: NULL text has no words and is never taken; a NULL source is a
source of its own and comes last; repeated rows are rows of their own; an empty
table gives no rows.  Only the named columns are read; results have new frames.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jamscope.llm.common import WORD, fresh_names, mixed, small_batches, staged, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 64
#: A block holds at most this part (one in so many) of its source and of its target.
MOST_SHARE = 256
SHARD_DRAWS = 1 << 16
SEED = 42

#: Rows of one bucket of a source, on average.
BUCKET_ROWS = 5_000
#: Sources come to the driver one row each; more than this is an error.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Source:
    """A source's words, its target and how its blocks are drawn."""

    name: str | None
    size: int
    target: float
    block_words: int
    blocks: int
    draws: int


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of all words by weight; what exceeds ``most`` times a size goes to the others."""
    found = [0.0] * len(sizes)
    open_, rest = [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                found[i] = unit * weights[i]
            break
        for i in full:
            found[i] = float(most * sizes[i])
        rest -= sum(found[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return found


def plan_sources(rows: list[tuple[str | None, int]], block_words: int) -> list[Source]:
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"{len(rows)} sources; at most {MOST_SOURCES} are planned on the driver")
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([s for _, s in rows], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    plan = []
    for (name, size), target in zip(rows, wanted, strict=True):
        length = max(1, min(block_words, int(min(size, target)) // MOST_SHARE))
        blocks = math.ceil(size / length)
        draws = min(round(target * blocks / size), MOST_REPEATS * blocks) if size else 0
        plan.append(Source(name, size, target, length, blocks, draws))
    return plan


def shard_counts(draws: np.ndarray, shards: int, shard: int, seed: int) -> tuple:
    """A shard's draws of each source and the draws of earlier shards.

    Halving a range of shards splits each count binomially, which makes the
    counts of all shards multinomial; a half's generator depends on its range.
    """
    low, high = 0, shards
    count, before = draws.astype(np.int64), np.zeros(len(draws), dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = rng.binomial(count, (middle - low) / (high - low))
        if shard < middle:
            high, count = middle, left
        else:
            low, before, count = middle, before + left, count - left
    return count, before


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of ``0 .. size - 1`` at the given places: a Feistel network
    over the next even number of bits, walked on until the value is in range."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for turn in range(4):
            salt = np.uint64((key * 4 + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
            left, right = right, left ^ (mixed(right ^ salt) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (far := np.flatnonzero(out >= size)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def drawn_blocks(plan: list[Source], shards: int, shard: int, seed: int) -> pd.DataFrame:
    """The draws of one shard: source number and block, in a shuffled slot order."""
    counts, before = shard_counts(np.array([s.draws for s in plan]), shards, shard, seed)
    numbers, blocks = [], []
    for i, source in enumerate(plan):
        k = np.arange(before[i], before[i] + counts[i])
        for turn in range(MOST_REPEATS):
            part = k[k // max(source.blocks, 1) == turn] - turn * source.blocks
            if len(part):
                key = (seed * 1_000_003 + i) * MOST_REPEATS + turn
                blocks.append(permuted(part, source.blocks, key))
                numbers.append(np.full(len(part), i, dtype=np.int32))
    if not blocks:
        return pd.DataFrame({"shard": [], "slot": [], "number": [], "block": []})
    order = np.random.default_rng([seed, shard, shards, 1]).permutation(sum(map(len, blocks)))
    return pd.DataFrame(
        {
            "shard": np.int64(shard),
            "slot": np.arange(len(order)),
            "number": np.concatenate(numbers)[order],
            "block": np.concatenate(blocks)[order],
        }
    )


class Mixture:
    """The mix of a document table, planned when made.

    ``docs`` needs ``doc_id``, ``text`` and ``source``.
    """

    def __init__(
        self,
        docs: DataFrame,
        block_words: int = BLOCK_WORDS,
        shard_draws: int = SHARD_DRAWS,
        seed: int = SEED,
    ) -> None:
        self.spark, self.seed = docs.sparkSession, seed
        self.docs = docs
        sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        self.sized = staged(sized, "sizes")
        totals = self.sized.groupBy("source").agg(F.sum("size").alias("size"))
        rows = [(r.source, r["size"]) for r in totals.limit(MOST_SOURCES + 1).collect()]
        self.plan = plan_sources(rows, block_words)
        self.shards = max(1, math.ceil(sum(s.draws for s in self.plan) / shard_draws))

    def draws(self) -> DataFrame:
        """Every slot of the output: ``shard``, ``slot``, ``number`` of the source, ``block``."""
        plan, shards, seed = self.plan, self.shards, self.seed

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"]:
                    yield drawn_blocks(plan, shards, int(shard), seed)

        return self.spark.range(0, shards, 1, min(shards, 10_000)).mapInPandas(
            draw, "shard long, slot long, number int, block long"
        )

    def sources(self) -> DataFrame:
        rows = [
            (i, s.name, s.size, float(s.target), s.block_words) for i, s in enumerate(self.plan)
        ]
        return self.spark.createDataFrame(
            rows, "number int, source string, source_size long, target double, block_words long"
        )

    def placed(self) -> DataFrame:
        """Each document with the place ``start`` of its first word in its source."""
        n = self.sized.count()
        buckets = max(8, math.ceil(n / BUCKET_ROWS))
        numbered = self.sized.alias("d").join(
            F.broadcast(self.sources()).alias("s"),
            F.col("d.source").eqNullSafe(F.col("s.source")),
        ).select(
            "d.doc_id", "d.size", "d.source", "number", "source_size", "target", "block_words"
        )
        numbered = numbered.withColumn(
            "bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int")
        )
        sums = numbered.groupBy("number", "bucket").agg(F.sum("size").alias("bucket_size"))
        before = Window.partitionBy("number").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1
        )
        offsets = sums.select(
            "number", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("o")
        )
        inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "size").rowsBetween(
            Window.unboundedPreceding, -1
        )
        return (
            numbered.withColumn("p", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(offsets, ["number", "bucket"])
            .withColumn("start", F.col("o") + F.col("p"))
            .drop("o", "p", "bucket")
        )

    def uses(self) -> DataFrame:
        """For each document and each of its blocks that is drawn: the overlap and the draws."""
        size = F.col("block_words")
        first = F.expr("start div block_words")
        last = F.expr("(start + size - 1) div block_words")
        pieces = self.placed().where("size > 0").withColumn(
            "block", F.explode(F.sequence(first, last))
        )
        times = self.draws().groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
        begin = F.greatest(F.col("block") * size, F.col("start"))
        end = F.least((F.col("block") + 1) * size, F.col("start") + F.col("size"))
        # A block row is many times what its document's size suggests: nothing to broadcast.
        return pieces.join(times.hint("merge"), ["number", "block"]).select(
            "doc_id",
            "number",
            "source",
            "size",
            "start",
            (begin - F.col("start")).alias("from_word"),
            (end - F.col("start")).alias("to_word"),
            "times",
        )

    def report(self) -> DataFrame:
        """One row per document: sizes, the target of its source and the words taken."""
        taken = self.uses().groupBy("number", "start").agg(
            F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken")
        )
        rows = self.placed()
        # Documents without words share their start with a neighbour and are never taken.
        found = F.when(F.col("size") > 0, F.coalesce(F.col("taken"), F.lit(0))).otherwise(0)
        return rows.join(taken, ["number", "start"], "left").select(
            "doc_id", "size", "source_size", "target", found.cast("long").alias("taken")
        )

    def mixed_documents(self) -> DataFrame:
        """The mix as documents: row ``c`` of a document has the words drawn at least ``c`` times.

        Rows have the columns of ``docs``; a column ``n_chars`` is counted anew.
        """
        same = ["doc_id", "source", "size"]
        chosen = (
            self.uses()
            .groupBy(*same, "number", "start")
            .agg(
                F.sort_array(F.collect_list(F.struct("from_word", "to_word", "times"))).alias("u")
            )
        )
        # Rows that agree in id, source and size take any of the places found for such rows.
        rank = F.row_number().over(Window.partitionBy(*same).orderBy("start"))
        columns = self.docs.columns
        names = ("id", "source", "size", "rank", "uses", "n", "nth")
        own = dict(zip(names, fresh_names(self.docs, *names), strict=True))
        chosen = chosen.withColumn("rank", rank).select(
            *[F.col(c).alias(own[n]) for c, n in zip((*same, "rank", "u"), names)]
        )
        rows = self.docs.withColumn(own["n"], word_count(F.col("text")))
        alike = Window.partitionBy("doc_id", "source", own["n"]).orderBy(F.xxhash64("text"))
        both = rows.withColumn(own["nth"], F.row_number().over(alike)).join(
            chosen,
            F.col("doc_id").eqNullSafe(F.col(own["id"]))
            & F.col("source").eqNullSafe(F.col(own["source"]))
            & (F.col(own["n"]) == F.col(own["size"]))
            & (F.col(own["nth"]) == F.col(own["rank"])),
        )
        others, read = [c for c in columns if c != "text"], fresh_names(self.docs, "text")[0]
        kept = both.select(
            *[F.col(f"`{c}`") for c in others],
            F.col("text").alias(read),
            F.col(own["uses"]).alias("text"),
        )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, read):
                pairs = zip(batch.column(read).to_pylist(), batch.column("text").to_pylist(), strict=True)
                made = [copies(text, drawn) for text, drawn in pairs]
                row = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                arrays = [batch.column(c).take(row) for c in others]
                arrays.append(pa.array([text for m in made for text in m], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*others, "text"])

        fields = [f"`{c}` {t}" for c, t in self.docs.select(*[f"`{c}`" for c in others]).dtypes]
        out = kept.mapInArrow(cut, ", ".join([*fields, "text string"]))
        if "n_chars" in columns:
            out = out.withColumn("n_chars", F.length("text").cast("long"))
        return out.select(*[F.col(f"`{c}`") for c in columns])


_WORD = re.compile(WORD)


def copies(text: str, uses: list[dict]) -> list[str]:
    """The texts that a document's drawn words make, one per repetition."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    starts[0] = 0
    made = []
    for c in range(1, MOST_REPEATS + 1):
        parts = [
            text[starts[u["from_word"]] : starts[u["to_word"]]] for u in uses if u["times"] >= c
        ]
        if parts:
            made.append("".join(parts))
    return made
