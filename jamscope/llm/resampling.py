"""Resampling of documents towards the distribution of a target corpus.

Features are the runs of 1 to ``longest`` words of a text, hashed into buckets by
crc32.  A bucket's gain is the log of its share in the target over its share in the
documents; a document's weight is the mean gain of its features.  Weight plus
seeded Gumbel noise is its score, and the highest scores are drawn: a weighted
sample without replacement.

1. Two passes over the texts: the first counts buckets (arrays per task, added up
   by bucket), the second looks gains up in one array per task.
2. Scores are ranked by a distributed radix sort, least significant digit first.
   The composite key is score (descending) and id (ascending), in as many bits as
   their ranges need.  A pass is a stable counting sort: rows are counted per block
   of the present order and digit, prefix sums over (digit, block) give where each
   pair's rows begin, and a row's place is that start plus its number within the
   pair.  Blocks keep digits that many rows share apart, so no task has more of a
   digit than a block has rows; only keys move, never texts.

Defined results: NULL texts have no features and weight 0; a NULL id enters the
noise as an empty text and comes after all ids; rows that tie in score and id keep
the order of the table; texts are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jamscope.llm.common import (
    forget_staged,
    fresh_names,
    scattered,
    small_batches,
    staged,
    text_bytes,
)

#: Bits of the widest digit of a sorting pass.
DIGIT_BITS = 12
#: Rows of a sorting block, at least and at most (powers of two).
BLOCK_ROWS = (1 << 12, 1 << 20)
#: Spans up to this length are hashed together, longer ones one by one.
SPAN_BYTES = 48


@dataclass(frozen=True)
class Settings:
    """How features are made, how much is drawn, and the seed of the noise."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def _byte_table() -> np.ndarray:
    """A-Z lowered; bytes that are no letter, digit or part of a non-ASCII character as blanks."""
    table = np.full(256, 0x20, dtype=np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def _crc_table() -> np.ndarray:
    """crc32 of single bytes: eight steps of division by the reversed polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_BYTES, _CRC = _byte_table(), _crc_table()


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib's crc32 of byte spans, one byte of all spans at a time."""
    size = ends - starts
    found = np.zeros(len(size), dtype=np.uint32)
    for i in np.flatnonzero(size > SPAN_BYTES).tolist():
        found[i] = zlib.crc32(data[starts[i] : ends[i]])
    short = np.flatnonzero(size <= SPAN_BYTES)
    order = short[np.argsort(size[short].astype(np.int8), kind="stable")[::-1]]
    at, size = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for step in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -step, side="left"))  # spans that are longer than step
        here = crc[:n]
        crc[:n] = _CRC[(here ^ data[at[:n] + step]) & np.uint32(255)] ^ (here >> np.uint32(8))
    found[order] = ~crc
    return found


class Features:
    """The feature buckets of some texts, text after text; ``first`` says where each begins."""

    def __init__(self, texts: list[bytes], settings: Settings) -> None:
        joined = _BYTES[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        inside = np.zeros(len(joined) + 1, dtype=np.int8)
        inside[1:] = joined != 0x20
        steps = np.diff(inside)
        starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        words = np.searchsorted(starts, np.append(0, np.cumsum(lengths)))
        self.words = np.diff(words)
        if settings.longest > 1:
            joined, starts, ends = self._single_blanks(joined, starts, ends)
        owner = np.repeat(np.arange(len(texts)), self.words)
        hashes, owners = [], []
        for n in range(1, settings.longest + 1):
            run = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
            hashes.append(crc32_of_spans(joined, starts[run], ends[run + n - 1]))
            owners.append(owner[run])
        buckets, owner = np.concatenate(hashes) % np.uint32(settings.buckets), np.concatenate(owners)
        self.buckets = buckets[np.argsort(owner, kind="stable")].astype(np.int64)
        self.first = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))

    @staticmethod
    def _single_blanks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
        """The words with one blank after each."""
        size = ends - starts
        last = np.cumsum(size + 1)
        begin = last - size - 1
        out = np.full(int(last[-1]) if len(last) else 0, 0x20, dtype=np.uint8)
        shift = np.repeat(starts - begin, size)
        at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        out[at] = data[at + shift]
        return out, begin, begin + size


def bucket_counts(rows: DataFrame, settings: Settings) -> np.ndarray:
    """Features per bucket of all texts of a column ``text``; the driver gets a row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, dtype=np.int64)
        for batch in small_batches(batches, "text"):
            found = Features(text_bytes(batch.column("text")), settings)
            total += np.bincount(found.buckets, minlength=settings.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used), "n": pa.array(total[used])})

    counted = rows.select("text").mapInArrow(count, "bucket long, n long")
    found = np.zeros(settings.buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row["bucket"]] = row["n"]
    return found


def bucket_gains(own: np.ndarray, target: np.ndarray, settings: Settings) -> np.ndarray:
    """Per bucket, the floored thousandfold log of its smoothed share in the target over its own."""
    n, total, aim = settings.buckets, int(own.sum()), int(target.sum())
    shares = [
        (t + 1) * (total + n) / ((s + 1) * (aim + n))
        for s, t in zip(own.tolist(), target.tolist(), strict=True)
    ]
    return np.array([math.floor(1000 * math.log(x)) for x in shares], dtype=np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Thousandfold standard Gumbel noise of an id, floored."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every document."""
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    own = bucket_counts(rows, settings)
    gains = bucket_gains(own, bucket_counts(target, settings), settings)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = Features(text_bytes(batch.column("text")), settings)
            sums = np.append(0, np.cumsum(shared.value[found.buckets]))[found.first]
            n = np.diff(found.first)
            weight = np.diff(sums) // np.maximum(n, 1)
            ids = batch.column("doc_id").to_pylist()
            chance = np.fromiter((noise(i, settings.seed) for i in ids), np.int64, len(ids))
            arrays = [found.words, n, weight, weight + chance]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(a.astype(np.int64)) for a in arrays)],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_features long, weight long, score long"
    return rows.mapInArrow(score, schema)


def _digits(key: Column, bits: int) -> list[Column]:
    """A key of so many bits as digits of about equal width, least significant first."""
    count = -(-bits // DIGIT_BITS)
    edges = [bits * i // count for i in range(count + 1)] if count else []
    return [
        F.shiftrightunsigned(key, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).cast("int")
        for low, high in zip(edges, edges[1:], strict=False)
    ]


def _key(column: str, descending: bool, low: int | None, high: int | None) -> tuple[Column, int]:
    """A column within bounds as a number from 0 in ascending (descending) order, NULL last, and
    the bits of that number."""
    if low is None:
        return F.lit(0).cast("long"), 0
    value, last = F.col(f"`{column}`").cast("long"), high - low + 1
    if last >= 1 << 62:  # too wide for a difference: order by the two's complement, NULLs as top
        raw = value.bitwiseXOR(F.lit((1 << 63) - 1 if descending else -(1 << 63)))
        return F.coalesce(raw, F.lit(-1)), 64
    distance = F.lit(high) - value if descending else value - F.lit(low)
    return F.coalesce(distance, F.lit(last)), last.bit_length()


def radix_ranked(rows: DataFrame, keys: list[tuple[str, bool]], rank: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 by integer ``keys`` (name, descending).

    Most significant key first; ties keep the order of the table.
    """
    place, block, digit, local, offset = fresh_names(rows, "place", "block", "digit", "local", "at")
    columns, parts = rows.columns, scattered(rows)
    # Where a row stands in the table; blocks of these numbers follow each other like the rows.
    order = staged(rows.withColumn(place, F.monotonically_increasing_id()), "order")
    ends = [f(F.col(f"`{k}`").cast("long")) for k, _ in keys for f in (F.min, F.max)]
    count, *bounds = order.agg(F.count(F.lit(1)), *ends).first()
    fewest, most = BLOCK_ROWS
    size = min(most, max(fewest, 1 << (count // parts).bit_length()))
    digits = []
    for i in reversed(range(len(keys))):
        digits += _digits(*_key(*keys[i], bounds[2 * i], bounds[2 * i + 1]))
    for value in digits or [F.lit(0)]:
        numbered = order.withColumn(block, F.expr(f"`{place}` div {size}")).withColumn(digit, value)
        pairs = numbered.groupBy(block, digit).agg(F.count(F.lit(1)).alias(local))
        before = F.sum(local).over(Window.partitionBy(digit).orderBy(block)) - F.col(local)
        totals = pairs.groupBy(digit).agg(F.sum(local).alias(local))  # one row per digit
        below = F.sum(local).over(Window.orderBy(digit)) - F.col(local)
        starts = pairs.select(block, digit, before.alias(offset)).join(
            totals.select(digit, below.alias(local)), digit
        )
        starts = starts.select(block, digit, (F.col(offset) + F.col(local)).alias(offset))
        number = F.row_number().over(Window.partitionBy(block, digit).orderBy(place))
        moved = numbered.withColumn(local, number.cast("long")).join(starts, [block, digit])
        moved = moved.select(*columns, (F.col(offset) + F.col(local) - 1).alias(place))
        moved = staged(moved, "order")
        forget_staged(order)
        order = moved
    return order.select(*columns, (F.col(place) + 1).alias(rank))


ORDER = [("score", True), ("doc_id", False)]


def resampling_report(
    docs: DataFrame, target: DataFrame, settings: Settings | None = None
) -> DataFrame:
    """``doc_id, n_features, weight, score`` of every document, and the ``rank`` of drawn ones."""
    settings = settings or Settings()
    found = staged(scored(docs, target, settings), "scores")
    able = F.col("n_words") >= settings.least_words
    ranked = radix_ranked(found.where(able), ORDER)
    drawn = F.expr(f"{settings.percent} * {found.where(able).count()} div 100")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = found.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


def resampled(docs: DataFrame, target: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The drawn documents with all their columns; rows of one id are drawn together."""
    report = resampling_report(docs, target, settings)
    (drawn,) = fresh_names(docs, "drawn")
    ids = report.where("rank IS NOT NULL").select(F.col("doc_id").alias(drawn)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[drawn]), "left_semi")
