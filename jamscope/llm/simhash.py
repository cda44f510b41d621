"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's four-word
shingles.  Fingerprints link at four differing bits or fewer.  To find links,
the 64 bits are cut in three segments, each padded to the 23 bits of the
perfect Golay code.  A segment's keys are the indices of the codewords at most
four bits away: one if the nearest is at most two bits off, else six.  Two
segments that differ in at most two bits always share a key; if they differ in
one bit, the nearest codeword of either is among the keys of the other.

Four errors over three segments leave one of two cases, so these joins are
complete:

- one segment is equal and another has at most two errors: key = the equal
  segment with a codeword of the other (six ordered pairs of segments);
- no segment is equal, hence two have one error each: key = a codeword of
  either; one side brings its nearest codewords, the other side all near ones.

Fingerprints that share a key are compared in numpy, straight from a sorted
stream of keys.  A task sends on, instead of comparing, groups beyond
``GROUP_ROWS``; they are dealt out anew as pairs of blocks.  Links of a batch
are reduced to a forest with the same components before they are emitted, so a
group of n gives fewer than n rows.

Defined results: a NULL or empty text has fingerprint zero, linked like any
other; equal fingerprints belong together; repeated rows and ids are rows of
their own; rows with NULL id get the smallest id of their component, NULL if it
has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jamscope.llm.common import (
    _SPACE,
    WordBuffer,
    chunks,
    dealt_in_blocks,
    fresh_names,
    scattered,
    shingle_spans,
    signed,
    small_batches,
    sorted_groups,
    staged,
    text_bytes,
)
from jamscope.llm.components import components

SHINGLE_WORDS = 4
HASH_SEED = 42
MOST_BITS = 4
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GENERATOR = 0xC75
#: Rows with one key that a task compares by itself.
GROUP_ROWS = 8192
BLOCK_ROWS = 4096
#: Comparisons made at once.
PIECE = 1 << 21


def normalised(buffer: WordBuffer) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The buffer with one blank between words, and where its words start and end."""
    space = _SPACE[buffer.data]
    keep = np.ones(len(space), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    place = np.cumsum(keep) - 1
    single = np.where(space, np.uint8(0x20), buffer.data)[keep].tobytes()
    return single, place[buffer.starts], place[buffer.ends - 1] + 1


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The 64-bit fingerprints of texts."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for low, high in chunks(texts):
        buffer = WordBuffer([t.lower() for t in texts[low:high]])  # bytes: A-Z only
        single, starts, ends = normalised(buffer)
        begin, first, last = shingle_spans(buffer.first, SHINGLE_WORDS)
        spans = zip(starts[first].tolist(), ends[last].tolist(), strict=True)
        value = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (value(single[a:b], HASH_SEED) for a, b in spans), dtype=np.uint64, count=len(first)
        )
        ones = np.zeros((high - low, 64), dtype=np.int64)
        step = 1 << 14
        for start in range(0, len(hashes), step):
            part = hashes[start : start + step]
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            i = np.searchsorted(begin, start, side="right") - 1
            j = np.searchsorted(begin, start + len(part), side="left")
            cuts = np.maximum(begin[i:j], start) - start
            full = np.diff(np.append(cuts, len(part))) > 0
            ones[i + np.flatnonzero(full)] += np.add.reduceat(
                bits, cuts[full], axis=0, dtype=np.int64
            )
        majority = ones * 2 > np.diff(begin)[:, None]
        out[low:high] = np.packbits(majority, axis=1).view(">u8")[:, 0]
    return out


def _syndromes(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the errors of up to six near codewords, nearest first, and how many."""
    near = np.zeros((2048, 6), dtype=np.int64)
    count = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)])
        for pattern, syndrome in zip(patterns, _syndromes(patterns), strict=True):
            near[syndrome, count[syndrome]] = pattern
            count[syndrome] += 1
    return near, count


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the near codewords (rows x 6, nearest first) and how many there are."""
    near, count = golay_tables()
    syndrome = _syndromes(segment)
    return (segment[:, None] ^ near[syndrome]) >> 11, count[syndrome]


def keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of fingerprints: key, row, and side.

    Keys of side 0 meet those of both sides, keys of side 1 only those of side 0.
    """
    parts = [(values >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    coded = [codewords(p) for p in parts]
    found, rows, sides = [], [], []

    def add(tag: int, key: np.ndarray, row: np.ndarray, side: int) -> None:
        found.append(key | (tag << 40))
        rows.append(row)
        sides.append(np.full(len(row), side, dtype=np.int8))

    every = np.arange(len(values))
    slots = np.arange(6)
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                words, count = coded[j]
                row, k = np.nonzero(slots < count[:, None])
                add(tag, parts[i][row] << 12 | words[row, k], row, 0)
                tag += 1
    for i, j in combinations(range(3), 2):
        (a, na), (b, nb) = coded[i], coded[j]
        add(tag, a[:, 0] << 12 | b[:, 0], every, 0)
        row, k = np.nonzero(slots < na[:, None])
        again = np.repeat(np.arange(len(row)), nb[row])
        start = np.repeat(np.cumsum(nb[row]) - nb[row], nb[row])
        m = np.arange(len(again)) - start
        add(tag, a[row[again], k[again]] << 12 | b[row[again], m], row[again], 1)
        tag += 1
    return np.concatenate(found), np.concatenate(rows), np.concatenate(sides)


def compared(key: np.ndarray, value: np.ndarray, side: np.ndarray) -> tuple:
    """Links within equal keys; rows are sorted by key and side."""
    ends = np.searchsorted(key, key, side="right")
    left = np.flatnonzero(side == 0)
    many = ends[left] - left - 1
    left, many = left[many > 0], many[many > 0]
    total = np.cumsum(many)
    links = []
    start = 0
    while start < len(left):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + PIECE, side="right")))
        if stop == start + 1 and many[start] > PIECE:  # one row against a very large group
            i = left[start]
            for low in range(i + 1, i + 1 + many[start], PIECE):
                other = value[low : min(low + PIECE, i + 1 + many[start])]
                hit = other[np.bitwise_count(other ^ value[i]) <= MOST_BITS]
                links.append((np.full(len(hit), value[i]), hit))
        else:
            m = many[start:stop]
            i = np.repeat(left[start:stop], m)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            near = np.bitwise_count(value[i] ^ value[j]) <= MOST_BITS
            links.append((value[i[near]], value[j[near]]))
        start = stop
    if not links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    return a[a != b], b[a != b]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the given ones: each node with its smallest."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.asarray(batch.column("fp")).view(np.uint64)
        for start in range(0, len(values), 4096):
            part = values[start : start + 4096]
            key, row, side = keys(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(signed(part[row])), pa.array(side)],
                names=["key", "fp", "side"],
            )


LINKS = "a long, b long, key long, side byte"


def _link_batch(a, b, key=None, side=None) -> pa.RecordBatch:
    """Links; or, with a key, rows of a group that is sent on."""
    n = len(a)
    none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.int8())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(signed(a)),
            none[0] if b is None else pa.array(signed(b)),
            none[0] if key is None else pa.array(key),
            none[1] if side is None else pa.array(side),
        ],
        names=["a", "b", "key", "side"],
    )


def _linked(limit: int | None):
    """Compares a stream sorted by key and side; groups beyond ``limit`` rows are sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hot, (key, value, side) in sorted_groups(batches, ["key", "fp", "side"], limit):
            value = value.view(np.uint64)
            if hot:
                yield _link_batch(value, None, key, side)
            else:
                yield _link_batch(*forest(*compared(key, value, side)))

    return run


def near_links(values: DataFrame) -> DataFrame:
    """Links ``a, b`` with the components of all pairs within four bits.

    ``values`` has one column ``fp`` of distinct fingerprints, as signed longs.
    """
    parts = scattered(values)
    # A value becomes some 119 rows, so values are dealt out by their number, not by their bytes.
    dealt = values.repartition(parts, F.xxhash64("fp"))
    keyed = dealt.mapInArrow(_keyed, "key long, fp long, side byte")
    sorted_ = keyed.repartition(parts, "key").sortWithinPartitions("key", "side")
    first = staged(sorted_.mapInArrow(_linked(GROUP_ROWS), LINKS), "simhash")
    links = first.where("b IS NOT NULL").select("a", "b")
    hot = first.where("b IS NULL").select("key", F.col("a").alias("fp"), "side")
    dealt = dealt_in_blocks(hot, "key", "fp", BLOCK_ROWS)
    dealt = dealt.repartition(parts, "key").sortWithinPartitions("key", "side")
    return links.unionByName(dealt.mapInArrow(_linked(None), LINKS).select("a", "b"))


def fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) with the fingerprint ``fp`` as a signed long."""
    others = [c for c in keep or docs.columns if c != "fp"]
    body = fresh_names(docs, "text")[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(body))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, body):
            values = fingerprints(text_bytes(batch.column(body)))
            arrays = [batch.column(c) for c in others] + [pa.array(signed(values))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "fp"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*others).dtypes)
    return rows.mapInArrow(made, f"{fields}, fp long")


def groups(docs: DataFrame) -> DataFrame:
    """Every row of ``doc_id, text`` as ``doc_id``, ``text_hash``, ``fp``, ``root`` (the
    smallest fingerprint of its component) and ``component_id`` (the smallest id)."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    marked = staged(fingerprint(rows, keep=["doc_id", "text_hash"]), "fingerprints")
    values = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(values.select("fp")))
    rooted = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_report(docs: DataFrame) -> DataFrame:
    return groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id.

    NULL ids come last.  Of several rows with that id and text the one whose columns (but
    for maps, which have no hash) have the smallest hash stays.
    """
    own_id, own_hash, nth = fresh_names(docs, "id", "hash", "nth")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    chosen = groups(docs).groupBy("root").agg(F.min(first).alias("c")).select(
        F.coalesce("c.doc_id", F.lit(-(1 << 63))).alias(own_id), F.col("c.text_hash").alias(own_hash)
    )
    keyed = docs.withColumn(own_id, F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn(
        own_hash, F.xxhash64(F.coalesce("text", F.lit("")))
    )
    kept = keyed.join(chosen.distinct(), [own_id, own_hash], "left_semi")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = Window.partitionBy(own_id, own_hash).orderBy(F.xxhash64(*hashed))
    kept = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
