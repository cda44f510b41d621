"""Document fingerprints: MinHash signatures, bands joined in Spark, Jaccard verified.

Shingles are runs of five words; a shorter text has one shingle of all its
words.  Each of the permutations is a universal multiply-add hash of the
shingle hashes, taken over pieces of a text in numpy, of which the smallest
value stays.  Signatures estimate the Jaccard similarity of the shingle sets:
the share of equal places.

``near_duplicates`` puts similar documents into classes: equal texts fall into
one class first; signature bands are hashed, and all texts of a band's group are
candidates of each other, held back only if their signatures agree in far fewer
places than similar texts do.  Large groups are dealt out as pairs of blocks.
A forest of the candidates is verified by the Jaccard similarity of the shingle
sets; where that leaves several classes among texts that candidates connect, all
pairs of these classes are verified, again in blocks.  Connected components give
the classes.  With 32 bands of four rows, a pair at similarity 0.8 shares a band
and passes the signatures but for a chance of about one in ten millions.

Defined results: NULL counts as empty; texts without words have the fingerprint
of the empty set, which is like itself (1) and unlike others (0); equal texts
have equal fingerprints; repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jamscope.llm.common import (
    WordBuffer,
    chunks,
    dealt_in_blocks,
    forget_shuffles,
    forget_staged,
    fresh_names,
    mixed,
    scattered,
    shingle_spans,
    signed,
    small_batches,
    sorted_groups,
    staged,
    text_bytes,
)
from jamscope.llm.components import components
from jamscope.llm.lines import BucketFilter

SHINGLE_WORDS = 5
PERMUTATIONS = 128
BAND_ROWS = 4
SIMILARITY = 0.8
SEED = 42
#: Shingles hashed at once by all permutations; fits a core's cache.
PIECE = 1 << 13
#: Larger groups are dealt out as pairs of blocks of so many rows.
GROUP_ROWS = 1024
BLOCK_ROWS = 512

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
_EMPTY = np.uint64((1 << 64) - 1)


def shingle_hashes(words: WordBuffer, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and where each text's shingles begin."""
    begin, place, last = shingle_spans(words.first, size)
    left = last - place + 1
    padded = np.concatenate([words.hashes(), np.zeros(size, np.uint64)])
    total = np.zeros(len(place), dtype=np.uint64)
    for k in range(size):
        # A short text's only shingle ends with it.
        part = np.where(k < left, padded[place + k], np.uint64(0))
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + part)
    return mixed(total), begin


def signatures(texts: list[bytes]) -> np.ndarray:
    """MinHash signatures (texts x permutations, 32 bits each)."""
    out = np.full((len(texts), PERMUTATIONS), _EMPTY, dtype=np.uint64)
    for low, high in chunks(texts):
        shingles, begin = shingle_hashes(WordBuffer(texts[low:high]))
        for start in range(0, len(shingles), PIECE):
            part = shingles[start : start + PIECE]
            first = np.searchsorted(begin, start, side="right") - 1
            last = np.searchsorted(begin, start + len(part), side="left")
            bounds = np.maximum(begin[first:last], start) - start
            # Texts without shingles take no part.
            full = np.diff(np.append(bounds, len(part))) > 0
            rows = low + first + np.flatnonzero(full)
            cuts = bounds[full]
            values = np.empty(len(part), dtype=np.uint64)
            for k in range(PERMUTATIONS):
                np.multiply(part, _FACTORS[k], out=values)
                values += _TERMS[k]
                least = np.minimum.reduceat(values, cuts)
                np.minimum(out[rows, k], least, out=least)
                out[rows, k] = least
    return (out >> np.uint64(32)).astype(np.uint32)


def _band_keys(found: np.ndarray) -> np.ndarray:
    """Hashes of the bands (texts x bands) of signatures."""
    bands = found.reshape(len(found), PERMUTATIONS // BAND_ROWS, BAND_ROWS).astype(np.uint64)
    keys = np.zeros(bands.shape[:2], dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + bands[:, :, k])
    return keys + np.arange(bands.shape[1], dtype=np.uint64)


def least_places(similarity: float) -> int:
    """Places in which signatures of similar texts agree, six deviations below the mean."""
    spread = math.sqrt(PERMUTATIONS * similarity * (1 - similarity))
    return max(0, math.floor(PERMUTATIONS * similarity - 6 * spread))


def spanning(classes: np.ndarray, similar) -> tuple[list[int], list[int]]:
    """Links between classes such that similar items are connected; merges ``classes``.

    ``similar(i, others)`` compares an item with others; it is asked for every pair that
    is not in one class yet.
    """
    a, b = [], []
    for i in range(len(classes) - 1):
        others = i + 1 + np.flatnonzero(classes[i + 1 :] != classes[i])
        hit = others[similar(i, others)] if len(others) else others
        if len(hit):
            hit = hit[np.unique(classes[hit], return_index=True)[1]]
            a += [i] * len(hit)
            b += hit.tolist()
            classes[np.isin(classes, classes[hit])] = classes[i]
    return a, b


def _like_signatures(similarity: float):
    """Links within a group of texts with sketches: the likeliest first, then all candidates.

    A sketch is the last byte of each place of a signature, so places that agree agree in it,
    and one in 256 of the others: some candidates more, none less.
    """

    def links(h: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.frombuffer(b"".join(found), np.uint8).reshape(len(h), PERMUTATIONS)
        classes = np.arange(len(h))
        a, b = [], []
        for least in (math.ceil(PERMUTATIONS * similarity), least_places(similarity)):
            x, y = spanning(
                classes, lambda i, others: (found[others] == found[i]).sum(axis=1) >= least
            )
            a += x
            b += y
        return h[a], h[b]

    return links


def _like_sets(similarity: float):
    """Links within a group of texts of known classes, by the Jaccard similarity of their sets."""

    def links(h: np.ndarray, known: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) // 8 for x in sets])
        values, place = np.unique(np.frombuffer(b"".join(sets), np.int64), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        own = np.zeros(len(values), dtype=bool)

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            low, high = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
            alike = low >= similarity * high
            own[place[begin[i] : begin[i + 1]]] = True
            for k in np.flatnonzero(alike):
                j = others[k]
                common = np.count_nonzero(own[place[begin[j] : begin[j + 1]]])
                alike[k] = common >= similarity * (size[i] + size[j] - common)
            own[place[begin[i] : begin[i + 1]]] = False
            return alike

        a, b = spanning(np.unique(known, return_inverse=True)[1], similar)
        return h[a], h[b]

    return links


def _links_in_groups(rows: DataFrame, links, name: str) -> DataFrame:
    """``a, b``: what ``links`` finds among the rows (``key``, ``h``, others) of each key."""
    parts = scattered(rows)
    others = [c for c in rows.columns if c != "key"]
    types = dict(rows.dtypes)
    fields = "a long, b long, key long, " + ", ".join(f"{c} {types[c]}" for c in others)
    arrow = {"bigint": pa.int64(), "binary": pa.binary()}

    def batch(a, b, key=None, rest=()) -> pa.RecordBatch:
        n = len(a) if key is None else len(key)
        values = [pa.nulls(n, pa.int64())] * 2 if key is not None else [pa.array(a), pa.array(b)]
        values.append(pa.nulls(n, pa.int64()) if key is None else pa.array(key))
        values += [
            pa.nulls(n, arrow[types[c]]) if key is None else pa.array(x, arrow[types[c]])
            for c, x in zip(others, rest or others, strict=True)
        ]
        return pa.RecordBatch.from_arrays(values, names=["a", "b", "key", *others])

    def compared(limit: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for hot, (key, *columns) in sorted_groups(batches, ["key", *others], limit):
                if hot:
                    yield batch(None, None, key, columns)
                    continue
                cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
                found = [
                    links(*(c[low:high] for c in columns))
                    for low, high in zip(cuts, cuts[1:])
                    if high - low > 1
                ]
                if found:
                    yield batch(*(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)))

        return run

    def sorted_(frame: DataFrame) -> DataFrame:
        return frame.select("key", *others).repartition(parts, "key").sortWithinPartitions("key")

    first = staged(sorted_(rows).mapInArrow(compared(GROUP_ROWS), fields), name)
    hot = first.where("b IS NULL").select("key", *others)
    dealt = sorted_(dealt_in_blocks(hot, "key", "h", BLOCK_ROWS))
    again = dealt.mapInArrow(compared(None), fields)
    return first.where("b IS NOT NULL").select("a", "b").unionByName(again.select("a", "b"))


def shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h`` and the shingle set ``s`` (64-bit values) of rows ``h, text``, once for each ``h``.

    Sets of all ``h`` in the one column of ``wanted``, and of a few others.
    """
    shared = rows.sparkSession.sparkContext.broadcast(BucketFilter(wanted))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            h, texts = np.asarray(batch.column("h")), text_bytes(batch.column("text"))
            chosen = np.flatnonzero(shared.value(h))
            found = [np.unique(shingle_hashes(WordBuffer([texts[i]]))[0]) for i in chosen]
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array(h[chosen]),
                    "s": pa.array([signed(f) for f in found], pa.list_(pa.int64())),
                }
            )

    return rows.select("h", "text").mapInArrow(sets, "h long, s array<long>").dropDuplicates(["h"])


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``class_id``, the smallest id of its class, of every row."""
    marked, classes = _classes(docs, similarity)
    return marked.join(classes, "h").select("doc_id", "class_id")


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, h`` of every row and ``h, class_id`` of every text; ``h`` is its hash."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = signatures(text_bytes(batch.column("text")))
            sketches = (found & np.uint32(255)).astype(np.uint8)
            arrays = [batch.column("doc_id"), batch.column("h")]
            arrays.append(pa.array([x.tobytes() for x in sketches], pa.binary()))
            arrays.append(pa.array(list(signed(_band_keys(found))), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "sketch", "bands"])

    marked = staged(
        rows.mapInArrow(signed_rows, "doc_id long, h long, sketch binary, bands array<long>"),
        "signatures",
    )
    texts = marked.groupBy("h").agg(F.min("doc_id").alias("least"))
    # Copies have the same sketch and bands: any row of a text speaks for it.
    sketches = marked.dropDuplicates(["h"]).select("h", "sketch")
    keyed = marked.dropDuplicates(["h"]).select("h", F.explode("bands").alias("key"))
    common = keyed.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x != y")
    shared = staged(keyed.join(common.select("key"), "key"), "shared")
    found = _links_in_groups(
        shared.join(sketches, "h").select("key", "h", "sketch"), _like_signatures(similarity), "likely"
    )
    ordered = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = staged(found.select(*ordered).distinct(), "pairs")
    forget_staged(shared)
    forget_shuffles(docs.sparkSession)

    # A forest of the candidates.
    full = shingle_sets(rows, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))
    x = full.select(F.col("h").alias("a"), F.col("s").alias("x"))
    y = full.select(F.col("h").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    similar = both >= similarity * (F.size("x") + F.size("y") - both)
    links = staged(pairs.join(x, "a").join(y, "b").where(similar).select("a", "b"), "verified")

    # All pairs of classes among texts that candidates connect.
    connected = components(pairs).select(F.col("node").alias("h"), F.col("root").alias("key"))
    connected = connected.unionByName(connected.select(F.col("key").alias("h"), "key").distinct())
    roots = components(links).select(F.col("node").alias("h"), F.col("root").alias("known"))
    members = connected.join(roots, "h", "left").withColumn("known", F.coalesce("known", "h"))
    several = members.groupBy("key").agg(F.min("known").alias("x"), F.max("known").alias("y"))
    members = staged(members.join(several.where("x != y").select("key"), "key"), "open")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.values.to_numpy().tobytes() for x in batch.column("s")]
            arrays = [batch.column("h"), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["h", "s"])

    full = shingle_sets(rows, members.select("h")).mapInArrow(packed, "h long, s binary")
    open_ = members.join(full, "h").select("key", "h", "known", "s")
    links = links.unionByName(_links_in_groups(open_, _like_sets(similarity), "classes"))

    roots = components(links).withColumnRenamed("node", "h")
    rooted = texts.select("h", "least").join(roots, "h", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "h"))
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    return marked.select("doc_id", "h"), rooted.join(least, "root").select("h", "class_id")


def printed(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places."""
    return float(np.mean(a == b))


def fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) with ``fingerprint``; a column of that name is replaced."""
    others = [c for c in keep or docs.columns if c != "fingerprint"]
    body = fresh_names(docs, "text")[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(body))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, body):
            found = signatures(text_bytes(batch.column(body)))
            arrays = [batch.column(c) for c in others]
            arrays.append(pa.array([printed(s) for s in found], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "fingerprint"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*others).dtypes)
    return rows.mapInArrow(made, f"{fields}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text whose last half gives way to the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_descending_order(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` in partitions of sorted ranges of descending ids.

    A range (``place``) ends with the first document of the next one (``more``),
    the last range with the first of all, so each document has its follower
    beside it.  Range bounds are quantiles of the ids; the driver sees one row
    per range, and texts move once.  Rows of one id follow each other by the
    hash of their text; NULL ids are the last range.  ``classes`` has one row of
    ``doc_id, h, class_id`` for each id and text hash; it comes before the rows
    with that id and text, without a text.
    """
    parts = scattered(docs)
    ranges = 4 * parts  # so that partitions, which get ranges by hash, are even
    ids = docs.select("doc_id", F.col("doc_id").cast("double").alias("id"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(ids.approxQuantile("id", shares, 0.2 / ranges))) or [0.0]
    cut = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")],
        inputCol="id",
        outputCol="bucket",
        handleInvalid="keep",
    )

    def placed(frame: DataFrame) -> DataFrame:
        with_id = frame.withColumn("id", F.col("doc_id").cast("double"))
        bucket = F.when(F.col("id").isNull(), -1).otherwise(F.col("bucket"))
        return cut.transform(with_id).withColumn("place", (len(bounds) - bucket).cast("int"))

    firsts = placed(docs.select("doc_id")).groupBy("place").agg(F.max("doc_id")).collect()
    firsts = sorted((r[0], r[1]) for r in firsts if r[1] is not None) + sorted(
        (r[0], r[1]) for r in firsts if r[1] is None
    )
    texts = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("order"),
    )
    first = F.col("doc_id").isin([i for _, i in firsts if i is not None])
    if any(i is None for _, i in firsts):
        least = texts.where("doc_id IS NULL").agg(F.min("order")).first()[0]
        first = F.when(F.col("doc_id").isNull(), F.col("order") == least).otherwise(first)
    before = [0] * (len(bounds) + 2)
    for k, (place, _) in enumerate(firsts):
        before[place] = firsts[k - 1][0]
    own = F.struct("place", F.lit(False).alias("more"))
    copy = F.struct(
        F.get(F.array(*map(F.lit, before)), F.col("place")).alias("place"), F.lit(True).alias("more")
    )
    targets = F.when(first, F.array(own, copy)).otherwise(F.array(own))
    rows = placed(texts).withColumn("to", F.explode(targets))
    marks = placed(classes).select(
        "doc_id",
        F.lit(None).cast("string").alias("text"),
        F.col("h").alias("order"),
        "place",
        F.lit(False).alias("more"),
        "class_id",
    )
    none = F.lit(None).cast("long").alias("class_id")
    return (
        rows.select("doc_id", "text", "order", "to.place", "to.more", none)
        .unionByName(marks)
        .repartition(parts, "place")
        .sortWithinPartitions("place", "more", F.desc_nulls_last("doc_id"), "order", "text")
    )


REPORT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, class_id long"
)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, and its class."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: place, id, text, signature and class
        known = None  # the class of the following texts
        for batch in small_batches(batches, "text"):
            marks = batch.column("text").is_null().to_pylist()
            found = []
            for mark, own in zip(marks, batch.column("class_id").to_pylist(), strict=True):
                known = own if mark else known
                found.append(known)
            found = [c for c, mark in zip(found, marks, strict=True) if not mark]
            batch = batch.filter(batch.column("text").is_valid())
            rows = [batch.column(c).to_pylist() for c in ("place", "more", "doc_id")] + [found]
            texts = text_bytes(batch.column("text"))
            for low, high in chunks(texts):
                found = list(signatures(texts[low:high]))
                held = [(p, m, i, t.decode("utf-8", "replace"), s, h) for p, m, i, h, t, s in zip(
                    *(r[low:high] for r in rows), texts[low:high], found, strict=True
                )]
                pairs = [
                    (a, b)
                    for a, b in zip([last, *held], held)
                    if a is not None and a[0] == b[0] and not a[1]
                ]
                last = held[-1]
                bodies = [edited(a[3], b[3]).encode() for a, b in pairs]
                changed = signatures(bodies)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in bodies], pa.string()),
                        pa.array([printed(a[4]) for a, _ in pairs], pa.string()),
                        pa.array([printed(c) for c in changed], pa.string()),
                        pa.array(
                            [likeness(a[4], c) for (a, _), c in zip(pairs, changed, strict=True)],
                            pa.float64(),
                        ),
                        pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                        pa.array([a[5] for a, _ in pairs], pa.int64()),
                    ],
                    names=[f.split()[0] for f in REPORT.split(", ")],
                )

    marked, classes = _classes(docs, SIMILARITY)
    classes = staged(marked.distinct().join(classes, "h").select("doc_id", "h", "class_id"), "classes")
    forget_staged(marked)
    forget_shuffles(docs.sparkSession)
    return in_descending_order(docs.select("doc_id", "text"), classes).mapInArrow(report, REPORT)
