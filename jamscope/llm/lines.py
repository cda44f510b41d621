"""Line dedup: an exact set-similarity join of all lines of a corpus.

A line is the set of its words.  A line goes if a similar one (Jaccard of 0.8
or more) stands earlier, whether that one stays or goes; earlier means a smaller
document id, or a smaller line number in documents of the same id.  So a line
stays if it is the first of its word set and no similar set begins earlier.

1. One pass hashes all words, counts them in a table of fixed size and lists the
   lines with the hash of their word set.
2. A second pass orders the words of each distinct set by rarity, after that
   table; any order gives a right result, a good one few candidates.  The first
   words (prefix filter), but for those that are in one line only, become postings
   with the set's size, the word's place and a parity map of the set, of up to 256 bits.
3. Postings meet by word; a task moves those of a bucket of words together, in
   columns as narrow as their values.  Length filter, positional filter
   and the parity map (whose differing bits are a lower bound of the differing
   words) leave few false candidates.  A set sends on its likeliest candidates of
   a word; if there are more, its posting and theirs are put aside, each once.
4. Candidates are verified on their full word sets, which a third pass makes from the
   texts of documents with candidates.  One similar set is enough to
   decide, so the likeliest is tried first, then the others where it fails.
   Sets of which none holds are joined with their postings put aside, so no
   candidate is lost.

Groups beyond ``GROUP_ROWS`` postings are dealt out anew as pairs of blocks.
Copies of a line in one batch give one posting, so frequent lines stay small.

Defined results: NULL counts as empty; lines without words always stay; NULL ids
come last; lines of equal number in rows of one id stand in the same place, so none
of them is earlier and repeated rows lose or keep the same lines; rows of one id with
different texts each lose lines of their own only; a text whose lines all go becomes
empty.  Words, sets and the texts of one id are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jamscope.llm.common import (
    WordBuffer,
    chunks,
    dealt_in_blocks,
    forget_shuffles,
    fresh_names,
    mixed,
    scattered,
    signed,
    small_batches,
    sorted_groups,
    staged,
    text_bytes,
)

#: Bytes of text cut into lines and words at once.
TEXT_BYTES = 1 << 19
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
#: Buckets of the word counts and of the filters, as powers of two.
COUNT_BITS = 22
FILTER_BITS = 22
#: The step of :func:`rarities` up to which a bucket has counted one word at most.
LONE = 6
SEGMENTS = 64
#: Tasks that add up a filter, whose rows are 8 KB for each segment and task before.
FILTER_TASKS = 16
GROUP_ROWS = 8192
BLOCK_ROWS = 4096
#: Buckets of words of a shuffle partition.
BUCKETS = 4
#: Postings of a task that are moved together, and of a bucket that are held before those of
#: hot words are sent on.
PACK_ROWS = 1 << 18
HELD_ROWS = 1 << 19
#: Candidates of a set that one word sends on; the postings of others are put aside.
CANDIDATES = 16
#: Comparisons made at once, and postings whose groups are compared together.
PIECE = 1 << 18
SLICE_ROWS = 1 << 15
#: 64-bit words of the widest parity maps.
MAP_WORDS = 4
#: Largest sets whose maps have one and two words.
MAP_SIZES = (72, 168)
LAST_ID = (1 << 63) - 1


class LineSets:
    """The distinct words of each line of some texts, rarest first.

    Lines with words only.  ``text`` and ``line`` say where a line stands,
    ``begin`` and ``size`` where its words are in ``words``; ``ids`` are hashes
    of the sets.
    """

    def __init__(self, texts: list[bytes], rarity: np.ndarray | None) -> None:
        buffer = WordBuffer(texts)
        breaks = np.flatnonzero(buffer.data == 0x0A)
        after = np.searchsorted(buffer.starts, breaks)
        line = np.repeat(np.arange(len(breaks)), np.diff(after, prepend=0))
        words = buffer.quick_hashes()
        self.all_words = words
        order = self._order(line, words, rarity)
        line, words = line[order], words[order]
        new = np.ones(len(line), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
        line, self.words = line[new], words[new]
        self.begin = np.flatnonzero(np.diff(line, prepend=-1))
        self.size = np.diff(np.append(self.begin, len(line)))
        whole = line[self.begin]
        first_line = np.searchsorted(breaks, buffer.text_starts[:-1])
        self.text = np.searchsorted(first_line, whole, side="right") - 1
        self.line = whole - first_line[self.text]
        if len(self.begin):
            sums = np.add.reduceat(mixed(self.words ^ np.uint64(0x5851F42D4C957F2D)), self.begin)
        else:
            sums = np.zeros(0, np.uint64)
        self.ids = signed(mixed(sums + self.size.astype(np.uint64)))

    @cached_property
    def parity(self) -> np.ndarray:
        """Which of a map's bits an odd number of words falls on; larger sets have wider maps."""
        if not len(self.begin):
            return np.zeros((MAP_WORDS, 0), np.uint64)
        bit = np.uint64(1) << (self.words & np.uint64(63))
        wide = np.repeat(map_words(self.size), self.size)
        place = (self.words >> np.uint64(6)).astype(np.int64) & (wide - 1)
        none = np.uint64(0)
        maps = [np.where(place == k, bit, none) for k in range(MAP_WORDS)]
        return np.stack([np.bitwise_xor.reduceat(m, self.begin) for m in maps])

    @staticmethod
    def _order(line: np.ndarray, words: np.ndarray, rarity: np.ndarray | None) -> np.ndarray:
        """Sorts by line, then rarity, then word."""
        rare = np.zeros(len(words), np.uint64)
        if rarity is not None:
            rare = rarity[words >> np.uint64(64 - COUNT_BITS)].astype(np.uint64)
        if len(line) and line[-1] < 1 << 22:
            # One key: 22 bits of line, 8 of rarity, 34 of the word.
            key = line.astype(np.uint64) << np.uint64(42) | rare << np.uint64(34)
            key |= words >> np.uint64(30)
            order = np.argsort(key)
            key, sorted_ = key[order], words[order]
            if (sorted_[1:] == sorted_[:-1])[key[1:] == key[:-1]].all():
                return order
        return np.lexsort((words, rare, line))


def prefix_sizes(size: np.ndarray) -> np.ndarray:
    a, b = SIMILAR
    return size - (a * size + b - 1) // b + 1


def map_words(size: np.ndarray) -> np.ndarray:
    """How many 64-bit words a set's parity map has: a power of two."""
    return np.where(size <= MAP_SIZES[0], 1, np.where(size <= MAP_SIZES[1], 2, MAP_WORDS))


def differing(nx, ny, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of two columns of parity maps, the wider one folded to the other's width."""
    wx, wy = map_words(nx), map_words(ny)
    least = np.minimum(wx, wy)
    total = np.zeros(len(nx), dtype=np.int64)
    halves = x ^ y
    # Words beyond a map's width are zero, so the difference can be folded as it is.
    for width in (4, 2):
        fold = least < width
        for k in range(width // 2):
            halves[k] = np.where(fold, halves[k] ^ halves[k + width // 2], halves[k])
            halves[k + width // 2] = np.where(fold, np.uint64(0), halves[k + width // 2])
    for k in range(MAP_WORDS):
        total += np.bitwise_count(halves[k])
    return total


def sizes_match(nx, ny, px, py) -> np.ndarray:
    """Length and positional filter for sets that share a word of their prefixes."""
    a, b = SIMILAR
    bound = np.minimum(px, py) + np.minimum(nx - px, ny - py)
    return (b * np.minimum(nx, ny) >= a * np.maximum(nx, ny)) & (bound >= needed(nx, ny))


def needed(nx, ny):
    """Words that similar sets of these sizes have in common at least."""
    a, b = SIMILAR
    return -(-a * (nx + ny) // (a + b))


COUNTED = (
    "set_id long, places array<struct<doc_id: long, line: int, text_id: long>>, segment int, "
    "content binary"
)
MAPS = ("p0", "p1", "p2", "p3")
POSTING = (
    "word long, doc_id long, line int, set_id long, n int, at int, "
    "p0 long, p1 long, p2 long, p3 long"
)


POSTING_NAMES = [f.split()[0] for f in POSTING.split(", ")]


def _sorted_postings(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple]:
    return sorted_groups(batches, POSTING_NAMES, limit)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word sets of lines with all their places, for pieces of texts; and at last the word
    counts of the task, in segments."""
    counts = np.zeros(1 << COUNT_BITS, dtype=np.uint32)
    names = ["set_id", "places", "segment", "content"]
    place = [("doc_id", pa.int64()), ("line", pa.int32()), ("text_id", pa.int64())]
    for batch in small_batches(batches, "text", TEXT_BYTES):
        text_ids, low = batch.column("text_id").to_numpy(), 0
        for ids, sets in _line_sets(batch, None):
            own_texts, low = text_ids[low : low + len(ids)], low + len(ids)
            bucket = (sets.all_words >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
            np.add.at(counts, bucket, np.uint32(1))
            order = np.argsort(sets.ids, kind="stable")
            own, start = np.unique(sets.ids[order], return_index=True)
            places = pa.StructArray.from_arrays(
                [
                    pa.array(ids[sets.text][order], pa.int64()),
                    pa.array(sets.line[order].astype(np.int32)),
                    pa.array(own_texts[sets.text][order], pa.int64()),
                ],
                names=["doc_id", "line", "text_id"],
            )
            offsets = pa.array(np.append(start, len(order)).astype(np.int32))
            columns = [
                pa.array(own, pa.int64()),
                pa.ListArray.from_arrays(offsets, places),
                pa.nulls(len(own), pa.int32()),
                pa.nulls(len(own), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    parts = [c.tobytes() for c in counts.reshape(SEGMENTS, -1)]
    none = [pa.nulls(SEGMENTS, t) for t in (pa.int64(), pa.list_(pa.struct(place)))]
    columns = [*none, pa.array(range(SEGMENTS), pa.int32()), pa.array(parts, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def _posted(ids: np.ndarray, sets: LineSets, rarity: np.ndarray) -> list[np.ndarray]:
    """Postings of the prefix words of the distinct sets that another set can be similar to, as
    columns of ``POSTING``.

    A word whose bucket has counted one word is in no other line: it is not posted.
    """
    a, b = SIMILAR
    doc, able = ids[sets.text], sets.size * b >= a * (sets.size + 1)
    order = np.lexsort((sets.line, doc, sets.ids))
    order = order[able[order]]
    first = np.ones(len(order), dtype=bool)
    first[1:] = sets.ids[order[1:]] != sets.ids[order[:-1]]
    chosen = np.sort(order[first])
    many = prefix_sizes(sets.size[chosen])
    row = np.repeat(chosen, many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    bucket = sets.words[sets.begin[row] + at] >> np.uint64(64 - COUNT_BITS)
    shared = rarity[bucket.astype(np.int64)] > LONE
    row, at = row[shared], at[shared]
    return [
        signed(sets.words[sets.begin[row] + at]),
        doc[row],
        sets.line[row].astype(np.int32),
        sets.ids[row],
        sets.size[row].astype(np.int32),
        at.astype(np.int32),
        *(signed(sets.parity[k][row]) for k in range(MAP_WORDS)),
    ]


def _packed(columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Postings as a row for each bucket of words, numbered from 0.

    Row count and least document id, the bytes a value of each narrow column has, words, sets,
    documents from the least one on, lines, sizes, places, and the words that the maps have.
    """
    own = (columns[0].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(own, kind="stable")
    own = own[order]
    word, doc, line, set_id, n, at, *maps = (c[order] for c in columns)
    wide = map_words(n)
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    content = []
    for low, high in zip(begin.tolist(), [*begin[1:].tolist(), len(own)], strict=True):
        part = slice(low, high)
        least = doc[part].min()
        narrow = [doc[part].view(np.uint64) - least.view(np.uint64), line[part], n[part], at[part]]
        narrow = [x.astype(np.min_scalar_type(x.max())) for x in narrow]
        parts = [np.array([high - low, least], np.int64)]
        parts += [np.array([x.itemsize for x in narrow], np.uint8), word[part], set_id[part]]
        parts += narrow
        parts += [maps[k][part][wide[part] > k] for k in range(MAP_WORDS)]
        content.append(b"".join(x.tobytes() for x in parts))
    return pa.RecordBatch.from_pydict(
        {"bucket": pa.array(own[begin], pa.int32()), "content": pa.array(content, pa.binary())}
    )


def _unpacked(content: bytes) -> list[np.ndarray]:
    """The postings of one row of :func:`_packed`."""
    rows, least = (int(x) for x in np.frombuffer(content, np.int64, 2))
    widths = np.frombuffer(content, np.uint8, 4, 16).tolist()
    place = 20

    def taken(dtype, count: int) -> np.ndarray:
        nonlocal place
        found = np.frombuffer(content, dtype, count, place)
        place += found.nbytes
        return found

    word, set_id = taken(np.int64, rows), taken(np.int64, rows)
    doc, line, n, at = (taken(f"u{w}", rows) for w in widths)
    doc = (doc.astype(np.uint64) + np.int64(least).view(np.uint64)).view(np.int64)
    n = n.astype(np.int32)
    wide, maps = map_words(n), []
    for k in range(MAP_WORDS):
        has = wide > k
        maps.append(np.zeros(rows, np.int64))
        maps[k][has] = taken(np.int64, int(has.sum()))
    return [word, doc, line.astype(np.int32), set_id, n, at.astype(np.int32), *maps]


def _packed_groups(
    batches: Iterator[pa.RecordBatch], limit: int
) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Like :func:`sorted_groups`, for rows ``bucket, content`` sorted by bucket: the postings of
    a bucket together, those of words with more than ``limit`` marked by True."""
    held: list[list[np.ndarray]] = []
    hot = np.zeros(0, np.int64)
    bucket, rows, most = None, 0, HELD_ROWS

    def parted() -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The held postings of hot words and the others."""
        nonlocal hot
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        words, many = np.unique(columns[0], return_counts=True)
        hot = np.union1d(hot, words[many > limit])
        big = np.isin(columns[0], hot) if len(hot) else np.zeros(len(columns[0]), dtype=bool)
        return [c[big] for c in columns], [c[~big] for c in columns]

    for batch in batches:
        for own, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if own != bucket:
                if held:
                    passed, rest = parted()
                    yield True, passed
                    yield False, rest
                held, hot, bucket, rows, most = [], hot[:0], own, 0, HELD_ROWS
            held.append(_unpacked(content.as_buffer()))
            rows += len(held[-1][0])
            if rows > most:
                passed, rest = parted()
                yield True, passed
                held, rows = [rest], len(rest[0])
                most = max(HELD_ROWS, 2 * rows)
    if held:
        passed, rest = parted()
        yield True, passed
        yield False, rest


def _place_order(word: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Sorts by word, then document and line."""
    if len(word) and int(line.max()) < 1 << 16 and len(word) < 1 << 23:
        # One key: 24 bits of word, 24 of document, 16 of line.
        key = line.astype(np.uint64)
        for column, shift in ((doc, 16), (word, 40)):
            order = np.argsort(column)
            rank = np.zeros(len(order), np.uint64)
            rank[order[1:]] = np.cumsum(np.diff(column[order]) != 0)
            key |= rank << np.uint64(shift)
        return np.argsort(key)
    return np.lexsort((line, doc, word))


def _again(word: np.ndarray, set_id: np.ndarray) -> np.ndarray:
    """Whether an earlier row has the same word and set."""
    key = mixed(word.view(np.uint64)) + set_id.view(np.uint64)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    one = (np.diff(word[order]) == 0) & (np.diff(set_id[order]) == 0)
    again = np.zeros(len(word), dtype=bool)
    if (one | ~same).all():
        first = np.flatnonzero(np.append(True, ~same)[: len(order)])
        again[:] = True
        again[np.minimum.reduceat(order, first) if len(order) else order] = False
        return again
    order = np.lexsort((set_id, word))
    again[order[1:]] = (np.diff(word[order]) == 0) & (np.diff(set_id[order]) == 0)
    return again


def _compared(groups: Callable, limit: int | None, most: int):
    """For postings that ``groups`` reads from a stream, all of a word together: of each set the
    ``most`` likeliest earlier sets that pass the filters, with ``n`` for the differing bits of
    the parity maps and the documents of both.

    Where a set has further ones, its posting comes with ``more`` true, and those of the further
    ones with ``more`` false, each once and without ``other``.  Rows of groups beyond ``limit``
    come as they are, without ``other`` and ``more``.
    """
    names, more = POSTING_NAMES, ("other", "other_doc", "more")

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = _place_order(*columns[:3])
        columns = [c[order] for c in columns]
        # Of a set that several batches have, its first row stands for it.
        again = _again(columns[0], columns[3])
        columns = [c[~again] for c in columns]
        low, ends = 0, np.flatnonzero(np.diff(columns[0])) + 1
        while low < len(columns[0]):
            # Whole groups, some rows at once.
            after = ends[np.searchsorted(ends, low + SLICE_ROWS) :]
            high = int(after[0]) if len(after) else len(columns[0])
            yield from met([c[low:high] for c in columns])
            low = high

    def met(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        word, doc, line, set_id, n, at, *maps = columns
        marked, further = np.zeros(len(word), dtype=bool), np.zeros(len(word), dtype=bool)
        i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
        differ = np.zeros(0, np.int32)
        for new in similar(columns):
            i, j, differ = (np.concatenate(x) for x in zip((i, j, differ), new, strict=True))
            if len(i) > PIECE:
                i, j, differ = likeliest(i, j, differ, marked, further)
        i, j, differ = likeliest(i, j, differ, marked, further)
        if len(i):
            starts = [pa.nulls(len(i), pa.int64()), pa.array(doc[i])]
            starts += [pa.nulls(len(i), pa.int32()), pa.array(set_id[i])]
            ends = [pa.array(differ), pa.nulls(len(i), pa.int32())]
            ends += [pa.nulls(len(i), pa.int64())] * MAP_WORDS
            ends += [pa.array(set_id[j]), pa.array(doc[j]), pa.nulls(len(i), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*starts, *ends], names=[*names, *more])
        aside = np.flatnonzero(marked | further)
        if len(aside):
            arrays = [pa.array(c[aside]) for c in columns]
            arrays += [pa.nulls(len(aside), pa.int64())] * 2 + [pa.array(marked[aside])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *more])

    def similar(columns: list[np.ndarray]) -> Iterator[tuple]:
        """Rows of a word, earlier ones second, that pass the filters, and their differing bits."""
        word, doc, line, _, n, at, *maps = columns
        a, b = SIMILAR
        # By size in each group: only sets of sizes that match are compared.
        group = np.append(0, np.cumsum(np.diff(word) != 0)) << 32
        by = np.argsort(group | n)
        group, n, at = group[by], n[by].astype(np.int64), at[by].astype(np.int64)
        parity = np.stack(maps).view(np.uint64)[:, by]
        start = np.searchsorted(group | n, group | -(-a * n // b))
        many = np.arange(len(by)) - start
        rows = np.flatnonzero(many)
        total = np.cumsum(many[rows])
        low = 0
        while low < len(rows):
            base = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, base + PIECE, side="right")))
            m = many[rows[low:high]]
            x = np.repeat(rows[low:high], m)
            y = start[x] + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
            good = sizes_match(n[x], n[y], at[x], at[y])
            x, y = x[good], y[good]
            differ = differing(n[x], n[y], parity[:, x], parity[:, y])
            good = differ <= n[x] + n[y] - 2 * needed(n[x], n[y])
            x, y, differ = by[x[good]], by[y[good]], differ[good].astype(np.int32)
            good = (doc[x] != doc[y]) | (line[x] != line[y])
            x, y = x[good], y[good]
            yield np.maximum(x, y), np.minimum(x, y), differ[good]
            low = high

    def likeliest(i, j, differ, marked: np.ndarray, further: np.ndarray) -> tuple:
        """The ``most`` likeliest of each row ``i``; which rows have more, and which the others are."""
        order = np.lexsort((j, differ, i))
        i, j, differ = i[order], j[order], differ[order]
        begin = np.flatnonzero(np.diff(i, prepend=-1))
        kept = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i)))) < most
        marked[i[~kept]] = True
        further[j[~kept]] = True
        return i[kept], j[kept], differ[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hot, columns in groups(batches, limit):
            if not len(columns[0]):
                continue
            if not hot:
                yield from found(columns)
                continue
            none = [pa.nulls(len(columns[0]), t) for t in (pa.int64(), pa.int64(), pa.bool_())]
            arrays = [*map(pa.array, columns), *none]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *more])

    return run


def _summed(segments: DataFrame, join: Callable, dtype: type, tasks: int) -> np.ndarray:
    """Adds up rows ``segment, content`` in streams; the driver gets one row per segment."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, content in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                part = np.frombuffer(content, dtype=dtype).astype(np.uint64)
                total[s] = join(total[s], part) if s in total else part
        yield pa.RecordBatch.from_pydict(
            {
                "segment": pa.array(list(total), pa.int32()),
                "content": pa.array([t.tobytes() for t in total.values()], pa.binary()),
            }
        )

    dealt = segments.repartition(min(tasks, scattered(segments)), "segment")
    rows = dealt.mapInArrow(add, "segment int, content binary").collect()
    found = {r["segment"]: np.frombuffer(r["content"], dtype=np.uint64) for r in rows}
    if not found:
        return np.zeros(0, np.uint64)
    return np.concatenate([found[s] for s in range(SEGMENTS)])


def rarities(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 256 steps."""
    steps = np.minimum(np.log2(counts.astype(float) + 1) * 6, 255)
    return steps.astype(np.uint8)


class BucketFilter:
    """Whether a 64-bit value may be among some values: one bit for each of fixed buckets."""

    def __init__(self, values: DataFrame) -> None:
        """``values`` has long columns, all of them without NULL."""

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            for batch in batches:
                for column in batch.columns:
                    bits[self.bucket(np.asarray(column))] = True
            content = np.packbits(bits).view(np.uint64).reshape(SEGMENTS, -1)
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array(range(SEGMENTS), pa.int32()),
                    "content": pa.array([c.tobytes() for c in content], pa.binary()),
                }
            )

        marked = values.mapInArrow(mark, "segment int, content binary")
        packed = _summed(marked, np.bitwise_or, np.uint64, FILTER_TASKS)
        self.bits = np.unpackbits(packed.view(np.uint8)).astype(bool)
        if not len(self.bits):
            self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)

    @staticmethod
    def bucket(values: np.ndarray) -> np.ndarray:
        return mixed(values.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return self.bits[self.bucket(values)]


def _line_sets(batch: pa.RecordBatch, rarity: np.ndarray | None) -> Iterator[tuple]:
    """For pieces of a batch: document ids (NULL as the last) and the line sets."""
    texts = text_bytes(batch.column("text"))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    if batch.column("doc_id").null_count:
        ids = batch.column("doc_id").fill_null(LAST_ID).to_numpy()
    for low, high in chunks(texts, TEXT_BYTES):
        yield ids[low:high], LineSets(texts[low:high], rarity)


def _differing_bits(n: Column, m: Column) -> Column:
    """What :func:`differing` counts, for joined postings ``x`` and ``y`` of sizes n and m."""
    d = [F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}")) for p in MAPS]
    halves = d[0].bitwiseXOR(d[2]), d[1].bitwiseXOR(d[3])
    one, two = MAP_SIZES
    width = F.least(*[F.when(k <= one, 1).when(k <= two, 2).otherwise(MAP_WORDS) for k in (n, m)])
    return (
        F.when(width == 1, F.bit_count(halves[0].bitwiseXOR(halves[1])))
        .when(width == 2, F.bit_count(halves[0]) + F.bit_count(halves[1]))
        .otherwise(sum((F.bit_count(x) for x in d[1:]), F.bit_count(d[0])))
    )


class LineIndex:
    """The lines of ``doc_id, text`` and which of them go; made in a few jobs."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs.select("doc_id", "text")
        self.spark = docs.sparkSession
        self.parts = scattered(docs)
        named = self.docs.withColumn("text_id", _text_id())
        found = staged(named.mapInArrow(_counted, COUNTED), "lines")
        self.lines = found.where("segment IS NULL").select("set_id", "places")
        counts = found.where("segment IS NOT NULL").select("segment", "content")
        self.rarity = rarities(_summed(counts, np.add, np.uint32, SEGMENTS))

    def postings(self) -> DataFrame:
        """The postings, packed; a row's bucket says in which task its words meet."""
        shared = self.spark.sparkContext.broadcast(self.rarity)
        buckets, most = BUCKETS * self.parts, PACK_ROWS

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rarity, held, rows = shared.value, [], 0
            for batch in small_batches(batches, "text", TEXT_BYTES):
                for ids, sets in _line_sets(batch, rarity):
                    held.append(_posted(ids, sets, rarity))
                    rows += len(held[-1][0])
                    if rows >= most:
                        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                        held, rows = [], 0
                        yield _packed(columns, buckets)
            if rows:
                yield _packed([np.concatenate(c) for c in zip(*held, strict=True)], buckets)

        return self.docs.mapInArrow(post, "bucket int, content binary")

    def candidates(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``set_id`` with earlier sets ``other`` that may be similar and the differing bits ``n``;
        the postings put aside, those of sets with further candidates with ``more`` true; and
        the documents that have these sets, at least one for each set."""
        fields = f"{POSTING}, other long, other_doc long, more boolean"

        def compared(rows: DataFrame, groups: Callable, limit: int | None, name: str) -> DataFrame:
            found = staged(rows.mapInArrow(_compared(groups, limit, CANDIDATES), fields), name)
            forget_shuffles(self.spark)
            return found

        packed = self.postings().repartitionById(self.parts, "bucket")
        packed = packed.sortWithinPartitions("bucket")
        first = compared(packed, _packed_groups, GROUP_ROWS, "candidates")
        hot = first.where("other IS NULL AND more IS NULL").drop("other", "other_doc", "more")
        # The rows of hot words get other words, so that no two groups have the same one.
        dealt = dealt_in_blocks(hot, "word", "set_id", BLOCK_ROWS)
        # By word alone, as Spark sorts one number far faster than several columns.
        dealt = dealt.repartition(self.parts, "word").sortWithinPartitions("word")
        both = first.unionByName(compared(dealt, _sorted_postings, None, "hot-candidates"))
        sent, aside = both.where("other IS NOT NULL"), both.where("more IS NOT NULL")
        pairs = sent.groupBy("set_id", "other").agg(F.min("n").alias("n"))
        docs = both.where("other IS NOT NULL OR more IS NOT NULL")
        docs = docs.select("doc_id", F.coalesce("other_doc", "doc_id").alias("other_doc"))
        return pairs, aside.drop("other", "other_doc"), docs

    def word_sets(self, wanted: BucketFilter, docs: BucketFilter) -> DataFrame:
        """``set_id`` and ``words`` of the sets that pass a filter, in documents that pass another."""
        shared = self.spark.sparkContext.broadcast(wanted)
        shared_docs = self.spark.sparkContext.broadcast(docs)

        def chosen_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").fill_null(LAST_ID).to_numpy()
                yield batch.filter(pa.array(shared_docs.value(ids)))

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(chosen_texts(batches), "text", TEXT_BYTES):
                for _, sets in _line_sets(batch, None):
                    _, chosen = np.unique(sets.ids, return_index=True)
                    chosen = chosen[shared.value(sets.ids[chosen])]
                    words = [
                        signed(sets.words[b : b + n])
                        for b, n in zip(sets.begin[chosen], sets.size[chosen], strict=True)
                    ]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "set_id": pa.array(sets.ids[chosen]),
                            "words": pa.array(words, pa.list_(pa.int64())),
                        }
                    )

        found = self.docs.mapInArrow(collect, "set_id long, words array<long>")
        return found.dropDuplicates(["set_id"])

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``set_id`` of the pairs that are similar; only their sets are moved."""
        a, b = SIMILAR
        # One filter for both: the other's sets are marked by their complement.
        ends = pairs.select("set_id", F.bitwise_not("other"))
        shared = self.spark.sparkContext.broadcast(BucketFilter(ends))
        among = F.pandas_udf(lambda i: pd.Series(shared.value(i.to_numpy())), "boolean")
        mine = sets.where(among("set_id")).withColumnRenamed("words", "x")
        theirs = sets.where(among(F.bitwise_not("set_id"))).select(F.col("set_id").alias("other"), F.col("words").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        similar = common * b >= (F.size("x") + F.size("y") - common) * a
        both = pairs.join(mine, "set_id").join(theirs, "other")
        return both.where(similar).select("set_id").distinct()

    def late_sets(self) -> DataFrame:
        """``set_id`` of the sets before whose first line a similar one stands."""
        pairs, aside, docs = self.candidates()
        pairs = staged(pairs, "pairs")
        ends = pairs.select("set_id").unionByName(pairs.select(F.col("other").alias("set_id")))
        ends = ends.unionByName(aside.select("set_id"))
        sets = staged(self.word_sets(BucketFilter(ends), BucketFilter(docs)), "sets")
        best = pairs.groupBy("set_id").agg(F.min_by("other", F.struct("n", "other")).alias("other"))
        best = staged(best, "best")
        late = staged(self._verified(best, sets), "late")
        forget_shuffles(self.spark)
        rest = pairs.join(best, ["set_id", "other"], "left_anti").join(late, "set_id", "left_anti")
        others = self._verified(staged(rest.select("set_id", "other"), "rest"), sets)
        late = late.unionByName(staged(others, "late"))
        open_ = aside.where("more").join(late, "set_id", "left_anti")
        open_ = staged(open_, "open")
        forget_shuffles(self.spark)
        return late if open_.isEmpty() else late.unionByName(self._further(open_, aside, sets))

    def _further(self, open_: DataFrame, aside: DataFrame, sets: DataFrame) -> DataFrame:
        """Late ones among sets whose sent candidates were all false: the others are tried."""
        a, b = SIMILAR
        place = F.struct("doc_id", "line").alias("place")
        columns = ["word", "set_id", "n", "at", *MAPS, place]
        x, y = open_.select(*columns).alias("x"), aside.select(*columns).alias("y")
        n, m = F.col("x.n"), F.col("y.n")
        least = F.ceil((n + m) * a / (a + b))
        rest = F.least(n - F.col("x.at"), m - F.col("y.at"))
        pairs = x.join(y, F.col("x.word") == F.col("y.word")).where(
            (F.col("y.place") < F.col("x.place"))
            & (F.col("x.set_id") != F.col("y.set_id"))
            & (F.least(n, m) * b >= F.greatest(n, m) * a)
            & (F.least("x.at", "y.at") + rest >= least)
            & (_differing_bits(n, m) <= n + m - least * 2)
        )
        pairs = staged(
            pairs.select("x.set_id", F.col("y.set_id").alias("other")).distinct(), "all-pairs"
        )
        return self._verified(pairs, sets)

    def removed(self) -> DataFrame:
        """``doc_id`` (NULL as the last id), ``line`` and ``text_id`` of every line that goes."""

        def where(place: Column) -> Column:
            return F.struct(place["doc_id"].alias("doc_id"), place["line"].alias("line"))

        lines = self.lines.repartition("set_id")  # moved once, for both uses
        firsts = lines.groupBy("set_id").agg(
            F.min(where(F.array_min("places"))).alias("first"),
            F.sum(F.size("places")).alias("n"),
        )
        late = self.late_sets().withColumn("late", F.lit(True))
        marked = firsts.join(late, "set_id", "left").where("n > 1 OR late")
        is_late = F.coalesce("late", F.lit(False))
        gone = F.filter("places", lambda p: is_late | (where(p) > F.col("first")))
        # A frequent line has many places: they are dealt out before they become rows.
        found = lines.join(marked, "set_id").select(gone.alias("gone")).repartition(self.parts)
        return found.select(F.inline("gone"))


def _id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(LAST_ID))


def _text_id(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{column}`"), F.lit("")))


def _by_document(index: LineIndex, doc_id: str, text_id: str, removed: str) -> DataFrame:
    """Ids, text hashes and the sorted removed lines of documents that lose any."""
    lines = F.array_sort(F.collect_set("line")).alias(removed)
    keys = F.col("doc_id").alias(doc_id), F.col("text_id").alias(text_id)
    return index.removed().groupBy(*keys).agg(lines)


def line_report(docs: DataFrame) -> DataFrame:
    """Lines and removed lines (numbered from 0) of every document."""
    text = F.coalesce("text", F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = docs.select(
        "doc_id", _id().alias("_id"), _text_id().alias("_text"), (breaks + 1).alias("n_lines")
    )
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    found = _by_document(LineIndex(docs), "_id", "_text", "removed")
    joined = rows.join(found, ["_id", "_text"], "left").withColumn("removed", gone)
    return joined.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with their remaining lines; a column ``n_chars`` is counted anew.

    Only texts of documents that may lose a line are moved to meet their lines.
    """
    doc_id, text_id, gone, may = fresh_names(docs, "id", "text_id", "removed", "may")
    removed = staged(_by_document(LineIndex(docs), doc_id, text_id, gone), "removed")
    shared = docs.sparkSession.sparkContext.broadcast(BucketFilter(removed.select(text_id)))
    may_lose = F.pandas_udf(lambda i: pd.Series(shared.value(i.to_numpy())), "boolean")

    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for body, lines in zip(text, gone, strict=True):
            drop = set() if lines is None else set(lines)
            parts = body.split("\n") if drop else ()
            out.append("\n".join(x for i, x in enumerate(parts) if i not in drop) if drop else body)
        return pd.Series(out)

    marked = docs.withColumns({doc_id: _id(), text_id: _text_id()})
    marked = marked.withColumn(may, may_lose(text_id))
    columns = docs.columns
    joined = marked.where(F.col(may)).join(removed, [doc_id, text_id], "left")
    changed = joined.withColumn(
        "text",
        F.when(F.col(gone).isNull(), F.col("text")).otherwise(
            F.pandas_udf(without, "string")(F.coalesce("text", F.lit("")), gone)
        ),
    )
    if "n_chars" in columns:
        counted = F.when(F.col(gone).isNull(), F.col("n_chars"))
        changed = changed.withColumn("n_chars", counted.otherwise(F.length("text").cast("long")))
    return marked.where(~F.col(may)).select(*columns).unionByName(changed.select(*columns))
