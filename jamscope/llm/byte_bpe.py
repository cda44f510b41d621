"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pattern cuts a text into pre-tokens.  The bytes of pre-tokens that are new to a
task stand in one linked list of symbols, with breaks between pre-tokens.  Each
merge rank has a bucket of list positions where its pair began when it was put
there; a bitmap of three levels marks the buckets in use, so that find-first-set
on three words gives the lowest rank.  Positions whose pair has changed since are
stale and skipped.  A pre-token that is a token itself is taken whole.  A merge may create a pair of a lower rank than its own: the
bucket is then left as it is and the lower rank goes first, so every pre-token
sees its merges lowest rank first and from left to right.  The work grows with the
bytes of a pre-token, not with their square, however long it is.

The rank file is read where the plan is made and broadcast: its size is that of
the vocabulary, whatever the corpus has.  Ids of pre-tokens are remembered by
a worker, up to ``REMEMBERED`` of them.

Defined results: NULL and empty texts have no tokens and decode to empty bytes;
repeated rows are encoded one by one; bytes that are no UTF-8 count as U+FFFD;
NULL ids decode to empty bytes, unknown ids are an error; the other columns pass
through, whatever their names, except that an input column of an output's name is
replaced.  Texts are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jamscope.llm.common import fresh_names, small_batches, text_bytes

#: Bytes of text whose new pre-tokens are merged together.
CHUNK = 1 << 21
#: Positions of a bucket from which on they are merged together.
MANY = 256
#: Pre-tokens that a worker remembers, and the longest of them in characters.
REMEMBERED = 1 << 19
LONGEST_REMEMBERED = 64


class RankQueue:
    """Buckets of list positions by rank; the lowest rank in use is found by three bitmaps.

    A bit of ``top`` stands for a word of ``middle``, a bit there for a word of
    ``low``, and a bit there for a rank.
    """

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [position])
        else:
            bucket.append(position)

    def open(self, rank: int, bucket: list[int]) -> None:
        """Begin the bucket of a rank that has none."""
        self.buckets[rank] = bucket
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def first(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.top:
            return -1
        i = (self.top & -self.top).bit_length() - 1
        bits = self.middle[i]
        i = i << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[i]
        return i << 6 | (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> None:
        """Forget an empty bucket."""
        del self.buckets[rank]
        word = rank >> 6
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            self.middle[word >> 6] ^= 1 << (word & 63)
            if not self.middle[word >> 6]:
                self.top ^= 1 << (word >> 6)


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    mixed = code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).view(np.int64)


class _Chain:
    """The symbols of some pre-tokens as one linked list with breaks, and their queue.

    Merged-away symbols are -1; a link of -1 is a break; ``rank`` is that of the
    pair that begins at a place now, or -1.
    """

    def __init__(self, pieces: list[bytes], model: ByteBpe) -> None:
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.ends = np.cumsum([len(p) for p in pieces])
        self.model = model
        place = np.arange(len(data), dtype=np.int32)
        following, previous = place + 1, place - 1
        following[self.ends - 1] = -1
        previous[np.append(0, self.ends[:-1])] = -1
        symbol = model.bytes[data].astype(np.int32)
        inner = np.flatnonzero(following >= 0)
        rank = np.full(len(data), -1, dtype=np.int32)
        rank[inner] = model.ranks_of(symbol[inner], symbol[inner + 1])
        # Single steps read arrays, steps for many positions the same memory by numpy.
        shared = [array("i", x.tobytes()) for x in (symbol, following, previous, rank)]
        self.symbol, self.following, self.previous, self.rank = shared
        self.views = [np.frombuffer(x, np.int32) for x in shared]
        self.queue = RankQueue(max(model.tokens))
        self._push(rank[inner], inner)

    def _push(self, rank: np.ndarray, place: np.ndarray) -> None:
        known = rank >= 0
        rank, place = rank[known], place[known]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, places = rank[order], place[order].tolist()
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        buckets = self.queue.buckets
        starts = cuts.tolist()
        for r, a, b in zip(rank[cuts].tolist(), starts, [*starts[1:], len(places)], strict=True):
            if r in buckets:
                buckets[r] += places[a:b]
            else:
                self.queue.open(r, places[a:b])

    def merge_one(self, rank: int, i: int) -> bool:
        """Merge the pair at a position, unless it is stale; whether that made a lower rank."""
        ranks = self.rank
        if ranks[i] != rank:
            return False
        symbol, following, previous = self.symbol, self.following, self.previous
        rank_of, shift = self.model.rank_of, self.model.shift
        j = following[i]
        beyond, before = following[j], previous[i]
        symbol[i], symbol[j] = rank, -1
        following[i], ranks[i], ranks[j] = beyond, -1, -1
        lower = False
        if beyond >= 0:
            previous[beyond] = i
            new = rank_of(rank << shift | symbol[beyond])
            if new is not None:
                ranks[i] = new
                self.queue.push(new, i)
                lower = new < rank
        if before >= 0:
            new = rank_of(symbol[before] << shift | rank)
            if new is None:
                ranks[before] = -1
            else:
                ranks[before] = new
                self.queue.push(new, before)
                lower = lower or new < rank
        return lower

    def merge_many(self, rank: int, bucket: list[int]) -> list[int]:
        """Merge all positions of a bucket at once, but for those of pre-tokens in which a
        merge makes a lower rank: these are returned."""
        symbol, following, previous, ranks = self.views
        place = np.array(bucket, dtype=np.int32)
        place = np.unique(place[ranks[place] == rank])
        if not len(place):
            return []
        every = place
        place = place[_alternating(following[place][:-1] == place[1:])]
        second = following[place]
        beyond, before = following[second], previous[place]
        joined = np.append(False, beyond[:-1] == place[1:])  # two merges side by side
        # What single steps would meet: beyond is not merged yet, what lies before is.
        on_left = np.where(before >= 0, symbol[before], -1)
        on_left[joined] = rank
        on_right = np.where(beyond >= 0, symbol[beyond], -1)
        same = np.full(len(place), rank, dtype=np.int32)
        left, right = self.model.ranks_of(on_left, same), self.model.ranks_of(same, on_right)
        lower = ((left >= 0) & (left < rank)) | ((right >= 0) & (right < rank))
        rest = []
        if lower.any():
            piece = np.searchsorted(self.ends, place, side="right")
            apart = np.isin(piece, piece[lower])
            others = np.searchsorted(self.ends, every, side="right")
            rest = every[np.isin(others, piece[lower])].tolist()
            kept = (place, second, beyond, before, joined, left, right)
            place, second, beyond, before, joined, left, right = (x[~apart] for x in kept)
        # Of two merges side by side the left one begins the pair.
        right[:-1][joined[1:]] = left[1:][joined[1:]]
        symbol[place], symbol[second] = rank, -1
        following[place] = beyond
        ranks[place], ranks[second] = right, -1
        inner = beyond >= 0
        previous[beyond[inner]] = place[inner]
        outer = (before >= 0) & ~joined
        ranks[before[outer]] = left[outer]
        self._push(right, place)
        self._push(left[outer], before[outer])
        return rest

    def tokens(self) -> list[bytes]:
        symbol = self.views[0]
        alive = symbol >= 0
        found = symbol[alive].tobytes()
        ends = (4 * np.cumsum(alive)[self.ends - 1]).tolist()
        return [found[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _alternating(touching: np.ndarray) -> np.ndarray:
    """Of places of which neighbours may overlap, every other one of a run, from its first."""
    place = np.arange(len(touching) + 1)
    first = np.maximum.accumulate(np.where(np.append(True, ~touching), place, 0))
    return (place - first) % 2 == 0


class ByteBpe:
    """A byte-level vocabulary: ``tokens`` by rank, and the pattern that cuts texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = pattern
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")

    @classmethod
    def read(cls, path: str, pattern: str) -> ByteBpe:
        """A vocabulary of lines with a token in base64 and its rank."""
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern}

    @cached_property
    def _cut(self) -> Callable[[str], list[str]]:
        return regex.compile(self.pattern).findall

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    @cached_property
    def shift(self) -> int:
        return max(self.tokens).bit_length()

    @cached_property
    def _pairs(self) -> dict[int, int]:
        """The rank of each pair of symbols that joins to a token, by ``left << shift | right``."""
        shift, ranks = self.shift, self.ranks
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left << shift | right] = rank
        return found

    @cached_property
    def _table(self) -> tuple[int, int, np.ndarray, np.ndarray]:
        """All pairs in a hash table of open addresses: its bits, the probes that find any
        pair, codes and ranks."""
        code = np.array(list(self._pairs), dtype=np.int64)
        rank = np.array(list(self._pairs.values()), dtype=np.int32)
        bits = max(4, len(code).bit_length() + 3)
        codes = np.full(1 << bits, -1, dtype=np.int64)
        ranks = np.full(1 << bits, -1, dtype=np.int32)
        probes = 0
        while len(code):
            at = (_slot(code, bits) + probes) & ((1 << bits) - 1)
            free = codes[at] < 0
            codes[at[free]], ranks[at[free]] = code[free], rank[free]
            # Of several in one place the last one has it; the others go on.
            out = codes[at] != code
            code, rank = code[out], rank[out]
            probes += 1
        return bits, probes, codes, ranks

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of many pairs of symbols; -1 for none, or where a symbol is negative."""
        bits, probes, codes, ranks = self._table
        code = left.astype(np.int64) << self.shift | right
        at = _slot(code, bits)
        found = np.where((codes[at] == code) & (code >= 0), ranks[at], -1)
        # A place that is free ends the search; few pairs go on.
        open_ = np.flatnonzero((found < 0) & (codes[at] >= 0) & (code >= 0))
        for step in range(1, probes):
            if not len(open_):
                break
            near = (at[open_] + step) & ((1 << bits) - 1)
            found[open_] = np.where(codes[near] == code[open_], ranks[near], -1)
            open_ = open_[(found[open_] < 0) & (codes[near] >= 0)]
        return found

    @cached_property
    def bytes(self) -> np.ndarray:
        """The symbol of each byte."""
        return np.array([self.ranks[b"%c" % b] for b in range(256)], dtype=np.int64)

    @cached_property
    def rank_of(self) -> Callable[[int], int | None]:
        return self._pairs.get

    @cached_property
    def _known(self) -> dict[str, bytes]:
        return {}

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The token ids of non-empty byte strings, each merged by itself, as 32-bit numbers."""
        if not pieces:
            return []
        chain = _Chain(pieces, self)
        queue = chain.queue
        left: dict[int, int] = {}  # of buckets left for a lower rank: the positions they had then
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            if len(bucket) >= MANY and rank not in left:
                bucket = queue.buckets[rank] = chain.merge_many(rank, bucket)
            if left.pop(rank, 0) != len(bucket):
                bucket.sort(reverse=True)  # the leftmost position is taken from the end
            while bucket:
                if chain.merge_one(rank, bucket.pop()) and bucket:
                    left[rank] = len(bucket)
                    break
            else:
                queue.close(rank)
        return chain.tokens()

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """As ``merged``, but a pre-token that is a token is taken as that, unmerged."""
        whole = [self.ranks.get(p) for p in pieces]
        others = iter(self.merged([p for p, r in zip(pieces, whole, strict=True) if r is None]))
        return [next(others) if r is None else array("i", [r]).tobytes() for r in whole]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of texts."""
        cut = [self._cut(text) for text in texts]
        known = self._known
        new = list({p for pieces in cut for p in pieces if p not in known})
        if len(known) + len(new) > REMEMBERED:
            # What these texts have again is likely to come again.
            often = {p: known[p] for pieces in cut for p in pieces if p in known}
            known.clear()
            known.update(often)
        for piece, own in zip(new, self._encoded([p.encode() for p in new]), strict=True):
            known[piece] = own
        found = [
            np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in cut
        ]
        for piece in new:
            if len(piece) > LONGEST_REMEMBERED:
                del known[piece]
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list[str]]]:
    low = 0
    for part in small_batches([batch], name, CHUNK):
        texts = [t.decode("utf-8", "replace") for t in text_bytes(part.column(name))]
        yield low, low + len(texts), texts
        low += len(texts)


def _added(docs: DataFrame, column: str, keep: list[str], added: dict[str, str], work) -> DataFrame:
    """The ``keep`` columns of ``docs`` and those that ``work`` makes of ``column``."""
    (source,) = fresh_names(docs, "in")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, arrays in work(batch, source):
                kept = [batch.column(i).slice(low, high - low) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*keep, *added])

    new = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items()))
    return rows.mapInArrow(run, StructType([*rows.drop(source).schema, *new]))


def _kept(docs: DataFrame, keep: list[str] | None, added: str) -> list[str]:
    return [c for c in (docs.columns if keep is None else keep) if c.lower() != added]


def encode(
    docs: DataFrame, model: ByteBpe, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all) with ``ids``, the tokens of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, source: str):
        for low, high, texts in _texts(batch, source):
            yield low, high, [pa.array(shared.value.encode(texts), pa.list_(pa.int32()))]

    return _added(docs, text, _kept(docs, keep, "ids"), {"ids": "array<int>"}, work)


def decode(
    docs: DataFrame, model: ByteBpe, ids: str = "ids", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all) with ``decoded``, the bytes that the tokens of ``ids`` stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, source: str):
        for low in range(0, batch.num_rows, 256):
            lists = batch.column(source).slice(low, 256).to_pylist()
            found = [shared.value.decode(i or []) for i in lists]
            yield low, low + len(found), [pa.array(found, pa.binary())]

    return _added(docs, ids, _kept(docs, keep, "decoded"), {"decoded": "binary"}, work)


def byte_bpe_report(docs: DataFrame, model: ByteBpe) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, source: str):
        model = shared.value
        digits = {i: str(i) for i in model.tokens}
        for low, high, texts in _texts(batch, source):
            counts, ids_sums, decoded_sums = [], [], []
            for found in model.encode(texts):
                ids = found.tolist()
                counts.append(len(ids))
                written = ",".join(map(digits.__getitem__, ids))
                ids_sums.append(hashlib.sha256(written.encode()).hexdigest())
                decoded_sums.append(hashlib.sha256(model.decode(ids)).hexdigest())
            yield low, high, [
                pa.array(counts, pa.int64()),
                pa.array(ids_sums, pa.string()),
                pa.array(decoded_sums, pa.string()),
            ]

    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _added(docs, "text", ["doc_id"], added, work)
