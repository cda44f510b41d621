"""BPE encoding and decoding with a pair occurrence index.

A text is split at special tokens, normalised and cut into words; a chunk's
distinct words become one array of symbols.  The pair index maps the rank of
each adjacent pair to all places where the pair stands.  The lowest active rank
is taken from a heap and merged at all its places at once, from left to right
where places overlap; the pairs that a merge creates join the lists of their
ranks.  Words do not touch, so each word sees its pairs in ascending rank, as
if it were encoded alone.

The vocabulary file is read where the plan is made, and broadcast: its size is
that of the vocabulary, whatever the corpus has.

Defined results: NULL and empty texts have no tokens and decode to the empty
text; repeated rows are encoded one by one; other columns pass through.
Characters that Unicode added after version 16 count as letters or digits
wherever the ``regex`` library knows them, so tokens of such characters can
differ from those of a library built on older tables.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jamscope.llm.common import fresh_names, small_batches, text_bytes

#: Bytes of text whose distinct words are merged together.
CHUNK = 1 << 21


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: the byte's
    own character if it is printable, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    others = [b for b in range(256) if b not in letters]
    return [letters.get(b) or chr(256 + others.index(b)) for b in range(256)]


@dataclass
class Bpe:
    """A word-level BPE vocabulary with byte letters and an end-of-word mark.

    ``split`` cuts a normalised text into words.
    """

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    split: str
    end_mark: str

    @classmethod
    def read(cls, path: str) -> Bpe:
        """A vocabulary in the JSON format of the ``tokenizers`` library."""
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        return cls(
            vocab=model["vocab"],
            merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]],
            special={t["content"]: t["id"] for t in content["added_tokens"]},
            split=content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
            end_mark=model["end_of_word_suffix"],
        )

    def __getstate__(self) -> dict:
        names = ("vocab", "merges", "special", "split", "end_mark")
        return {n: self.__dict__[n] for n in names}

    @cached_property
    def _pattern(self) -> regex.Pattern:
        return regex.compile(self.split)

    @cached_property
    def _specials(self) -> regex.Pattern | None:
        names = sorted(self.special, key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, names))) if names else None

    @cached_property
    def _symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the 256 bytes inside a word and at its end."""
        letters = byte_letters()
        inside = np.array([self.vocab[c] for c in letters], dtype=np.int64)
        return inside, np.array([self.vocab[c + self.end_mark] for c in letters], dtype=np.int64)

    @cached_property
    def _ranks(self) -> tuple[np.ndarray, ...]:
        """By rank: left, right and merged symbol; and all pair codes, sorted, with their ranks."""
        v = self.vocab
        left = np.array([v[a] for a, _ in self.merges], dtype=np.int64)
        right = np.array([v[b] for _, b in self.merges], dtype=np.int64)
        merged = np.array([v[a + b] for a, b in self.merges], dtype=np.int64)
        codes = left << 32 | right
        order = np.argsort(codes)
        return left, right, merged, codes[order], order

    @cached_property
    def _texts(self) -> dict[int, str]:
        return {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Letters are lowered one by one: no final sigma.
        return self._pattern.findall(text.replace("Σ", "σ").lower())

    def _active(self, symbol: np.ndarray, following: np.ndarray, place: np.ndarray) -> tuple:
        """Of the places that begin a pair with a rank: rank and place, by rank."""
        place = place[following[place] >= 0]
        code = symbol[place] << 32 | symbol[following[place]]
        codes, ranks = self._ranks[3:]
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        known = codes[at] == code
        rank, place = ranks[at[known]], place[known]
        order = np.argsort(rank, kind="stable")
        return rank[order], place[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of non-empty words, one after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        if not len(lengths):
            return np.zeros(0, np.int64), lengths
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(lengths)
        inside, final = self._symbols
        symbol = inside[data]
        symbol[ends - 1] = final[data[ends - 1]]
        following = np.arange(1, len(data) + 1, dtype=np.int32)
        following[ends - 1] = -1
        previous = np.arange(-1, len(data) - 1, dtype=np.int32)
        previous[ends - lengths] = -1
        left, right, merged = self._ranks[:3]
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(rank: np.ndarray, place: np.ndarray) -> None:
            cuts = np.flatnonzero(np.diff(rank)) + 1
            starts = [0, *cuts.tolist()] if len(rank) else []
            stops = [*cuts.tolist(), len(rank)]
            for r, a, b in zip(rank[starts].tolist(), starts, stops, strict=False):
                if r in index:
                    index[r].append(place[a:b])
                else:
                    index[r] = [place[a:b]]
                    heapq.heappush(active, r)

        add(*self._active(symbol, following, np.arange(len(data))))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            place = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = left[r], right[r]
            # Places change as pairs beside them merge: merged-away ones have symbol -1.
            place = place[(symbol[place] == a) & (following[place] >= 0)]
            place = place[symbol[following[place]] == b]
            if a == b and len(place) > 1:
                place = place[_alternating(following[place][:-1] == place[1:])]
            if not len(place):
                continue
            gone = following[place]
            beyond = following[gone]
            symbol[place] = merged[r]
            symbol[gone] = -1
            following[place] = beyond
            inner = beyond >= 0
            previous[beyond[inner]] = place[inner]
            before = previous[place]
            add(*self._active(symbol, following, np.union1d(place, before[before >= 0])))
        alive = symbol >= 0
        counts = np.add.reduceat(alive.astype(np.int64), ends - lengths)
        return symbol[alive], counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of texts."""
        numbers: dict[str, int] = {}
        special = {t: -1 - i for t, i in self.special.items()}
        found: list[list[int]] = []
        for text in texts:
            own: list[int] = []
            start = 0
            marks = self._specials.finditer(text) if self._specials and "<" in text else ()
            for mark in marks:
                own += [numbers.setdefault(w, len(numbers)) for w in self.words(text[start : mark.start()])]
                own.append(special[mark[0]])
                start = mark.end()
            rest = text[start:] if start else text
            own += [numbers.setdefault(w, len(numbers)) for w in self.words(rest)]
            found.append(own)
        tokens, counts = self.encode_words([w.encode() for w in numbers])
        starts = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for own in found:
            word = np.array(own, dtype=np.int64)
            plain = word >= 0
            n = np.ones(len(word), dtype=np.int64)
            n[plain] = counts[word[plain]]
            first = np.where(plain, starts[np.maximum(word, 0)], 0)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids = tokens[at] if len(tokens) else np.zeros(len(at), np.int64)
            if not plain.all():
                ids[(np.cumsum(n) - n)[~plain]] = -1 - word[~plain]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens with single blanks between, as a vocabulary without a decoder has it."""
        texts = self._texts
        return " ".join([texts[i] for i in ids])

    def restored(self, ids: list[int]) -> str:
        """The normalised text that the tokens stand for: a blank after each word."""
        letters = {c: b for b, c in enumerate(byte_letters())}
        names = set(self.special.values())
        out = bytearray()
        for i in ids:
            token = self._texts[i]
            if i in names:
                out += token.encode()
                continue
            ends = token.endswith(self.end_mark)
            body = token[: len(token) - len(self.end_mark)] if ends else token
            out += bytes(letters[c] for c in body) + (b" " if ends else b"")
        return out.decode("utf-8", "replace")


def _alternating(touching: np.ndarray) -> np.ndarray:
    """Of places of which neighbours may overlap, every other one of a run, from its first."""
    start = np.concatenate([[True], ~touching])
    place = np.arange(len(start))
    first = np.maximum.accumulate(np.where(start, place, 0))
    return (place - first) % 2 == 0


def _texts_of(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    low = 0
    rows = pa.RecordBatch.from_arrays([column], names=["text"])
    for part in small_batches([rows], "text", CHUNK):
        texts = [t.decode("utf-8", "replace") for t in text_bytes(part.column("text"))]
        yield low, low + len(texts), texts
        low += len(texts)


def _mapped(docs: DataFrame, column: str, keep: list[str], added: list[tuple[str, str]], work):
    """``keep`` columns of ``docs`` and the ``added`` ones that ``work`` makes of ``column``."""
    read = fresh_names(docs, "in")[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(read))
    names = [*keep, *(n for n, _ in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, arrays in work(batch.column(read)):
                kept = [batch.column(c).slice(low, high - low) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=names)
                del arrays

    fields = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] + [f"{n} {t}" for n, t in added]
    return rows.mapInArrow(run, ", ".join(fields))


def encode(docs: DataFrame, model: Bpe, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) with ``ids``, the tokens of ``text``; ``ids`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or docs.columns if c != "ids"]

    def work(column: pa.Array):
        for low, high, texts in _texts_of(column):
            found = [i.astype(np.int32) for i in shared.value.encode(texts)]
            yield low, high, [pa.array(found, pa.list_(pa.int32()))]

    return _mapped(docs, text, keep, [("ids", "array<int>")], work)


def decode(docs: DataFrame, model: Bpe, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) with ``decoded``, the tokens of ``ids`` as text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or docs.columns if c != "decoded"]

    def work(column: pa.Array):
        for low in range(0, len(column), 256):
            lists = column.slice(low, 256).to_pylist()
            texts = [shared.value.decode(i or []) for i in lists]
            yield low, low + len(texts), [pa.array(texts, pa.string())]

    return _mapped(docs, ids, keep, [("decoded", "string")], work)


def round_trip(docs: DataFrame, model: Bpe, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``ids`` and ``decoded`` beside the ``keep`` columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or docs.columns if c not in ("ids", "decoded")]

    def work(column: pa.Array):
        for low, high, texts in _texts_of(column):
            found = [i.astype(np.int32) for i in shared.value.encode(texts)]
            decoded = pa.array([shared.value.decode(i.tolist()) for i in found], pa.string())
            yield low, high, [pa.array(found, pa.list_(pa.int32())), decoded]

    return _mapped(docs, text, keep, [("ids", "array<int>"), ("decoded", "string")], work)


def bpe_report(docs: DataFrame, model: Bpe) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array):
        model = shared.value
        digits = [str(i) for i in range(max(model._texts) + 1)]
        for low, high, texts in _texts_of(column):
            counts, ids_sums, decoded_sums = [], [], []
            for found in model.encode(texts):
                ids = found.tolist()
                counts.append(len(ids))
                written = " ".join([digits[i] for i in ids])
                ids_sums.append(hashlib.sha256(written.encode()).hexdigest())
                decoded_sums.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield low, high, [
                pa.array(counts, pa.int64()),
                pa.array(ids_sums, pa.string()),
                pa.array(decoded_sums, pa.string()),
            ]

    added = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return _mapped(docs, "text", ["doc_id"], added, work)
