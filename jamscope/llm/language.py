"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower-case letters with single blanks between words; every
run of one to three characters is hashed to a bucket.  Bucket counts per
language are added up in Spark from a bounded sample of labelled documents;
the log-probability matrix (languages x buckets) is broadcast.  A task looks
the n-grams of a piece of texts up in one matrix row per language and sums them
per text, all in numpy, so whole texts of any length are scored in pieces.

Defined results: ``und`` with score 0 for a NULL text, a text without a letter,
and for all texts if nothing could be learned.  Ties take the first language in
code point order.  Repeated rows are scored one by one.  Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jamscope.llm.common import chunks, fresh_names, held_out, mixed, small_batches, text_bytes

BUCKETS = 1 << 15
LENGTHS = (1, 2, 3)
#: Labelled documents that are learned from, on average.
SAMPLE_DOCUMENTS = 8_000
#: Languages that a model can have; the matrix has this many rows at most.
MOST_LANGUAGES = 256
SMOOTHING = 0.1
UNKNOWN = "und"
#: Characters handled at once.
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """For each code point: the code of its lower-case letter, a blank for all else."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text each belongs to, and whether texts have letters."""
    parts = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
    lengths = np.array([len(p) + 2 for p in parts])
    ends = np.cumsum(lengths)
    codes = np.full(int(ends[-1]) if len(parts) else 0, 32, dtype=np.uint32)
    folds = _folds()
    for part, end in zip(parts, ends, strict=True):
        codes[end - len(part) - 1 : end - 1] = folds[part]
    owner = np.repeat(np.arange(len(parts)), lengths)
    blank = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes, owner, blank = codes[keep], owner[keep], blank[keep]
    lettered = np.zeros(len(parts), dtype=bool)
    lettered[owner[~blank]] = True
    found, owners = [], []
    for n in LENGTHS:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x1000193) + codes[k : len(codes) - n + 1 + k]
        whole = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            whole &= ~blank
        h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((h[whole] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
        owners.append(owner[: len(whole)][whole])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), lettered
    return np.concatenate(found), np.concatenate(owners), lettered


def pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at blanks where there is one, else between characters."""
    start = 0
    while len(text) - start > PIECE:
        end = text.rfind(b" ", start, start + PIECE) + 1
        if end <= start:
            end = start + PIECE
            while end > start and text[end] & 0xC0 == 0x80:
                end -= 1
        yield text[start:end]
        start = end
    yield text[start:]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code point order, their log priors and bucket log probabilities."""

    languages: list[str]
    priors: np.ndarray
    matrix: np.ndarray

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores (texts x languages) and whether texts have a letter."""
        total = np.tile(self.priors, (len(texts), 1))
        lettered = np.zeros(len(texts), dtype=bool)
        flat, owner = [], []
        for i, text in enumerate(texts):
            for piece in pieces(text):
                flat.append(piece)
                owner.append(i)
        owner = np.array(owner, dtype=np.int64)
        for low, high in chunks(flat, PIECE):
            buckets, place, has = ngrams(flat[low:high])
            np.logical_or.at(lettered, owner[low:high], has)
            for k in range(len(self.languages)):
                sums = np.bincount(place, self.matrix[k][buckets], high - low)
                np.add.at(total[:, k], owner[low:high], sums)
        return total, lettered


def even_shares(sizes: dict[str, int], sample: int) -> dict[str, float]:
    """The share of its rows that each language gives to a sample of ``sample`` rows: all
    languages give as many rows, those with fewer give all and the others make up for them."""
    shares, left = {}, sample
    for k, (lang, size) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        wanted = min(size, left / (len(sizes) - k))
        shares[lang] = wanted / size
        left -= wanted
    return shares


def learn(
    docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, seed: int = 5
) -> LanguageModel:
    """Learn from about ``sample`` rows of ``doc_id``, ``text``, ``lang`` that may be learned from.

    Each language gives the same number of rows, or all where it has fewer, so rare
    languages are learned at any table size; priors come from the counts of all rows.
    More than ``MOST_LANGUAGES`` languages are an error.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the model holds so many")
    total = {r["lang"]: r["count"] for r in sizes}
    shares = even_shares(total, sample)
    rows = known.select("lang", "text")
    rows = rows.sampleBy("lang", shares, seed) if shares else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in small_batches(batches, "text"):
            langs, texts = batch.column("lang").to_pylist(), text_bytes(batch.column("text"))
            for lang, text in zip(langs, texts, strict=True):
                if lang not in sums:
                    sums[lang], seen[lang] = np.zeros(BUCKETS, dtype=np.int64), 0
                seen[lang] += 1
                for piece in pieces(text):
                    sums[lang] += np.bincount(ngrams([piece])[0], minlength=BUCKETS)
        for lang, row in sums.items():
            full = np.flatnonzero(row)
            bucket = np.concatenate([[-1], full])  # bucket -1: documents
            n = np.concatenate([[seen[lang]], row[full]])
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(n), "bucket": bucket.astype(np.int32), "n": n}
            )

    counted = rows.mapInArrow(count, "lang string, bucket int, n long")
    counts = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    languages = sorted(found["lang"].unique())
    matrix = np.full((len(languages), BUCKETS), SMOOTHING)
    documents = np.ones(len(languages))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        own_buckets = own["bucket"].to_numpy()
        inside = own_buckets >= 0
        matrix[k, own_buckets[inside]] += own["n"].to_numpy()[inside]
        documents[k] = total[lang]
    if languages:
        matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True))
        documents = np.log(documents / documents.sum())
    return LanguageModel(languages, documents, matrix)


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all) with ``lang_pred`` and ``score``, that language's probability.

    Existing columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in keep or docs.columns if c not in ("lang_pred", "score")]
    body = fresh_names(docs, "text")[0]
    kept = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(body))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches, body):
            texts = text_bytes(batch.column(body))
            logs, lettered = model.scores(texts)
            if model.languages:
                best = logs.argmax(axis=1)
                top = logs[np.arange(len(texts)), best]
                certain = 1 / np.exp(logs - top[:, None]).sum(axis=1)
            else:
                best, certain = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                lettered[:] = False
            names = [model.languages[b] if l else UNKNOWN for b, l in zip(best, lettered, strict=True)]
            arrays = [batch.column(c) for c in others]
            arrays += [pa.array(names, pa.string()), pa.array(np.where(lettered, certain, 0.0))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*others).dtypes)
    return kept.mapInArrow(score, f"{fields}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Predictions for every document of a table, by a model learned from it."""
    model = learn(docs.select("doc_id", "text", "lang"))
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
