"""Toxicity: a weighted lexicon, matched after folding disguises.

Folding maps letters that look like Latin ones, accents, full-width forms and
digits or signs that stand for letters inside a word to plain letters; all else
becomes a blank.  An Aho-Corasick automaton over the folded text finds lexicon
words and phrases at word borders.  A match inside an exception phrase does not
count.  The weights of the matches are added up, normalised by the number of
words and turned into a probability by a logistic curve.

The lexicon starts from a list of common insults.  Words join it, and weights
are set, by their log odds in a bounded sample of labelled documents; the curve
is fitted on the same sample.  No label is read at scoring.

Defined results: NULL and empty texts have no match and get the score of a text
without matches; documents without a label are scored like others; repeated
rows are scored one by one; a document labelled twice counts as toxic if one of
its labels says so.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jamscope.llm import simhash
from jamscope.llm.common import fresh_names, held_out, small_batches, staged, text_bytes

#: Labelled documents that are learned from, on average.
SAMPLE_DOCUMENTS = 20_000
#: Words that labels can add to the lexicon.
MOST_LEARNED = 5_000
#: A learned word stands in so many toxic texts at least; near-copies count as one text
#: together, so that the words of one much-copied text do not join.
MIN_SUPPORT = 5
MIN_LOG_ODDS = 2.5
#: Log odds of a listed word that the sample does not have.
PRIOR_WEIGHT = 3.0
THRESHOLD = 0.3
PIECE = 1 << 18

# Insults of everyday English, phrases in which such words are harmless.
INSULTS = (
    "asshole bastard bitch clown coward creep cretin degenerate disgusting dumb dumbass fool "
    "freak garbage idiot idiotic imbecile jerk liar loser lunatic maggot moron moronic parasite "
    "pathetic pig psycho retard scum scumbag shit stupid trash ugly vermin worthless"
).split()
EXCEPTIONS = (
    "clown fish",
    "circus clown",
    "class clown",
    "garbage can",
    "garbage collection",
    "garbage collector",
    "garbage truck",
    "guinea pig",
    "not stupid",
    "not worthless",
    "pig iron",
    "trash bag",
    "trash bin",
    "trash can",
)
# Letters of other scripts by the Latin letter they look like, and stand-ins.
LOOKALIKES = {
    "a": "аαɑ",
    "b": "Вв",
    "c": "сϲС",
    "d": "ԁ",
    "e": "еєεЕ",
    "g": "ɡ",
    "h": "һНн",
    "i": "іıιІ",
    "j": "ј",
    "k": "кκК",
    "l": "ӏⅼ",
    "m": "мМ",
    "n": "ոη",
    "o": "оοσО",
    "p": "рρР",
    "q": "ԛ",
    "r": "г",
    "s": "ѕЅ",
    "t": "тτТ",
    "u": "υս",
    "v": "νѵ",
    "w": "ԝω",
    "x": "хχХ",
    "y": "уүУ",
    "z": "ᴢ",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INNER_STAND_INS = {"!": "i", "|": "i"}

_BLANK = 32
_DROPPED = 255
#: What a text without near-copies adds to the support of its words.
_WHOLE = 1 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its folded letter; and its stand-in class (1 anywhere, 2 inside)."""
    fold = np.full(0x110000, _BLANK, dtype=np.uint8)
    kind = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x30000):
        c = chr(i)
        if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
            fold[i] = _DROPPED
        elif c.isalpha():
            plain = unicodedata.normalize("NFKD", c)[0].lower()
            fold[i] = ord(plain) if "a" <= plain <= "z" else 1
    for letter, others in LOOKALIKES.items():
        for other in others:
            for form in {other, other.lower(), other.upper()}:
                if len(form) == 1:
                    fold[ord(form)] = ord(letter)
    for signs, k in ((STAND_INS, 1), (INNER_STAND_INS, 2)):
        for sign, letter in signs.items():
            fold[ord(sign)], kind[ord(sign)] = ord(letter), k
    return fold, kind


def folded(text: str) -> str:
    """Words of plain letters with single blanks between, and one at either end.

    ``i`` stands for ``l`` as well, since ``1`` and ``|`` are used for both.
    Letters outside the alphabet keep a word apart as ``\\x01``.
    """
    fold, kind = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, signs = fold[codes], kind[codes]
    shown = out != _DROPPED
    if not shown.all():
        out, signs = out[shown], signs[shown]
    if signs.any():
        place = np.arange(len(out))
        plain = signs == 0
        letter = plain & (out != _BLANK)
        last = np.maximum.accumulate(np.where(plain, place, -1))
        following = np.minimum.accumulate(np.where(plain, place, len(out))[::-1])[::-1]
        after = np.append(letter, False)[following]
        before = (last >= 0) & letter[last]
        stands = np.where(signs == 2, before & after, before | after)
        out = np.where(plain | stands, out, _BLANK).astype(np.uint8)
    out = np.concatenate([[_BLANK], out, [_BLANK]]).astype(np.uint8)
    blank = out == _BLANK
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    out = out[keep]
    out[out == ord("l")] = ord("i")
    return out.tobytes().decode("latin-1")


def folded_pieces(text: bytes) -> Iterator[str]:
    """A folded text in parts; a long text is cut at line ends or blanks, so words stay whole."""
    start = 0
    while len(text) - start > PIECE:
        end = max(text.rfind(c, start, start + PIECE) for c in (b"\n", b" ")) + 1
        if end <= start:
            break
        yield folded(text[start:end].decode("utf-8", "replace"))
        start = end
    yield folded(text[start:].decode("utf-8", "replace"))


@dataclass(frozen=True)
class ToxicityModel:
    """Folded lexicon words with weights, exception phrases, and the curve's parameters."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 1.0, 0.5)
    _built: dict = field(default_factory=dict, compare=False, repr=False)

    def automaton(self) -> ahocorasick.Automaton:
        if "automaton" not in self._built:
            found = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                found.add_word(f" {word} ", (len(word), weight))
            for phrase in self.exceptions:
                shape = folded(phrase)
                found.add_word(shape, (len(shape) - 2, None))
            found.make_automaton()
            self._built["automaton"] = found
        return self._built["automaton"]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_built": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def measure(self, text: bytes) -> tuple[float, int]:
        """Weight of the matches outside exceptions, and the number of words."""
        total, words = 0.0, 0
        if not self.weights and not self.exceptions:
            return 0.0, sum(piece.count(" ") - 1 for piece in folded_pieces(text))
        automaton = self.automaton()
        for piece in folded_pieces(text):
            words += max(piece.count(" ") - 1, 0)
            hits, spared = [], []
            for end, (length, weight) in automaton.iter(piece):
                span = (end - length, end)
                if weight is None:
                    spared.append(span)
                else:
                    hits.append((span, weight))
            for (start, end), weight in hits:
                if not any(a <= start and end <= b for a, b in spared):
                    total += weight
        return total, words

    def probability(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * _density(total, words))))


def _density(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(100 * total / np.maximum(words, 1))


def fitted_curve(total: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple:
    """Logistic regression of the label on total and density, slightly held back."""
    x = np.column_stack([np.ones(len(total)), np.log1p(total), _density(total, words)])
    beta = np.zeros(3)
    hold = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (toxic - p) - hold @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int = 3) -> DataFrame:
    """Texts and labels of about ``rows`` labelled documents that may be learned from."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    # About ``rows`` rows of two numbers: small enough for every executor.
    chosen = F.broadcast(known.sample(fraction=min(1.0, rows / total) if total else 1.0, seed=seed))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic")


def weighed(sample: DataFrame) -> DataFrame:
    """Distinct texts of ``doc_id, text, toxic`` with ``toxic`` and ``share``.

    Copies of one text say no more than the text; near-copies of one label, by
    SimHash groups, share ``_WHOLE`` between them.
    """
    hashed = sample.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    marks = hashed.groupBy("text_hash").agg(F.max("toxic").alias("toxic"))
    roots = simhash.groups(sample.select("doc_id", "text")).select("text_hash", "root").distinct()
    known = staged(marks.join(roots, "text_hash"), "copies")
    label = (F.col("toxic") > 0).alias("label")
    sizes = known.groupBy("root", label).agg(F.count(F.lit(1)).alias("n"))
    marked = known.withColumn("label", label).join(sizes, ["root", "label"])
    shares = marked.select(
        "text_hash", "toxic", F.ceil(_WHOLE / F.col("n")).cast("long").alias("share")
    )
    # About ``SAMPLE_DOCUMENTS`` rows of three numbers.
    texts = hashed.select("text", "text_hash").dropDuplicates(["text_hash"])
    return texts.join(F.broadcast(shares), "text_hash").select("text", "toxic", "share")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCUMENTS) -> ToxicityModel:
    sample = staged(labelled_sample(docs, labels, rows), "labelled")
    distinct = weighed(sample)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {"": [0, 0, 0]}
        for batch in small_batches(batches, "text"):
            toxic, share = (batch.column(c).to_pylist() for c in ("toxic", "share"))
            for text, label, part in zip(text_bytes(batch.column("text")), toxic, share, strict=True):
                found = {""}
                for piece in folded_pieces(text):
                    found.update(piece.split())
                for word in found:
                    if len(word) < 3 and word:
                        continue
                    count = counts.setdefault(word, [0, 0, 0])
                    count[int(label > 0)] += 1
                    count[2] += part if label > 0 else 0
        yield pa.RecordBatch.from_pydict(
            {
                "word": list(counts),
                "clean": [c[0] for c in counts.values()],
                "toxic": [c[1] for c in counts.values()],
                "support": [c[2] for c in counts.values()],
            }
        )

    counted = (
        distinct.mapInArrow(words, "word string, clean long, toxic long, support long")
        .groupBy("word")
        .agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "support")])
    )
    totals = counted.where("word = ''").first()
    clean, toxic = (totals["clean"], totals["toxic"]) if totals else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    listed = {folded(w).strip() for w in INSULTS}
    listed |= {w + "s" for w in listed}
    scored = counted.where("word != ''").withColumn("odds", odds)
    supported = F.col("support") >= MIN_SUPPORT * _WHOLE  # shares are rounded up
    strong = supported & (F.col("odds") >= MIN_LOG_ODDS)
    best = scored.where(strong).orderBy(F.desc("support"), "word").limit(MOST_LEARNED).collect()
    weights = {w: PRIOR_WEIGHT for w in listed}
    for row in scored.where(F.col("word").isin(sorted(listed))).collect():
        seen = row["clean"] + row["toxic"]
        weights[row["word"]] = max(0.0, (PRIOR_WEIGHT * 4 + row["odds"] * seen) / (4 + seen))
    weights |= {row["word"]: row["odds"] for row in best if row["word"] not in listed}
    model = ToxicityModel(weights)
    if not clean or not toxic:
        return model

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            pairs = [model.measure(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_pydict(
                {
                    "total": pa.array([p[0] for p in pairs], pa.float64()),
                    "words": pa.array([p[1] for p in pairs], pa.int64()),
                    "toxic": batch.column("toxic"),
                }
            )

    # About ``rows`` rows of three numbers.
    found = sample.mapInArrow(measures, "total double, words long, toxic int").toPandas()
    curve = fitted_curve(
        found["total"].to_numpy(), found["words"].to_numpy(), (found["toxic"] > 0).to_numpy(float)
    )
    return ToxicityModel(weights, curve=curve)


def score(
    docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all) with ``score``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in keep or docs.columns if c != "score"]
    body = fresh_names(docs, "text")[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(body))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches, body):
            pairs = [model.measure(t) for t in text_bytes(batch.column(body))]
            values = np.array(pairs, dtype=float).reshape(-1, 2)
            arrays = [batch.column(c) for c in others]
            arrays.append(pa.array(model.probability(values[:, 0], values[:, 1])))
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "score"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*others).dtypes)
    return rows.mapInArrow(measured, f"{fields}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document, by a model learned from the labels that may be read."""
    found = score(docs, learn(docs, labels), keep=["doc_id"])
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
