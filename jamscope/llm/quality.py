"""Quality rules: a short-circuit cascade ordered by what a rule rejects for its cost.

Each rule is a condition on a text.  On a bounded sample the cascade measures
how long a rule takes and how many documents it rejects, and puts rules with
the most rejections per second first.  The verdict of a row is one ``CASE``
expression: the first rule that fires ends the work on that row.  The verdict
does not depend on the order.  Only Spark functions are used; there is no
shuffle.

Defined results: a NULL text counts as empty and is rejected for having few
words; repeated rows are judged one by one; other columns pass through and may
have any name, as no helper column is added; an empty table stays empty.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jamscope.llm.common import let, staged, words_of

SYMBOLS = r"[#*$%&|<>]"
VISIBLE = r"[^\x20\x09-\x0D]"

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_SYMBOLS_PERCENT = 10
MAX_DUPLICATE_LINES_PERCENT = 35
MAX_CAPITALS_PERCENT = 30
WORD_LENGTHS = (2, 15)

#: Rows of the sample that orders the rules, on average.
SAMPLE_ROWS = 2000


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")


def n_capitals(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}")).cast("long")


def full_lines(text: Column) -> Column:
    """Lines with a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: line.rlike(VISIBLE))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _windows(words: Column) -> Column:
    """Hash, words and position of every window of three words."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(
            F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
            w.alias("a"),
            F.get(words, i + 1).alias("b"),
            F.get(words, i + 2).alias("c"),
            i.alias("i"),
        ),
    )


def _same(x: Column, y: Column) -> Column:
    return (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)


def _covered(ordered: Column) -> Column:
    """Words inside windows that equal a neighbour in the sorted windows."""
    repeated = F.filter(
        ordered,
        lambda x, i: F.coalesce(
            _same(x, F.get(ordered, i + 1)) | ((i > 0) & _same(x, F.get(ordered, i - 1))),
            (i > 0) & _same(x, F.get(ordered, i - 1)),
        ),
    )
    places = F.sort_array(F.transform(repeated, lambda x: x.i))
    return let(
        places,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))),
            F.lit(0),
            lambda total, x: total + x,
        ),
    )


def n_repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first included.

    Most texts have no repeated window; distinct hashes show that without
    sorting.  Otherwise equal windows are neighbours after sorting by hash and
    words, so a collision of hashes changes nothing.
    """
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(
        let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)),
        let(F.sort_array(_windows(words)), _covered),
    ).otherwise(0).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true for a text that must go; it is never NULL."""

    name: str
    rejects: Callable[[Column, Column], Column]


def default_rules() -> list[Rule]:
    def lines_repeat(text: Column, words: Column) -> Column:
        return let(
            full_lines(text),
            lambda x: n_dup_lines(x) * 100 > F.size(x) * MAX_DUPLICATE_LINES_PERCENT,
        )

    def odd_length(text: Column, words: Column) -> Column:
        n = F.size(words)
        return let(
            word_chars(words), lambda c: (c < n * WORD_LENGTHS[0]) | (c > n * WORD_LENGTHS[1])
        )

    return [
        Rule("few_words", lambda text, words: F.size(words) < MIN_WORDS),
        Rule(
            "repeated_words",
            lambda text, words: n_repeat_words(words) * 100 > F.size(words) * MAX_REPEATED_PERCENT,
        ),
        Rule(
            "symbols",
            lambda text, words: n_symbols(text) * 100 > F.size(words) * MAX_SYMBOLS_PERCENT,
        ),
        Rule("repeated_lines", lines_repeat),
        Rule(
            "capitals",
            lambda text, words: n_capitals(text) * 100 > word_chars(words) * MAX_CAPITALS_PERCENT,
        ),
        Rule("word_length", odd_length),
    ]


@dataclass
class Measured:
    """What a rule cost and rejected on the sample."""

    seconds: float
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-3)


@dataclass
class QualityCascade:
    """Ordered rules.  ``fit`` orders them; unfitted, they keep their given order."""

    rules: list[Rule] = field(default_factory=default_rules)
    measured: dict[str, Measured] = field(default_factory=dict)

    def fit(self, docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> QualityCascade:
        """Measure every rule on about ``rows`` rows drawn from the whole table."""
        total = docs.count()
        share = min(1.0, rows / total) if total else 1.0
        sample = staged(docs.select(F.col(text).alias("text")).sample(fraction=share, seed=7), "quality")
        body = F.col("text")

        def run(condition: Column) -> tuple[float, int]:
            started = time.perf_counter()
            counted = sample.agg(F.count_if(condition)).first()[0]
            return time.perf_counter() - started, counted

        run(F.size(words_of(body)) < 0)  # starts the workers
        base, _ = run(F.size(words_of(body)) < 0)
        for rule in self.rules:
            seconds, rejected = run(let(words_of(body), partial(rule.rejects, body)))
            self.measured[rule.name] = Measured(seconds - base, rejected)
        self.rules.sort(key=lambda r: -self.measured[r.name].worth)
        return self

    def kept(self, text: Column, words: Column, given: Column | None = None) -> Column:
        """The verdict; ``given``, where it is false, already rejects."""
        chain = F.when(~given, F.lit(False)) if given is not None else F
        for rule in self.rules:
            chain = chain.when(rule.rejects(text, words), F.lit(False))
        return chain.otherwise(F.lit(True))

    def filter(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows that no rule rejects, with all their columns."""
        body = F.col(text)
        return docs.where(let(words_of(body), lambda w: self.kept(body, w)))


def quality_report(docs: DataFrame, cascade: QualityCascade | None = None) -> DataFrame:
    """Base measures and verdict of every document.

    The base measures are wanted of all rows, so the cascade skips its rules
    on rows that the base already rejects and takes the measures as they are.
    """
    if cascade is None:
        # Few words and repeated words are decided by the base.
        rules = [r for r in default_rules() if r.name not in ("few_words", "repeated_words")]
        cascade = QualityCascade(rules).fit(docs)
    words = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    text, w = F.col("text"), F.col("words")
    base = words.select(
        "doc_id",
        "text",
        "words",
        F.size(w).cast("long").alias("n_words"),
        word_chars(w).alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        let(full_lines(text), n_dup_lines).alias("n_dup_lines"),
        n_repeat_words(w).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )
    return base.withColumn("base_failed", failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        cascade.kept(text, w, ~F.col("base_failed")).alias("kept"),
    )
