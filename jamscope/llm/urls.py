"""URL filters: path rules, then a classifier over the words inside host names.

Host names run words together (``bestcasinobonus``).  A unigram model counts
words where they stand apart, in paths and in labels with several words; whole
labels are then cut by it, and their parts count as well.  A whole label never
speaks for itself being a word, so names are cut alike in tables of any size.
Viterbi cuts each name into the words of the most likely product.  Multinomial naive Bayes then scores the segmented
host and path words of a URL as wanted or not.

The classifier learns from a bounded sample of labelled URLs.  ``weak_labels``
makes such labels where there are none: a URL is unwanted if its segmented host
has one of a list of words.  What else such URLs have in common is learned.

Rules decide before the classifier; of the rules that fit, the longest wins.

Defined results: a NULL URL, or one without ``://``, has an empty host and path
and is scored by the prior alone; repeated rows are judged one by one; an empty
table stays empty.  Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jamscope.llm.common import staged

#: The rules (text, verdict); the text is a host and the start of a path.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Words that mark unwanted hosts, for labels where there are none.
UNWANTED = (
    "ad ads adult bet bets betting bonus casino cheap clickbait dating escort farm free gambling "
    "jackpot lottery loan loans pill pills poker porn porno replica sex spam track tracker "
    "viagra warez win xxx"
).split()
#: Words of the unigram model: this many of the most frequent ones, and those above.
VOCABULARY = 50_000
LONGEST_WORD = 24
#: An unknown part of a cut name has so many letters at least.
UNKNOWN_PART = 4
#: How often whole labels are cut to count their parts.
ROUNDS = 2
#: URLs that are learned from, on average.
SAMPLE_URLS = 20_000
LETTERS = r"[a-z]+"


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to a slash, question mark or hash; A-Z lowered."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The text of the longest rule that fits, else NULL."""
    found = F
    for text, _ in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = found.when(fits, F.lit(text))
    return found.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


@dataclass
class Segmenter:
    """Words with their counts; ``split`` finds the most likely words of a name.

    ``labels`` are words known only from a whole label: they can be parts of other names,
    but a name that is one of them is cut as if it was unknown.
    """

    counts: dict[str, int]
    labels: frozenset[str] = frozenset()
    _known: dict[str, list[str]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        total = sum(self.counts.values()) + 1
        self._log = {w: math.log(c / total) for w, c in self.counts.items()}
        self._total = math.log(total)

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "labels": self.labels}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["counts"], state["labels"])

    def _cost(self, word: str, whole: bool) -> float:
        """Log probability; an unknown word loses a factor of ten with each letter.

        Single letters and short unknown words are no parts of a longer name.
        """
        known = None if whole and word in self.labels else self._log.get(word)
        if not whole and len(word) < (2 if known is not None else UNKNOWN_PART):
            return -math.inf
        return known if known is not None else -self._total - len(word) * math.log(10)

    def split(self, name: str) -> list[str]:
        if name not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[name] = self._viterbi(name)
        return self._known[name]

    def _viterbi(self, name: str) -> list[str]:
        best, cut = [0.0], [0]
        for end in range(1, len(name) + 1):
            score, start = max(
                (best[s] + self._cost(name[s:end], end - s == len(name)), s)
                for s in range(max(0, end - LONGEST_WORD), end)
            )
            best.append(score)
            cut.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[cut[end] : end])
            end = cut[end]
        # A name that is unknown for the most part stays whole.
        known = sum(len(w) for w in words if w in self._log)
        return words[::-1] if 2 * known >= len(name) and best[-1] > -math.inf else [name][: len(name)]

    def host_words(self, host: str) -> list[str]:
        return [w for name in re.findall(LETTERS, host) for w in self.split(name)]

    def tokens(self, host: str, path: str) -> list[str]:
        """Segmented words of host and path, told apart."""
        own = ["h:" + w for w in self.host_words(host)]
        return own + [
            "p:" + w for name in re.findall(LETTERS, path.lower()) for w in self.split(name)
        ]


def learn_segmenter(hosts: DataFrame, vocabulary: int = VOCABULARY) -> Segmenter:
    """Counts over the paths and labels of ``host, path``.

    A path word counts once a host, unless it is a label of that host; the words of a label
    with several count once a label.  Each other label is cut, and adds one to its parts.
    """
    runs = F.regexp_extract_all("label", F.lit(LETTERS), F.lit(0))
    parts_of = F.split("host", r"\.")
    labels = hosts.select(F.explode(parts_of).alias("label")).distinct().select(runs.alias("runs"))
    in_path = F.explode(F.regexp_extract_all(F.lower("path"), F.lit(LETTERS), F.lit(0)))
    apart = (
        hosts.select("host", parts_of.alias("labels"), in_path.alias("w"))
        .where(~F.array_contains("labels", F.col("w")))
        .select("host", "w")
        .distinct()
        .select("w")
        .unionByName(labels.where(F.size("runs") > 1).select(F.explode(F.array_distinct("runs")).alias("w")))
        .where(F.length("w") <= LONGEST_WORD)
    )
    apart = staged(apart.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    whole = staged(labels.where(F.size("runs") == 1).select(F.col("runs")[0].alias("w")).distinct(), "labels")

    def model(votes: DataFrame) -> Segmenter:
        """From rows of ``w``, ``n`` and how many of these come from elsewhere, ``others``."""
        words = votes.groupBy("w").agg(F.sum("n").alias("n"), F.sum("others").alias("others"))
        top = words.orderBy(F.desc("n"), "w").limit(vocabulary).collect()
        counts = {r["w"]: r["n"] for r in top}
        # Listed words are words, however rare they are.
        floor = max(2, sum(counts.values()) // 10_000)
        for word in UNWANTED:
            counts[word] = max(counts.get(word, 0), floor)
        return Segmenter(counts, frozenset(r["w"] for r in top if not r["others"]) - set(UNWANTED))

    def cut_by(segmenter: Segmenter):
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(w, 1, int(w != name)) for name in batch["w"] for w in segmenter.split(name)]
                yield pd.DataFrame(rows, columns=["w", "n", "others"])

        return cut

    given = apart.select("w", "n", F.col("n").alias("others"))
    segmenter = model(given)
    for _ in range(ROUNDS):
        cut = whole.mapInPandas(cut_by(segmenter), "w string, n long, others long")
        segmenter = model(given.unionByName(cut.where(F.length("w") <= LONGEST_WORD)))
    return segmenter


def weak_labels(segmenter: Segmenter):
    """1 for hosts with an unwanted word, else 0, as a pandas UDF over the host."""
    unwanted = frozenset(UNWANTED)

    def label(host: pd.Series) -> pd.Series:
        return host.map(lambda h: int(not unwanted.isdisjoint(segmenter.host_words(h))))

    return F.pandas_udf(label, "int")


@dataclass(frozen=True)
class UrlModel:
    """Log odds of tokens for being unwanted, and of the prior."""

    segmenter: Segmenter
    odds: dict[str, float]
    prior: float

    def score(self, host: str, path: str) -> float:
        return self.prior + sum(self.odds.get(t, 0.0) for t in self.segmenter.tokens(host, path))


def learn(labelled: DataFrame, segmenter: Segmenter) -> UrlModel:
    """Naive Bayes from rows of ``host, path, label`` (1: unwanted).

    The model holds every token of these rows, so their number bounds its size.
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (t, label)
                for h, p, label in zip(batch["host"], batch["path"], batch["label"], strict=True)
                for t in ["", *segmenter.tokens(h, p)]
            ]
            yield pd.DataFrame(rows, columns=["token", "label"])

    counted = (
        labelled.mapInPandas(tokens, "token string, label int")
        .groupBy("token")
        .agg(F.count_if(F.col("label") == 0).alias("good"), F.count_if(F.col("label") == 1).alias("bad"))
    )
    urls = counted.where("token = ''").first()
    words = counted.where("token != ''")
    sums = words.agg(F.sum("good"), F.sum("bad"), F.count(F.lit(1))).first()
    if urls is None:
        return UrlModel(segmenter, {}, -1.0)
    good, bad, size = (x or 0 for x in sums)
    odds = {
        r["token"]: math.log((r["bad"] + 1) / (bad + size)) - math.log((r["good"] + 1) / (good + size))
        for r in words.collect()
    }
    return UrlModel(segmenter, odds, math.log((urls["bad"] + 1) / (urls["good"] + 1)))


def url_report(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE_URLS
) -> DataFrame:
    """Host, path, rule and verdict of every row of ``page_id, url``."""
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    segmenter = learn_segmenter(parts.select("host", "path"))
    total = pages.count()
    some = parts.select("host", "path").sample(fraction=min(1.0, sample / total) if total else 1.0, seed=11)
    model = learn(some.withColumn("label", weak_labels(segmenter)("host")), segmenter)

    def judge(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([model.score(h, p) for h, p in zip(host, path, strict=True)], dtype=float)

    score = F.pandas_udf(judge, "double")("host", "path")
    ruled = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    host, path = F.col("host"), F.col("path")
    judged = parts.withColumn("rule", longest_rule(host, path, rules)).withColumn("score", score)
    verdict = F.when(F.col("rule").isNotNull(), F.try_element_at(ruled, F.col("rule"))).otherwise(
        F.when(F.col("score") > 0, "block").otherwise("allow")
    )
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
