"""Source divergence audit: how the word use of sources differs within a language.

Each source of a language, and the language itself, is a count tree: a segment tree
whose leaves are the language's kept terms and hold the counts there.  Trees are
hash-consed: subtrees of equal counts are one node, whatever place or source they
have.  Two trees are compared by walking both at once; a pair of nodes is priced once
and weighed by how often the walk meets it, so the many equal stretches of rare terms
cost one visit a level.

A price compares smoothed shares: p = 1 + floor(10^9 (count + 1) / (N + V)), N the
counts of the group over the V kept terms, and f = floor((p - q)^2 / q).  All of it is
integer arithmetic.

How it is spread: terms are counted per source in the tasks that read the texts, then
added up; kept terms are dealt by hash to segments of about ``WIDTH`` terms.  A unit of
work is one segment of one language with two blocks of about ``SOURCES`` sources, so
neither a large vocabulary nor a language of many sources meets in one task.  Units
give partial sums per pair of sources, which are added up, and their own first ranks of
terms, of which the first ranks overall are taken.

Defined results: NULL text, language and source count as empty texts; repeated rows are
documents of their own; documents without terms still make their group known; equal
values rank by item; without kept terms all pairs have value 0 and no term is listed;
an empty table gives an empty result.  Texts are taken whole, other columns not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jamscope.llm.common import small_batches, staged, text_bytes

#: Terms of a segment and sources of a block, about.
WIDTH = 1 << 13
SOURCES = 48
#: Counted terms that a task holds before it passes them on.
HELD = 300_000
#: Node pairs that are walked at once, about.
WALKED = 1 << 20
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    """Documents of a language that a kept term is in at least; term ranks listed per group."""

    least_docs: int = 3
    term_ranks: int = 200


def _term_bytes() -> bytes:
    """A-Z lowered; ASCII bytes that are no letter as blanks."""
    letters = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes((b | 0x20 if b < 0x80 else b) if b in letters else 0x20 for b in range(256))


_TERM_BYTES = _term_bytes()
COUNTED = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group and term the occurrences and documents; the empty term stands for the group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, docs) in held.items():
            terms = pa.array(list(total), pa.binary())
            try:
                terms = terms.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no UTF-8
                terms = pa.array([t.decode("utf-8", "replace") for t in total], pa.string())
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(total), pa.string()),
                    "source": pa.array([source] * len(total), pa.string()),
                    "term": terms,
                    "n": pa.array(list(total.values()), pa.int64()),
                    "docs": pa.array([docs[t] for t in total], pa.int64()),
                }
            )
        held.clear()

    for batch in small_batches(batches, "text"):
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, text in zip(groups, text_bytes(batch.column("text")), strict=True):
            counts = held.get(group)
            if counts is None:
                counts = held[group] = Counter({b"": 0}), Counter()
            total, docs = counts
            terms = text.translate(_TERM_BYTES).split()
            size -= len(total)
            total.update(terms)
            docs.update(set(terms))
            size += len(total)
        if size > HELD:
            yield from passed_on()
            size = 0
    yield from passed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: a row per group and term, and one per group with an
    empty term."""
    rows = docs.select(
        "text", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    )
    found = rows.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term")
    return found.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) by long division, exact up to totals of 9 * 10^15."""
    rest, found = count.astype(np.int64) + 1, np.zeros(len(count), dtype=np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digit
    return found + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Forest:
    """Hash-consed segment trees over the same terms, one per row of ``counts``.

    ``levels[k]`` holds the nodes of width 2^k as (left, right) numbers of nodes a level
    below; nodes of width 1 are the distinct counts, where -1 stands beyond the last
    term.  ``roots`` are the trees' nodes at the top level.
    """

    def __init__(self, counts: np.ndarray) -> None:
        trees, terms = counts.shape
        depth = max(0, int(terms - 1).bit_length())
        padded = np.full((trees, 1 << depth), -1, dtype=np.int64)
        padded[:, :terms] = counts
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(trees, -1)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        below = len(self.leaves)
        for _ in range(depth):
            code, again = np.unique(nodes[:, 0::2] * below + nodes[:, 1::2], return_inverse=True)
            self.levels.append((code // below, code % below))
            nodes, below = again.reshape(trees, -1), len(code)
        self.roots = nodes[:, 0]

    def walk(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """Leaf pairs met by walking trees ``first[i]`` and ``second[i]`` at once: the walk, the
        two counts, and how often; each pair of nodes of a walk is opened once."""
        walk = np.arange(len(first))
        a, b = self.roots[first], self.roots[second]
        often = np.ones(len(first), dtype=np.int64)
        for left, right in reversed(self.levels):
            walk, often = np.tile(walk, 2), np.tile(often, 2)
            a, b = np.append(left[a], right[a]), np.append(left[b], right[b])
            walk, a, b, often = _once(walk, a, b, often)
        x, y = self.leaves[a], self.leaves[b]
        there = x >= 0
        return walk[there], x[there], y[there], often[there]


def _once(walk: np.ndarray, a: np.ndarray, b: np.ndarray, often: np.ndarray) -> tuple:
    """Equal (walk, a, b) as one, with their multiplicities added."""
    n, m = int(a.max()) + 1, int(b.max()) + 1
    key = (walk * n + a) * m + b
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    often = np.add.reduceat(often[order], start)
    key = key[start]
    return key // m // n, key // m % n, key % m, often


def _unit(table: pa.Table, term_ranks: int) -> pa.Table:
    """Partial pair sums and first term ranks of a unit.

    Rows: ``term`` NULL for a source (``n`` its sum of counts) and for the language
    (``source`` NULL); else the count of a term in a source or the language.
    """
    lang = table.column("lang")[0].as_py()
    v = table.column("v")[0].as_py()
    one, other = table.column("one")[0].as_py(), table.column("other")[0].as_py()
    sources, terms = table.column("source"), table.column("term").cast(pa.binary())
    n = table.column("n").to_numpy()
    source_of, term_of = sources.is_null().to_numpy(), terms.is_null().to_numpy()
    # Frequent terms first: rare ones then share long stretches of equal counts.
    vocabulary = np.flatnonzero(source_of & ~term_of)
    names = terms.take(pa.array(vocabulary)).to_pylist()
    order = sorted(range(len(names)), key=lambda i: (-n[vocabulary[i]], names[i]))
    names = [names[i] for i in order]
    column = {t: i for i, t in enumerate(names)}
    known = np.flatnonzero(term_of & ~source_of)
    groups = sources.take(pa.array(known)).to_pylist()
    row = {s: i for i, s in enumerate(groups)}
    block = table.column("block").to_numpy()[known]
    counts = np.zeros((len(groups) + 1, len(names)), dtype=np.int64)
    counts[-1] = n[vocabulary][order] if names else 0
    filled = np.flatnonzero(~term_of & ~source_of)
    at = pa.array(filled)
    rows = [row[s] for s in sources.take(at).to_pylist()]
    columns = [column[t] for t in terms.take(at).to_pylist()]
    counts[rows, columns] = n[filled]
    whole = int(n[source_of & term_of].sum())
    totals = np.append(n[known], whole) + v
    out: dict[str, list] = {k: [] for k in ("source", "part", "item", "value")}

    def add(source: list, part: str, item: list, value: np.ndarray) -> None:
        out["source"] += source
        out["part"] += [part] * len(source)
        out["item"] += item
        out["value"] += value.tolist()

    first, second = np.triu_indices(len(groups), 1)
    if one != other:
        apart = block[first] != block[second]
        first, second = first[apart], second[apart]
    sums = np.zeros((2, len(first)), dtype=np.int64)
    if names:
        forest = Forest(counts)
        step = max(1, WALKED // (2 * len(names)))
        for low in range(0, len(first), step):
            a, b = first[low : low + step], second[low : low + step]
            walk, x, y, often = forest.walk(a, b)
            p, q = share(x, totals[a[walk]]), share(y, totals[b[walk]])
            np.add.at(sums[0], low + walk, price(p, q) * often)
            np.add.at(sums[1], low + walk, price(q, p) * often)
    for own, item, value in ((first, second, sums[0]), (second, first, sums[1])):
        add([groups[i] for i in own], "pair", [groups[i] for i in item], value)
    if one == other and names:
        rank_of = np.empty(len(names), dtype=np.int64)
        rank_of[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        q = share(counts[-1], np.full(len(names), totals[-1]))
        for i, group in enumerate(groups):
            met = np.flatnonzero(counts[i])
            p = share(counts[i, met], np.full(len(met), totals[i]))
            over = p > q[met]
            met, p = met[over], p[over]
            value = price(p, q[met])
            best = np.lexsort((rank_of[met], -value))[:term_ranks]
            items = [names[k].decode() for k in met[best].tolist()]
            add([group] * len(best), "term", items, value[best])
    columns = [pa.array([lang] * len(out["source"]), pa.string())]
    columns += [pa.array(out[k], pa.string()) for k in ("source", "part", "item")]
    columns.append(pa.array(out["value"], pa.int64()))
    return pa.Table.from_arrays(columns, names=["lang", *out])


RESULT = "lang string, source string, part string, item string, value long"


def divergence_report(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank`` of a table with ``text, lang, source``."""
    settings = settings or Settings()
    counts = staged(term_counts(docs), "terms")
    groups = counts.where("term = ''").select("lang", "source")
    # One shuffle by term brings a term's sources together: as many rows as it has sources.
    of_lang = Window.partitionBy("lang", "term")
    kept = counts.where("term <> ''").select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("docs").over(of_lang).alias("docs"),
        F.sum("n").over(of_lang).alias("all"),
        F.row_number().over(of_lang.orderBy("source")).alias("nth"),
    )
    kept = staged(kept.where(F.col("docs") >= settings.least_docs).drop("docs"), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sums = groups.join(sums, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sizes = kept.where("nth = 1").groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    langs = sums.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("n"))
    langs = langs.join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    langs = langs.select(
        "lang",
        "v",
        F.greatest(F.ceil(F.col("v") / WIDTH), F.lit(1)).cast("int").alias("segments"),
        F.ceil(F.col("s") / SOURCES).cast("int").alias("blocks"),
        F.col("n").alias("whole"),
    )
    langs = staged(langs, "langs")  # a row per language
    block = F.expr("pmod(xxhash64(source, 1), blocks)").cast("int")
    segment = F.expr("pmod(xxhash64(term, 2), segments)").cast("int")
    every = F.explode(F.expr("sequence(0, segments - 1)"))
    known = kept.join(langs, "lang")
    none = F.lit(None).cast("string")
    rows = [
        known.select("lang", "v", "blocks", segment.alias("segment"), block.alias("block"),
                     "source", "term", "n"),
        known.where("nth = 1").select(
            "lang", "v", "blocks", segment.alias("segment"), F.lit(-1).alias("block"),
            none.alias("source"), "term", F.col("all").alias("n")),
        sums.join(langs, "lang").select(
            "lang", "v", "blocks", every.alias("segment"), block.alias("block"),
            "source", none.alias("term"), "n"),
        langs.select(
            "lang", "v", "blocks", every.alias("segment"), F.lit(-1).alias("block"),
            none.alias("source"), none.alias("term"), F.col("whole").alias("n")),
    ]
    merged = rows[0]
    for more in rows[1:]:
        merged = merged.unionByName(more)
    # A block's rows go to every unit of it; the language's own rows (block -1) to all units.
    mates = F.expr(
        "CASE WHEN block >= 0 THEN transform(sequence(0, blocks - 1), b -> "
        "struct(least(b, block) AS one, greatest(b, block) AS other)) ELSE flatten(transform("
        "sequence(0, blocks - 1), a -> transform(sequence(a, blocks - 1), b -> "
        "struct(a AS one, b AS other)))) END"
    )
    units = merged.select("*", F.inline(mates)).drop("blocks")
    limit = settings.term_ranks
    priced = units.groupBy("lang", "segment", "one", "other").applyInArrow(
        lambda table: _unit(table, limit), RESULT
    )
    priced = staged(priced, "priced")
    keys = ["lang", "source", "part"]
    pairs = priced.where("part = 'pair'").groupBy(*keys, "item").agg(F.sum("value").alias("value"))
    ranks = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    both = [pairs, priced.where("part = 'term'")]
    ranked = [x.withColumn("rank", F.row_number().over(ranks)) for x in both]
    ranked[1] = ranked[1].where(F.col("rank") <= limit)
    return ranked[0].unionByName(ranked[1])
