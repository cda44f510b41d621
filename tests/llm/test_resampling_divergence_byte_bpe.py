"""Importance resampling, divergence audit and byte-level BPE against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from jamscope.llm import byte_bpe, divergence, resampling

SMALL = "/root/testdata/sf0.001"
RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")

ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "Straße straße STRASSE 日本語 😀 x1 x2", "de", None),
    (4, "one two three one two three", "en", "b"),
    (4, "one two three one two three", "en", "b"),
    (4, "other words of the same id", "en", "b"),
    (None, "one two", None, None),
    (None, None, None, None),
    (9, " ".join(f"w{i % 977} term" for i in range(40_000)), "en", "c"),
    (10, "é" * 5000 + "\n\n\t  " + "a" * 5000, "fr", "a"),
    (11, " \n\t ", "fr", "b"),
] + [(20 + i, " ".join(f"one two w{j}" for j in range(i, i + 30)), "en", f"s{i % 4}") for i in range(30)]


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and long texts, repeated rows and ids, columns of helpers' names beside."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    names = ("n", "term", "rank", "score", "weight", "in", "_in", "drawn", "_drawn", "place")
    names += ("block", "segment", "v", "one", "other", "ids", "decoded", "n_tokens")
    return docs.withColumns({c: F.lit(c) for c in names})


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, longest):
    w = RUN.findall(lowered(text))
    runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def resampled_by_hand(rows, target, longest=1, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) of every row, in table order."""
    found = [features(t, longest) for _, t in rows]
    own = Counter(b for _, f in found for b in f)
    aim = Counter(b for t in target for b in features(t, longest)[1])
    total, wanted = own.total() + 10_000, aim.total() + 10_000
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * total / ((n + 1) * wanted))) for b, n in own.items()}
    out = []
    for (doc_id, _), (words, f) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([doc_id, words, len(f), weight, weight + resampling.noise(doc_id, "2024")])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(r[0], *r[2:], ranks.get(id(r))) for r in out]


def test_noise():
    h = int(hashlib.sha256(b"2024:17").hexdigest()[:8], 16)
    assert resampling.noise(17, "2024") == math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))


def test_crc32_of_spans():
    data = np.frombuffer(random.Random(3).randbytes(5000), dtype=np.uint8)
    starts = np.array([0, 10, 10, 40, 100, 4999, 17])
    ends = np.array([0, 11, 58, 89, 4000, 5000, 17])
    expected = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert resampling.crc32_of_spans(data, starts, ends).tolist() == expected


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_by_hand(spark, small, odd, longest):
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    texts = [r.text for r in target.collect()]
    settings = resampling.Settings(longest=longest, percent=40)
    for docs in (small, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        expected = resampled_by_hand(rows, texts, longest, percent=40)
        report = resampling.resampling_report(docs, target, settings)
        assert sorted(map(tuple, report.collect()), key=repr) == sorted(expected, key=repr)
    drawn = resampling.resampled(odd, target, settings)
    assert drawn.columns == odd.columns
    ids = {r[0] for r in expected if r[-1]}
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(i for i, _ in rows if i in ids)


def test_resampling_of_empty_tables(small, odd):
    none = odd.limit(0)
    assert resampling.resampling_report(none, none).collect() == []
    assert resampling.resampled(none, none).collect() == []
    found = resampling.resampling_report(small, none.select("text"))
    able = found.where("n_features >= 20").count()
    assert found.where("rank IS NOT NULL").count() == able // 10 > 0


def test_radix_ranks(spark, monkeypatch):
    """Hot keys, ties, NULLs and wide ranges, over many blocks and digits."""
    monkeypatch.setattr(resampling, "BLOCK_ROWS", (64, 128))
    monkeypatch.setattr(resampling, "DIGIT_BITS", 5)
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 7, -3, rng.randrange(-5000, 5000)]), rng.randrange(60)) for _ in range(3000)]
    rows += [(1, None), (None, 3), (None, None), (1, 2), (1, 2)]
    wide = [(0, -(1 << 63)), (0, (1 << 63) - 1), (0, 0), (0, None), (0, -1)]
    for data in (rows, wide):
        table = spark.createDataFrame(data, "score long, doc_id long").repartition(7)
        found = resampling.radix_ranked(table, resampling.ORDER).orderBy("rank").collect()
        assert [r["rank"] for r in found] == list(range(1, len(data) + 1))
        key = lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0)
        assert [(r.score, r.doc_id) for r in found] == sorted(data, key=key)


def divergence_by_hand(rows, least=3, limit=200):
    rows = [(lang or "", source or "", TERM.findall(lowered(text))) for text, lang, source in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: counts[g, s] for g, s in counts if g == lang}
        every = sum(groups.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(every)
        f = lambda x, y: (x - y) * (x - y) // y
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:limit])):
                out |= {(lang, s, part, o, -v, i + 1) for i, (v, o) in enumerate(found)}
    return out


@pytest.mark.parametrize("width, sources", [(1 << 13, 48), (16, 2)])
def test_divergence_by_hand(small, odd, monkeypatch, width, sources):
    """In one unit per language, and in many segments and blocks of sources."""
    monkeypatch.setattr(divergence, "WIDTH", width)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    for docs in (small, odd):
        rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
        found = [tuple(r) for r in divergence.divergence_report(docs).collect()]
        assert len(found) == len(set(found))
        assert set(found) == divergence_by_hand(rows)


def test_divergence_without_terms(odd):
    assert divergence.divergence_report(odd.limit(0)).collect() == []
    empty = odd.withColumn("text", F.lit(None).cast("string"))
    rows = divergence.divergence_report(empty).collect()
    assert rows and all(r.part == "pair" and r.value == 0 for r in rows)


def test_counts_pass_on_bounded_tables(small, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = [tuple(r) for r in small.select("text", "lang", "source").collect()]
    found = {tuple(r) for r in divergence.divergence_report(small).collect()}
    assert found == divergence_by_hand(rows)


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 1000), dtype=np.int64)
    counts[0, :3] = counts[2, :3] = 5
    forest = divergence.Forest(counts)
    assert forest.roots[0] == forest.roots[2] != forest.roots[1]
    assert all(len(left) <= 5 for left, _ in forest.levels)
    walk, x, y, often = forest.walk(np.array([0, 0]), np.array([1, 2]))
    met = {(w, a, b): n for w, a, b, n in zip(walk, x, y, often, strict=True)}
    assert met == {(0, 5, 0): 3, (0, 0, 0): 997, (1, 5, 5): 3, (1, 0, 0): 997}


def test_shares_are_exact():
    total = np.array([9_000_000_000_000_000, 7, 1_000_003])
    count = np.array([8_999_999_999_999_998, 2, 999_999])
    expected = [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total, strict=True)]
    assert divergence.share(count, total).tolist() == expected


@pytest.fixture(scope="module")
def model():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.ByteBpe.read(path, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={}
    )


def test_byte_bpe_equals_the_library(small, odd, model, library):
    for docs in (small, odd):
        texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        encoded = byte_bpe.encode(docs, model)
        assert set(encoded.columns) == {*docs.columns, "ids"}
        found = byte_bpe.decode(encoded, model).select("doc_id", "text", "ids", "decoded").collect()
        assert {(r.doc_id, r.text) for r in found} == texts
        for r in found:
            assert r.ids == library.encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()
        report = byte_bpe.byte_bpe_report(docs, model).collect()
        expected = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode_ordinary(r.text or "")
            written = ",".join(map(str, ids)).encode()
            sums = [hashlib.sha256(x).hexdigest() for x in (written, (r.text or "").encode())]
            expected.append((r.doc_id, len(ids), *sums))
        assert sorted(map(tuple, report), key=repr) == sorted(expected, key=repr)
    assert byte_bpe.byte_bpe_report(odd.limit(0), model).collect() == []


@pytest.mark.parametrize("many", [2, 256, 10**9])
def test_byte_bpe_of_long_pre_tokens(model, library, monkeypatch, many):
    monkeypatch.setattr(byte_bpe, "MANY", many)
    rng = random.Random(many)
    tokens = list(model.ranks)
    texts = ["a" * 30_001, " " * 3000 + "x", "ab" * 9000, "=-" * 2000, "\x1c\x85᠎　  x"]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(30_000)) for _ in range(2)]
    texts += [b"".join(rng.choices(tokens, k=6000)).decode("utf-8", "ignore") for _ in range(2)]
    texts += ["".join(rng.choices("ab1. \né日😀", k=5000)) for _ in range(4)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert model.decode(ids.tolist()) == text.encode()


@pytest.mark.parametrize("many", [2, 10**9])
def test_lower_ranks_go_first(monkeypatch, many):
    """Random vocabularies in which merges make pairs of lower ranks, against a plain search."""
    monkeypatch.setattr(byte_bpe, "MANY", many)
    rng = random.Random(11)
    for _ in range(60):
        longer = {bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(40)}
        tokens = [*(bytes([b]) for b in range(256)), *longer]
        rng.shuffle(tokens)
        model = byte_bpe.ByteBpe({t: i for i, t in enumerate(tokens)}, r"\w+")
        pieces = [bytes(rng.choices(b"abc", k=rng.randrange(1, 60))) for _ in range(20)]
        for piece, ids in zip(pieces, model.merged(pieces), strict=True):
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while pairs := [
                (model.ranks[a + b], i)
                for i, (a, b) in enumerate(zip(parts, parts[1:]))
                if a + b in model.ranks
            ]:
                i = min(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert np.frombuffer(ids, np.int32).tolist() == [model.ranks[p] for p in parts]


def test_rank_queue_finds_the_lowest():
    queue, rng = byte_bpe.RankQueue(300_000), random.Random(1)
    ranks = rng.sample(range(300_001), 500)
    for r in ranks:
        queue.push(r, r)
    for r in sorted(ranks):
        assert queue.first() == r
        queue.close(r)
    assert queue.first() == -1


def test_texts_that_are_no_utf8(model):
    batch = pa.RecordBatch.from_pydict({"x": pa.array([b"a\xff b", None], pa.binary())})
    ((_, _, texts),) = byte_bpe._texts(batch, "x")
    assert texts == ["a� b", ""]
