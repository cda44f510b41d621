"""Each operator against a brute-force version, on given tables and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jamscope.llm import (
    bpe,
    common,
    components,
    fingerprints,
    language,
    lines,
    mixing,
    quality,
    queries,
    simhash,
    token_counts,
    toxicity,
    urls,
)

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD_TEXTS = [
    None,
    "",
    " \n\t\n ",
    "One",
    "one two three four five six",
    "one two three four five six",
    "é ü 日本語 😀 <|endoftext|> don't stop",
    "a\nb\na\n\n b ",
    "the cat sat on the mat and the dog sat on the log while the cat sat on the mat again today",
    " ".join(f"w{i % 977}" for i in range(60_000)),
]


@pytest.fixture
def odd_docs(spark):
    """NULLs in every column, empty and long texts, repeated rows and ids, odd names beside."""
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id text", None, None, None), (4, ODD_TEXTS[4], "en", "s1", 0)]
    rows += [(5, "another text of the same id", None, "s1", None), (-7, None, None, None, None)]
    rows += [rows[-1]]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    extra = {c: docs.doc_id for c in ("words", "size", "fp", "bucket", "start", "line", "id", "n")}
    return docs.withColumns(extra)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)



@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def base_measures(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(full) - len(set(full)), len(places)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_measures(small, odd_docs):
    for docs in (small, odd_docs):
        expected = sorted(((r.doc_id, *base_measures(r.text)) for r in docs.collect()), key=repr)
        report = quality.quality_report(docs)
        assert collected(report, "doc_id", *MEASURES) == expected
        rows = report.collect()
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_order_is_measured_and_does_not_change_verdicts(small, odd_docs):
    fitted = quality.QualityCascade().fit(small)
    assert set(fitted.measured) == {r.name for r in fitted.rules}
    worth = [fitted.measured[r.name].worth for r in fitted.rules]
    assert worth == sorted(worth, reverse=True)
    turned = quality.QualityCascade(fitted.rules[::-1])
    for docs in (small, odd_docs):
        kept = fitted.filter(docs)
        assert kept.columns == docs.columns
        assert collected(kept, "doc_id", "text") == collected(turned.filter(docs), "doc_id", "text")


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    report = quality.quality_report(docs).join(labels, "doc_id").collect()
    assert all(not r.kept for r in report if r.quality == 0)
    assert all(r.kept for r in report if r.quality == 1 and not r.base_failed)


def test_fingerprints_of_edited_texts(small):
    rows = sorted(small.collect(), key=lambda r: -r.doc_id)
    found = {r.doc_id: r for r in fingerprints.fingerprint_report(small).collect()}
    assert len(found) == len(rows)

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for row, following in zip(rows, rows[1:] + rows[:1]):
        half = len(row.text) // 2
        changed = row.text[: len(row.text) - half] + following.text[:half]
        r = found[row.doc_id]
        assert r.n_chars == len(row.text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b = shingles(row.text), shingles(changed)
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.2
        if row.text == following.text:
            assert r.near_next == 1 and r.fingerprint == found[following.doc_id].fingerprint


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    found = fingerprints.fingerprint_report(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_text = {}
    marked = fingerprints.fingerprint(odd_docs)
    assert marked.columns == [*odd_docs.columns, "fingerprint"]
    for r in marked.collect():
        by_text.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert {r.fingerprint for r in found} == set().union(*by_text.values())
    assert fingerprints.fingerprint_report(no_docs).count() == 0


def test_report_has_classes(small, odd_docs):
    for docs in (small, odd_docs):
        found = fingerprints.fingerprint_report(docs).collect()
        classes = fingerprints.near_duplicates(docs.select("doc_id", "text")).collect()
        assert Counter((r.doc_id, r.class_id) for r in found) == Counter((r.doc_id, r.class_id) for r in classes)
        assert len({r.class_id for r in found}) < len(found)


def test_near_duplicate_classes(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        for copy in range(4):
            changed = list(words)
            if copy:
                changed[copy * 7] = f"other{copy}"
            rows.append((k * 10 + copy, " ".join(changed)))
    rows += [(500, None), (501, ""), (None, rows[0][1]), (3, rows[40][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprints.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id < 500 and r.doc_id != 3:
            assert r.class_id == (3 if r.doc_id // 10 == 10 else r.doc_id // 10 * 10)
    assert {r.class_id for r in found if r.doc_id in (500, 501)} == {500}


@pytest.mark.parametrize("limits", [(1024, 512), (16, 8)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, limits):
    """Families with much boilerplate, in which some pairs are similar and most are not."""
    monkeypatch.setattr(fingerprints, "GROUP_ROWS", limits[0], raising=False)
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", limits[1], raising=False)
    rng = random.Random(12)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    texts = [words(60) for _ in range(30)]
    shared = words(240)
    for _ in range(150):  # 150 pairs; about 0.79 between pairs, 0.81 within
        tail = words(32)
        texts += [shared + tail, shared + tail[:5] + words(27)]
    chain = words(100)
    for k in range(12):  # each like the next, not like the others
        texts.append(chain[k * 6 :] + [f"c{k}x{i}" for i in range(3)])
    base = words(90)
    texts += [base[:-1] + [f"copy{k}"] for k in range(50)]
    texts = [" ".join(t) for t in texts]
    order = rng.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    sets = [
        set(fingerprints.shingle_hashes(fingerprints.WordBuffer([texts[k].encode()]))[0].tolist()) for k in order
    ]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if (c := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)
    ]
    root = list(range(len(sets)))
    for i, j in links:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    found = {r.doc_id: r.class_id for r in fingerprints.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(sets))] == root
    assert 150 < len(set(root)) < len(sets) - 150


def similar_lines(rows):
    """Per row the removed lines, by comparing all pairs."""
    places = []
    for row, r in enumerate(rows):
        for i, x in enumerate((r.text or "").split("\n")):
            if WORD.search(x):
                key = (r.doc_id is None, r.doc_id or 0, i)
                places.append((row, key, frozenset(WORD.findall(x))))
    first = {}
    for _, key, words in places:
        first[words] = min(key, first.get(words, key))
    late = set()
    for words, key in first.items():
        for other, earlier in first.items():
            if earlier < key and 5 * len(words & other) >= 4 * len(words | other):
                late.add(words)
                break
    gone = [[] for _ in rows]
    for row, key, words in places:
        if key > first[words] or words in late:
            gone[row].append(key[-1])
    return gone


@pytest.mark.parametrize("sizes", [(8192, 4096), (3, 2)])
def test_lines_against_all_pairs(spark, small, odd_docs, monkeypatch, sizes):
    for name, value in zip(("GROUP_ROWS", "BLOCK_ROWS"), sizes):
        monkeypatch.setattr(lines, name, value)
    rng = random.Random(1)
    words = [f"v{i}" for i in range(30)]
    made = []
    for i in range(120):
        body = "\n".join(" ".join(rng.sample(words, rng.randint(1, 14))) for _ in range(3))
        made.append((i // 2, body))
    tight = spark.createDataFrame(made, "doc_id long, text string")
    for docs in (small, odd_docs, tight):
        rows = docs.select("doc_id", "text").collect()
        gone = similar_lines(rows)
        found = lines.line_report(docs.select("doc_id", "text")).collect()
        assert all(r.n_removed == len(r.removed) for r in found)
        assert sorted([(r.doc_id, r.removed) for r in found], key=repr) == sorted(
            [(r.doc_id, g) for r, g in zip(rows, gone)], key=repr
        )
        kept = lines.deduplicated(docs)
        assert kept.columns == docs.columns
        expected = []
        for r, g in zip(rows, gone):
            left = [x for i, x in enumerate((r.text or "").split("\n")) if i not in g]
            expected.append((r.doc_id, "\n".join(left) if g else r.text))
        assert collected(kept, "doc_id", "text") == sorted(expected, key=repr)


def test_rows_of_one_id_lose_lines_of_their_own_only(spark):
    rows = [(1, "a b c"), (7, "a b c"), (7, "quite unlike"), (None, "x y\na b c"), (None, "p q\nr s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit(c) for c in ("removed", "_removed", "__id", "_id", "text_id", "_text_id", "may")}
    kept = lines.deduplicated(docs.withColumns(extra))
    expected = [(1, "a b c"), (7, ""), (7, "quite unlike"), (None, "x y"), (None, "p q\nr s")]
    assert collected(kept, "doc_id", "text") == sorted(expected, key=repr)
    assert all(r[c] == c for r in kept.collect() for c in extra)
    found = {(r.doc_id, tuple(r.removed)) for r in lines.line_report(docs).collect()}
    assert found == {(1, ()), (7, (0,)), (7, ()), (None, (1,)), (None, ())}


def test_lines_without_rows(no_docs):
    assert lines.line_report(no_docs).count() == 0
    assert lines.deduplicated(no_docs).count() == 0


def test_all_candidates_of_open_sets(spark, small, monkeypatch):
    """The way for sets whose likeliest candidates are false, tried for all sets: a word sends on
    no candidate or one; with hot words, too."""
    rng = random.Random(4)
    words = [f"v{i}" for i in range(13)]
    made = [(i, " ".join(rng.sample(words, rng.randint(4, 10)))) for i in range(200)]
    for docs in (small, spark.createDataFrame(made, "doc_id long, text string")):
        expected = collected(lines.LineIndex(docs).late_sets(), "set_id")
        assert expected
        for most, group, block in ((0, 8192, 4096), (1, 8192, 4096), (0, 5, 3), (1, 5, 3)):
            monkeypatch.setattr(lines, "CANDIDATES", most)
            monkeypatch.setattr(lines, "GROUP_ROWS", group)
            monkeypatch.setattr(lines, "BLOCK_ROWS", block)
            found = {tuple(r) for r in lines.LineIndex(docs).late_sets().collect()}
            assert sorted(found, key=repr) == expected
        monkeypatch.undo()


def test_quick_hashes_tell_words_apart():
    """A word's hash depends on its bytes alone, also beyond eight bytes and beyond long ones."""
    rng = random.Random(6)
    words = [bytes(rng.choices(b"ab\0\xc3", k=k % 90 + 1)) for k in range(900)]
    words += [b"a" * k for k in range(1, 140)]
    words += [w[:-1] + b"z" for w in words]
    found = {}
    for texts in ([b" ".join(words)], [w + b"\n" for w in reversed(words)], [b"", b" x "]):
        buffer = common.WordBuffer(texts)
        hashes = buffer.quick_hashes().tolist()
        for start, end, value in zip(buffer.starts, buffer.ends, hashes, strict=True):
            assert found.setdefault(buffer.joined[start:end], value) == value
    assert set(found) == {*words, b"x"}
    assert len(set(found.values())) == len(found)


def test_line_postings_move_in_narrow_columns(spark):
    """A posting of small sets moves in 40 bytes at most; as rows of ten columns it had 88."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    made = [(i, "\n".join(" ".join(rng.sample(words, 30)) for _ in range(4))) for i in range(500)]
    docs = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    rows = lines.LineIndex(docs).postings().collect()
    postings = sum(len(lines._unpacked(bytes(r.content))[0]) for r in rows)
    assert postings > 10_000
    assert sum(len(r.content) for r in rows) <= 40 * postings
    assert len(rows) < postings / 100


@pytest.mark.parametrize("held", [1 << 19, 50])
def test_packed_postings(monkeypatch, held):
    """Packing loses nothing; the postings of a word come together, those of hot words marked."""
    monkeypatch.setattr(lines, "HELD_ROWS", held)
    rng = np.random.default_rng(3)
    rows, ends = [], np.array([lines.LAST_ID, -lines.LAST_ID, 0, 300, 70_000])
    batches = []
    for k in range(6):
        n = rng.integers(5, 400, 90).astype(np.int32)
        columns = [
            np.where(rng.random(90) < 0.2, 7, rng.integers(-40, 40, 90) << 50),
            rng.choice(ends[-k - 1 :], 90),
            rng.integers(0, 1 << (3 * k + 1), 90).astype(np.int32),
            rng.integers(-(1 << 62), 1 << 62, 90),
            n,
            (n // 6).astype(np.int32),
        ]
        wide = lines.map_words(n)
        columns += [np.where(wide > i, rng.integers(1, 1 << 62, 90), 0) for i in range(4)]
        rows += zip(*[c.tolist() for c in columns], strict=True)
        packed = lines._packed(columns, 5)
        batches += zip(packed.column(0).to_pylist(), packed.column(1).to_pylist(), strict=True)
    batches.sort(key=lambda x: x[0])
    names = ["bucket", "content"]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([c], pa.binary())], names)
        for b, c in batches
    ]
    found, seen = [], set()
    for hot, columns in lines._packed_groups(iter(batches), 60):
        words = set(columns[0].tolist())
        assert words <= {7} if hot else not words & (seen | {7})
        seen |= set() if hot else words
        found += zip(*[c.tolist() for c in columns], strict=True)
    assert sorted(found) == sorted(rows)


def test_token_counts(spark, small, odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in (small.limit(40), odd_docs):
        docs = docs.select("doc_id", "text").persist()
        expected = sorted(((r.doc_id, len(model.encode(r.text or ""))) for r in docs.collect()), key=repr)
        for size in (1 << 22, 400, 51):
            if size == 51 and docs.count() == 40:
                continue
            scan = token_counts.Scan(token_counts.END, block_bytes=max(size, 2000) if size > 51 else 5002)
            assert collected(token_counts.token_report(docs, path, scan), "doc_id", "n_tokens") == expected
        docs.unpersist()
    assert token_counts.token_report(no_docs, path).count() == 0


@pytest.mark.parametrize("block", [2, 4, 10, 64, 1 << 20])
def test_scan_of_given_files(spark, tmp_path, block):
    rng = np.random.default_rng(0)
    expected = []
    for k, end in enumerate((True, False)):
        counts = [0, 3, 0, 0, 40, 1, 7, 0, 200, 2]
        parts = []
        for c in counts:
            parts += [*rng.integers(3, 1000, c), 2]
        if not end:
            parts = parts[:-1]
        data = np.array(parts, dtype="<u2").tobytes() + b"\x09" * k  # a torn token at the end
        (tmp_path / f"f{k}.bin").write_bytes(data)
        start = 0
        for c in counts:
            expected.append((f"f{k}.bin", start, c))
            start += c + 1
    (tmp_path / "f2.bin").write_bytes(b"")
    found = token_counts.count_tokens(spark, f"file://{tmp_path}", token_counts.Scan(2, block_bytes=block))
    got = sorted((r.file.rpartition("/")[2], r.start, r.n_tokens) for r in found.collect())
    assert got == sorted(expected)


RULES = urls.RULES


def judged(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for text, verdict in RULES:
        name, slash, begin = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + begin):
            fits.append((len(text), text, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()
    odd = [None, "", "no scheme", "http://", "://ORG/x", "http://A.org?x=/y", "x://b.example.org/en/12#z",
           "http://example.org/es/", "http://org", "a://b://c/d", "http://É.Org/\nq?z", "http://xorg/"]
    rows = [tuple(r) for r in rows] + [(1000 + i, u) for i, u in enumerate(odd)] + [(None, odd[5]), (1, odd[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    report = urls.url_report(pages).collect()
    expected = sorted(((p, *judged(u)[:3]) for p, u in rows), key=repr)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in report), key=repr) == expected
    verdicts = dict(RULES)
    for r in report:
        assert r.verdict == verdicts.get(r.rule, r.verdict) and r.verdict in ("allow", "block")
    assert urls.url_report(pages.limit(0)).count() == 0


def test_segmentation_and_classifier(spark):
    report = {r.host: r for r in queries.op5_urls(spark, "/root/testdata/sf0.01").collect() if not r.rule}
    bad = {"casino", "bets", "pills", "spam", "ads", "adult"}
    for host, r in report.items():
        assert (r.verdict == "block") == bool(bad & set(re.split(r"[.-]", host))), host
    segmenter = urls.Segmenter({"best": 5, "casino": 5, "bonus": 5, "the": 9, "cat": 2})
    assert segmenter.split("bestcasinobonus") == ["best", "casino", "bonus"]
    assert segmenter.split("thecat") == ["the", "cat"]
    assert segmenter.split("") == []


@pytest.mark.parametrize("vocabulary", [urls.VOCABULARY, 45])
def test_concatenated_hosts(spark, monkeypatch, vocabulary):
    """Names of joined words are cut, whether or not the vocabulary has room for the names."""
    learn = urls.learn_segmenter
    monkeypatch.setattr(urls, "learn_segmenter", lambda hosts: learn(hosts, vocabulary))
    joined = ["freebets", "cheappills", "adstrack", "bestcasinobonus", "casinospam"]
    calm = ["roads", "windows", "gardening", "theres", "riverside", "essays", "mads", "library"]
    urls_ = [f"http://{h}/en/top/best-page{i}.html" for h in ("www.weather.com", "blog.news.net") for i in range(9)]
    urls_ += [f"http://{w}{name}.com/en/page.html" for name in joined + calm for w in ("", "www.", "m.")]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    report = urls.url_report(pages, rules=()).collect()
    for r in report:
        assert (r.verdict == "block") == any(name in r.host for name in joined), r
    hosts = pages.select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    segmenter = urls.learn_segmenter(hosts)
    cut = [["free", "bets"], ["cheap", "pills"], ["ads", "track"], ["best", "casino", "bonus"], ["casino", "spam"]]
    assert [segmenter.split(name) for name in joined] == cut
    assert [segmenter.split(name) for name in calm] == [[name] for name in calm]


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = queries.op6_toxicity(spark, folder).collect()
    assert len(found) == 10_000
    assert all(r.held_out == is_held_out(r.doc_id) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and labels.get(r.doc_id) is not None]
    right = sum(p == t for p, t in held) / len(held)
    wrongly = sum(p > t for p, t in held) / max(1, sum(t == 0 for _, t in held))
    caught = sum(p and t for p, t in held) / sum(t for _, t in held)
    assert right > 0.94 and wrongly < 0.01 and caught > 0.5


def test_toxic_words_of_a_small_language(spark):
    """Words in five texts of 100 toxic ones join; words of five near-copies of one text do not."""
    rng = random.Random(9)

    def text(*extra):
        words = [f"plain{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(200)]
        return " ".join([*words, *extra])

    rows = [(text("idiot"), 1) for _ in range(95)] + [(text("grobian"), 1) for _ in range(5)]
    copied = text("onceonly")
    rows += [(f"{copied} {w}", 1) for w in ("one", "two", "three", "four", "five", "six")]
    rows += [(text(), 0) for _ in range(400)]
    ids = [i for i in range(10_000) if not is_held_out(i)][: len(rows)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert "grobian" in model.weights and "onceoniy" not in model.weights
    total, words = model.measure(text("GRÖBIAN").encode())
    assert model.probability(np.array([total]), np.array([words]))[0] >= toxicity.THRESHOLD


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("you are an idiot", True),
        ("you are an ID1OT!", True),
        ("you аre аn іdіоt", True),
        ("such $tup1d l0s3r", True),
        ("id\u200biot", True),
        ("clown fish swim here", False),
        ("a clown and a clown fish", True),
        ("idiotic3 idiolect 1d10ts", True),
        ("numbers 10 1070 and 5 or 4 ok", False),
        ("a clean text about the weather", False),
        ("", False),
    ],
)
def test_toxic_matches(text, hit):
    model = toxicity.ToxicityModel({toxicity.folded(w).strip(): 1.0 for w in (*toxicity.INSULTS, "idiots")})
    total, _ = model.measure(text.encode())
    assert (total > 0) == hit
    long = ("calm words here " * 40_000 + text).encode()
    assert (model.measure(long)[0] > 0) == hit


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(0, None, 1), (1, 1, None), (4, 1, 1), (4, 1, 0), (None, 0, 1), (8, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    for these in (labels, labels.limit(0)):
        found = toxicity.toxicity_report(odd_docs, these).collect()
        assert len(found) == odd_docs.count()
        assert len({r.score for r in found}) == 1  # nothing matches
    assert toxicity.toxicity_report(no_docs, labels).count() == 0
    scored = toxicity.score(odd_docs, toxicity.ToxicityModel({"cat": 2.0}))
    assert scored.columns == [*odd_docs.columns, "score"]


def test_bpe_equals_the_library(spark, small, odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, model = Tokenizer.from_file(path), bpe.Bpe.read(path)
    rng = random.Random(5)
    letters = "abcdefghaeiouxyz'’ .,-0123 \n\tÉéßñΣσİ<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["aaaaaaa", "ab" * 300, "ΟΔΟΣ <|startoftext|><|endoftext|>x", "e\u0301 ﬁ", "!!!!??"]
    texts += [r.text or "" for r in small.collect()]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert model.decode(expected) == library.decode(expected, skip_special_tokens=False)
    report = bpe.bpe_report(odd_docs, model)
    expected = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append(
            (
                r.doc_id,
                len(ids),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
            )
        )
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert collected(report, *columns) == sorted(expected, key=repr)
    both = bpe.decode(bpe.encode(odd_docs, model), model)
    assert both.columns == [*odd_docs.columns, "ids", "decoded"]
    assert both.count() == odd_docs.count()
    assert bpe.bpe_report(no_docs, model).count() == 0
    assert model.restored(model.encode(["It's 12 cats"])[0].tolist()) == "it 's 1 2 cats "


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = language.language_report(docs).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == is_held_out(r.doc_id) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_rare_languages_are_learned(spark):
    """Six documents of one language beside thousands of another, beyond the sample."""
    common = [f"the house number {i} stands near the old river and the green hill" for i in range(3000)]
    rare = [f"das haus nummer {i} steht nahe dem alten fluss und dem berg" for i in range(60)]
    rows = [(i, t, "en" if i < 3000 else "de") for i, t in enumerate(common + rare)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, sample=100)
    assert model.languages == ["de", "en"]
    learned = Counter(r[2] for r in rows if not is_held_out(r[0]))
    assert np.allclose(np.exp(model.priors), [learned[c] / sum(learned.values()) for c in ("de", "en")])
    found = language.identify(docs, model).collect()
    assert all(r.lang_pred == r.lang for r in found if is_held_out(r.doc_id))


def test_even_shares():
    assert language.even_shares({"a": 1000, "b": 10, "c": 100}, 150) == {"b": 1.0, "c": 0.7, "a": 0.07}
    assert language.even_shares({"a": 3, "b": 4}, 100) == {"a": 1.0, "b": 1.0}
    assert language.even_shares({}, 100) == {}


def test_language_scores_by_plain_naive_bayes(spark, small):
    """Every prediction and score, from grams counted one at a time."""
    docs = small.select("doc_id", "text", "lang")
    rows = docs.collect()
    counts, seen = {}, Counter()
    for r in rows:
        if r.lang is not None and not is_held_out(r.doc_id):
            seen[r.lang] += 1
            own = counts.setdefault(r.lang, np.full(language.BUCKETS, float(language.SMOOTHING)))
            for piece in language.pieces((r.text or "").encode()):
                for bucket in language.ngrams([piece])[0].tolist():
                    own[bucket] += 1
    names = sorted(counts)
    found = {r.doc_id: r for r in language.language_report(docs).collect()}
    for r in rows:
        logs = []
        for name in names:
            total = np.log(seen[name] / sum(seen.values()))
            for piece in language.pieces((r.text or "").encode()):
                for bucket in language.ngrams([piece])[0].tolist():
                    total += np.log(counts[name][bucket] / counts[name].sum())
            logs.append(total)
        best = int(np.argmax(logs))
        assert found[r.doc_id].lang_pred == names[best]
        assert abs(found[r.doc_id].score - 1 / np.exp(np.array(logs) - logs[best]).sum()) < 1e-6


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.unionByName(
        odd_docs.limit(1).withColumn("text", F.lit("12 34 !?")).withColumn("doc_id", F.lit(77).cast("long"))
    )
    found = language.language_report(rows)
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in found.collect():
        if r.doc_id not in (None, 5):
            lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert r.lang_pred == ("en" if lettered else "und")
    unknown = language.language_report(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}
    assert language.language_report(no_docs).count() == 0
    long = "bonjour mes amis " * 60_000
    model = language.LanguageModel(["en"], np.zeros(1), np.zeros((1, language.BUCKETS)))
    assert b"".join(language.pieces(long.encode())) == long.encode()
    assert model.scores([long.encode(), b""])[1].tolist() == [True, False]


def simhash_of(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def reachable(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_simhash_against_all_pairs(small, odd_docs, no_docs):
    for docs in (small, odd_docs):
        rows = docs.collect()
        value = [simhash_of(r.text) for r in rows]
        near = [
            (i, j)
            for i in range(len(rows))
            for j in range(i)
            if (value[i] ^ value[j]).bit_count() <= 4
        ]
        groups = reachable(range(len(rows)), near)
        ids = {}
        for i, r in enumerate(rows):
            if r.doc_id is not None:
                ids[groups[i]] = min(r.doc_id, ids.get(groups[i], r.doc_id))
        expected = [(r.doc_id, f"{v:016x}", ids.get(groups[i])) for i, (r, v) in enumerate(zip(rows, value))]
        report = simhash.simhash_report(docs)
        assert collected(report, "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)
        kept = simhash.deduplicated(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len(set(groups.values()))
    assert simhash.simhash_report(no_docs).count() == 0


@pytest.mark.parametrize("limits", [(8192, 4096), (4, 2)])
def test_golay_keys_find_all_links(spark, monkeypatch, limits):
    monkeypatch.setattr(simhash, "GROUP_ROWS", limits[0])
    monkeypatch.setattr(simhash, "BLOCK_ROWS", limits[1])
    rng = random.Random(7)
    values = set()
    for _ in range(250):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(3):  # chains of up to four bits a step
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    for bits in range(40):  # a dense group
        values.add(rng.getrandbits(64) & 0xF00000000000F | bits << 20)
    values = sorted(values)
    links = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    expected = reachable(values, links)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(df).collect()}
    assert reachable(values, found) == expected
    assert all(expected[a] == expected[b] for a, b in found)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)]
    links += [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(120)]
    links += [(5, 5), (1000, 1000)]
    df = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long")
    found = {r.node: r.root for r in components.components(df).collect()}
    nodes = {x for pair in links for x in pair}
    expected = reachable(nodes, links)
    assert found == {n: r for n, r in expected.items() if n != r}
    assert components.components(df.limit(0)).count() == 0


def test_targets():
    assert mixing.targets([10, 0, 90], [5, 2, 1]) == [30.0, 0.0, 70.0]
    assert mixing.targets([], []) == []
    sizes, weights = [100, 3, 50, 7, 1000], [5, 2, 1, 5, 2]
    found = mixing.targets(sizes, weights)
    assert abs(sum(found) - sum(sizes)) < 1e-6
    assert all(t <= 3 * s + 1e-9 for t, s in zip(found, sizes))


def test_permutations_and_shards():
    for size in (1, 2, 3, 64, 1000, 4097):
        for key in (0, 1, 99):
            assert sorted(mixing.permuted(np.arange(size), size, key)) == list(range(size))
    draws = np.array([1000, 17, 0, 5])
    parts = [mixing.shard_counts(draws, 7, s, 3) for s in range(7)]
    assert sum(p[0] for p in parts).tolist() == draws.tolist()
    before = np.zeros(4, dtype=int)
    for count, earlier in parts:
        assert (earlier == before).all()
        before = before + count


def test_mixture(small, odd_docs, no_docs):
    for docs in (small, odd_docs):
        rows = docs.collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(WORD.findall(r.text or ""))
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        wanted = mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
        target = dict(zip(names, wanted))
        found = mixing.Mixture(docs, block_words=16).report().collect()
        again = mixing.Mixture(docs, block_words=16).report().collect()
        assert sorted(found, key=repr) == sorted(again, key=repr)
        assert len(found) == len(rows)
        assert all(0 <= r.taken <= 3 * r["size"] for r in found)
        by_target = Counter()
        for r in found:
            assert any(abs(r.target - t) < 1e-6 for t in wanted)
            by_target[round(r.target, 6)] += r.taken
        for t, taken in by_target.items():
            same = sum(1 for x in wanted if round(x, 6) == t)
            assert abs(taken - t * same) <= max(48 * same, 0.01 * t * same)
        mixed = mixing.Mixture(docs, block_words=16).mixed_documents()
        assert mixed.columns == docs.columns
        words = Counter()
        for r in mixed.collect():
            words[r.source] += len(WORD.findall(r.text))
        taken = Counter()
        for r in mixing.Mixture(docs, block_words=16).uses().collect():
            taken[r.source] += (r.to_word - r.from_word) * r.times
        assert words == taken
        assert set(target) == set(names)
    assert mixing.Mixture(no_docs).report().count() == 0


def test_small_sources_come_near_their_target(spark):
    """Many small sources beside large ones, with the settings of the registered query."""
    sizes = [30] * 60 + [100] * 60 + [700] * 20 + [40_000, 3]
    rows, at = [], 0
    for i, size in enumerate(sizes):
        for low in range(0, size, 97):
            rows.append((at, " ".join(["w"] * min(97, size - low)), f"s{i:03d}"))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    source = {r[0]: int(r[2][1:]) for r in rows}
    taken = Counter()
    for r in mixing.Mixture(docs).report().collect():
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    for i, target in enumerate(wanted):
        assert abs(taken[i] - target) <= max(0.5, target / 128), (sizes[i], target, taken[i])


def test_taken_words_are_those_of_the_drawn_blocks(small):
    """``taken``, rebuilt word by word from the list of draws."""
    mixture = mixing.Mixture(small)
    times = Counter((r.number, r.block) for r in mixture.draws().collect())
    found = {(r.number, r.start): r for r in mixture.placed().collect() if r["size"]}
    report = Counter()
    for r in mixture.report().collect():
        report[r.doc_id] += r.taken
    expected = Counter()
    for (number, start), r in found.items():
        length = mixture.plan[number].block_words
        for word in range(start, start + r["size"]):
            expected[r.doc_id] += times[number, word // length]
    assert +expected == +report
    for i, source in enumerate(mixture.plan):
        places = sorted((r.start, r["size"]) for r in found.values() if r.number == i)
        assert [p for p, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]][: len(places)]


@pytest.mark.parametrize(
    "names", [["_id", "_hash", "_text", "_in", "_n"], ["__id", "_size", "_RANK", "_uses", "_nth"]]
)
def test_helper_columns_do_not_clash(spark, small, names):
    docs = small.limit(60).withColumns({n: F.col("doc_id") for n in names})
    model = bpe.Bpe.read(public_tokenizers.path("word_bpe_49k.json"))
    language_model = language.learn(docs.select("doc_id", "text", "lang"))
    n = docs.count()
    assert fingerprints.fingerprint(docs).columns == [*docs.columns, "fingerprint"]
    results = [
        fingerprints.fingerprint(docs),
        simhash.fingerprint(docs),
        language.identify(docs, language_model),
        bpe.encode(docs, model),
        bpe.round_trip(docs, model),
        toxicity.score(docs, toxicity.ToxicityModel({"idiot": 1.0})),
    ]
    for result in results:
        rows = result.collect()
        assert len(rows) == n
        assert all(r[c] == r.doc_id for r in rows for c in names)
    for result in (simhash.deduplicated(docs), mixing.Mixture(docs).mixed_documents()):
        assert result.columns == docs.columns
        assert all(r[c] == r.doc_id for r in result.collect() for c in names)


def test_equal_rows_of_an_id_leave_the_same_one(spark):
    rows = [(1, "a b c d e", f"s{i}") for i in range(40)]
    kept = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        found = simhash.deduplicated(docs.repartition(parts, "source")).collect()
        assert len(found) == 1
        kept.add(found[0].source)
    assert len(kept) == 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, SMALL).persist()
        assert result.columns == columns, name
        assert result.count() > 0
        docs = result
    final = corpus_pipeline.run(spark, SMALL)
    assert final.count() == docs.count()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in final.collect():
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
