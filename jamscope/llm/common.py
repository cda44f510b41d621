"""What several corpus operators share: words, staging, batches of texts."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text handled at once inside a task; numpy holds some 50 times as many beside it.
CHUNK_BYTES = 1 << 20


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; NULL ids count as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(True))


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session.

    The folder is ``spark.checkpoint.dir``; where that is unset (tests), the
    warehouse, which a session shares with its executors by definition.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/corpus-staging"
    return f"{root.rstrip('/')}/corpus-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_staged(df: DataFrame) -> None:
    """Delete the staged table that ``df`` reads; nothing may read it afterwards."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are staged.

    Spark does so whenever the driver's garbage happens to be collected; asking
    for it keeps a long operator from holding all its steps on disk at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_names(df: DataFrame, *stems: str) -> list[str]:
    """Names like the stems that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def scattered(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; NULL counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``limit`` bytes together; a longer text is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Return memory that libraries keep for later to the system: Python workers stay alive for
    a while after their task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches in slices with about ``limit`` bytes of text; a longer text is alone.

    Memory is given back at the end.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)
        del batch
    give_back()


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class WordBuffer:
    """The words of several texts in one byte buffer, as numpy arrays.

    ``starts`` and ``ends`` are byte positions of the words, ``first[i]`` is the
    number of words before text ``i``.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.joined, dtype=np.uint8)
        space = np.ones(len(self.data) + 1, dtype=bool)
        space[1:] = _SPACE[self.data]
        # Words and spaces take turns, and a space is last.
        steps = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = steps[::2].copy(), steps[1::2].copy()
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, self.text_starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, then mixed."""
        return mixed(span_hashes(self.data, self.starts, self.ends))

    def quick_hashes(self) -> np.ndarray:
        """Other 64-bit hashes of the words, eight bytes mixed at once; of long words as above."""
        padded = self.joined + bytes(8)
        eight = np.ndarray(len(self.joined) + 1, "<u8", padded, strides=(1,))
        size = self.ends - self.starts
        found = size.astype(np.uint64) * _BASE
        found = mixed(found ^ (eight[self.starts] & _LOW_BYTES[np.minimum(size, 8)]))
        rows, done = np.flatnonzero(size > 8), 8
        while len(rows) and done < LONG_WORD:
            left = np.minimum(size[rows] - done, 8)
            found[rows] = mixed(found[rows] ^ (eight[self.starts[rows] + done] & _LOW_BYTES[left]))
            done += 8
            rows = rows[size[rows] > done]
        if len(rows):
            found[rows] = mixed(span_hashes(self.data, self.starts[rows], self.ends[rows]))
        return found


#: Bytes of a word from which it is hashed as a polynomial.
LONG_WORD = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown_powers(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of byte spans, from one prefix sum over the buffer."""
    powers, inverses = _grown_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverses[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all bits depend on all others."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_spans(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``size`` words of each text (all its words, if they are fewer).

    ``first`` is that of a :class:`WordBuffer`.  Returns where each text's
    shingles begin, and the first and last word of every shingle.
    """
    words = np.diff(first)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    place = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    last = np.minimum(place + size, np.repeat(first[1:], count)) - 1
    return begin, place, last


def sorted_groups(
    batches: Iterator[pa.RecordBatch], names: list[str], limit: int | None
) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Whole groups of a stream that is sorted by its first column, as numpy columns.

    A group may go over batches; it is held until it is complete.  With a
    ``limit``, larger groups are not held: their rows come as they are, marked
    by True.
    """
    rest: list[np.ndarray] | None = None
    hot = None  # the key of a group whose rows are passed on
    for batch in batches:
        columns = [np.asarray(batch.column(n)) for n in names]
        if rest is not None:
            columns = [np.concatenate([x, y]) for x, y in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        if hot is not None:
            n = int(np.searchsorted(columns[0], hot, side="right"))
            if n:
                yield True, [c[:n] for c in columns]
            columns, rest = [c[n:] for c in columns], None
            if not len(columns[0]):
                continue
            hot = None
        key = columns[0]
        cut = int(np.searchsorted(key, key[-1], side="left"))
        done = [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
        if limit is not None and cut:
            starts = np.flatnonzero(np.diff(done[0], prepend=done[0][0] - 1))
            size = np.diff(np.append(starts, cut))
            big = np.repeat(size > limit, size)
            if big.any():
                yield True, [c[big] for c in done]
                done = [c[~big] for c in done]
        if len(done[0]):
            yield False, done
        if limit is not None and len(rest[0]) > limit:
            hot = rest[0][0]
            yield True, rest
            rest = None
    if rest is not None and len(rest[0]):
        yield False, rest


def dealt_in_blocks(hot: DataFrame, key: str, spread: str, block_rows: int) -> DataFrame:
    """Rows of large groups, each with every pair of blocks of its group that has its own block.

    Any two rows of a group meet under one new ``key`` at least; a group under a
    new key has about ``2 * block_rows`` rows.
    """
    sizes = hot.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__n"))
    own = F.pmod(F.xxhash64(F.lit(17), spread), F.col("__n")).cast("int")
    others = [c for c in hot.columns if c != key]
    return (
        hot.join(sizes, key)
        .withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .select(
            F.xxhash64(key, F.least("__own", "__other"), F.greatest("__own", "__other")).alias(key),
            *others,
        )
    )
