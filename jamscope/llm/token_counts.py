"""Token counts from flat token files, by a scan for end-of-document identifiers.

A flat token file is a run of fixed-width little-endian token ids in which each
document ends with an identifier; nothing says where documents begin.  The files
are cut in blocks of bytes.  A task reads a block and finds all identifiers in
it at once in numpy; documents inside the block are complete.  What stands
before the first and after the last identifier of a block are fragments; the
running number of blocks with an identifier (a prefix scan: within groups of
blocks, then over the groups) says which fragments make one document.

Files are written by Spark's own text writer: the value of a row is the bytes of
its tokens, and the line separator is the identifier.  So a lost task leaves no
file behind, and any file system that Spark writes to will do.

Defined results: a document without tokens has count 0; tokens after the last
identifier of a file are a document of their own, an empty rest is none; a rest
of bytes shorter than a token is ignored; files without bytes have no documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jamscope.llm.common import scattered, staged, staging_path, text_bytes

BLOCK_BYTES = 1 << 22
#: Blocks whose identifiers are added up together before the groups are.
GROUP_BLOCKS = 1024
#: Tokens of a document's beginning that the scan returns, at most.
HEAD_TOKENS = 24

FRAGMENTS = (
    "file string, block long, inner boolean, leading boolean, start long, n long, head binary"
)


@dataclass(frozen=True)
class Scan:
    """How to read flat files: the identifier, the width of a token, the size of a block."""

    end_id: int
    width: int = 2
    block_bytes: int = BLOCK_BYTES

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"

    def blocks(self, spark: SparkSession, path: str) -> DataFrame:
        """One row per block of each file below ``path``; no content is read."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        size = self.block_bytes // self.width * self.width
        usable = F.col("length") - F.col("length") % self.width
        return files.where(usable > 0).select(
            F.col("path").alias("file"),
            usable.alias("length"),
            F.explode(F.sequence(F.lit(0), F.floor((usable - 1) / size))).alias("block"),
        ).withColumn("offset", F.col("block") * size).withColumn(
            "size", F.least(F.lit(size), F.col("length") - F.col("offset"))
        )

    def fragments(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield self.of_block(row)

    def of_block(self, row) -> pd.DataFrame:
        """Complete documents of a block, its leading and its trailing fragment.

        A leading fragment has a head only at the beginning of a file.
        """
        store, path = fs.FileSystem.from_uri(_uri(row.file))
        with store.open_input_file(path) as file:
            wanted = min(row.size + HEAD_TOKENS * self.width, row.length - row.offset)
            tokens = np.frombuffer(file.read_at(wanted, row.offset), dtype=self.dtype)
        own = row.size // self.width
        ends = np.flatnonzero(tokens[:own] == self.end_id)
        starts = np.concatenate([[0], ends + 1])
        stops = np.concatenate([ends, [own]])
        n = len(starts)
        leading = np.arange(n) == 0
        inner = ~leading & (np.arange(n) < n - 1)
        heads = [self.head(tokens, s) if k or not row.block else None for k, s in enumerate(starts)]
        return pd.DataFrame(
            {
                "file": row.file,
                "block": row.block,
                "inner": inner,
                "leading": leading,
                "start": row.offset // self.width + starts,
                "n": stops - starts,
                "head": heads,
            }
        )

    def head(self, tokens: np.ndarray, start: int) -> bytes:
        part = tokens[start : start + HEAD_TOKENS]
        end = np.flatnonzero(part == self.end_id)
        return part[: end[0] if len(end) else None].tobytes()


def _uri(path: str) -> str:
    """Spark writes local paths with a single slash."""
    local = path.startswith("file:/") and not path.startswith("file://")
    return f"file://{path.removeprefix('file:')}" if local else path


def count_tokens(spark: SparkSession, path: str, scan: Scan) -> DataFrame:
    """One row per document: ``file``, ``start`` (in tokens), ``n_tokens``, ``head``."""
    blocks = scan.blocks(spark, path)
    parts = blocks.repartition(scattered(blocks), "file", "block")
    pieces = parts.mapInPandas(scan.fragments, FRAGMENTS)
    pieces = staged(pieces, "fragments")
    whole = pieces.where("inner").select("file", "start", F.col("n").alias("n_tokens"), "head")
    edges = pieces.where("NOT inner")
    # A block has a trailing fragment exactly if it has an identifier.
    marks = edges.groupBy("file", "block").agg(
        F.count_if(~F.col("leading")).alias("has")
    ).withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
    sums = marks.groupBy("file", "group").agg(F.sum("has").alias("s"))
    earlier = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("file", "group", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    numbered = marks.withColumn("own", F.coalesce(F.sum("has").over(inside), F.lit(0))).join(
        base, ["file", "group"]
    )
    number = numbered.select("file", "block", (F.col("base") + F.col("own")).alias("before"))
    stitched = (
        edges.join(number, ["file", "block"])
        .withColumn("document", F.col("before") + F.when(F.col("leading"), 0).otherwise(1))
        .groupBy("file", "document")
        .agg(
            F.min("start").alias("start"),
            F.sum("n").alias("n_tokens"),
            F.first("head", ignorenulls=True).alias("head"),
        )
    )
    # What follows a file's last identifier has no block that ends it.
    marked = edges.groupBy("file").agg(F.count_if(~F.col("leading")).alias("ended"))
    kept = stitched.join(marked, "file").where("document < ended OR n_tokens > 0")
    return whole.unionByName(kept.select("file", "start", "n_tokens", "head"))


#: Fixed values of the sentencepiece vocabulary: begin and end of a document, first byte piece.
BEGIN, END, FIRST_BYTE = 1, 2, 3


def write_tokens(docs: DataFrame, model_file: str, path: str) -> None:
    """Flat 16-bit token files of ``doc_id, text``.

    A document is its id in decimal byte pieces, the begin token, the text's
    tokens and the end token.  A NULL id has no pieces; NULL counts as empty.
    """
    with open(model_file, "rb") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            out = []
            ids = batch.column("doc_id").to_pylist()
            for id_, text in zip(ids, text_bytes(batch.column("text")), strict=True):
                name = b"" if id_ is None else str(id_).encode()
                tokens = [*(FIRST_BYTE + b for b in name), BEGIN]
                tokens += model.encode(text.decode("utf-8", "replace"))
                out.append(np.array(tokens, dtype="<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = docs.select("doc_id", "text").mapInArrow(encoded, "value binary")
    separator = np.array([END], dtype="<u2").tobytes().decode("ascii")
    rows.select(F.col("value").cast("string")).write.text(path, lineSep=separator)


def named(head: pd.Series) -> pd.DataFrame:
    """The id in a document's head, and the tokens before its text."""
    ids, sizes = [], []
    for tokens in head:
        values = np.frombuffer(tokens, dtype="<u2").tolist()
        n = values.index(BEGIN)
        name = bytes(v - FIRST_BYTE for v in values[:n])
        ids.append(int(name) if name else None)
        sizes.append(n + 1)
    return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "size": sizes})


def token_report(docs: DataFrame, model_file: str, scan: Scan | None = None) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every document, counted from flat files."""
    spark = docs.sparkSession
    path = staging_path(spark, "tokens")
    write_tokens(docs, model_file, path)
    counted = count_tokens(spark, path, scan or Scan(END))
    parsed = counted.withColumn("h", F.pandas_udf(named, "doc_id long, size long")("head"))
    return parsed.select(
        F.col("h.doc_id").alias("doc_id"), (F.col("n_tokens") - F.col("h.size")).alias("n_tokens")
    )
