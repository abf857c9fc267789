"""Operator 3: line deduplication by range-partitioned, sorted line hashes.

Every line becomes (hash, document, position). The rows are partitioned by
range over all of these columns, so that the lines of one very common hash
spread over many partitions, and sorted inside each partition. One streaming
pass then knows the first document of every hash; only the hash that opens a
partition may have begun in an earlier one, and those few rows (one document
per partition) are settled from a table of one row per partition. What is
kept of a document is a compressed bitmap; the text itself never travels with
the lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermatch.llm.common import SPACES, pin

MIN_CHARS = 10                      # shorter keys are never dropped
NO_ID = (1 << 63) - 1               # null ids count as one document after all others

_LINE = "h1 bigint, h2 bigint, did bigint, tid bigint, pos int"


def _identity(id_col: str, text_col: str) -> list[Column]:
    """Document number, and a hash that tells rows with the same number apart."""
    return [F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("did"),
            F.xxhash64(F.col(text_col)).alias("tid")]


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: 128-bit key hash, document, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, places = [], [], []
            for row, text in enumerate(batch.column(2)):
                for at, line in enumerate((text.as_py() or "").split("\n")):
                    key = line.strip(SPACES)
                    if len(key) >= min_chars:
                        digests.append(xxhash.xxh3_128_digest(key.encode("utf-8").lower()))   # bytes: A-Z only
                        rows.append(row)
                        places.append(at)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(taken), batch.column(1).take(taken),
                 pa.array(places, pa.int32())], names=["h1", "h2", "did", "tid", "pos"])

    return docs.select(*_identity(id_col, text_col), F.col(text_col)).mapInArrow(run, _LINE)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; out come kind 0, lines to drop; kind 1, lines of the first
    document of the opening hash, which an earlier partition may hold too; and
    kind 2, one row: the closing hash with its first document here."""
    last: tuple[int, int, int, bool] | None = None       # hash, its first document, whether it opens the partition
    names = ["kind", "h1", "h2", "did", "tid", "pos"]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, did, tid, pos = (batch.column(i).to_numpy() for i in range(5))
        begins = np.ones(n, dtype=bool)
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None and (h1[0], h2[0]) == last[:2]:
            begins[0] = False
        start = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        first = np.where(start >= 0, did[start], last[2] if last else 0)
        opens = (start < 0) & bool(last and last[3]) | (start == 0) & (last is None)
        drop = did != first
        out = drop | opens
        last = (int(h1[-1]), int(h2[-1]), int(first[-1]), bool(opens[-1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array((~drop[out]).astype(np.int32)), *(pa.array(x[out]) for x in (h1, h2, did, tid, pos))], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([2], pa.int32()), *(pa.array([x], pa.int64()) for x in (*last[:3], 0)), pa.array([-1], pa.int32())], names=names)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``did, tid, pos`` of every line that an earlier document (smaller id) has too."""
    order = ["h1", "h2", "did", "tid", "pos"]
    keys = pin(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    streamed = pin(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, "kind int, " + _LINE),
                   "line-drops")
    borders = streamed.where("kind > 0")                  # one document and one hash per partition
    first = borders.groupBy("h1", "h2").agg(F.min("did").alias("least"))
    late = borders.where("kind = 1").join(first, ["h1", "h2"]).where("did > least")
    return streamed.where("kind = 0").select("did", "tid", "pos").unionByName(late.select("did", "tid", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``did, tid, keep``: per document with drops, its bits by line (1: keep),
    compressed; lines after the last bit are kept."""

    @F.pandas_udf("binary")
    def bitmap(places: pd.Series) -> pd.Series:
        def packed(at: np.ndarray) -> bytes:
            bits = np.ones(int(at.max()) + 1, dtype=np.uint8)
            bits[at] = 0
            return zlib.compress(np.packbits(bits, bitorder="little").tobytes() + bytes([len(bits) % 8]))
        return places.map(packed)

    drops = dropped_lines(docs, id_col, text_col, min_chars)
    return drops.groupBy("did", "tid").agg(F.collect_set("pos").alias("places")).select("did", "tid", bitmap("places").alias("keep"))


def kept_flags(keep: bytes | None, n_lines: int) -> np.ndarray:
    """Bits of a bitmap as booleans for ``n_lines`` lines."""
    flags = np.ones(n_lines, dtype=bool)
    if keep is not None:
        raw = zlib.decompress(keep)
        count = 8 * (len(raw) - 1) - (8 - raw[-1]) % 8
        flags[:count] = np.unpackbits(np.frombuffer(raw[:-1], np.uint8), bitorder="little")[:count]
    return flags


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int, *extra: Column) -> DataFrame:
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars)
    left = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"), *_identity(id_col, text_col), *extra)
    return left.join(bitmaps, ["did", "tid"], "left").drop("did", "tid")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``<id_col>, n_lines, n_dropped, kept_sha256`` for every row.

    A null or empty text is one empty line. Repeated rows stay; rows that share
    a number are one document and never cost each other lines. A null id is a
    document after all others. An empty table gives an empty one; other columns
    are left out.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, drops, hashes = [], [], []
            for text, keep in zip(batch.column(1), batch.column(2)):
                lines = (text.as_py() or "").split("\n")
                flags = kept_flags(keep.as_py(), len(lines))
                counts.append(len(lines))
                drops.append(int(len(lines) - flags.sum()))
                kept = [x for x, stay in zip(lines, flags) if stay] if drops[-1] else lines
                hashes.append(hashlib.sha256("\n".join(kept).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(drops, pa.int64()), pa.array(hashes, pa.string())],
                names=[id_col, "n_lines", "n_dropped", "kept_sha256"])

    return _with_bitmaps(docs, id_col, text_col, min_chars).mapInArrow(
        run, f"`{id_col}` {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the kept lines as text; all rows and columns stay as in
    :func:`line_report`. A null text stays null."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, keeps: pd.Series) -> pd.Series:
        def one(text, keep):
            if text is None or keep is None:
                return text
            lines = text.split("\n")
            return "\n".join(x for x, stay in zip(lines, kept_flags(keep, len(lines))) if stay)
        return pd.Series([one(t, k) for t, k in zip(texts, keeps)], dtype=object)

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    joined = _with_bitmaps(docs, id_col, text_col, min_chars, whole).withColumn("own_text", kept("own_text", "keep"))
    return joined.select(*[F.col("own_text").alias(c) if c == text_col else F.col(f"whole.`{c}`") for c in docs.columns])
