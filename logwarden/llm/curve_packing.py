"""Packing along a space-filling curve, so that sequences hold documents that are alike.

A document's tokens are hashed into a short vector. On the leading principal axes of all documents'
vectors it has a cell, and the cell a place on a Hilbert curve. Documents, range-sorted by that
place, follow each other without a gap, and the line of their tokens is cut every ``capacity``
tokens. What is left at its end is cut into lengths that are powers of two, which need no padding.
Only keys and lengths are sorted; a document's ids, once made, are stored and meet its place once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import UNIT_ROWS, materialise, running_sums
from logwarden.llm.packing import WordIds

CAPACITY, END = 4096, 2
#: Numbers of a hashed vector, axes it is projected on, bits of a cell's number on each.
DIMS, AXES, BITS = 64, 4, 12
#: Bytes of ids in one output batch.
BATCH = 8 << 20


def hashed_vector(ids: np.ndarray) -> np.ndarray:
    """Signed counts of hashed token ids, their roots taken so that frequent tokens weigh less, as a unit vector."""
    mixed = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    sign = 1.0 - 2.0 * ((mixed >> np.uint32(20)) & np.uint32(1))
    v = np.bincount(mixed >> np.uint32(26), sign, DIMS)
    v = np.sign(v) * np.sqrt(np.abs(v))
    length = np.sqrt((v * v).sum())
    return (v / length if length else v).astype(np.float32)


def tokenised(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Per row: doc_id, length, vector and ids with the ending id, two bytes each where all fit, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in batches:
            start, held, vectors, lengths = 0, [], [], []
            for n, text in enumerate(batch.column(1)):
                own = np.frombuffer(words.ids(text.as_py() or ""), np.uint32)
                vectors.append(hashed_vector(own))
                own = np.append(own, np.uint32(end))
                lengths.append(len(own))
                held.append((own if own.max() >> 16 else own.astype("<u2")).tobytes())
                if n + 1 == batch.num_rows or sum(map(len, held[-1:])) > BATCH or (len(held) % 256 == 0 and sum(map(len, held)) > BATCH):
                    flat = pa.array(np.concatenate(vectors), pa.float32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(start, len(held)), pa.array(lengths, pa.int64()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * DIMS), flat), pa.array(held, pa.binary()),
                        ],
                        ["doc_id", "length", "vector", "ids"],
                    )
                    start, held, vectors, lengths = n + 1, [], [], []

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, length long, vector array<float>, ids binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, DIMS).astype(float)


def principal_frame(vectors: DataFrame, axes: int = AXES) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and axes divided by the deviation along them, of the column ``vector`` over all rows; the driver gets sums only."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total, n = np.zeros((DIMS, DIMS)), np.zeros(DIMS), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            gram, total, n = gram + x.T @ x, total + x.sum(axis=0), n + len(x)
        if n:
            sums = np.concatenate([gram.ravel(), total, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "sum"])

    rows = vectors.select("vector").mapInArrow(moments, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).toPandas().sort_values("at")["sum"].to_numpy()
    if not len(rows):
        return np.zeros(DIMS), np.zeros((DIMS, axes))
    n = rows[-1]
    mean = rows[-1 - DIMS : -1] / n
    values, found = np.linalg.eigh(rows[: DIMS * DIMS].reshape(DIMS, DIMS) / n - np.outer(mean, mean))
    values, found = values[::-1][:axes], found[:, ::-1][:, :axes]
    # the sign of an axis is free; its largest component makes it positive, so that reruns agree
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(axes)])
    return mean, found / np.sqrt(np.maximum(values, 1e-12))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells, a row each with a number of ``bits`` bits a dimension.

    By the transposed form of the curve: from the highest bit down, cells are turned and mirrored
    into the orientation of their half, then Gray-coded; the bits of all dimensions are interleaved.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for k in range(dims):
            mirrored = (x[:, k] >> b & 1).astype(bool)
            turned = np.where(mirrored, 0, (x[:, 0] ^ x[:, k]) & low)
            x[:, 0] ^= np.where(mirrored, low, turned)
            x[:, k] ^= turned
    for k in range(1, dims):
        x[:, k] ^= x[:, k - 1]
    flips = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        flips ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= flips[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = key << 1 | x[:, k] >> b & 1
    return key


def curve_places(tokens: DataFrame) -> DataFrame:
    """(row, key, length): where on the curve each row of tokenised() lies. Cells are finest where documents are many."""
    mean, axes = principal_frame(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.tanh(0.8 * ((_matrix(batch.column(2)) - mean) @ axes))
            cells = np.minimum(((on + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert_keys(cells, BITS)), batch.column(1)], ["row", "key", "length"])

    return tokens.select("row", "length", "vector").mapInArrow(run, "row long, key long, length long")


def along_curve(keys: DataFrame) -> DataFrame:
    """(row, place): tokens before each row in the order of keys, equal keys by row; place is without gaps.

    Rows are range-sorted; a range is summed by itself, and one number a range meets the others.
    """
    ranges = max(1, -(-keys.count() // UNIT_ROWS))
    dealt = materialise(keys.repartitionByRange(ranges, "key", "row").withColumn("range", F.spark_partition_id()), "curve-ranges")
    return running_sums(dealt, [], F.col("range"), [F.col("key"), F.col("row")], {"place": F.col("length")}).select("row", "place")


def sequence_starts(total: int, capacity: int) -> tuple[int, np.ndarray]:
    """How many full sequences there are, and where those of the rest start, the longest power of two first."""
    full = total // capacity
    starts, at, rest = [], full * capacity, total % capacity
    while rest:
        starts.append(at)
        at, rest = at + (1 << rest.bit_length() - 1), rest - (1 << rest.bit_length() - 1)
    return full, np.array(starts, np.int64)


def pack_along_curve(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids (null or empty: none) and the id ``end``; it is cut wherever a
    sequence ends. Every sequence but those of the last ``capacity`` tokens is full; those have
    lengths that are powers of two, so nothing is padded. Rows with equal ids, or none, are
    documents of their own. Texts without tokens lie together on the curve. An empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    tokens = materialise(tokenised(docs, tokenizer, end).withColumn("row", F.monotonically_increasing_id()), "curve-tokens")
    keys = materialise(curve_places(tokens), "curve-keys")
    total = keys.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    full, rest = sequence_starts(total, capacity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rows = [], []
            for n, (length, ids, place) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                width = len(ids) // length
                at, last = place, place + length
                while at < last:
                    if at < full * capacity:
                        sequence = at // capacity
                        start, stop = sequence * capacity, (sequence + 1) * capacity
                    else:
                        k = int(np.searchsorted(rest, at, side="right")) - 1
                        sequence, start, stop = full + k, int(rest[k]), int(rest[k + 1]) if k + 1 < len(rest) else total
                    stop = min(stop, last)
                    part = ids[(at - place) * width : (stop - place) * width]
                    part = part if width == 4 else np.frombuffer(part, "<u2").astype("<u4").tobytes()
                    doc.append(n)
                    rows.append((at - place, stop - at, zlib.crc32(part), length, sequence, at - start))
                    at = stop
            made = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), *[pa.array(made[:, k]) for k in range(6)]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    placed = tokens.select("row", "doc_id", "length", "ids").join(along_curve(keys), "row").select("doc_id", "length", "ids", "place")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
