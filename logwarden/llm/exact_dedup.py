"""Exact dedup by content-defined chunk recipes.

A text, lower-cased A-Z, is cut where a hash of the eight bytes before a place has some bits unset,
so equal passages are cut alike wherever they stand. Equal chunks become one identifier: a 64-bit
fingerprint, verified by comparing the chunks' bytes; a text with a chunk whose fingerprint another
chunk shares is listed by SHA-256 of its chunks. Texts are equal when their ordered identifier lists are; only those lists, not the
texts, meet in the comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import ROW, keep_rows, lower_ascii, materialise, text_blocks, with_rows

LEAST, MEAN_BITS, MOST = 1024, 12, 65536
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def cut_places(raw: np.ndarray, bits: int = MEAN_BITS) -> np.ndarray:
    """Places (ends of chunks) that the eight bytes before them choose, one in 2**bits on average."""
    if len(raw) < 8:
        return np.zeros(0, np.int64)
    words = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    return np.flatnonzero((words * MULTIPLIER) >> np.uint64(64 - bits) == 0) + 8


def chunk_ends(places: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of one text's chunks: chosen places at least LEAST apart, and every MOST bytes without any."""
    ends, at = [], start
    while end - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST))
        cut = int(places[k]) if k < len(places) else end
        cut = min(cut, at + MOST, end)
        ends.append(cut)
        at = cut
    if at < end:
        ends.append(end)
    return ends


def chunks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, list[bytes]]]:
    """The folded text and its chunks, for each text of a block."""
    folded = np.ascontiguousarray(_FOLD[raw])
    places, whole = cut_places(folded), folded.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text, at, out = whole[a:b], 0, []
        # a place counts only if its eight bytes are the text's own
        own = places[np.searchsorted(places, a + 8) : np.searchsorted(places, b, side="right")] - a
        for end in chunk_ends(own, 0, b - a):
            out.append(text[at:end])
            at = end
        yield text, out


def fingerprint(chunk: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, offsets, raw in text_blocks(batch, "text"):
            found = [(hashlib.sha256(text).hexdigest(), [fingerprint(c) for c in parts]) for text, parts in chunks(raw, offsets)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(found)), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.int64()))],
                ["doc_id", "text_sha256", "recipe"],
            )


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, offsets, raw in text_blocks(batch, "text"):
            own = {c for _, parts in chunks(raw, offsets) for c in parts}
            rows = list(own)
            yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, rows), pa.int64()), pa.array(rows, pa.binary())], ["fingerprint", "chunk"])


def shared_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints that different chunks share: next to none.

    Every distinct chunk moves once, whole, and chunks are compared as bytes.
    """
    distinct = docs.select("text").mapInArrow(_chunk_rows, "fingerprint long, chunk binary").distinct()
    return distinct.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")


def _exact_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, offsets, raw in text_blocks(batch, "text"):
            found = [[hashlib.sha256(c).hexdigest() for c in parts] for _, parts in chunks(raw, offsets)]
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(found)), pa.array(found, pa.list_(pa.string()))], ["doc_id", "strong"])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal
    texts the largest doc_id stays (keep_id); a null doc_id stays only where the group has no other.
    Rows repeated with the same doc_id and text count in group_size and are flagged alike. An empty
    table gives an empty result. Other columns are ignored.

    A group may hold a third of all rows: it is counted by partial aggregates, and its rows meet
    the one row of counts in a join whose hot side adaptive execution splits.
    """
    rows = docs.select("doc_id", "text")
    recipes = materialise(rows.mapInArrow(_recipes, "doc_id long, text_sha256 string, recipe array<long>"), "recipes")
    clashes = materialise(shared_fingerprints(rows), "clashes")
    if clashes.isEmpty():
        listed = recipes.withColumn("ids", F.struct("recipe", F.lit(None).cast("array<string>").alias("strong")))
    else:
        named = recipes.select(F.explode("recipe").alias("fingerprint"), "text_sha256").join(clashes, "fingerprint", "left_semi").select("text_sha256").distinct()
        hit = rows.withColumn("text_sha256", F.sha2(lower_ascii(F.coalesce("text", F.lit(""))).cast("binary"), 256)).join(named, "text_sha256", "left_semi")
        strong = hit.select("text_sha256", "text").dropDuplicates(["text_sha256"]).select(F.col("text_sha256").alias("doc_id"), "text")
        strong = strong.mapInArrow(_exact_recipes, "doc_id string, strong array<string>").withColumnRenamed("doc_id", "text_sha256")
        listed = recipes.join(strong, "text_sha256", "left").withColumn("ids", F.struct("recipe", "strong"))
    groups = listed.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = groups.filter("group_size > 1")
    met = listed.join(several, "ids", "left")
    return met.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """Of the rows of equal texts the one with the largest doc_id, with all its columns.

    One row stays of each text: rows that repeat a doc_id count singly, and a row with a null doc_id
    stays only where the text has no other. See keep_rows() for what moves.
    """
    rows, key = with_rows(docs)
    groups = exact_dedup(rows.select(F.col(key).alias("doc_id"), "text")).filter("group_size > 1").select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group"))
    return keep_rows(rows, key, groups, F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id")))
