"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.sources.scratch import broadcast_if_small, materialise, release, scratch_dir

__all__ = ["FEW_KEYS", "ROW", "broadcast_if_small", "keep_rows", "leading_bits", "lower_ascii", "materialise", "null_safe", "release", "row_key", "running_sums", "scratch_dir", "table", "text_blocks", "unit_bits", "with_rows"]
#: What separates words, as a Java regular expression of the words themselves.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that one task numbers or sums in order; more rows make more units.
UNIT_ROWS = 20_000
#: So many keys, some tens of megabytes, are broadcast; more are joined by a shuffle.
FEW_KEYS = 2_000_000
#: A row's key, where rows and not ids are decided on; with_rows() lengthens the name where a table has it.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def row_key(df: DataFrame) -> str:
    """A name for a key that no column of the table has."""
    name, taken = ROW, {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, and its name; written down so that every reading sees the same keys."""
    key = row_key(df)
    return materialise(df.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def keep_rows(rows: DataFrame, key: str, groups: DataFrame, best: Column) -> DataFrame:
    """Of the rows of each group the one of least ``best``, whatever ids rows share; the keys go.

    rows, key: with_rows(); groups: (ROW, group), one row each. Only keys and ids meet in groups. Of
    up to FEW_KEYS rows that go the keys are broadcast, and no text moves; beyond that the rows are
    joined by their keys.
    """
    known = materialise(groups.join(rows.select(F.col(key).alias(ROW), "doc_id"), ROW).select(ROW, "group", "doc_id"), "row-groups")
    stays = known.groupBy("group").agg(F.min(F.struct(best, F.col(ROW)))[ROW].alias(ROW))
    gone = broadcast_if_small(known.select(ROW).join(stays, ROW, "left_anti").select(F.col(ROW).alias(key)), "rows-gone", FEW_KEYS)
    return rows.join(gone, key, "left_anti").drop(key)


def unit_bits(rows: int) -> int:
    """So many leading bits of a 64-bit hash cut that many rows into units of UNIT_ROWS or fewer."""
    return max(0, int(np.ceil(np.log2(max(1, rows) / UNIT_ROWS))))


def leading_bits(hashed: Column, bits: int) -> Column:
    """The first bits of a signed 64-bit hash, as a number in the hash's order."""
    return F.shiftright(hashed, 64 - bits) if bits else F.lit(0).cast("long")


def running_sums(df: DataFrame, keys: list[str], unit: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name, the sum of its column over the rows before this one within the keys.

    Order is by unit, then by ``order``. Units are summed first and their sums added up, so a key
    that holds a third of all rows is still dealt out over its units; only one row a unit and key
    meets the other units.
    """
    rows = df.withColumn("__unit", unit)
    totals = rows.groupBy(*keys, "__unit").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("__unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__unit", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums])
    within = Window.partitionBy(*keys, "__unit").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe(rows, starts, [*keys, "__unit"])
    out = joined.select(
        *df.columns,
        *[(F.col(f"__s_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in sums.items()],
    )
    return out


def text_blocks(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``most_bytes`` of UTF-8: first row, offsets from 0, bytes.

    A null text counts as empty. A text is never cut; one longer than the limit is a run of its own.
    """
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, offsets[first : last + 1] - offsets[first], raw[offsets[first] : offsets[last]]
        first = last
