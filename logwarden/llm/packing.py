"""Best-fit packing by a linear grouping scheme.

Documents become pieces of at most a sequence's length. Large pieces, sorted, are cut into groups
of equal cardinality and rounded up to the longest of their group, which leaves few sizes; the
driver picks configurations of those few sizes (how many of each share a sequence, how often), from
counts alone. Real pieces then take the places of their group by rank, and what is really left of
each sequence is filled with small pieces, longest first, each where it leaves least. That, too, is
decided on counts: of sequences by space left and of small pieces by length, both at most a
sequence's length of numbers. Joins by rank carry the decisions out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.common import leading_bits, materialise, running_sums, unit_bits

CAPACITY, GROUPS, SMALL_PART = 2048, 512, 8
#: Texts of words of these are split as the tokenizer splits them; others go through it whole.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")
_LATIN = re.compile(r"[a-zß-öø-ÿA-ZÀ-ÖØ-Þ.,;:!?|()\-#$%&*\"@+=/_]+\Z")
CACHED = 700_000


class WordIds(dict):
    """Token ids (little-endian 32 bits) of what stands between spaces, made once a word.

    The tokenizer drops white space and no token crosses it, so a text's ids are its words' ids.
    Words of Latin letters and plain marks are cut into runs here, a run being one pre-token that
    the model encodes by itself; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        marks = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = (256 + k for k in range(256))
        self.letters = {b: chr(b) if b in marks else chr(next(spare)) for b in range(256)}

    def run(self, text: str) -> bytes:
        out = self.get(text)
        if out is None:
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            out = self[text] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return out

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        if not _LATIN.match(word):
            out = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            runs = _PLAIN.findall(word.lower())
            out = self.run(runs[0]) if len(runs) == 1 else b"".join(map(self.run, runs))
        self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; each ends with id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in batches:
            doc, piece, length, crc = [], [], [], []
            for n, text in enumerate(batch.column(1)):
                ids = words.ids(text.as_py() or "") + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    doc.append(n)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            number = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(longest, count) of groups of equal cardinality, longest first; counts: pieces by length."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, int]] = []
    longest, held = 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            longest = longest if held else length
            took = min(left, each - held)
            held, left = held + took, left - took
            if held == each:
                out.append((longest, held))
                held = 0
    return out + ([(longest, held)] if held else [])


def best_fill(sizes: list[int], left: list[int], space: int) -> list[int]:
    """Groups (with repeats) whose sizes come nearest to ``space`` without passing it, longer ones first."""
    reached = np.zeros(space + 1, bool)
    reached[0] = True
    group, copies = np.zeros(space + 1, np.int64), np.zeros(space + 1, np.int64)
    for g, size in enumerate(sizes):
        if not left[g] or size > space:
            continue
        before = reached.copy()
        for n in range(1, min(left[g], space // size) + 1):
            new = np.flatnonzero(before[: space + 1 - n * size] & ~reached[n * size :]) + n * size
            reached[new], group[new], copies[new] = True, g, n
        if reached[space]:
            break
    at, out = int(np.flatnonzero(reached)[-1]), []
    while at:
        g, n = int(group[at]), int(copies[at])
        out += [g] * n
        at -= n * sizes[g]
    return out


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(group: how many a sequence, sequences): each step fills up the longest group left as well as can be.

    A configuration is used as often as the counts allow, so the steps are about as many as groups,
    whatever the number of pieces.
    """
    sizes, left = [s for s, _ in groups], [n for _, n in groups]
    out = []
    for g in range(len(sizes)):
        while left[g]:
            left[g] -= 1
            chosen = [g, *best_fill(sizes, left, capacity - sizes[g])]
            left[g] += 1
            need: dict[int, int] = {}
            for x in chosen:
                need[x] = need.get(x, 0) + 1
            times = min(left[x] // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= n * times
            out.append((need, times))
    return out


def best_fit(spaces: dict[int, int], small: dict[int, int], capacity: int, first_new: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where small pieces go, longest first, each into the sequence with the least space that holds it.

    spaces: sequences by space left; small: pieces by length. Returns runs (length, first rank,
    count, space, first rank of sequence): pieces of that length and ranks go to the sequences of
    that original space and ranks, one each. New sequences have space -1 and are ranked from
    ``first_new``; their number comes second.
    """
    bins: dict[int, deque[tuple[int, int, int]]] = {s: deque([(s, 0, n)]) for s, n in spaces.items() if n}
    runs, new = [], 0
    present = np.zeros(capacity + 1, bool)
    present[list(bins)] = True
    for length in sorted(small, reverse=True):
        rank, left = 0, small[length]
        while left:
            at = np.flatnonzero(present[length:])
            if len(at):
                space = length + int(at[0])
            else:
                # as many new sequences as it takes to hold what is left of this length
                space, opened = capacity, -(-left // max(1, capacity // length))
                bins.setdefault(space, deque()).append((-1, first_new + new, opened))
                new += opened
            kind, start, n = bins[space].popleft()
            took = min(n, left)
            if took < n:
                bins[space].appendleft((kind, start + took, n - took))
            present[space] = bool(bins[space])
            runs.append((length, rank, took, kind, start))
            bins.setdefault(space - length, deque()).append((kind, start, took))
            present[space - length] = True
            rank, left = rank + took, left - took
    return runs, new


def pack(parts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to pieces (a column ``length``, at least 1 and at most ``capacity``).

    Pieces that fill a sequence are sequences themselves. The driver holds counts by length, at most
    ``capacity`` of them, and the decisions made on them. Repeated rows are pieces of their own. An
    empty table gives an empty result.
    """
    cols = parts.columns
    parts = materialise(parts.withColumn("__h", F.xxhash64(*[c for c in ("doc_id", "piece", "length") if c in cols])), "pieces")
    bits = unit_bits(parts.count())
    unit = leading_bits(F.col("__h"), bits)
    by = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    full = by.pop(capacity, 0)
    large = {n: c for n, c in by.items() if n > capacity // SMALL_PART}
    small = {n: c for n, c in by.items() if n <= capacity // SMALL_PART}
    ranked = materialise(running_sums(parts, ["length"], unit, [F.col("__h")], {"__rank": F.lit(1)}), "ranked")

    # large pieces: rank over all lengths, longest first, finds the group; the rank in it, the place
    longer, run = {}, 0
    for n in sorted(large, reverse=True):
        longer[n], run = run, run + large[n]
    grouped = linear_groups(large, groups)
    plan = configurations(grouped, capacity)
    starts = np.concatenate([[0], np.cumsum([n for _, n in grouped])]).astype(np.int64)
    taken, base = [0] * len(grouped), 0
    rows = []
    for need, times in plan:
        for g, n in need.items():
            rows.append((int(starts[g] + taken[g]), n * times, base, times))
            taken[g] += n * times
        base += times
    rows.sort()
    from_rank, _, bases, uses = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    lead = np.zeros(capacity + 1, np.int64)
    for n, x in longer.items():
        lead[n] = x
    most = capacity // SMALL_PART

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["__rank"].to_numpy()
            place = np.full(len(frame), -1, np.int64)
            big = (length > most) & (length < capacity)
            overall = lead[length[big]] + rank[big]
            if big.any():
                k = np.searchsorted(from_rank, overall, side="right") - 1
                place[big] = bases[k] + (overall - from_rank[k]) % uses[k]
            place[length == capacity] = base + rank[length == capacity]
            yield frame.assign(sequence_id=place)

    def with_longs(*names: str) -> T.StructType:
        return T.StructType([*ranked.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    placed = ranked.mapInPandas(place, with_longs("sequence_id"))
    done = materialise(placed.filter("sequence_id >= 0"), "placed-large")
    spaces = done.filter(F.col("length") < capacity).groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("space")).filter("space > 0")
    spaces = spaces.withColumn("__h", F.xxhash64("sequence_id"))
    spaces = materialise(running_sums(spaces, ["space"], leading_bits(F.col("__h"), bits), [F.col("__h"), F.col("sequence_id")], {"at": F.lit(1)}), "spaces")
    runs, _ = best_fit({r[0]: r[1] for r in spaces.groupBy("space").count().collect()}, small, capacity, base + full)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    firsts = {int(n): (int(a), int(b)) for n, a, b in zip(*_spans(table[:, 0]), strict=True)}

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["__rank"].to_numpy()
            kind, at = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for n in np.unique(length):
                own, (a, b) = length == n, firsts[int(n)]
                k = a + np.searchsorted(table[a:b, 1], rank[own], side="right") - 1
                kind[own], at[own] = table[k, 3], table[k, 4] + rank[own] - table[k, 1]
            yield frame.assign(space=kind, at=at)

    rest = ranked.filter(F.col("length") <= most).mapInPandas(fill, with_longs("space", "at"))
    filled = rest.join(spaces.select(F.col("space").cast("long").alias("space"), F.col("at").cast("long").alias("at"), "sequence_id"), ["space", "at"], "left")
    filled = filled.withColumn("sequence_id", F.coalesce("sequence_id", "at"))
    out = done.select(*cols, "__h", "sequence_id").unionByName(filled.select(*cols, "__h", "sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "__h").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).select(*cols, "sequence_id", "offset")


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array, and where each starts and ends."""
    found, start = np.unique(keys, return_index=True)
    return found, start, np.append(start, len(keys))[1:]


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null: none) and id 0; only longer ones than ``capacity`` are cut.
    Repeated rows, and rows with a null doc_id, are documents of their own. Other columns of
    ``docs`` are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)
