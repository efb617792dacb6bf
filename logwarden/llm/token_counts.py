"""Edit-aware token counting.

A text is a sequence of segments: white space with the word after it. No token of the byte-level
pre-tokenizer crosses from a word into the white space after it, so counts of segments add up. Each
document keeps a tree: its segments' lengths and token counts, in leaves of a few dozen segments,
and the sums of leaves above. Trees are rows of a table. An edit re-encodes the segments that it
touches and the ones next to it, replaces them in their leaf, and updates the sums on the leaf's
path to the root; what it makes is a tree again, so the next edits go on from there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import materialise

#: (start, end, new): the characters from start to end become new; edits that overlap are an error.
Edit = tuple[int, int, str]
LEAF, FANOUT, CACHED = 16, 16, 400_000
#: The characters with the Unicode property White_Space.
_WHITE = "\t-\r \x85\xa0  -     　"
_SEGMENT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: Segments whose pre-tokens are plain: a space or line feed, then Latin letters, digits or marks.
_PLAIN = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ.,;:!?|()#$%&*\"@+=/_\-]+\Z")
_TOKENS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[.,;:!?|()#$%&*\"@+=/_\-]+|\n")


class SegmentCounts(dict):
    """Token counts of segments, each made once."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, int] = {}
        marks = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = (256 + k for k in range(256))
        self.letters = {b: chr(b) if b in marks else chr(next(spare)) for b in range(256)}

    def part(self, text: str) -> int:
        n = self.parts.get(text)
        if n is None:
            if len(self.parts) >= CACHED:
                self.parts.clear()
            n = self.parts[text] = len(self.model.tokenize(text.encode().decode("latin-1").translate(self.letters)))
        return n

    def __missing__(self, segment: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        if _PLAIN.match(segment):
            n = sum(map(self.part, _TOKENS.findall(segment)))
        else:
            n = len(self.tokenizer.encode(segment, add_special_tokens=False).ids)
        self[segment] = n
        return n


class CountTree:
    """A text's segments and the sums of their token counts; the bottom level of ``levels`` has the leaves."""

    def __init__(self, text: str, counts: SegmentCounts) -> None:
        self.counts = counts
        segments = _SEGMENT.findall(text)
        self.text, (self.lengths, self.tokens) = text, self._encode(segments)
        self._grow()

    @classmethod
    def stored(cls, text: str, counts: SegmentCounts, lengths: np.ndarray, tokens: np.ndarray, leaves: np.ndarray, sums: np.ndarray) -> CountTree:
        """The tree that a row of count_trees() holds; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.text, tree.counts, tree.lengths, tree.tokens, tree.leaves = text, counts, lengths, tokens, leaves.copy()
        tree.levels, at, n = [], 0, len(leaves)
        while n:
            tree.levels.append(sums[at : at + n].copy())
            at, n = at + n, 0 if n == 1 else -(-n // FANOUT)
        return tree

    def _encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(segments)
        return np.fromiter(map(len, segments), np.int32, n), np.fromiter(map(self.counts.__getitem__, segments), np.int32, n)

    def _grow(self) -> None:
        """Deal the segments into full leaves and add up the levels; nothing is encoded."""
        n = len(self.tokens)
        starts = np.arange(0, n, LEAF)
        self.leaves = np.diff(np.append(starts, n)).astype(np.int32) if n else np.zeros(0, np.int32)
        self.levels = [np.add.reduceat(self.tokens, starts, dtype=np.int64)] if n else []
        while n and len(self.levels[-1]) > 1:
            self.levels.append(np.add.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), FANOUT)))

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if self.levels else 0

    @property
    def sums(self) -> np.ndarray:
        return np.concatenate(self.levels) if self.levels else np.zeros(0, np.int64)

    def _add(self, leaf: int, change: int) -> None:
        for level in self.levels if change else ():
            level[leaf] += change
            leaf //= FANOUT

    def apply(self, edits: list[Edit]) -> tuple[str, int]:
        """Apply edits in order of place; the new text and how many segments were encoded again.

        Places count characters of the text as it is before the call. Afterwards the tree is that of
        the new text, but for leaves that became longer or shorter; when one passes four times its
        size, all are dealt anew. Edits that overlap, or reach beyond the text, are an error.
        """
        if not edits:
            return self.text, 0
        place = 0
        for start, end, _ in sorted(edits, key=lambda e: e[:2]):
            if not place <= start <= end <= len(self.text):
                raise ValueError(f"an edit of {start} to {end} overlaps another or leaves a text of {len(self.text)} characters")
            place = end
        if not len(self.lengths):
            self.__init__("".join(new for _, _, new in sorted(edits, key=lambda e: e[:2])), self.counts)
            return self.text, len(self.lengths)
        ends, last = np.cumsum(self.lengths, dtype=np.int64), len(self.lengths) - 1
        runs: list[list] = []
        for start, end, new in sorted(edits, key=lambda e: e[:2]):
            first = min(int(np.searchsorted(ends, max(start - 1, 0), side="right")), last)
            final = min(int(np.searchsorted(ends, end, side="right")), last)
            if runs and first <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], final)
                runs[-1][2].append((start, end, new))
            else:
                runs.append([first, final, [(start, end, new)]])
        bounds = np.cumsum(self.leaves, dtype=np.int64)
        out, at, encoded, kept = [], 0, 0, 0
        lengths, tokens = [], []
        for first, final, own in runs:
            begin = int(ends[first - 1]) if first else 0
            stop = int(ends[final])
            parts, here = [], begin
            for start, end, new in own:
                parts += [self.text[here:start], new]
                here = end
            region = "".join([*parts, self.text[here:stop]])
            out += [self.text[at:begin], region]
            fresh = self._encode(_SEGMENT.findall(region))
            lengths += [self.lengths[kept:first], fresh[0]]
            tokens += [self.tokens[kept:first], fresh[1]]
            # the new segments join the first leaf that the old ones leave
            home = int(np.searchsorted(bounds, first, side="right"))
            for leaf in range(home, int(np.searchsorted(bounds, final, side="right")) + 1):
                a = max(first, int(bounds[leaf - 1]) if leaf else 0)
                b = min(final + 1, int(bounds[leaf]))
                self.leaves[leaf] -= b - a
                self._add(leaf, -int(self.tokens[a:b].sum()))
            self.leaves[home] += len(fresh[0])
            self._add(home, int(fresh[1].sum()))
            at, kept, encoded = stop, final + 1, encoded + len(fresh[0])
        self.text = "".join([*out, self.text[at:]])
        self.lengths, self.tokens = np.concatenate([*lengths, self.lengths[kept:]]), np.concatenate([*tokens, self.tokens[kept:]])
        if int(self.leaves.max()) > 4 * LEAF:
            self._grow()
        return self.text, encoded


_RUNS = re.compile(r"[0-9]{6,}|[#$%&*!]{2,}")


def cleaning_edits(text: str) -> list[Edit]:
    """Edits of a cleaning pass: long numbers become <NUM>, runs of marks one space, repeated lines go."""
    edits: list[Edit] = []
    gone: list[tuple[int, int]] = []
    if "\n" in text:
        seen, at = set(), 0
        for line in text.split("\n"):
            end = at + len(line)
            if line in seen and line:
                gone.append((at - 1, end))
            seen.add(line)
            at = end + 1
    edits += [(a, b, "") for a, b in gone]
    k = 0
    for m in _RUNS.finditer(text):
        while k < len(gone) and gone[k][1] <= m.start():
            k += 1
        if k == len(gone) or m.end() <= gone[k][0]:
            edits.append((m.start(), m.end(), "<NUM>" if m.group()[0].isdigit() else " "))
    return sorted(edits)


#: A document's state: its text, its segments' lengths in characters and token counts, segments of each leaf, sums level by level.
TREE = "doc_id long, text string, lengths array<int>, tokens array<int>, leaves array<int>, sums array<long>"
COUNTS = "tokens_before long, n_edits long, n_segments long, n_encoded long"
#: Rows of an output batch.
ROWS = 256


def _lists(parts: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.from_numpy_dtype(kind)))


def _columns(ids: pa.Array, trees: list[CountTree], nulls: list[bool]) -> list[pa.Array]:
    texts = pa.array([None if gone and not tree.text else tree.text for tree, gone in zip(trees, nulls, strict=True)], pa.string())
    numbers = [_lists([getattr(t, c) for t in trees], np.dtype(np.int32)) for c in ("lengths", "tokens", "leaves")]
    return [ids, texts, *numbers, _lists([t.sums for t in trees], np.dtype(np.int64))]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def count_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The count tree of every row of ``docs``: doc_id, text, lengths, tokens, leaves, sums.

    This is the one full encoding; write the table down, and edits go on from it. A null text counts
    as empty and stays null until an edit puts something there. Rows stay in their tasks. Repeated
    rows have trees of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = SegmentCounts(tokenizer)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                texts = batch.column(1).to_pylist()
                trees = [CountTree(t or "", counts) for t in texts]
                yield pa.RecordBatch.from_arrays(_columns(batch.column(0), trees, [t is None for t in texts]), _names(TREE))

    return docs.select("doc_id", "text").mapInArrow(run, TREE)


def _edited(trees: DataFrame, tokenizer: str, edits_of: Callable[[str, list | None], list[Edit]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = SegmentCounts(tokenizer)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                texts = batch.column(1).to_pylist()
                listed = batch.column(6).to_pylist() if batch.num_columns > 6 else [None] * len(texts)
                lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[2:6]]
                done, rows = [], []
                for n, text in enumerate(texts):
                    tree = CountTree.stored(text or "", counts, *[values[ends[n] : ends[n + 1]] for ends, values in lists])
                    edits, before, segments = edits_of(tree.text, listed[n]), tree.total, len(tree.lengths)
                    _, encoded = tree.apply(edits)
                    done.append(tree)
                    rows.append((before, len(edits), segments, encoded))
                numbers = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*_columns(batch.column(0), done, [t is None for t in texts]), *numbers], _names(f"{TREE}, {COUNTS}"))

    return trees.mapInArrow(run, f"{TREE}, {COUNTS}")


def edit_by_rule(trees: DataFrame, tokenizer: str, rule: Callable[[str], list[Edit]]) -> DataFrame:
    """The trees after the edits that ``rule`` makes of their texts, with tokens_before, n_edits, n_segments, n_encoded."""
    return _edited(trees.select(*_names(TREE)), tokenizer, lambda text, _: rule(text))


def edit_by_table(trees: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """The trees after listed edits, with tokens_before, n_edits, n_segments, n_encoded.

    edits: (doc_id, start, end, new), at places of the trees' texts; those of a document do not
    overlap. Rows that share a doc_id get the same edits, rows without one get none, and edits of
    unknown documents are left out. A text's edits meet in its row.
    """
    own = edits.filter("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("__edits"))
    met = trees.select(*_names(TREE)).join(own, "doc_id", "left")
    return _edited(met, tokenizer, lambda _, listed: [(e["start"], e["end"], e["new"] or "") for e in listed or []])


def total_tokens() -> Column:
    """A tree's root: the tokens of its text."""
    return F.coalesce(F.try_element_at("sums", F.lit(-1)), F.lit(0)).cast("long")


def count_with_edits(docs: DataFrame, tokenizer: str, rule: Callable[[str], list[Edit]] = cleaning_edits, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, tokens_before, tokens_after, n_edits, n_segments, n_encoded (, text).

    Trees are counted and written down; the edits that ``rule`` gives of a text then go on from
    those. n_segments is what a full count encodes, n_encoded what the edits made it encode again. A
    null text counts as empty. Rows stay in their tasks. Repeated rows are counted alike; other
    columns are ignored.
    """
    trees = materialise(count_trees(docs, tokenizer), "count-trees")
    edited = edit_by_rule(trees, tokenizer, rule)
    return edited.select("doc_id", "tokens_before", total_tokens().alias("tokens_after"), "n_edits", "n_segments", "n_encoded", *["text"] * with_text)
