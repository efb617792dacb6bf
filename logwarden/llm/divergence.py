"""How the words of sources differ, language by language, by sorted streams.

Terms are counted with their documents where texts are read, in tables of bounded size. What comes
out of those tables is dealt out by (lang, term) and sorted by (lang, term, source, document); a scan
over the runs of equal keys gives document frequencies and counts. The terms that a language keeps
are dealt out again, in any number of parts, each part behind a head with all groups of the language;
a second scan over the runs adds up, for a part, the differences of every pair of sources and holds
the terms that stand out most, and hands on those partial results. They meet in one last aggregate.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import materialise

#: Bytes of terms: letters, and all bytes of characters beyond ASCII.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Entries of a counting table, rows of a part, numbers of a dense block, bytes of a text counted at a time.
ENTRIES, PART_ROWS, BLOCK, SLICE = 400_000, 200_000, 2_000_000, 4 << 20
#: An entry of a table is its documents times this, plus its occurrences.
DOCUMENT = 1 << 40
SCALE, SMOOTH = 1_000_000_000, 5

COUNTED = "lang string, term string, source string, document long, docs long, n long"
RUNS = "lang string, term string, source string, n long, term_first long"
PARTIAL = "lang string, source string, part string, item string, value long"


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices of about SLICE bytes that cut no term."""
    start = 0
    while len(text) - start > SLICE:
        end = start + SLICE
        found = _TERM.match(text, end)
        end = found.end() if found else end
        yield text[start:end]
        start = end
    yield text[start:]


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, source, document, docs, n): in how many documents and how often, from each counting table.

    ``document`` is the number, within the task, of the first document that the table counts. A row
    with an empty term stands for each (lang, source) and holds its documents. A table that has
    grown to ENTRIES goes out and a new one is begun, so that a term that every document has makes a
    row a table, not a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)
        first = seen = held = 0

        def out() -> pa.RecordBatch:
            terms, entries, sizes = [], [], []
            for own in table.values():
                terms += own
                entries.append(np.fromiter(own.values(), np.int64, len(own)))
                sizes.append(len(own))
            groups, packed = pa.array(np.repeat(np.arange(len(sizes)), sizes)), np.concatenate(entries)
            named = [pa.array([g[k] for g in table], pa.string()).take(groups) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(
                [named[0], pa.array(terms, pa.binary()).cast(pa.string()), named[1], pa.array(np.full(len(packed), first, np.int64)), pa.array(packed // DOCUMENT), pa.array(packed % DOCUMENT)],
                ["lang", "term", "source", "document", "docs", "n"],
            )

        for batch in batches:
            langs, sources, texts = (c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())))
            for lang, source, text in zip(langs, sources, texts, strict=True):
                terms = table[lang, source]
                own: Counter[bytes] = Counter()
                for part in _slices(text):
                    own.update(_TERM.findall(part.lower()))
                held -= len(terms)
                for term, n in own.items():
                    terms[term] = terms.get(term, 0) + n + DOCUMENT
                terms[b""] = terms.get(b"", 0) + DOCUMENT
                held += len(terms)
                seen += 1
                if held >= ENTRIES:
                    yield out()
                    table.clear()
                    first, held = seen, 0
        if table:
            yield out()

    empty = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    return docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(run, COUNTED)


def _starts(*columns: pa.Array) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns; the first row is a start."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        if n > 1:
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that end where a run of equal keys ends; keys: places of its columns.

    What is held back is the last run of a batch, which has a row for each source and counting table
    at most.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(batch.column(k)[batch.num_rows - 1] == held[0].column(k)[0] for k in keys):
            held.append(batch)
            continue
        whole = _joined([*held, batch])
        last = int(np.flatnonzero(_starts(*[whole.column(k) for k in keys]))[-1])
        if last:
            yield whole.slice(0, last)
        held = [whole.slice(last)]
    if held:
        yield _joined(held)


def scan_terms(counted: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, source, n, term_first): counts of the terms that at least ``least_docs`` documents of their language have.

    term_first is 1 for one row of each term. The empty terms of count_terms() stay, with n as their
    documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches, (0, 1)):
            terms = _starts(rows.column(0), rows.column(1))
            sources = np.flatnonzero(terms | _starts(rows.column(2)))
            docs, n = (np.add.reduceat(rows.column(k).to_numpy(), sources) for k in (4, 5))
            at = np.flatnonzero(terms)
            own = np.searchsorted(at, sources, side="right") - 1
            frequency = np.bincount(own, docs, len(at)).astype(np.int64)
            blank = pc.equal(rows.column(1), "").to_numpy(zero_copy_only=False)[sources]
            keep = np.flatnonzero(blank | (frequency[own] >= least_docs))
            picked = pa.array(sources[keep])
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(k).take(picked) for k in (0, 1, 2)], pa.array(np.where(blank, docs, n)[keep]), pa.array((terms[sources] & ~blank)[keep].astype(np.int64))],
                ["lang", "term", "source", "n", "term_first"],
            )

    # the hash in front settles nearly all comparisons without looking at texts
    dealt = counted.repartition("lang", "term").withColumn("key", F.xxhash64("lang", "term")).sortWithinPartitions("key", "lang", "term", "source", "document")
    return dealt.drop("key").mapInArrow(run, RUNS)


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / whole) in whole numbers, by long division three digits at a time.

    ``whole`` is at least count + SMOOTH. Nothing overflows up to 9e15 words.
    """
    rest = counts + SMOOTH
    out, rest = np.divmod(rest, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


class Differences:
    """What one part of a language's terms adds to its pairs of sources, and the terms that stand out most in it."""

    def __init__(self, lang: str, sources: list[str], whole: list[int], top: int) -> None:
        self.lang, self.sources, self.top = lang, sources, top
        self.at = {s: k for k, s in enumerate(sources)}
        self.whole, self.all = np.array(whole[:-1], np.int64), np.array(whole[-1:], np.int64)
        self.dense = len(sources) ** 2 <= BLOCK
        self.sums = np.zeros((len(sources), len(sources)), np.int64) if self.dense else None
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in sources]

    def add(self, counts: np.ndarray, terms: list[str]) -> Iterator[pa.RecordBatch]:
        """counts: a row a term, a column a source. Of more sources than a dense block has room for, sums go out at once."""
        p, q = shares(counts, self.whole), shares(counts.sum(axis=1), self.all)
        for k in range(len(self.sources)):
            sums = np.abs(p - p[:, k : k + 1]).sum(axis=0)
            if self.dense:
                self.sums[k] += sums
            else:
                yield self.pairs(k, sums)
        over = np.where(counts > 0, p - q[:, None], 0)
        for k in range(len(self.sources)):
            found = np.flatnonzero(over[:, k] > 0)
            if len(found) > self.top:
                least = np.partition(over[found, k], len(found) - self.top)[len(found) - self.top]
                found = found[over[found, k] >= least]
            if len(found):
                mine = [*self.best[k], *((-int(over[t, k]), terms[t].encode()) for t in found)]
                self.best[k] = sorted(mine)[: self.top]

    def pairs(self, k: int, sums: np.ndarray) -> pa.RecordBatch:
        rest = [s for n, s in enumerate(self.sources) if n != k]
        return self.rows([self.sources[k]] * len(rest), "pair", rest, [int(v) for n, v in enumerate(sums) if n != k])

    def rows(self, sources: list[str], part: str, items: list[str], values: list[int]) -> pa.RecordBatch:
        n = len(items)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * n, pa.string()), pa.array(sources, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())],
            ["lang", "source", "part", "item", "value"],
        )

    def done(self) -> Iterator[pa.RecordBatch]:
        for k, source in enumerate(self.sources):
            if self.dense:
                yield self.pairs(k, self.sums[k])
            if self.best[k]:
                yield self.rows([source] * len(self.best[k]), "term", [t.decode() for _, t in self.best[k]], [-v for v, _ in self.best[k]])


def scan_parts(dealt: DataFrame, top: int) -> DataFrame:
    """Partial results of each part: see PARTIAL. dealt: sorted by part, language, head first, term and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Differences | None = None
        key, heads = None, ([], [])
        for rows in _whole_runs(batches, (0, 1, 2, 3)):
            begins = np.append(np.flatnonzero(_starts(rows.column(0), rows.column(1), rows.column(2))), rows.num_rows)
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                part = rows.slice(a, b - a)
                own = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if own != key:
                    if now:
                        yield from now.done()
                    now, key, heads = None, own, ([], [])
                if not part.column(2)[0].as_py():
                    # a head may come in several batches, but always before the terms
                    heads[0].extend(part.column(4).to_pylist())
                    heads[1].extend(part.column(5).to_pylist())
                    continue
                now = now or Differences(own[1], heads[0][1:], [*heads[1][1:], heads[1][0]], top)
                starts = _starts(part.column(3))
                term = np.cumsum(starts) - 1
                names = part.column(3).take(pa.array(np.flatnonzero(starts))).to_pylist()
                source, n = np.array([now.at[s] for s in part.column(4).to_pylist()], np.int64), part.column(5).to_numpy()
                step = max(1, BLOCK // len(now.sources))
                for t in range(0, len(names), step):
                    i, j = np.searchsorted(term, [t, t + step])
                    counts = np.zeros((len(names[t : t + step]), len(now.sources)), np.int64)
                    counts[term[i:j] - t, source[i:j]] = n[i:j]
                    yield from now.add(counts, names[t : t + step])
        if now:
            yield from now.done()

    return dealt.mapInArrow(run, PARTIAL)


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: see the module.

    Null text, lang and source count as empty. A term is a run of letters and of characters beyond
    ASCII, A-Z lower-cased; a language keeps the terms that ``least_docs`` of its documents (rows)
    have. Every group (lang, source) that occurs gives each of the V kept terms the share
    1 + floor(1e9 * (count + 5) / (N + 5 V)), N being the group's occurrences of kept terms, and so
    does the language as a whole. Part ``pair``: for each other source of the language the sum of
    the differences over all kept terms, 0 if there are none. Part ``term``: the ``top`` kept terms
    that the group has and gives a larger share than its language does, with the difference. Ranks
    count from 1 within group and part, by value descending and item ascending. Equal rows are
    documents of their own. An empty table gives an empty result; other columns are ignored.

    Groups are a handful for most tables; heads repeat them once a part. With so many sources that
    their pairs exceed a block, partial sums go out block by block, and tasks hold one row of them.
    """
    runs = materialise(scan_terms(count_terms(docs), least_docs), "divergence-runs")
    term = F.col("term") != ""
    group = runs.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(term, F.col("n"))), F.lit(0)).alias("words"), F.sum("term_first").alias("terms"))
    group = materialise(group, "divergence-groups")
    lang = group.groupBy("lang").agg(F.sum("words").alias("all_words"), F.sum("terms").alias("kept"))
    parts = max(1, -(-runs.count() // PART_ROWS))
    known = group.join(lang, "lang")
    whole = lambda words: F.col(words) + SMOOTH * F.col("kept")
    # the head of a part: the language itself (no source), then its groups in order
    heads = known.select("lang", "source", whole("words").alias("n")).unionByName(lang.select("lang", F.lit(None).cast("string").alias("source"), whole("all_words").alias("n")))
    heads = heads.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "lang", F.lit(False).alias("body"), F.lit("").alias("term"), "source", "n")
    body = runs.filter(term).select(F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("part"), "lang", F.lit(True).alias("body"), "term", "source", "n")
    dealt = heads.unionByName(body).repartition(F.col("part"), F.col("lang")).sortWithinPartitions("part", "lang", "body", "term", F.col("source").asc_nulls_first())
    pairs = group.select("lang", "source").join(group.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    nothing = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    found = scan_parts(dealt, top).unionByName(nothing).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
