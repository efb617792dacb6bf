"""N-gram Jaccard join with signature trees.

Sets are the distinct word shingles of whole texts, as 64-bit hashes. A pair with Jaccard J or more
shares a token among the rarest |x| - ceil(J |x|) + 1 tokens of each, in any order that holds for
all sets. That brings together what can link, in three steps that lose no link:

1. Of each set the tokens of smallest hash, a tenth of the set more than the bound needs, are
   counted over all documents; a set of which too few of them occur elsewhere goes.
2. What is left has its tokens counted whole, rarest first, and its prefix by that order joins it
   to others in candidate components (star links to one set a token, so frequent tokens cost no
   pairs).
3. In each component a signature tree is built. A node holds the OR of its sets' token bitmaps, one
   plane per multiplicity, so that the common bits of two nodes bound the overlap of any of their
   sets, and the range of their sizes. A dual traversal leaves out pairs of nodes that cannot reach
   J, or whose sets are one component already; what remains is compared exactly.

Large components are cut into blocks of bounded tokens, and pairs of blocks are tasks. Sets that link
with their component's first set need not meet each other again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import ROW, leading_bits, materialise, release, running_sums, text_blocks, unit_bits, with_rows
from logwarden.llm.components import components
from logwarden.sources.scratch import temporary_tables

WORDS, PERCENT = 5, 80
#: Sets, and tokens of 8 bytes, that make a block of a large component or a group of small components; a set is never cut.
BLOCK, TOKENS = 512, 4 << 20
#: Tokens that a task remembers; what it forgets is told of again.
REMEMBERED = 1 << 20
#: Bytes of text that are worked on at once; temporaries take some sixty times as many.
BYTES = 1 << 20
#: Weights from here on are those of texts.
OWN = 1 << 32
PLANE, FANOUT, LEAF = 1024, 8, 16
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PLACE = mixed(np.arange(1, 65, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)
_BASE = 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, modulo 2**64, up to n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(max(n, 1 << 16), _U(base))
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text of a block its set of shingles: distinct 64-bit hashes in signed order."""
    n = len(offsets) - 1
    none = [np.zeros(0, np.int64)] * n
    if not len(raw):
        return none
    inside = ~_SPACE[raw]
    full = np.flatnonzero(np.diff(offsets))
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[full]] = False
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[full + 1] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return none
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[_FOLD[raw]] * up[: len(raw)], out=sums[1:])
    word = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    first = np.searchsorted(starts, offsets)
    out = list(none)
    terms = [word * _PLACE[k] for k in range(words)]
    m = len(word) - words + 1
    if m > 0:
        rolled = terms[0][:m].copy()
        for k in range(1, words):
            rolled += terms[k][k : k + m]
        rolled = mixed(rolled).view(np.int64)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= words:
            out[d] = np.unique(rolled[a : b - words + 1])
        elif b > a:
            whole = sum((int(terms[k][a + k]) for k in range(b - a)), (b - a) * 0x632BE59BD9B4E019) & ((1 << 64) - 1)
            out[d] = mixed(np.array([whole], _U)).view(np.int64)
    return out


def needed(n, percent: int):
    """The least overlap of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def prefix(n, percent: int):
    return n - needed(n, percent) + 1


class Met:
    """Tokens that a task has met: those told of for one text, and those told of as shared.

    Both are forgotten when they are too many, so memory is bounded. A token that half of all texts
    have is met again at once, so a task tells of it a few times, not once a text or block.
    """

    def __init__(self, most: int = REMEMBERED) -> None:
        self.most, self.single, self.shared = most, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def holds(self, known: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(tokens), bool)
        at = np.searchsorted(known, tokens)
        at[at == len(known)] = 0
        return known[at] == tokens

    def grown(self, known: np.ndarray, new: np.ndarray) -> np.ndarray:
        if len(known) + len(new) > self.most:
            return new[: self.most]
        return np.sort(np.concatenate([known, new]), kind="stable")

    def meet(self, tokens: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct sorted tokens of a block, which to tell of for their one text, and which as shared.

        several: tokens of more than one text of the block. Tokens that are neither are known to be shared.
        """
        told = self.holds(self.shared, tokens)
        shared = ~told & (several | self.holds(self.single, tokens))
        single = ~told & ~shared
        self.single, self.shared = self.grown(self.single, tokens[single]), self.grown(self.shared, tokens[shared])
        return single, shared


def _emit(words: int, percent: int):
    """Rows (token, doc_id, weight, hi, lo): a token of one text; or, doc_id null, of several that the task has met.

    A text's own row has the mixed doc_id for a token and the 128-bit print of its set; its weight is
    the set's size plus 1, shifted by 32 bits, plus the number of its tokens that the task knows to
    be shared. See Met for what keeps a token of all texts from making a row a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for batch in batches:
            ids = batch.column(0)
            for first, offsets, raw in text_blocks(batch, "text", BYTES):
                sets = shingle_sets(raw, offsets, words)
                sizes = np.array([len(s) for s in sets], np.int64)
                low = [s[: prefix(len(s), percent) + len(s) // 10] for s in sets]
                of = np.repeat(np.arange(len(sets)), [len(x) for x in low])
                tokens = np.concatenate(low)
                order = np.argsort(tokens, kind="stable")
                tokens, of = tokens[order], of[order]
                fresh = np.ones(len(tokens), bool)
                fresh[1:] = tokens[1:] != tokens[:-1]
                alone = fresh.copy()
                alone[:-1] &= fresh[1:]
                own_token, shared = met.meet(tokens[fresh], ~alone[fresh])
                alone &= own_token[np.cumsum(fresh) - 1]
                local = np.bincount(of[~alone], minlength=len(sets))
                # in the texts' order again, so that neighbouring rows share most of their bytes
                rank = np.argsort(of[alone], kind="stable")
                single, owner = tokens[alone][rank], of[alone][rank]
                several = tokens[fresh][shared]
                own = ids.slice(first, len(sets))
                docs = pa.chunked_array([own.take(pa.array(owner)), pa.nulls(len(several), own.type), own]).combine_chunks()
                keys = pa.chunked_array([pa.array(np.concatenate([single, several])), pa.array(mixed(own.to_numpy().view(_U)).view(np.int64))]).combine_chunks()
                weight = np.concatenate([np.ones(len(single), np.int64), np.zeros(len(several), np.int64), ((sizes + 1) << 32) + local])
                prints = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
                marks = [pa.chunked_array([pa.nulls(len(keys) - len(sets), pa.int64()), pa.array(prints[:, k])]).combine_chunks() for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([keys, docs, pa.array(weight), *marks], ["token", "doc_id", "weight", "hi", "lo"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, raw in text_blocks(batch, "text", BYTES):
                sets = shingle_sets(raw, offsets, words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                own = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), values], ["doc_id", "n", "tokens"])

    return run


class Node:
    """A node of a signature tree: positions of its sets, bitmap planes as counts, sizes, children."""

    __slots__ = ("children", "high", "low", "members", "planes")

    def __init__(self, members: np.ndarray, planes: np.ndarray, low: int, high: int, children: list[Node]) -> None:
        self.members, self.planes, self.low, self.high, self.children = members, planes, low, high, children


def planes_of(tokens: np.ndarray) -> np.ndarray:
    """Bit m of place p is set if over m of the set's tokens fall there; kept as the number of such bits, in the least type that holds all."""
    counts = np.bincount((tokens.view(_U) >> _U(20)).astype(np.int64) % PLANE, minlength=PLANE)
    return counts.astype(np.min_scalar_type(int(counts.max())))


def build_tree(sets: list[np.ndarray], members: np.ndarray, planes: np.ndarray) -> Node:
    """Pack sets, in the order given, into leaves and leaves into parents, ORing their bitmaps."""
    sizes = np.array([len(s) for s in sets])
    level = []
    for k in range(0, len(members), LEAF):
        own = members[k : k + LEAF]
        level.append(Node(own, planes[own].max(axis=0), int(sizes[own].min()), int(sizes[own].max()), []))
    while len(level) > 1:
        level = [
            Node(np.concatenate([x.members for x in part]), np.max([x.planes for x in part], axis=0), min(x.low for x in part), max(x.high for x in part), part)
            for part in (level[k : k + FANOUT] for k in range(0, len(level), FANOUT))
        ]
    return level[0]


def may_link(overlap, low_a, high_a, low_b, high_b, percent: int):
    """Whether sets of these sizes with an overlap of at most that much can reach the threshold."""
    most = np.minimum(np.minimum(overlap, high_a), high_b)
    return (100 * most >= percent * (low_a + low_b - most)) & (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of common bits, over all planes."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def tree_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Links of sets of ``left`` (with ``right``, or among themselves): all, or as a forest that joins the same."""
    own = {int(n): planes_of(sets[n]) for n in (left if right is None else np.concatenate([left, right]))}
    planes = np.zeros((len(sets), PLANE), np.result_type(np.uint8, *{p.dtype for p in own.values()}))
    for n, p in own.items():
        planes[n] = p
    sizes = np.array([len(s) for s in sets])
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    a = build_tree(sets, left, planes)
    stack = [(a, a if right is None else build_tree(sets, right, planes))]
    while stack:
        x, y = stack.pop()
        if not may_link(overlap_bound(x.planes, y.planes), x.low, x.high, y.low, y.high, percent):
            continue
        if x.children or y.children:
            if x is y:
                stack += [(p, q) for k, p in enumerate(x.children) for q in x.children[k:]]
            elif x.children and (len(x.members) >= len(y.members) or not y.children):
                stack += [(p, y) for p in x.children]
            else:
                stack += [(x, q) for q in y.children]
            continue
        i, j = x.members, y.members
        bound = overlap_bound(planes[i][:, None, :], planes[j][None, :, :])
        fits = may_link(bound, sizes[i][:, None], sizes[i][:, None], sizes[j][None, :], sizes[j][None, :], percent)
        for p, q in zip(*np.nonzero(fits), strict=True):
            u, v = int(i[p]), int(j[q])
            if x is y and u >= v:
                continue
            ru, rv = root(u), root(v)
            if ru == rv and not every:
                continue
            both = common(sets[u], sets[v])
            if 100 * both >= percent * (len(sets[u]) + len(sets[v]) - both):
                parent[ru] = rv
                links.append((u, v))
    return links


def _join_groups(percent: int, every: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("comp", "ascending"), ("low", "ascending"), ("doc_id", "ascending")])
        ids = table.column("doc_id").to_numpy()
        comp, part, x, y = (table.column(c).to_numpy() for c in ("comp", "part", "x", "y"))
        lists = table.column("tokens").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        out = []
        for c in np.unique(comp):
            rows = np.flatnonzero(comp == c)
            own = rows[part[rows] == x[rows]]
            if x[rows[0]] == y[rows[0]]:
                pairs = [(own, None)]
            else:
                pairs = [(own, rows[part[rows] == y[rows]])]
            for left, right in pairs:
                if len(left) and (right is None or len(right)):
                    out += tree_links(sets, left, right, percent, every)
        u, v = (np.array([ids[p[k]] for p in out], np.int64) for k in (0, 1))
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return run


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of distinct
    shingles of ``words`` words, A-Z lower-cased. A text with fewer words is one shingle; without
    words, or null, its set is empty, and it links with nothing. component_id is the smallest doc_id
    reachable over links, the document's own included. Equal sets meet once, as one class.

    Rows that repeat a doc_id are documents of their own, and so are rows without one; these link
    like others, and where nothing with an id is reached, component_id is null. An empty table gives
    an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 or doc_id is null").isEmpty():
        return join_rows(rows, words, percent)
    # ids that are no keys: rows are joined by keys of their own
    keyed, _ = with_rows(rows)
    joined = materialise(join_rows(keyed.select(F.col(ROW).alias("doc_id"), "text"), words, percent).withColumnRenamed("doc_id", ROW).join(keyed.select(ROW, "doc_id"), ROW), "joined-rows")
    least = joined.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    met = joined.join(least.withColumn("known", F.lit(True)), "component_id", "left")
    return met.select("doc_id", "n_shingles", F.when(F.col("known"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def join_rows(rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """jaccard_join() of rows (doc_id, text) whose ids are distinct and not null."""
    stats, classes, links = _classes_and_links(rows, words, percent, every=False)
    joined = components(links.select("u", "v").unionByName(_members(stats, classes)), "u", "v")
    out = stats.join(joined, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_links(rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links, not only what joins components: (u, v) of classes of equal sets, and (doc_id, rep, n_links) of documents.

    rows: (doc_id, text) with distinct ids. A class goes by its smallest doc_id. n_links counts the
    documents that a document links with, those of its own class and of all classes linked with it.
    Documents with an empty set link with nothing and are their own class.
    """
    stats, classes, links = _classes_and_links(rows, words, percent, every=True)
    sized = classes.select("rep", "copies")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = both.join(sized, F.col("v") == F.col("rep")).groupBy("u").agg(F.sum("copies").alias("others"))
    rep = stats.join(classes.select("hi", "lo", "n", "rep", "copies"), ["hi", "lo", "n"], "left").join(others, F.col("rep") == F.col("u"), "left")
    return links, rep.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"))


def _members(stats: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): documents of a class of several and the class's smallest."""
    several = classes.filter("copies > 1").select("hi", "lo", "n", "rep")
    return stats.filter("n > 0").join(several, ["hi", "lo", "n"]).filter("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def _classes_and_links(rows: DataFrame, words: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set sizes by document, classes of equal sets, and links between classes, all or as many as join them."""
    rows = rows.select("doc_id", "text")
    emitted = rows.mapInArrow(_emit(words, percent), "token long, doc_id long, weight long, hi long, lo long")
    counted = emitted.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("weight > 0")
    is_own, size = F.col("weight") >= OWN, F.shiftright("weight", 32) - 1
    own = lambda c: F.max(F.when(is_own, c))
    widest = own(F.struct(size.alias("n"), "hi", "lo"))
    stats = counted.filter(is_own | (F.col("k") > 1)).groupBy("doc_id").agg(
        widest["n"].alias("n"), widest["hi"].alias("hi"), widest["lo"].alias("lo"),
        F.sum(F.when(is_own, F.col("weight").bitwiseAND(F.lit(OWN - 1))).otherwise(1)).alias("shared"),
    )
    stats = materialise(stats, "shingle-counts")
    # equal sets are one class, known by its smallest doc_id
    classes = stats.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "shingle-classes")
    wanted = F.greatest(F.lit(1), F.floor(F.col("n") / 10) - 1)
    open_ = classes.filter(F.col("shared") >= wanted).select(F.col("rep").alias("doc_id"), "n")
    # what grows with the data is never broadcast: the plan stays the same at every size
    found = rows.join(open_.hint("merge"), "doc_id").select("doc_id", "n", "text")
    lists = found.mapInArrow(_sets(words), "doc_id long, n long, tokens array<long>")
    reps = materialise(lists.filter(F.size("tokens") == F.col("n")), "shingle-sets")
    # token lists are the large tables here; they go as soon as links are found
    with temporary_tables("links"):
        near = components(candidate_links(reps, percent), "doc_id", "pivot")
    with temporary_tables("links-found"):
        links = exact_links(reps, near, percent, every)
    release(reps)
    return stats, classes, links


def candidate_links(reps: DataFrame, percent: int) -> DataFrame:
    """(doc_id, pivot): sets that share a token of their rarest-first prefixes are joined through one of them."""
    tokens = reps.select("doc_id", "n", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = tokens.join(often.hint("merge"), "token")
    per_set = Window.partitionBy("doc_id")
    # tokens that no other set has come first and need not be listed
    rank = F.row_number().over(per_set.orderBy("df", "token")) + F.col("n") - F.count(F.lit(1)).over(per_set)
    least = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    pre = materialise(shared.withColumn("rank", rank).filter(F.col("rank") <= least + 1).select("doc_id", "token"), "prefixes")
    first = pre.groupBy("token").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).filter("pivot != last")
    return pre.join(first.select("token", "pivot"), "token").filter("doc_id != pivot").select("doc_id", "pivot").distinct()


def exact_links(reps: DataFrame, near: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """(u, v): links within each candidate component; with ``every`` all of them, otherwise as many as join all that link."""
    sizes = near.join(reps.select("doc_id", "n"), F.col("doc_id") == F.col("node")).groupBy("component")
    sized = sizes.agg(((F.count(F.lit(1)) > BLOCK) | (F.sum("n") > TOKENS)).alias("large"))
    placed = reps.join(near.join(sized, "component"), F.col("doc_id") == F.col("node")).select("doc_id", "n", "tokens", F.col("component").alias("comp"), "large")
    placed = materialise(placed.withColumn("low", F.col("tokens")[0]), "candidates")
    shape = "u long, v long"
    # small components: several to a group
    small = placed.filter(~F.col("large"))
    count, total = small.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, -(-count // BLOCK), -(-total // TOKENS))
    zero = F.lit(0).cast("long")
    small = small.select("doc_id", "comp", "low", "tokens", zero.alias("part"), zero.alias("x"), zero.alias("y"), F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("key"))
    links = small.groupBy("key").applyInArrow(_join_groups(percent, every), shape)
    large = placed.filter("large")
    if large.isEmpty():
        return materialise(links, "links-found")
    pivots = large.filter("doc_id = comp").select("comp", F.col("tokens").alias("pivot_tokens"))
    both = F.size(F.array_intersect("tokens", "pivot_tokens"))
    meets = F.lit(not every) & (100 * both >= percent * (F.col("n") + F.size("pivot_tokens") - both)) & (F.col("doc_id") != F.col("comp"))
    tried = large.join(pivots, "comp").withColumn("settled", meets | (F.lit(not every) & (F.col("doc_id") == F.col("comp")))).drop("pivot_tokens")
    tried = materialise(tried, "pivoted")
    settled = tried.filter("settled and doc_id != comp").select(F.col("doc_id").alias("u"), F.col("comp").alias("v"))
    # blocks, of so many sets and tokens at most, of those not settled come first, each by size; a pair of blocks is a task if one is
    # such and their sizes allow a link
    dealt = tried.select("doc_id", "comp", "settled", "n", "low")
    unit = F.struct("settled", "n", leading_bits(F.col("low"), unit_bits(tried.count())).alias("bits"))
    dealt = running_sums(dealt, ["comp"], unit, [F.col("low"), F.col("doc_id")], {"rank": F.lit(1), "before": F.col("n")})
    dealt = materialise(dealt.withColumn("part", (F.floor(F.col("rank") / BLOCK) + F.floor(F.col("before") / TOKENS)).cast("long")), "blocks-dealt")
    nodes = dealt.groupBy("comp", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("settled").alias("settled"), (F.count(F.lit(1)) > 1).alias("several"))
    end = nodes.groupBy("comp").agg(F.max("part").alias("end"))
    first = nodes.join(end, "comp").withColumn("y", F.explode(F.sequence("part", "end"))).select("comp", F.col("part").alias("x"), "y", F.col("least").alias("l"), F.col("most").alias("m"), F.col("settled").alias("s"), F.col("several").alias("inner"))
    met = first.join(nodes, (first["comp"] == nodes["comp"]) & (first["y"] == nodes["part"])).drop(nodes["comp"])
    met = met.filter((F.col("inner") | (F.col("x") != F.col("y"))) & ~(F.col("s") & F.col("settled")) & (100 * F.col("most") >= percent * F.col("l")) & (100 * F.col("m") >= percent * F.col("least")))
    sides = met.select("comp", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("part"))
    met = dealt.select("doc_id", "comp", "part").join(sides, ["comp", "part"])
    tasks = met.join(large.select("doc_id", "comp", "low", "tokens"), ["doc_id", "comp"])
    tasks = tasks.withColumn("key", F.concat_ws("-", "comp", "x", "y"))
    wide = tasks.groupBy("key").applyInArrow(_join_groups(percent, every), shape)
    return materialise(links.unionByName(wide).unionByName(settled), "links-found")
