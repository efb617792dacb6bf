"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other, and so do their
projections on any orthonormal axes. Vectors are sorted by the cells, eps wide, that they fall into
on the leading principal axes; the sequence is cut into blocks with bounding boxes. Intervals of
blocks are joined from the top down, and a pair of intervals whose boxes are more than eps apart is
left out with all below it. Boxes have one more dimension, the length of what the axes leave of a
vector: two such lengths differ by no more than the vectors do. What remains are pairs of blocks; a
task takes the pairs of two runs of blocks, so a block travels once a run, not once a pair, and
joins them by the same recursion down to small dense products in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import materialise, running_sums
from logwarden.llm.components import components

AXES, BLOCK, LEAF, FANOUT, TOP = 8, 1024, 64, 8, 16
#: Most blocks of a run, and bytes of one.
RUN, RUN_BYTES = 16, 16 << 20
#: Added to eps: rounding must not hide a pair.
SLACK = 1e-7


def unit_rows(vectors: pd.Series, dims: int) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), dims))
    for n, v in enumerate(vectors):
        out[n, : len(v)] = v
    if len(out):
        # dividing by the largest component first keeps the squares from over- or underflowing
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def principal_axes(vectors: DataFrame, dims: int, axes: int) -> np.ndarray:
    """The leading eigenvectors of the covariance of all unit vectors; the driver gets dims squared sums."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, total, n = np.zeros((dims, dims)), np.zeros(dims), 0
        for frame in frames:
            x = unit_rows(frame["embedding"], dims)
            gram, total, n = gram + x.T @ x, total + x.sum(axis=0), n + len(x)
        if n:
            i, j = np.divmod(np.arange(dims * dims), dims)
            yield pd.DataFrame({"i": i, "j": j, "v": gram.ravel()})
            yield pd.DataFrame({"i": np.full(dims, -1), "j": np.arange(dims), "v": total})
            yield pd.DataFrame({"i": [-2], "j": [0], "v": [float(n)]})

    rows = vectors.select("embedding").mapInPandas(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    n = rows.v[rows.i == -2].sum()
    mean = rows[rows.i == -1].sort_values("j").v.to_numpy() / n
    gram = rows[rows.i >= 0].sort_values(["i", "j"]).v.to_numpy().reshape(dims, dims) / n
    _, found = np.linalg.eigh(gram - np.outer(mean, mean))
    return found[:, ::-1][:, :axes].copy()


def apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """The least squared distance between points of two boxes."""
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((gap * gap).sum())


def places(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Projections on the axes, and last the length of what they leave; distances between rows are lower bounds of those of the vectors."""
    on = units @ axes
    return np.column_stack([on, np.sqrt(np.maximum(0.0, 1.0 - (on * on).sum(axis=1)))])


class Interval:
    """A run of a block's vectors with the box of their places; halves are made when asked for."""

    __slots__ = ("end", "hi", "lo", "of", "start")

    def __init__(self, of: Block, start: int, end: int) -> None:
        self.of, self.start, self.end = of, start, end
        p = of.places[start:end]
        self.lo, self.hi = p.min(axis=0), p.max(axis=0)

    def halves(self) -> list[Interval]:
        middle = (self.start + self.end) // 2
        return [Interval(self.of, self.start, middle), Interval(self.of, middle, self.end)]


class Block:
    """A block: unit vectors in grid order and their projections."""

    __slots__ = ("places", "units")

    def __init__(self, units: np.ndarray, axes: np.ndarray) -> None:
        self.units, self.places = units, places(units, axes)


def ego_join(a: Interval, b: Interval, eps: float, cosine: float, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Add the positions of linked pairs of two intervals, of one block (then i < j) or of two."""
    if apart(a.lo, a.hi, b.lo, b.hi) > (eps + SLACK) ** 2:
        return
    na, nb = a.end - a.start, b.end - b.start
    if max(na, nb) <= LEAF:
        i, j = np.nonzero(a.of.units[a.start : a.end] @ b.of.units[b.start : b.end].T >= cosine)
        i, j = i + a.start, j + b.start
        if a.of is b.of:
            i, j = i[i < j], j[i < j]
        if len(i):
            found.append((i, j))
    elif a.of is b.of and a.start == b.start:
        left, right = a.halves()
        for x, y in ((left, left), (left, right), (right, right)):
            ego_join(x, y, eps, cosine, found)
    elif na >= nb:
        for x in a.halves():
            ego_join(x, b, eps, cosine, found)
    else:
        for y in b.halves():
            ego_join(a, y, eps, cosine, found)


def roots_of(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position that each position reaches over links (i, j)."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, block_rows: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors with a cosine of at least ``cosine``; component_id is the
    smallest vec_id reachable over links, the vector's own included; kept says that it is its own.
    Vectors that are null or zero or hold null or non-finite components link with nothing. A vector
    shorter than the longest is filled up with zeros. Equal vectors are joined once, as one with a
    multiplicity. A null vec_id counts as a link of others but gets no component and isn't kept;
    vec_id is assumed unique, and rows that repeat one share its component. An empty table gives an
    empty result. Other columns, labels included, are ignored.
    """
    rows = vectors.select("vec_id", "embedding")
    good = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    valid = rows.filter(good)
    dims = valid.agg(F.max(F.size("embedding"))).first()[0]
    if dims is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    groups = valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = materialise(groups, "vectors")
    axes = principal_axes(groups, dims, min(AXES, dims))
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    k = axes.shape[1]

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.floor(unit_rows(frame["embedding"], dims) @ axes / max(eps, 1e-3)).astype(np.int32)
            yield frame.assign(**{f"c{n}": at[:, n] for n in range(k)})

    grid = groups.select("rep", "copies", "embedding").mapInPandas(
        cells, "rep long, copies long, embedding array<double>, " + ", ".join(f"c{n} int" for n in range(k))
    )
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [f"c{n}" for n in range(k)] + ["rep"]

    def to_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, count = TaskContext.get().partitionId(), None, 0

        def block(frame: pd.DataFrame) -> pd.DataFrame:
            x = unit_rows(frame["embedding"], dims)
            p = places(x, axes)
            out = {"part": part, "no": count, "reps": [frame["rep"].fillna(-(1 << 63)).astype("int64").tolist()], "copies": [frame["copies"].tolist()], "vectors": x.tobytes()}
            return pd.DataFrame(out | {f"lo{n}": p[:, n].min() for n in range(k + 1)} | {f"hi{n}": p[:, n].max() for n in range(k + 1)})

        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            while len(held) >= block_rows:
                yield block(held[:block_rows])
                held, count = held[block_rows:], count + 1
        if held is not None and len(held):
            yield block(held)

    boxes = [f"{s}{n}" for n in range(k + 1) for s in ("lo", "hi")]
    blocks = grid.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(
        to_blocks, "part int, no long, reps array<long>, copies array<long>, vectors binary, " + ", ".join(f"{c} double" for c in boxes)
    )
    blocks = materialise(blocks, "blocks")
    seq = running_sums(blocks.select("part", "no", *boxes), [], F.col("part"), [F.col("no")], {"seq": F.lit(1)})
    seq = materialise(seq.withColumn("seq", F.col("seq").cast("long")), "block-boxes")
    pairs = _block_pairs(seq, k + 1, eps)

    # a task: two runs of blocks that follow each other in grid order, or one run with itself
    run = max(1, min(RUN, RUN_BYTES // (8 * dims * block_rows)))
    of = lambda c: F.floor(F.col(c) / run).cast("long").alias(f"run_{c}")
    needs = pairs.select(of("a"), of("b"), F.explode(F.array("a", "b")).alias("seq")).distinct()
    data = seq.select("part", "no", "seq").join(blocks.select("part", "no", "reps", "copies", "vectors"), ["part", "no"]).drop("part", "no")
    tasks = needs.join(data, "seq")

    def join_runs(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["seq"])
        blocks = [Block(np.frombuffer(x["vectors"]).reshape(-1, dims), axes) for x in rows]
        reps, copies = (np.concatenate([np.array(x[c]) for x in rows]) for c in ("reps", "copies"))
        starts = np.cumsum([0, *(len(b.units) for b in blocks)])
        left = [n for n, x in enumerate(rows) if x["seq"] // run == x["run_a"]]
        right = [n for n, x in enumerate(rows) if x["seq"] // run == x["run_b"]]
        tops = [Interval(b, 0, len(b.units)) for b in blocks]
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m, n in ((m, n) for m in left for n in right if m <= n):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            ego_join(tops[m], tops[n], eps, cosine, found)
            i += [x + starts[m] for x, _ in found]
            j += [x + starts[n] for _, x in found]
        i, j = np.concatenate(i), np.concatenate(j)
        links = np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))
        root, hit = roots_of(len(reps), i, j), np.flatnonzero(links)
        return pa.table({"rep": pa.array(reps[hit], pa.int64()), "links": pa.array(links[hit].astype(np.int64)), "mate": pa.array(reps[root[hit]], pa.int64())})

    linked = materialise(tasks.groupBy("run_a", "run_b").applyInArrow(join_runs, "rep long, links long, mate long"), "vector-links")
    none = F.lit(-(1 << 63))
    linked = linked.select(*[F.when(F.col(c) != none, F.col(c)).alias(c) for c in ("rep", "mate")], "links")
    joined = components(linked, "rep", "mate")
    totals = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    merged = groups.select("embedding", "rep", "copies").join(totals, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    merged = merged.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # rows without a valid vector meet nothing
    out = valid.join(merged, "embedding", "left").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _block_pairs(seq: DataFrame, k: int, eps: float) -> DataFrame:
    """(a, b), a <= b, of blocks whose boxes are within eps: intervals of blocks, from the top down."""
    last = seq.agg(F.max("seq")).first()[0]
    levels = [0]
    while (last >> levels[-1]) >= TOP:
        levels.append(levels[-1] + FANOUT.bit_length() - 1)
    box = [F.min(f"lo{n}").alias(f"lo{n}") for n in range(k)] + [F.max(f"hi{n}").alias(f"hi{n}") for n in range(k)]
    pairs = None
    for shift in reversed(levels):
        nodes = seq.groupBy(F.shiftright("seq", shift).alias("at")).agg(*box)
        a = nodes.select(F.col("at").alias("a"), *[F.col(f"{s}{n}").alias(f"a_{s}{n}") for n in range(k) for s in ("lo", "hi")])
        b = nodes.select(F.col("at").alias("b"), *[F.col(f"{s}{n}").alias(f"b_{s}{n}") for n in range(k) for s in ("lo", "hi")])
        if pairs is None:
            most = int(last >> shift)
            met = a.withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(most).cast("long"))))
        else:
            below = lambda c: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(FANOUT - 1).cast("long")), lambda x: F.col(c) * FANOUT + x))
            met = pairs.withColumn("x", below("a")).withColumn("y", below("b")).filter("x <= y").select(F.col("x").alias("a"), F.col("y").alias("b")).join(a, "a")
        gap = lambda n: F.greatest(F.lit(0.0), F.col(f"a_lo{n}") - F.col(f"b_hi{n}"), F.col(f"b_lo{n}") - F.col(f"a_hi{n}"))
        apart2 = sum((gap(n) * gap(n) for n in range(k)), F.lit(0.0))
        pairs = met.join(b, "b").filter(apart2 <= (eps + SLACK) ** 2).select("a", "b")
    return pairs
