"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight schedule over training time, 0 to 1, as straight lines between knots. The
schedule's integral is the source's share; the cumulative demand, inverted, says at which time a
source's words are due. Documents of a source follow each other in the order of a hash, over and
over while the target lasts, and each use gets the training position at which its middle word is
due. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import FEW_KEYS, WORD_PATTERN, broadcast_if_small, leading_bits, materialise, null_safe, running_sums, unit_bits

Schedule = list[tuple[float, float]]
#: Weights 1, 2 and 3: falling, level and rising over the run.
SCHEDULES: list[Schedule] = [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 1.5), (1.0, 4.5)]]


def integrals(schedule: Schedule) -> list[float]:
    """The schedule's integral up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("knots must rise in time and weights must not be negative")
        out.append(out[-1] + (w0 + w1) / 2 * (t1 - t0))
    if out[-1] <= 0:
        raise ValueError("a schedule needs some weight")
    return out


def due_at(schedule: Schedule, share: Column) -> Column:
    """The time by which this share (0 to 1) of the schedule's integral is reached."""
    sums = integrals(schedule)
    wanted = share * sums[-1]
    out = F.lit(float(schedule[-1][0]))
    for k in range(len(schedule) - 2, -1, -1):
        (t0, w0), (t1, w1) = schedule[k], schedule[k + 1]
        rest, slope = wanted - sums[k], (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))
        step = F.when(rest <= 0, F.lit(0.0)).otherwise(rest * 2 / (root + w0))
        out = F.when(wanted <= sums[k + 1], F.least(step + t0, F.lit(t1))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, schedules: list[Schedule], most_uses: int) -> DataFrame:
    """(source, source_size, schedule, target): shares by weight, none above ``most_uses`` times its source.

    Raising one common level until the targets fill the total caps sources in the order of
    cap / weight; the windows run over one row a source.
    """
    weights = F.array(*[F.lit(integrals(s)[-1]) for s in schedules])
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "schedule", F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(schedules)))
    )
    full = ranked.withColumn("w", weights[F.col("schedule")]).withColumn("cap", F.col("source_size") * float(most_uses))
    every = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(0))
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    flagged = full.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") > F.col("level"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"]
    target = F.least("cap", F.coalesce(first * F.col("w"), F.col("cap")))
    return flagged.withColumn("target", target).select("source", "source_size", "schedule", "target")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


#: What gives a document its place in the order of its source.
PLACE = ("h", "doc_id", "size", "mark")


def _used(sizes: DataFrame, schedules: list[Schedule], most_uses: int, seed: int) -> DataFrame:
    """Documents (doc_id, source, size, mark) with their places in their source's order and how often they are used; see mix()."""
    base = materialise(sizes.select("doc_id", "source", "size", "mark", F.xxhash64("doc_id", "size", F.lit(seed)).alias("h")), "mix-sizes")
    targets = materialise(source_targets(base, schedules, most_uses), "mix-targets")
    unit, order = leading_bits(F.col("h"), unit_bits(base.count())), [F.col(c) for c in PLACE]
    placed = running_sums(base, ["source"], unit, order, {"start": F.col("size")})
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_uses))).otherwise(0).cast("long")
    placed = null_safe(placed, targets, ["source"]).withColumn("full", full)
    placed = placed.withColumn("rest", F.when(F.col("full") < most_uses, F.col("target") - F.col("full") * F.col("source_size")).otherwise(0.0))
    fits = (F.col("start") + F.col("size") <= F.col("rest")) & (F.col("rest") > 0)
    placed = materialise(placed.withColumn("fits", fits), "mix-placed")
    # what a long document at the cut leaves open is filled from the shorter ones behind it, then by the nearest
    left = lambda df, was, took: df.groupBy("source").agg((F.max(was) - F.sum(F.when(F.col(took), F.col("size")).otherwise(0))).alias(f"left_{took}"))
    behind = null_safe(placed, left(placed, "rest", "fits"), ["source"]).withColumn("more", ~F.col("fits") & (F.col("size") > 0) & (F.col("size") <= F.col("left_fits")))
    filled = running_sums(behind.filter("more"), ["source"], unit, order, {"start_more": F.col("size")})
    filled = filled.withColumn("fills", F.col("start_more") + F.col("size") <= F.col("left_fits"))
    others = behind.filter("not more").withColumn("start_more", F.lit(0).cast("long")).withColumn("fills", F.lit(False))
    placed = materialise(filled.unionByName(others), "mix-filled")
    placed = null_safe(placed, left(placed, "left_fits", "fills"), ["source"])
    nearest = F.struct(F.abs(F.col("size") - F.col("left_fills")).alias("off"), F.col("start"))
    offered = placed.filter((F.col("rest") > 0) & (F.col("size") > 0) & ~F.col("fits") & ~F.col("fills") & (nearest["off"] < F.col("left_fills")))
    extra = offered.groupBy("source").agg(F.min(nearest)["start"].alias("extra_start"))
    used = null_safe(placed, extra, ["source"], "left")
    is_extra = F.coalesce(~F.col("fits") & ~F.col("fills") & (F.col("size") > 0) & (F.col("start") == F.col("extra_start")), F.lit(False))
    return used.withColumn("late", F.col("fills") | is_extra).withColumn("uses", F.col("full") + F.when(F.col("fits") | F.col("late"), 1).otherwise(0))


def mix(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, most_uses: int = 3, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, uses, positions, first_position.

    Size is the number of words. ``uses`` says how often the mix takes the document, ``taken`` is
    uses times size, ``positions`` holds a training time (0 to 1) for each use. A source's uses go
    in hash order; after the last whole document that fits its target one more is used where that
    comes nearer to it, the one whose size is nearest to what is missing. Rows come sorted by first
    position (a range sort), unused ones last.

    Sources go by code point, null last, and take the schedules in turn. A null text has size 0; a
    document without words is used zero words' worth: its taken is 0 and it takes the uses of its
    place. Repeated rows are documents of their own. An empty table gives an empty result. Other
    columns of ``docs`` are ignored.
    """
    used = _used(docs.select("doc_id", "source", word_count().alias("size"), F.lit(0).cast("long").alias("mark")), schedules, most_uses, seed)
    # where the document's words stand in its last use, among the source's words of that round
    last_start = F.when(F.col("fits"), F.col("start")).when(F.col("fills"), F.col("rest") - F.col("left_fits") + F.col("start_more")).otherwise(F.col("rest") - F.col("left_fills"))
    middle = lambda k: F.least((k * F.col("source_size") + F.when(k == F.col("full"), last_start).otherwise(F.col("start")) + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))

    def place(k: Column) -> Column:
        out = F.lit(None).cast("double")
        for n, schedule in enumerate(schedules):
            out = F.when(F.col("schedule") == n, due_at(schedule, middle(k))).otherwise(out)
        return out

    positions = F.when(F.col("uses") > 0, F.transform(F.sequence(F.lit(0), F.col("uses") - 1), place)).otherwise(F.array().cast("array<double>"))
    out = used.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("uses") * F.col("size")).alias("taken"), "uses", positions.alias("positions")
    ).withColumn("first_position", F.element_at(F.when(F.size("positions") > 0, F.col("positions")), 1))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """Every use of every document in training order: doc_id, use, position; range-sorted by position."""
    return mixed.select("doc_id", F.posexplode("positions").alias("use", "position")).orderBy("position", "doc_id", "use")


def apply_mix(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, most_uses: int = 3, seed: int = 11) -> DataFrame:
    """The documents that the mix takes, each repeated as often as it is used, with the columns of ``docs``.

    A source's uses are told by one row: the whole rounds, and the place in the order of the hash up
    to which its documents are used once more. The few taken behind that place are listed. Both
    meet the documents where these are read, by broadcast while they are small; then no text moves.
    Each row is a document, as in mix(). Places tell rows apart by all their columns (but for maps),
    so only rows that are alike throughout share one; where the mix takes some of these once more
    and not the others, one stands for all and is repeated as often as they are taken together.
    Columns of ``docs`` may have any names.
    """
    hashed = [F.col(f"doc.`{f.name}`") for f in docs.schema.fields if not f.dataType.simpleString().count("map<")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.col("doc.source").alias("source"), F.col("doc.doc_id").alias("doc_id"), word_count("doc.text").alias("size"), F.xxhash64(*hashed).alias("mark"))
    used = _used(rows.drop("doc"), schedules, most_uses, seed).withColumn("more", F.col("fits") | F.col("late"))
    used = materialise(used.select("source", *PLACE, "full", "fits", "late", "more"), "mix-uses")
    place = F.struct(*PLACE)
    shared = used.groupBy("source", *PLACE).agg(F.sum("full").cast("long").alias("rounds"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("more").cast("long")).alias("taken"))
    shared = materialise(shared.filter("taken > 0 and taken < rows").select(F.col("source").alias("shared_source"), place.alias("shared_place"), (F.col("rounds") + F.col("taken")).alias("shared_uses")), "mix-shared")
    rules = used.groupBy(F.col("source").alias("rule_source")).agg(F.max("full").alias("full"), F.max(F.when(F.col("fits"), place)).alias("cut"))
    late = used.filter("late").select(F.col("source").alias("late_source"), place.alias("late_place")).distinct().withColumn("late", F.lit(True))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("place", place)
    same = lambda name: F.col("source").eqNullSafe(F.col(f"{name}_source")) & F.col("place").eqNullSafe(F.col(f"{name}_place"))
    some = not shared.isEmpty()
    single = rows.join(F.broadcast(shared), same("shared"), "left_anti") if some else rows
    met = single.join(broadcast_if_small(rules, "mix-rules", FEW_KEYS // 4), F.col("source").eqNullSafe(F.col("rule_source")))
    met = met.join(broadcast_if_small(late, "mix-late", FEW_KEYS // 4), same("late"), "left")
    once_more = F.coalesce(F.col("place") <= F.col("cut"), F.lit(False)) | F.coalesce("late", F.lit(False))
    out = met.select("doc", (F.col("full") + once_more.cast("int")).cast("long").alias("uses"))
    if some:
        alike = rows.join(F.broadcast(shared), same("shared")).dropDuplicates(["source", *PLACE])
        out = out.unionByName(alike.select("doc", F.col("shared_uses").alias("uses")))
    return out.filter("uses > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses")))).select("doc.*")
