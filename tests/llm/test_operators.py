"""Training-data operators against brute force on small tables, and the cases that their docstrings define."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import components, embedding_dedup, exact_dedup, fixity, jaccard_join, language, mixing, packing, pii, sharding, token_counts
from logwarden.llm.common import materialise
from logwarden.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=True):
    """rows: (doc_id, text, source). Extra columns have the names that operators make."""
    frame = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS)
    for name in ("size", "shard", "slot", "rank", "uses", "kept", "n", "token", "h", "piece", "length", "sequence_id", "group", "component") if extra else ():
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def sample_rows(seed=0, n=120):
    rng = random.Random(seed)
    rows = [(k, words(rng, rng.choice([0, 1, 3, 4, 5, 8, 30, 120])), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}") for k in range(n)]
    rows += [(1000, None, None), (1001, "", "s1"), (1002, rows[7][1].upper(), "s2"), (1003, rows[7][1], None), (1004, words(rng, 9000), "s5"), (1005, "   \t\n", "s0")]
    return rows


# --- components ----------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(200, 260)] + [(None, 3), (5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- 1 mixing ------------------------------------------------------------------------------------


def expected_targets(rows):
    size = lambda t: len([w for w in (t or "").split() if w])
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and rest * weight[s] / share > 3 * total[s]}
        if not new:
            return total, {s: 3 * total[s] if s in capped else rest * weight[s] / share for s in order}
        capped |= new


@pytest.mark.parametrize("seed", [0, 1])
def test_mix(spark, seed):
    rows = sample_rows(seed)
    total, target = expected_targets(rows)
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["uses"] * r["size"] <= 3 * r["size"] and len(r["positions"]) == r["uses"]
        assert list(r["positions"]) == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        largest = max(len((x or "").split()) for _, x, y in rows if y == s)
        assert abs(taken[s] - t) <= max(1, largest / 2)
    assert [r["first_position"] for r in got] == sorted([r["first_position"] for r in got], key=lambda p: (p is None, p))
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_curriculum_is_inverted():
    for schedule in mixing.SCHEDULES:
        assert mixing.integrals(schedule)[0] == 0
    assert [mixing.integrals(s)[-1] for s in mixing.SCHEDULES] == [1, 2, 3]
    with pytest.raises(ValueError):
        mixing.integrals([(0, 1), (0, 1)])


def test_due_times_follow_the_schedule(spark):
    schedule = [(0.0, 0.0), (0.25, 2.0), (1.0, 1.0)]
    rows = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", mixing.due_at(schedule, F.col("u")).alias("t")).collect()
    total = mixing.integrals(schedule)[-1]
    for r in rows:
        t = r["t"]
        done = 4 * t * t if t <= 0.25 else 0.25 + 2 * (t - 0.25) - (t - 0.25) ** 2 * (1 / 0.75) / 2
        assert done / total == pytest.approx(r["u"], abs=1e-9)


def test_mix_empty_and_repeated(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    same = mixing.mix(docs(spark, [(1, "a b c", "x")] * 4 + [(None, None, None)])).collect()
    assert len(same) == 5 and sum(r["taken"] for r in same) <= 3 * 12
    kept = mixing.apply_mix(docs(spark, sample_rows(), extra=False))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def taken_by(frame):
    """Words by source, and how often each text is there."""
    words_of, uses = collections.Counter(), collections.Counter()
    for r in frame.collect():
        words_of[r["source"]] += len((r["text"] or "").split())
        uses[r["source"], r["doc_id"], r["text"]] += 1
    return words_of, uses


@pytest.mark.parametrize("kind", ["sample", "alike", "no ids", "same ids"])
def test_apply_mix_takes_what_the_mix_takes(spark, kind):
    """Word for word by source, with rows that share all columns, an id and a size, or only a size."""
    rows = {
        "sample": sample_rows(3),
        "alike": [(1, "a b c", "x")] * 601 + [(k, "w " * (k % 9), "y") for k in range(300)],
        "no ids": [(None, f"a{k} b c", "x") for k in range(601)] + [(None, "d " * (k % 4), "y") for k in range(400)],
        "same ids": [(k % 7, f"t{k} " * (k % 3 + 1), f"s{k % 2}") for k in range(500)] + [(1, "one two", "s2")] * 50,
    }[kind]
    frame = docs(spark, rows)
    taken = collections.Counter()
    for r in mixing.mix(frame).collect():
        taken[r["source"]] += r["taken"]
    made = mixing.apply_mix(frame)
    assert made.columns == frame.columns
    got, uses = taken_by(made)
    assert {s: n for s, n in got.items() if n} == {s: n for s, n in taken.items() if n}
    held = collections.Counter((s, d, t) for d, t, s in rows)
    assert all(n <= 3 * held[k] for k, n in uses.items())
    assert taken_by(mixing.apply_mix(frame.repartition(5))) == (got, uses)


def test_tables_with_any_column_names(spark):
    """Columns named like those that operators make, with dots, or like row keys come back as they were."""
    names = ["__row", "__row_", "a.b", "__size", "__place", "__uses", "__full", "__n", "place", "mark", "full", "late", "cut", "doc", "h", "size", "source_size", "group", "count", "Text2"]
    rows = [(k, f"einige worte {k % 5} und mehr text", "s") for k in range(40)] + [(None, None, None), (3, "", "s")]
    frame = docs(spark, rows, extra=False).select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    for made in (mixing.apply_mix(frame), exact_dedup.drop_copies(frame), language.keep_identified(frame)):
        assert made.columns == frame.columns
        found = made.collect()
        assert found and all(r[n] == f"{n}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in found for n in names)


# --- 2 exact dedup -------------------------------------------------------------------------------


def test_exact_dedup(spark):
    rows = sample_rows() + [(2000, "x" * 200_000, "s"), (2001, "X" * 200_000, "s"), (2002, "x" * 199_999, "s"), (None, "only", "s")]
    got = {(r["doc_id"]): r for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = collections.defaultdict(list)
    for d, t, _ in rows:
        groups[fold(t)].append(d)
    for d, t, _ in rows:
        own, r = groups[fold(t)], got[d]
        keep = max((x for x in own if x is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), d == keep)
        assert r["text_sha256"] == hashlib.sha256(fold(t).encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    kept = exact_dedup.drop_copies(docs(spark, rows, extra=False))
    assert kept.count() == len(groups)


def test_drop_copies_decides_by_row(spark):
    rows = [(None, "Twice", "a"), (7, "twice", "b"), (None, "null only", "c"), (None, "null only", "d"), (None, "single", "e"), (5, "one", "f"), (5, "one", "g"), (5, "other", "h"), (7, "ONE", "i")]
    got = exact_dedup.drop_copies(docs(spark, rows, extra=False))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = collections.Counter((r["doc_id"], r["text"].lower()) for r in got.collect())
    assert found == collections.Counter([(7, "twice"), (None, "null only"), (None, "single"), (5, "other"), (7, "one")])


def test_chunks_round_trip_and_follow_content():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 60_000).astype(np.uint8)
    texts = [body, np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), body])]
    cut = [next(exact_dedup.chunks(t, np.array([0, len(t)])))[1] for t in texts]
    assert [b"".join(c) for c in cut] == [t.tobytes() for t in texts]
    assert len(set(cut[0]) & set(cut[1])) >= len(cut[0]) - 3
    assert all(len(c) <= exact_dedup.MOST for c in cut[0])


def test_fingerprint_clash(spark, monkeypatch):
    rows = docs(spark, [(1, "aaa", "s"), (2, "AAA", "s"), (3, "bbb", "s"), (4, "ccc", "s")])
    clashes = spark.createDataFrame([(exact_dedup.fingerprint(b"aaa"),)], "fingerprint long")
    monkeypatch.setattr(exact_dedup, "shared_fingerprints", lambda _: clashes)
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4}


# --- 3 embeddings --------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [16, 1024])
def test_embedding_dedup(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + 0.18 * rng.normal(size=(20, 8)) for c in centres] + [rng.normal(size=(60, 8))]).astype(np.float32)
    x[5], x[6], x[7] = x[4], x[4], 3 * x[4]
    rows = [(k, [float(v) for v in x[k]]) for k in range(len(x))]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (905, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("links", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(frame, block_rows=block).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = embedding_dedup.roots_of(len(x), *np.nonzero(link))
    assert got == {k: (int(link[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(len(x))} | {k: (0, k, True) for k in range(900, 906)}


def test_embedding_dedup_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(str, embedding_dedup.near_duplicates(bad).collect())) == sorted(map(str, spark.createDataFrame([(1, 0, 1, True), (None, 0, None, False)], "vec_id long, n_links long, component_id long, kept boolean").collect()))


# --- 4 sharding ----------------------------------------------------------------------------------


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c = (low + high) // 2
        used, held = 1, 0
        for s in sizes:
            if held + s > c:
                used, held = used + 1, 0
            held += s
        low, high = (low, c) if used <= shards else (c + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_minimax_cuts(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 500, 60).tolist()
    groups = spark.createDataFrame(list(zip(sizes, np.cumsum(sizes).tolist(), strict=True)), "size long, through long")
    capacity, cuts = sharding.minimax_cuts(groups, 8)
    assert capacity == best_capacity(sizes, 8)
    ends = [0, *cuts, sum(sizes)]
    assert max(b - a for a, b in zip(ends, ends[1:], strict=False)) <= capacity


def test_shard(spark):
    rows = sample_rows() + [(3000 + k, "the same text", "s") for k in range(40)]
    got = sharding.shard(docs(spark, rows)).collect()
    text = {d: t or "" for d, t, _ in rows}
    where, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        slots[r["shard"]].append(r["slot"])
    by_doc = {r["doc_id"]: r["shard"] for r in got}
    for d, t, _ in rows:
        where[t].add(by_doc[d])
    assert all(len(w) == 1 for w in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.shard(docs(spark, [])).count() == 0
    assert {r["shard"] for r in sharding.shard(docs(spark, [(1, "x", "s")] * 3)).collect()} == {0}


def test_write_shards(spark, tmp_path):
    frame = docs(spark, sample_rows(), extra=False).filter("doc_id is not null")
    sharding.write_shards(frame, sharding.shard(frame), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == frame.count()


def test_write_shards_writes_every_row(spark, tmp_path):
    rows = [(None, "x", "a"), (None, "y", "b"), (None, "x", "c"), (4, "p", "d"), (4, "longer", "e"), (4, "p", "f"), (6, None, "g"), (6, "", "h")]
    frame = docs(spark, rows, extra=False)
    placed = materialise(sharding.shard(frame), "placed")
    sharding.write_shards(frame, placed, f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["source"]) for r in got))) == sorted(map(str, rows))
    key = lambda r: (r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, placed.collect()))
    assert all(len({r["shard"] for r in got if r["text"] == t}) == 1 for t in ("x", "p"))


# --- 5 fixity ------------------------------------------------------------------------------------


def test_fixity(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>" + "x" * (k % 50)) for k in range(700)] + [(None, None, None)], "page_id long, url string, html string")
    first = fixity.warc_records(pages)
    assert fixity.fixity_audit(first, fixity.warc_records(pages)).count() == 0
    other = pages.withColumn("html", F.when(F.col("page_id").isin(3, 300, 511), F.concat(F.lit("#"), F.substring("html", 2, 9999))).otherwise(F.col("html"))).filter("page_id is null or page_id != 699")
    got = sorted((r["file_id"], r["record_no"], r["fault"]) for r in fixity.fixity_audit(first, fixity.warc_records(other)).collect())
    assert got == [(0, 3, "altered"), (1, 44, "altered"), (1, 255, "altered"), (2, 187, "missing")]
    shifted = pages.withColumn("html", F.when(F.col("page_id") == 698, F.lit("longer than it was")).otherwise(F.col("html")))
    assert {r["fault"] for r in fixity.fixity_audit(first, fixity.warc_records(shifted)).collect()} >= {"altered"}
    none = fixity.warc_records(pages.limit(0))
    assert fixity.fixity_audit(none, none).count() == 0
    assert {r["fault"] for r in fixity.fixity_audit(first, none).collect()} == {"missing"}
    assert {r["fault"] for r in fixity.fixity_audit(none, first).collect()} == {"surplus"}


def test_fixity_inside_files(spark):
    rows = [(k, f"http://h/{k}", "<p>" + "x" * (k % 50)) for k in range(700)]
    rows += [(40, "http://h/40", "<p>repeated")] * 3 + [(None, "a", "b"), (None, "c", "d")]
    lost, new, longer, hit = {10, 300}, [(100, "http://h/100", "inserted"), (800, "u", "v")], {400}, {20, 350}
    first = [r for r in rows if r[0] != 120]
    change = lambda r: (r[0], r[1], r[2] + "longer" if r[0] in longer else "#" + r[2][1:] if r[0] in hit else r[2])
    other = [change(r) for r in rows if r[0] not in lost] + new
    other.remove((40, "http://h/40", "<p>repeated"))
    table = lambda x: fixity.warc_records(spark.createDataFrame(x, "page_id long, url string, html string"))
    one, two = ([r.asDict() for r in table(x).collect()] for x in (first, other))
    # brute force: equal bytes first, then equal ids, each in order
    want, left = [], []
    for r in one:
        if twin := next((s for s in two if all(s[c] == r[c] for c in ("file_id", "record_no", "offset", "payload"))), None):
            two.remove(twin)
        else:
            left.append(r)
    for fault, columns in (("moved", ("file_id", "page_id", "payload")), ("altered", ("file_id", "page_id"))):
        for r in list(left):
            if twin := next((s for s in two if all(s[c] == r[c] for c in columns)), None):
                left.remove(r)
                two.remove(twin)
                want.append((r["file_id"], r["record_no"], fault, r["offset"], r["length"], twin["offset"], twin["length"]))
    want += [(r["file_id"], r["record_no"], "missing", r["offset"], r["length"], None, None) for r in left]
    want += [(r["file_id"], r["record_no"], "surplus", None, None, r["offset"], r["length"]) for r in two]
    got = [tuple(r) for r in fixity.fixity_audit(table(first), table(other)).collect()]
    index = lambda x: fixity.warc_index(spark.createDataFrame(x, "page_id long, url string, html string"))
    assert sorted(map(str, map(tuple, fixity.fixity_audit(index(first), index(other)).collect()))) == sorted(map(str, got))
    assert sorted(map(str, got)) == sorted(map(str, want))
    faults = collections.Counter(r[2] for r in got)
    assert (faults["missing"], faults["surplus"], faults["altered"]) == (3, 3, 3) and faults["moved"] > 400


# --- 6 pseudonyms --------------------------------------------------------------------------------

KEY = b"test key"


def test_permutation_is_one():
    for size in (1, 2, 7, 100, 101):
        image = [pii.permute(k, size, KEY, "t") for k in range(size)]
        assert sorted(image) == list(range(size))
        assert [pii.permute(x, size, KEY, "t", back=True) for x in image] == list(range(size))
    assert [pii.permute(k, 100, KEY, "t") for k in range(100)] != [pii.permute(k, 100, b"other", "t") for k in range(100)]


@pytest.mark.parametrize("size", [1 << 64, 26**12, (1 << 128) + 1, 10**70, (1 << 256) - 1])
def test_permutation_reaches_every_digit_of_large_domains(size):
    rng = random.Random(size)
    values = [rng.randrange(size) for _ in range(400)]
    image = [pii.permute(v, size, KEY, "t") for v in values]
    assert [pii.permute(x, size, KEY, "t", back=True) for x in image] == values and all(0 <= x < size for x in image)
    # each byte of the number changes as often as chance has it
    for shift in range(0, size.bit_length() - 8, 8):
        same = sum((a >> shift & 255) == (b >> shift & 255) for a, b in zip(values, image, strict=True))
        assert same <= 12, shift
    with pytest.raises(ValueError):
        pii.permute(0, 1 << 256, KEY, "t")


def test_every_kind_stays_within_a_domain():
    longest = {"token": "a1" * 32, "iban": "LC" + "AB1" * 10, "ipv6": ":".join(["ffff"] * 8), "card": "9" * 19, "email": "Ab1" * 9000}
    for text in longest.values():
        sizes = [len(next((own for own in pii.LATIN if c in own), c)) for c in text]
        blocks = pii._blocks(sizes)
        assert [a for a, _ in blocks] == [0, *[b for _, b in blocks[:-1]]] and blocks[-1][1] == len(text)
        assert all(math.prod(sizes[a:b]).bit_length() < pii.DOMAIN_BITS for a, b in blocks)
    assert all(len(pii._blocks([16] * n)) == 1 for n in (32, 40, 62)) and pii._blocks([26] * 53) == [(0, 26), (26, 53)]


def test_long_names_are_permuted_throughout():
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for length, tries in ((1, 600), (2, 400), (10, 300), (52, 200), (53, 200), (120, 200), (400, 100), (3000, 20), (20_000, 3)):
        same, names = np.zeros(length), ["".join(rng.choices(letters, k=length)) for _ in range(tries)]
        for name in names:
            new = pii.email(f"{name}@h.org", KEY)
            assert new.endswith("@h.org") and pii.email(new, KEY, back=True) == f"{name}@h.org"
            same += [a == b for a, b in zip(name, new[:-6], strict=True)]
        # a place stays as it was once in 26 names
        assert same.sum() <= length * tries / 26 + 6 * math.sqrt(length * tries / 26) + 3
        assert same.max() <= tries / 26 + 7 * math.sqrt(tries / 26) + 3
    for length in (6_500, 100_000):
        name = "".join(rng.choices("Ab1._%+-" + letters, k=length)) + "z"
        began = time.process_time()
        new, spans = pii.pseudonymise(f"{'x' + name}@h.org", KEY)
        assert [k for k, _, _ in spans] == ["email"] and pii.pseudonymise(new, KEY, back=True)[0] == f"{'x' + name}@h.org"
        assert time.process_time() - began < 10
    # a change at either end changes all of a long name
    one = "".join(rng.choices(letters, k=300))
    first = pii.email(f"{one}@h", KEY)
    for other in ("a" + one[1:] if one[0] != "a" else "b" + one[1:], one[:-1] + ("a" if one[-1] != "a" else "b")):
        new = pii.email(f"{other}@h", KEY)
        assert sum(a == b for a, b in zip(first[:300], new[:300], strict=True)) < 40


def test_pseudonyms_keep_format_and_link():
    text = "a 4539 1488 0343 6467, b 4539148803436467, born 1987-06-05 or 05/06/1987; +1 (212) 555-7713, 078-05-1120, 10.20.30.40, joe.7@mail3.example.com."
    new, spans = pii.pseudonymise(text, KEY)
    assert [k for k, _, _ in spans] == ["card", "card", "date", "date", "phone", "social", "ipv4", "email"]
    assert "".join("9" if c.isdigit() else c for c in new[:70]) == "".join("9" if c.isdigit() else c for c in text[:70])
    cards = new[2:21].replace(" ", ""), new[25:41]
    assert cards[0] == cards[1] != "4539148803436467" and pii.luhn_digit(cards[0][:-1]) == cards[0][-1]
    day, other = new[48:58], new[62:72]
    assert day.split("-") == other.split("/")[::-1]
    assert "@mail3.example.com" in new and "joe.7@" not in new and "555-7713" not in new
    assert pii.pseudonymise(new, KEY, back=True)[0] == text


def test_what_is_not_valid_stays():
    for text in ("4539148803436468", "2025-02-30", "999.1.1.1", "000-12-3456", "version 2.0.1", "12345", "", "no digits"):
        assert pii.pseudonymise(text, KEY) == (text, [])


def odd_finds(rng):
    """A value of a random kind, in one of the ways it is written."""
    day, month, year = rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1900, 2100)
    digits = "4539" + "".join(rng.choice("0123456789") for _ in range(11))
    account = "".join(rng.choice("0123456789") for _ in range(18))
    return rng.choice([
        f"{day:02d}/{month:02d}/{year}", f"{month:02d}-{day:02d}-{year}", f"{year}.{month:02d}.{day:02d}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))),
        f"J{day}.x@h.org", f"+{day} {rng.randrange(10, 999)} {rng.randrange(10**6, 10**8)}", ".".join(str(rng.randrange(256)) for _ in range(4)), ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)),
        f"2a03::{year:x}", digits + pii.luhn_digit(digits), "DE" + pii.iban_digits("DE", account) + account, f"{day + 100}-{month:02d}-{year}", "word", str(account),
    ])


def test_every_kind_is_turned_back():
    rng, kinds = random.Random(5), collections.Counter()
    for _ in range(1500):
        text = rng.choice([" ", ", ", "; "]).join(odd_finds(rng) for _ in range(rng.randrange(1, 8)))
        new, spans = pii.pseudonymise(text, KEY)
        kinds.update(k for k, _, _ in spans)
        back, again = pii.pseudonymise(new, KEY, back=True)
        assert back == text and [k for k, _, _ in again] == [k for k, _, _ in spans]
    assert set(kinds) == {k for k, _, _ in pii.KINDS}


def test_tokens_stay_hexadecimal_and_dates_valid():
    text = "key deadbeef0123456789ABCDEF01234567, 12/25/1987 is 25.12.1987 is 1987-12-25, DE89 3704 0044 0532 0130 00 or DE89370400440532013000 AND"
    new, spans = pii.pseudonymise(text, KEY)
    assert [k for k, _, _ in spans] == ["token", "date", "date", "date", "iban", "iban"]
    token = new[4:36]
    assert token != text[4:36] and all(c in "0123456789abcdefABCDEF" for c in token) and [c.islower() for c in token] == [c.islower() for c in text[4:36]]
    m, d, y = new[38:48].split("/")
    assert int(d) > 12 and new[52:62] == f"{d}.{m}.{y}" and new[66:76] == f"{y}-{m}-{d}"
    one, two = new[78:].split(" or ")
    assert one.replace(" ", "") == two.removesuffix(" AND") and pii.iban_digits("DE", two[4:22]) == two[2:4]


def test_long_texts_take_linear_time():
    many = " ".join(f"u{k}@h{k}.example.com" for k in range(50_000))
    for text, n in (("a" * 4_000_000 + "@", 0), ("@".join(["ab"] * 1_000_000), 0), (many, 50_000), ("1.1." * 1_000_000, 0), (":" * 2_000_000, 0)):
        began = time.process_time()
        assert len(pii.pseudonymise(text, KEY)[1]) == n
        assert time.process_time() - began < 5


def test_pseudonymise_documents(spark):
    rows = [(1, "card 4539148803436467", "s"), (2, None, "s"), (3, "", "s"), (None, "x 10.0.0.1", "s"), (1, "card 4539148803436467", "s")]
    got = pii.pseudonymise_documents(docs(spark, rows), KEY).collect()
    assert len(got) == 5 and [r["n_replaced"] for r in got if r["doc_id"] == 1] == [1, 1] and [r["text"] for r in got if r["doc_id"] == 2] == [None]
    back = pii.pseudonymise_documents(spark.createDataFrame(got), KEY, back=True).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in back) == sorted(str((d, t)) for d, t, _ in rows)
    assert pii.pseudonymise_documents(docs(spark, []), KEY).count() == 0


# --- 7 packing -----------------------------------------------------------------------------------


def best_fit_decreasing(lengths, capacity):
    bins, n = collections.Counter(), 0
    for x in sorted(lengths, reverse=True):
        space = next((s for s in range(x, capacity + 1) if bins[s]), None)
        if space is None:
            space, n = capacity, n + 1
            bins[capacity] += 1
        bins[space] -= 1
        bins[space - x] += 1
    return n


@pytest.mark.parametrize("kind", ["uniform", "small", "large", "equal", "one"])
def test_pack(spark, kind):
    rng = np.random.default_rng(7)
    lengths = {"uniform": rng.integers(1, 513, 900), "small": rng.integers(1, 60, 900), "large": rng.integers(200, 513, 900), "equal": np.full(500, 171), "one": np.array([512])}[kind].tolist()
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(frame, capacity=512, groups=256).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    full = collections.defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(full) <= best_fit_decreasing(lengths, 512) * 1.02 + 1


def test_linear_groups_and_configurations():
    counts = {500: 7, 300: 5, 200: 9}
    groups = packing.linear_groups(counts, 4)
    assert sum(n for _, n in groups) == 21 and len({n for _, n in groups[:-1]}) == 1 and groups[0][0] == 500
    plan = packing.configurations(groups, 1000)
    used = collections.Counter()
    for need, times in plan:
        assert sum(groups[g][0] * n for g, n in need.items()) <= 1000
        for g, n in need.items():
            used[g] += n * times
    assert used == {g: n for g, (_, n) in enumerate(groups)}


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    odd = ["Größe ÀÉÎ naïve's don't 3rd x1y2 ...", "a\tb c d\x1ce", "<|endoftext|> tail", "İstanbul ΣΑΣ ﬁ é ½ 你好", "!!## $%", "it's 'S", "\n\n", "x" * 3000, "re-do (this)."]
    rows = sample_rows(4, 30) + [(5000 + k, t, "s") for k, t in enumerate(odd)] + [(None, "no id", "s"), (5000, odd[0], "s")]
    got = packing.pack_documents(docs(spark, rows), tokenizer_path("word_bpe_49k.json"), 256).collect()
    want = []
    for d, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    key = lambda r: tuple(-1 if x is None else x for x in r[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert packing.pack_documents(docs(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


# --- 8 token counts ------------------------------------------------------------------------------


def test_edits_count_like_a_full_encoding():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    counts = token_counts.SegmentCounts(tokenizer_path("byte_bpe_50k.json"))
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rng = random.Random(9)
    bits = ["word", " ", "  ", "\n", "it's", "Größe", "123", "...", " x", "\t", "你", "<|endoftext|>", " ", "é", "'s", "\n\n "]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))
        edits, at = [], 0
        while at <= len(text) and rng.random() < 0.7:
            a = rng.randint(at, len(text))
            b = min(len(text), a + rng.randrange(0, 6))
            edits.append((a, b, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 4)))))
            at = b + 1
        tree = token_counts.CountTree(text, counts)
        assert tree.total == count(text)
        want = text
        for a, b, new in reversed(edits):
            want = want[:a] + new + want[b:]
        new, _ = tree.apply(edits)
        assert new == want and tree.total == count(want)


def random_edits(rng, text, bits, longest=6):
    edits, at = [], 0
    while at <= len(text) and rng.random() < 0.7:
        a = rng.randint(at, len(text))
        b = min(len(text), a + rng.randrange(0, longest))
        edits.append((a, b, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 4, 90])))))
        at = b + 1
    want = text
    for a, b, new in reversed(edits):
        want = want[:a] + new + want[b:]
    return edits, want


def test_trees_hold_over_successive_edits():
    counts = token_counts.SegmentCounts(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(10)
    bits = ["word", " ", "  ", "\n", "it's", "Größe", "123", "...", " x", "\t", "你", "<|endoftext|>", " ", "é", "'s", "\n\n "]
    for _ in range(200):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 60, 400])))
        tree = token_counts.CountTree(text, counts)
        for _ in range(4):
            edits, text = random_edits(rng, text, bits, rng.choice([6, 300]))
            tree = token_counts.CountTree.stored(tree.text, counts, tree.lengths, tree.tokens, tree.leaves, tree.sums)
            assert tree.apply(edits)[0] == text
            full = token_counts.CountTree(text, counts)
            assert tree.total == full.total == tree.tokens.sum() and tree.lengths.sum() == len(text) and tree.leaves.sum() == len(tree.lengths)
            starts = np.cumsum(tree.leaves) - tree.leaves
            assert [int(tree.tokens[a : a + n].sum()) for a, n in zip(starts, tree.leaves, strict=True)] == (tree.levels[0].tolist() if tree.levels else [])


def test_edits_that_overlap_are_an_error():
    counts = token_counts.SegmentCounts(tokenizer_path("byte_bpe_50k.json"))
    for edits in ([(0, 5, "x"), (3, 8, "Y")], [(0, 99, "x")], [(4, 2, "x")], [(-1, 2, "x")], [(5, 5, "a"), (3, 6, "b")]):
        with pytest.raises(ValueError, match="overlaps"):
            token_counts.CountTree("aa bb cc dd", counts).apply(edits)


def test_stored_trees_take_edits_from_a_table(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(1, "some plain words " * 300, "s"), (2, None, "s"), (3, "", "s"), (None, "no id", "s"), (4, "untouched text", "s"), (4, "twice", "s")]
    trees = materialise(token_counts.count_trees(docs(spark, rows), path), "trees")
    table = lambda x: spark.createDataFrame(x, "doc_id long, start long, end long, new string")
    first = materialise(token_counts.edit_by_table(trees, table([(1, 5, 10, "new"), (1, 2000, 2000, "in here "), (2, 0, 0, "was null"), (3, 0, 0, None), (9, 0, 1, "x"), (None, 0, 1, "x")]), path), "trees")
    second = token_counts.edit_by_table(first, table([(1, 0, 4, ""), (2, 3, 8, "")]), path).collect()
    texts = {r["doc_id"]: r["text"] for r in second if r["doc_id"] != 4}
    want = rows[0][1][:5] + "new" + rows[0][1][10:2000] + "in here " + rows[0][1][2000:]
    assert texts == {1: want[4:], 2: "was", 3: "", None: "no id"}
    full = {r["text"]: r["sums"][-1] for r in token_counts.count_trees(spark.createDataFrame([(k, t) for k, t in enumerate(texts.values()) if t], "doc_id long, text string"), path).collect()}
    for r in second:
        assert r["doc_id"] == 4 or (r["sums"][-1] if r["sums"] else 0) == full.get(r["text"], 0)
        assert r["n_encoded"] <= 4 and (r["doc_id"] in (1, 2) or r["n_encoded"] == 0)
    assert len(second) == 6 and sum(r["doc_id"] == 4 for r in second) == 2
    assert token_counts.edit_by_table(trees.limit(0), table([]), path).count() == 0


def test_edits_encode_little():
    counts = token_counts.SegmentCounts(tokenizer_path("byte_bpe_50k.json"))
    tree = token_counts.CountTree("some plain words " * 2000, counts)
    _, encoded = tree.apply([(20_000, 20_003, "new")])
    assert encoded <= 4 and len(tree.levels) >= 3


def test_count_with_edits(spark):
    rows = [(1, "call 5551234567 now !!! ok\nline\nline\n", "s"), (2, None, "s"), (3, "", "s"), (None, "plain", "s"), (2, None, "s")]
    got = token_counts.count_with_edits(docs(spark, rows), tokenizer_path("byte_bpe_50k.json"), with_text=True).collect()
    assert len(got) == 5
    first = next(r for r in got if r["doc_id"] == 1)
    assert first["text"] == "call <NUM> now   ok\nline\n" and first["n_edits"] == 3
    assert all(r["tokens_before"] == r["tokens_after"] == 0 for r in got if r["doc_id"] in (2, 3))
    assert token_counts.count_with_edits(docs(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


# --- 9 language ----------------------------------------------------------------------------------

STEMS = {"aa": "the and with which there were", "bb": "und der nicht auch über größer", "cc": "les des être où déjà façon"}


def language_rows(n=240):
    rng = random.Random(11)
    out = []
    for k in range(n):
        lang = rng.choice(sorted(STEMS))
        out.append((k, " ".join(rng.choice(STEMS[lang].split()) + rng.choice(["", "s", "en"]) for _ in range(rng.choice([3, 20, 900]))), lang))
    return out


def test_language(spark):
    rows = language_rows() + [(900, None, "aa"), (901, "", "bb"), (902, "123 ... !!", "cc"), (903, "the and there", None), (None, "und nicht der", "bb")]
    frame = spark.createDataFrame([(d, t, g, "s") for d, t, g in rows], "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    got = language.identify(frame).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[d]["lang_pred"] for d in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] == "aa" and by[None]["held_out"]
    held = [(by[d], g) for d, _, g in rows[:240] if by[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([r["lang_pred"] == g for r, g in held]) > 0.97
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns and {d for d, _, _ in rows} - {r["doc_id"] for r in kept.collect()} == {900, 901, 902}


def test_language_model_is_kernel_ridge_regression(spark):
    """Every window a landmark: the Nystroem model must be dense kernel ridge regression, by the kernel matrix alone."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(STEMS[g].split()) for _ in range(rng.choice([2, 9, 40]))), g) for k, g in enumerate("aa bb cc aa bb".split() * 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = language.learn(frame, landmarks=3 * len(rows))
    x = language.unit(np.concatenate([language.presence(np.frombuffer(t.encode(), np.uint8), [(0, len(t.encode()))]) for _, t, _ in rows])).astype(float)
    names = np.array([g for _, _, g in rows])
    y = np.where(names[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    weight = np.array([1 / (names == g).sum() for g in names])
    kernel = x @ x.T
    # minimises sum of w (f - y)^2 + ridge |f|^2 over f in the kernel's space
    alpha = np.linalg.solve(kernel * weight[None, :] + language.RIDGE * np.eye(len(rows)), y)
    want = kernel @ (weight[:, None] * alpha)
    got = (x @ model.landmarks) @ model.weights
    assert np.abs(got - want).max() < 2e-3


def test_language_learns_from_every_window(spark):
    """The language shows in one window of a long text alone, at its start, middle or end."""
    rng = random.Random(4)
    filler = "0123 456 789 " * 320
    rows = []
    for k in range(90):
        g = rng.choice(sorted(STEMS))
        parts = [filler] * 5
        parts[rng.randrange(5)] = " ".join(rng.choice(STEMS[g].split()) for _ in range(900))
        rows.append((k, "".join(parts), g))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame).collect()}
    assert np.mean([got[d] == g for d, _, g in rows]) > 0.97


def test_sample_is_bounded_by_rows(spark):
    own = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows = [(own, f"the and {k}", "aa") for k in range(50)] + [(k, "und nicht der", "bb") for k in range(100, 160)] + [(None, "the", "aa")]
    got = language.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 7).collect()
    assert collections.Counter(r["lang"] for r in got) == {"aa": 1, "bb": 7}


def test_keep_identified_rejects_what_no_language_claims(spark):
    odd = [(900, "qx zzkw vvyq xjxj kqkq wzwz " * 40, None), (901, "qx zz", None)]
    frame = spark.createDataFrame(language_rows(120) + odd, "doc_id long, text string, lang string")
    gone = {r["doc_id"] for r in frame.collect()} - {r["doc_id"] for r in language.keep_identified(frame).collect()}
    assert gone == {900}
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(unlabelled).count() == 122


def late_ids(spark, n, late):
    """Ids to learn from, and the ``late`` of them whose hash is greatest, which a sample by hash would take last."""
    ids = [k for k in range(n) if zlib.crc32(str(k).encode()) % 4 != 2]
    by_hash = spark.createDataFrame([(k,) for k in ids], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return ids, {r["doc_id"] for r in by_hash[-late:]}


def test_language_learns_from_every_document(spark):
    """A few documents in a thousand, last by hash, show words that all others of their language lack."""
    rng = random.Random(6)
    ids, late = late_ids(spark, 1400, 30)
    usual = {"aa": STEMS["aa"], "bb": STEMS["bb"]}
    rare = {"aa": "undz derz nichz auchz", "bb": "thep andp withp whichp"}
    say = lambda words: " ".join(rng.choice(words.split()) for _ in range(60))
    rows = [(d, say((rare if d in late else usual)[g]), g) for d in ids for g in ("aa", "bb")]
    asked = [(10**6 + k, say(rare[g]), g) for k, g in enumerate(["aa", "bb"] * 20)]
    frame = spark.createDataFrame(rows + [(d, t, None) for d, t, _ in asked], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame).collect() if r["doc_id"] >= 10**6}
    assert [got[d] for d, _, _ in asked] == [g for _, _, g in asked]


def test_least_scores_come_from_every_document(spark):
    """No text that is learned from and predicted rightly is rejected, whatever its hash: the last ones mix languages."""
    rng = random.Random(7)
    ids, late = late_ids(spark, 1400, 30)
    rows = []
    for d in ids:
        for g in ("aa", "bb"):
            own, other = STEMS[g].split(), STEMS["bb" if g == "aa" else "aa"].split()
            rows.append((d, " ".join(rng.choice(own[:3] + other[-2:] if d in late else own) for _ in range(90)), g))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(frame)
    right = {(d, t) for d, t, g in rows for p in [model.languages[_best(model, t)]] if p == g}
    kept = {(r["doc_id"], r["text"]) for r in language.keep_identified(frame).collect()}
    assert sum(d in late for d, _ in right) > 20 and not right - kept


def _best(model, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(model.scores(language.presence(raw, [(0, len(raw))])).argmax())


def test_sums_of_tasks(spark):
    """Middles are the counts of features of the nearest windows, and moments those of all windows, however tasks cut the table."""
    rows = [(d, t, g) for d, t, g in language_rows(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    langs, base = language.landmark_windows(language.sampled(frame, 9), 9)
    x, own = [], []
    for _, t, g in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        spans, _ = language.windows_of(np.array([0, len(raw)]))
        x.append(language.presence(raw, spans))
        own += [g] * len(spans)
    x, own = np.concatenate(x), np.array(own)
    near = np.where(own[:, None] == np.array(langs)[None, :], language.unit(x) @ base.T, -1).argmax(axis=1)
    want = np.array([x[near == k].sum(axis=0) for k in range(len(langs))])
    got = language.middles(language.labelled(frame), langs, base)
    assert len(langs) == 9 and np.abs(got - want / np.linalg.norm(want, axis=1, keepdims=True)).max() < 1e-6
    root = language.spanning(got)
    z, n = (language.unit(x) @ got.T) @ root, root.shape[1]
    for lang, sums in language.window_moments(language.labelled(frame), sorted(set(langs)), got, root).items():
        mine = z[own == lang]
        assert np.allclose(sums[: n * n].reshape(n, n), mine.T @ mine, atol=1e-3) and np.allclose(sums[n * n : -1], mine.sum(axis=0), atol=1e-3) and sums[-1] == len(mine)


def test_keep_identified_decides_by_row(spark):
    odd = [(None, "123", "aa"), (None, "und nicht der", "bb"), (900, "...", "aa"), (900, "the and there", "aa")]
    frame = spark.createDataFrame(language_rows(60) + odd, "doc_id long, text string, lang string")
    kept = language.keep_identified(frame).collect()
    assert len(kept) == 62 and {(None, "und nicht der"), (900, "the and there")} <= {(r["doc_id"], r["text"]) for r in kept}


def test_language_without_labels(spark):
    frame = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language.identify(frame).collect()] == [("und", 0.0)]
    assert language.identify(frame.limit(0)).count() == 0


# --- 10 n-gram Jaccard join ----------------------------------------------------------------------


def shingles(t, n=5):
    w = tuple("".join(c.lower() if c.isascii() else c for c in t or "").split())
    return {w[k : k + n] for k in range(len(w) - n + 1)} if len(w) >= n else ({w} if w else set())


def brute_components(rows, percent=80):
    sets = {d: shingles(t) for d, t in rows}
    comp = {d: d for d in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    return {d: (len(sets[d]), comp[d]) for d in ids}


def near_rows(seed):
    rng = random.Random(seed)
    rows, passage = [], [f"p{k}" for k in range(60)]
    for k in range(90):
        base = words(rng, rng.choice([3, 5, 7, 12, 60, 250])).split()
        if rng.random() < 0.3:
            base += passage
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            new = list(base)
            for _ in range(rng.choice([0, 1, 2, max(1, len(base) // 50), max(1, len(base) // 25)])):
                new[rng.randrange(len(new))] = f"v{rng.randrange(9999)}"
            rows.append((len(rows), (" ".join(new)).upper() if rng.random() < 0.3 else "\t".join(new)))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "one"), (5005, "one two")]


@pytest.mark.parametrize("block", [8, 512])
@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_join(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_rows(seed)
    frame = docs(spark, [(d, t, "s") for d, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(frame).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_odd_rows(spark):
    assert jaccard_join.jaccard_join(docs(spark, [])).count() == 0
    rows = docs(spark, [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "A B C D E F", "s"), (None, "a b c d e f", "s")])
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard_join.jaccard_join(rows).collect())
    assert got == ["(1, 2, 1)", "(1, 2, 1)", "(2, 2, 1)", "(None, 2, 1)"]
    rows = docs(spark, [(7, "a b c d e f", "s"), (7, "u v w x y z", "s"), (9, "U V W X Y Z", "s"), (None, "no one else says this", "s"), (None, "", "s"), (None, "k l m n o p", "s"), (None, "k l m n o p", "s")])
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard_join.jaccard_join(rows).collect())
    assert got == ["(7, 2, 7)", "(7, 2, 7)", "(9, 2, 7)", "(None, 0, None)", "(None, 1, None)", "(None, 2, None)", "(None, 2, None)"]


@pytest.mark.parametrize("block", [8, 512])
def test_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_rows(3)
    links, members = jaccard_join.jaccard_links(docs(spark, [(d, t, "s") for d, t in rows]))
    sets = {d: shingles(t) for d, t in rows}
    linked = lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    got = {r["doc_id"]: (r["rep"], r["n_links"]) for r in members.collect()}
    want = {d: (min(e for e in sets if e == d or (sets[e] == sets[d] and sets[d])), sum(linked(d, e) for e in sets if e != d)) for d in sets}
    assert got == want
    reps = sorted({r for r, _ in got.values()})
    pairs = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if linked(a, b)}
    assert pairs and {(min(r), max(r)) for r in links.collect()} == pairs and links.count() == len(pairs)


def test_component_of_over_a_block(spark):
    """A chain of 700 sets, each near the next ones alone: no set settles the others, and blocks meet by trees."""
    rows = [(k, " ".join(f"c{w}" for w in range(5 * k, 5 * k + 120))) for k in range(700)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(docs(spark, [(d, t, "s") for d, t in rows])).collect()}
    assert set(got.values()) == {0} and len(got) == 700


def test_signature_tree_finds_all_links():
    rng = np.random.default_rng(13)
    base = [np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 200))) for _ in range(60)]
    sets = base + [np.unique(np.concatenate([b[: max(1, int(len(b) * 0.93))], rng.integers(0, 1 << 40, 3)])) for b in base]
    links = jaccard_join.tree_links(sets, np.arange(len(sets)), None, 80)
    label = embedding_dedup.roots_of(len(sets), *(np.array([p[k] for p in links], int) for k in (0, 1)))
    want = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert want and (label == embedding_dedup.roots_of(len(sets), *(np.array([p[k] for p in want], int) for k in (0, 1)))).all()
    assert math.isfinite(len(links))


def test_signature_tree_bounds_very_large_sets():
    rng = np.random.default_rng(17)
    both, a, b = np.split(np.unique(rng.integers(-(1 << 62), 1 << 62, 354_000))[: 353_000], [317_000, 335_000])
    sets = [np.sort(np.concatenate([both, x])) for x in (a, b)]
    overlap = len(np.intersect1d(*sets))
    assert min(map(len, sets)) > 300_000 and overlap / len(np.union1d(*sets)) == pytest.approx(0.9, abs=0.01)
    assert jaccard_join.overlap_bound(*map(jaccard_join.planes_of, sets)) >= overlap
    assert len(jaccard_join.tree_links(sets, np.arange(2), None, 80)) == 1
    assert len(jaccard_join.tree_links(sets, np.array([0]), np.array([1]), 80)) == 1
