"""Operators 11 to 13 against brute force on small tables, and the cases that their docstrings define."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import curve_packing, divergence, infill
from logwarden.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("value", "rank", "part", "item", "n", "form", "output", "units", "made", "row", "place", "key", "length", "ids", "vector", "start", "document", "docs", "term", "h1", "a.b")


def docs(spark, rows, extra=True):
    """rows: (doc_id, text, lang, source); extra columns have the names that operators make."""
    frame = spark.createDataFrame([(d, t, lang, s, 0) for d, t, lang, s in rows], DOCS)
    return frame.select("*", *[F.lit("clash").alias(c) for c in CLASHES]) if extra else frame


# --- 11 divergence -------------------------------------------------------------------------------


def expected_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    frequency, counts, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = term.findall((text or "").translate(upper))
        for t in set(found):
            frequency[lang, t] += 1
        for t in found:
            counts[lang, source, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (g, t), n in frequency.items() if g == lang and n >= least]

        def share(count, own, kept=kept):
            return {t: 1 + 1_000_000_000 * (count(t) + 5) // (own + 5 * len(kept)) for t in kept}

        per = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        p = {s: share(c.get, sum(c.values())) for s, c in per.items()}
        every = {t: sum(c[t] for c in per.values()) for t in kept}
        q = share(every.get, sum(every.values()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if per[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def divergence_rows(seed, n=400):
    rng = random.Random(seed)
    pool = ["Alpha", "beta", "GAMMA", "été", "Ünder", "ÉTÉ", "x", "日本語", "a1b", "don't", "😀", "ß", "KK"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(k, " ".join(rng.choices(pool, k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "é", "", None])) for k in range(n)]
    rows += [(7, "alpha alpha", "en", "s0")] * 3 + [(None, None, "en", "only null"), (None, "", None, None), (1, "12 34 --", "xx", "a"), (2, None, "xx", "b")]
    return rows


@pytest.mark.parametrize(("least", "top"), [(30, 50), (1, 3), (10_000, 50)])
def test_divergence_equals_brute_force(spark, monkeypatch, least, top):
    rows = divergence_rows(least)
    want = expected_divergence(rows, least, top)
    for entries, part_rows, block in ((200_000, 200_000, 2_000_000), (20, 15, 8)):
        # small tables, parts and blocks: sums go out block by block, runs are cut everywhere
        monkeypatch.setattr(divergence, "ENTRIES", entries)
        monkeypatch.setattr(divergence, "PART_ROWS", part_rows)
        monkeypatch.setattr(divergence, "BLOCK", block)
        got = divergence.divergence(docs(spark, rows).repartition(5), least, top).collect()
        assert len(got) == len(want)
        assert {tuple(r) for r in got} == want


def test_divergence_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choices("aé1 ", [5, 3, 1, 1], k=rng.randrange(80))).encode()
        slices = list(divergence._slices(text))
        assert b"".join(slices) == text
        assert [t for s in slices for t in divergence._TERM.findall(s)] == divergence._TERM.findall(text)


def test_divergence_shares_are_exact():
    rng = random.Random(2)
    for _ in range(2000):
        whole = rng.choice([5, 7, 1000, 10**9, 10**15, 9 * 10**15])
        count = rng.randrange(-5, whole - 4)
        if count >= 0:
            assert divergence.shares(np.array([count]), np.array([whole]))[0] == 1 + 1_000_000_000 * (count + 5) // whole


def test_divergence_of_no_documents(spark):
    assert divergence.divergence(docs(spark, [])).count() == 0


# --- 12 infill -----------------------------------------------------------------------------------


def expected_infill(doc_id, text, rate=90, suffix_first=20, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return (doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_infill_equals_brute_force_and_comes_back(spark):
    rng = random.Random(4)
    odd = [None, "", "a", "é", "😀", "é", "a<P>b", "<S>", "x<M", "<", ">P<", "\n\r\n\t", " x\u0085y", "\x00z", "日本語 テキスト", "👩‍👩‍👧 family", "$1 \\E \\Q <p>", "x" * 300_000]
    rows = [(k, t, "en", "s") for k, t in enumerate(odd)]
    rows += [(100 + k, "".join(rng.choices("ab <>PSM\n😀é", k=rng.randrange(60))), None, None) for k in range(600)]
    rows += [(5000, "same", "en", "s")] * 2 + [(None, "no id", "en", "s"), (-3, "negative id", "en", "s")]
    made = infill.infill(docs(spark, rows)).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    want = [expected_infill(d, t) for d, t, _, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted([tuple(r)[:6] for r in made], key=key) == sorted(want, key=key)
    texts = {d: t or "" for d, t, _, _ in rows}
    assert all(r["back"] == texts[r["doc_id"]] for r in made)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_infill_options(spark):
    rows = [(k, f"text {k} <P>", "en", "s") for k in range(200)]
    marks = infill.Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    made = infill.infill(docs(spark, rows), seed=9, rate=100, suffix_first=100, marks=marks).withColumn("back", infill.restored(F.col("form"), F.col("output"), marks)).collect()
    assert {r["form"] for r in made} == {"spm"}
    assert all(r["output"].startswith("<|suf|>") and r["back"] == f"text {r['doc_id']} <P>" for r in made)
    assert {r["form"] for r in infill.infill(docs(spark, rows), rate=0).collect()} == {"plain"}
    assert infill.infill(docs(spark, [])).count() == 0
    for bad in (("<a", "<a", "<c"), ("<a", "<ab", "<c"), ("a>", "<b", "<c"), ("<a<", "<b", "<c")):
        with pytest.raises(ValueError):
            infill.Sentinels(*bad)


def test_infill_has_no_python_workers(spark):
    made = infill.infill(docs(spark, [(1, "x", "en", "s")]))
    plan = made.select(infill.restored(F.col("form"), F.col("output")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- 13 packing along a curve --------------------------------------------------------------------


def test_hilbert_keys_visit_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curve_packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()
    assert curve_packing.hilbert_keys(np.zeros((0, 4), np.int64), 12).shape == (0,)


def test_sequence_starts():
    for total in [*range(0, 70), 4096, 12345]:
        full, starts = curve_packing.sequence_starts(total, 16)
        ends = [*starts[1:], total]
        assert full == total // 16
        assert [int(b - a) for a, b in zip(starts, ends, strict=False)] == [1 << k for k in range(3, -1, -1) if total % 16 >> k & 1]


@pytest.mark.parametrize("capacity", [64, 50])
def test_curve_packing_covers_every_token_without_padding(spark, capacity, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(curve_packing, "UNIT_ROWS", 20)
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(k, text(rng.choice([0, 1, 3, 10, 40])), "en", "s") for k in range(150)] + [(900, None, "en", "s"), (901, "", "en", "s"), (902, text(3000), "en", "s"), (903, "日本語 é 😀", "en", "s")]
    rows += [(7000, "same same", "en", "s")] * 30 + [(None, "no id", "en", "s")] * 2
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {(d, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t, _, _ in rows}
    got = curve_packing.pack_along_curve(docs(spark, rows).repartition(3), path, capacity).collect()
    by_id = {d: v for (d, _), v in ids.items()}
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in got:
        part = by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(by_id[r["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        covered.update((r["doc_id"], r["start"] + k) for k in range(r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == collections.Counter((d, k) for d, t, _, _ in rows for k in range(len(ids[d, t])))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    assert len(sequences) == len(set(sequences)) and sum(n for s in sequences.values() for _, n in s) == sum(len(ids[d, t]) for d, t, _, _ in rows)


def test_curve_packing_puts_like_documents_together(spark):
    rng = random.Random(8)
    topics = [[f"{a}{b}" for b in "abcdefgh"] for a in ("zq", "xv", "wk", "jd")]
    rows = [(k, " ".join(rng.choices(topics[k % 4], k=60)), "en", "s") for k in range(400)]
    got = curve_packing.pack_along_curve(docs(spark, rows).repartition(4), tokenizer_path("word_bpe_49k.json"), 1024).collect()
    inside = collections.defaultdict(collections.Counter)
    for r in got:
        inside[r["sequence_id"]][r["doc_id"] % 4] += r["length"]
    # by chance, the topic that a sequence has most of would hold about a third of it
    assert sum(max(c.values()) for c in inside.values()) > 0.8 * sum(sum(c.values()) for c in inside.values())


def test_curve_packing_of_nothing(spark):
    path = tokenizer_path("word_bpe_49k.json")
    assert curve_packing.pack_along_curve(docs(spark, []), path).count() == 0
    got = curve_packing.pack_along_curve(docs(spark, [(1, None, None, None)]), path).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["offset"]) for r in got] == [(1, 0, 1, 1, 0)]
