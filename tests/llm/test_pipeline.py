"""The corpus pipeline: each stage against a plain version, and the whole."""

from __future__ import annotations

import collections
import random

import corpus_pipeline
from logwarden.llm import mixing
from tests.llm.test_operators import brute_components, language_rows


def corpus(spark):
    rng = random.Random(21)
    rows = [(d, t, g, f"src{d % 5}") for d, t, g in language_rows(80) if len(t.split()) > 3]
    pool = [f"wort{k}" for k in range(500)]
    for k in range(100, 140):
        t = " ".join(rng.choice(pool) for _ in range(80))
        rows += [(k, t, "bb", "src0"), (k + 1000, t.upper(), "bb", "src0"), (k + 2000, t + " ende", "bb", "src1")]
    rows += [(9000, None, "aa", "src0"), (9001, "...", "aa", None), (9002, "42", None, "src3")]
    return spark.createDataFrame([(d, t, g, s, len(t or "")) for d, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = corpus(spark)
    before = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
    a = stage["language"](spark, docs, "")
    assert a.columns == docs.columns and set(before) - {r["doc_id"] for r in a.collect()} == {9000, 9001, 9002}
    b = stage["exact_dedup"](spark, a, "")
    keep = {}
    for r in a.collect():
        t = "".join(c.lower() if c.isascii() else c for c in r["text"])
        keep[t] = max(keep.get(t, -1), r["doc_id"])
    assert b.columns == docs.columns and sorted(r["doc_id"] for r in b.collect()) == sorted(keep.values())
    c = stage["near_dedup"](spark, b, "")
    classes = brute_components([(r["doc_id"], r["text"]) for r in b.collect()])
    assert sorted(r["doc_id"] for r in c.collect()) == sorted({x for _, x in classes.values()})
    d = stage["mix"](spark, c, "")
    uses = collections.Counter(r["doc_id"] for r in d.collect())
    assert d.columns == docs.columns and max(uses.values()) <= 3 and set(uses) <= {r["doc_id"] for r in c.collect()}
    taken, words = collections.Counter(), collections.Counter()
    for r in mixing.mix(c).collect():
        taken[r["source"]] += r["taken"]
    for r in d.collect():
        words[r["source"]] += len(r["text"].split())
    assert +words == +taken
    e = stage["pack"](spark, d, "").collect()
    assert collections.Counter(r["doc_id"] for r in e if r["piece"] == 0) == uses
    full = collections.Counter()
    for r in e:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 2048


def test_run(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() > 0 and "sequence_id" in rows.columns
    corpus(spark).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_copies_by_row(spark):
    text = " ".join(f"wort{k}" for k in range(80))
    other = " ".join(f"word{k}" for k in range(80))
    rows = [(None, text), (None, text + " ende"), (None, other), (3, other + " end"), (3, "another text of six words"), (2, other)]
    docs = spark.createDataFrame([(d, t, "bb", "src0", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"].split()[0]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [("2", "word0"), ("3", "another"), ("None", "wort0")]
