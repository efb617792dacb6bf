"""The Jaccard join where one passage is everywhere and where sets are very large."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from logwarden.llm import jaccard_join
from tests.llm.test_operators import brute_components, docs, near_rows

PASSAGE = " ".join(f"p{k}" for k in range(80))


def told_rows(texts, a_batch=1):
    """What _emit() hands on for batches of so many texts."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part)), pa.int64()), pa.array(part)], ["doc_id", "text"]) for k in range(0, len(texts), a_batch) for part in [texts[k : k + a_batch]]]
    return [r for out in jaccard_join._emit(5, 80)(iter(batches)) for r in out.to_pylist()]


@pytest.mark.parametrize("a_batch", [1, 3])
def test_a_passage_of_all_texts_is_told_of_a_few_times(a_batch):
    rng = random.Random(1)
    texts = [PASSAGE + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(300)]
    rows = told_rows(texts, a_batch)
    hot = set(jaccard_join.shingle_sets(np.frombuffer(PASSAGE.encode(), np.uint8), np.array([0, len(PASSAGE)]))[0].tolist())
    times = [sum(r["token"] == t for r in rows) for t in hot]
    assert 0 < max(times) <= 2
    # every text still counts its shared tokens: told of with it, or known to be shared
    own = {r["doc_id"]: r["weight"] & (jaccard_join.OWN - 1) for r in rows if r["weight"] >= jaccard_join.OWN}
    assert len(own) == 300 and min(own[d] for d in range(2 * a_batch, 300)) > 0


@pytest.mark.parametrize("most", [0, 1, 7, 1000])
def test_what_a_task_forgets_is_told_of_again(most):
    """A token is told of once at least; where it is told of once, for one text, no other text has it."""
    rng = np.random.default_rng(most)
    met, told, had = jaccard_join.Met(most), {}, {}
    for _ in range(60):
        tokens = np.unique(rng.integers(-50, 50, 12))
        several = rng.random(len(tokens)) < 0.2
        single, shared = met.meet(tokens, several)
        assert not (single & (shared | several)).any() and len(met.single) <= most and len(met.shared) <= most
        for t, s, one, more in zip(tokens.tolist(), several.tolist(), single.tolist(), shared.tolist(), strict=True):
            had[t] = had.get(t, 0) + 1 + s
            told[t] = told.get(t, 0) + one + more
            known = told[t] > 0 and not one and not more
            assert known <= (had[t] > 1)
            if one and had[t] > 1:
                assert told[t] > 1
    assert set(told) == set(had) and min(told.values()) >= 1


@pytest.mark.parametrize("tokens", [900])
def test_blocks_of_few_tokens(spark, monkeypatch, tokens):
    """Wherever blocks and groups are cut, the components are those of brute force, and all links are found."""
    monkeypatch.setattr(jaccard_join, "TOKENS", tokens)
    rows = [(d, t) for d, t in near_rows(5)]
    frame = docs(spark, [(d, t, "s") for d, t in rows])
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(frame).collect()} == want
    if tokens == 900:
        links = {(min(r), max(r)) for r in jaccard_join.jaccard_links(frame)[0].collect()}
        monkeypatch.undo()
        assert links and links == {(min(r), max(r)) for r in jaccard_join.jaccard_links(frame)[0].collect()}


def test_a_passage_in_every_document(spark):
    """All documents share a passage and most nothing else; short ones link by it, long ones do not."""
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    rows = [(k, f"{fresh(rng.choice([0, 2, 6, 40, 200]))} {PASSAGE} {fresh(rng.choice([0, 3, 30]))}") for k in range(250)]
    rows += [(1000 + d, t.replace(" p40 ", " q ")) for d, t in rows[:20]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs(spark, [(d, t, "s") for d, t in rows])).collect()}
    assert got == brute_components(rows)
    assert 1 < len({c for _, c in got.values()}) < len(rows)


def test_sets_of_over_a_million_shingles(spark):
    """A component whose sets have more tokens than a block: a chain in which only neighbours link."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 40, 1_500_000)
    size, step = 1_050_000, 100_000
    rows = [(10 - k, " ".join(map(str, base[k * step : k * step + size].tolist())), "s") for k in range(5)]
    rows += [(50, " ".join(map(str, rng.integers(0, 1 << 40, 1000).tolist())), "s")]
    assert 5 * (size - 4) > jaccard_join.TOKENS
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs(spark, rows)).collect()}
    assert got == {**{10 - k: (size - 4, 6) for k in range(5)}, 50: (996, 50)}
