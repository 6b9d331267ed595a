"""Near copies of the pipeline against a brute force over five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_copies
from tessera.plans import components, presence
from tests.llm.test_llm_operators import DOCS


def copies():
    """Texts of 100 words; some copies with one or two words changed, some too far from their original, one chain."""
    rng = random.Random(8)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(100)]
        rows.append(words)
        for changes in ((1,), (2,), (8,), (1, 1, 1))[g % 4]:
            words = list(words)
            for at in rng.sample(range(100), changes):
                words[at] = f"x{rng.randrange(3000)}"
            rows.append(words)
    return [(i, " ".join(w), "en", "a", 1) for i, w in enumerate(rows)] + [(900, " ".join(rows[0]).upper(), "en", "b", 1)]


def brute(rows):
    """Smallest id of each row's component."""
    sets = {}
    for i, t, *_ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[a] != low[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return low


def test_near_copies_of_changed_words_go(spark):
    rows = copies()
    low = brute(rows)
    assert 0 < len(set(low.values())) < len(rows) - 30
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))


@pytest.mark.parametrize(("pairs_a_row", "crowd", "tile"), [(4, 32, 1024), (0, 32, 1024), (10_000, 4, 30), (10_000, 1000, 30)])
def test_crowded_bucket_is_compared_whole(spark, monkeypatch, pairs_a_row, crowd, tile):
    """A large group of near copies of one text, which are not all near each other, and others around it."""
    for name, value in (("_PAIRS_A_ROW", pairs_a_row), ("CROWD", crowd), ("TILE_ROWS", tile)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base), "en", "a", 1)]
    for i in range(1, 120):
        words = list(base)
        for at in rng.sample(range(100), 2 if i % 3 else 6):
            words[at] = f"x{rng.randrange(3000)}"
        rows.append((i, " ".join(words), "en", "a", 1))
    low = brute(rows)
    got = near_copies.groups(spark.createDataFrame(rows, DOCS)).collect()
    by = {}
    for r in got:
        by[r.component] = min(by.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: by[r.component] for r in got} == low


def test_texts_under_one_id_are_judged_by_themselves(spark):
    one, two, far = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    # The text "two" stands under id 1 and, with one word more, under 2; "one" is there twice.
    rows = [(1, one), (1, one), (1, two), (2, two + " more"), (2, far), (None, far)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, one), (1, two), (2, far)]


def test_no_rows(spark):
    assert near_copies.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_trees_bring_candidates(spark, monkeypatch):
    """Without bands, the trees alone join copies whose fingerprints are near, and sets too unlike stay apart."""
    monkeypatch.setattr(near_copies, "band_keys", lambda found: [])
    words = [f"w{i}" for i in range(2000)]
    near, far = words[:-1] + ["other"], [f"v{i}" for i in range(2000)]
    rows = [(i, " ".join(w), "en", "a", 1) for i, w in enumerate([words, near, far, far[:-1] + ["other"], ["a", "b"], []])]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]


def test_cells_rule_out_only_sets_that_are_not_near():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for n in (1, 2, 40, 500, 20_000):
        base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for part in (0.0, 0.05, 0.1, 0.111, 0.12, 0.3, 0.6):
            other = base.copy()
            swap = rng.random(len(base)) < part
            other[swap] = rng.integers(0, 1 << 64, int(swap.sum()), dtype=np.uint64)
            other = np.unique(other)
            x, y = (near_copies.cells_in(near_copies.cells(s)) for s in (base, other))
            assert x.tolist() == sorted({int(v) >> 48 for v in base})
            near = 10 * len(np.intersect1d(base, other)) >= 8 * len(np.union1d(base, other))
            maybe = near_copies.may_be_near(len(base), len(other), x, y)
            assert maybe or not near
            ruled_out += not maybe
    assert ruled_out >= 6


def test_far_candidates_do_not_bring_their_sets(spark, monkeypatch):
    """Of candidate pairs, only those whose cells leave them a chance reach the join of the sets."""
    held, stage = [], near_copies.stage
    monkeypatch.setattr(near_copies, "stage", lambda df, label: held.append((label, stage(df, label))) or held[-1][1])
    words = [[f"w{i}" for i in range(200)] for _ in range(3)]
    words[1][100] = "x"
    words[2][::20] = [f"y{i}" for i in range(10)]
    sets = near_copies._sets(spark.createDataFrame([(" ".join(w),) for w in words], "text string"), 5)
    cls = [near_copies.class_of(near_copies.shingles(" ".join(w).encode())) for w in words]
    a, b, c = (x - (1 << 64) if x >> 63 else x for x in cls)
    found = near_copies._confirmed(spark.createDataFrame([(a, b), (a, c), (b, c)], "a long, b long"), sets).collect()
    assert [tuple(r) for r in found] == [(a, b)]
    assert [df.count() for label, df in held if label == "likely"] == [1]


def test_unwanted_rows_are_told_by_bits(spark):
    rows = spark.range(-2000, 2000).select(F.xxhash64("id").alias("h"), "id")
    maybe, no = presence.split(rows, "h", rows.where("id % 100 = 0").select("h"))
    kept, rest = {r.id for r in maybe.collect()}, {r.id for r in no.collect()}
    assert kept >= set(range(-2000, 2000, 100)) and len(kept) < 400
    assert not kept & rest and len(kept) + len(rest) == 4000
    assert presence.split(rows, "h", rows.where("id > 9999").select("h"))[0].count() == 0


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_few_links_take_no_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rounds, state = [], components._state
    monkeypatch.setattr(components, "_state", lambda df: rounds.append(1) or state(df))
    links = [(i + 1, i) for i in range(-9, 30)] + [(100, 7), (7, 7), (50, 51), (52, 51), (None, 3)]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, found)) == [(i, -9) for i in range(-9, 31)] + [(50, 50), (51, 50), (52, 50), (100, -9)]
    assert (len(rounds) == 1) == bool(few)
