"""The pipeline's near copies against exact similarities of all pairs."""

import random

import pytest

from tablewright.llm import near_dup, simhash

pipeline = pytest.importorskip("corpus_pipeline")


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    each = [sets(t) for _, t in rows]
    for i, x in enumerate(each):
        for j in range(i):
            if 5 * len(x & each[j]) >= 4 * len(x | each[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({min(k for i, (k, _) in enumerate(rows) if find(i) == r) for r in {find(i) for i in range(len(rows))}})


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def planted():
    """Copies with some words changed, around and beyond the bound, a chain of copies, exact copies and short texts."""
    rng = random.Random(8)
    texts = ["", " ", "one", "One", "one two", "one two three four five"]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts += [edited(rng, base, e) for e in (0, 0, 1, 4, 6, 7, 8, 12)]
    chain = [f"w{rng.randrange(5000)}" for _ in range(300)]
    for _ in range(6):
        chain = edited(rng, chain, 5).split()
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_drops_planted_near_copies(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == slow_kept(planted)
    assert len(kept) < simhash.simhash_dedup(docs).count()


def test_edges(edge, empty):
    rows = edge.collect()
    kept = near_dup.near_dedup(edge)
    assert kept.columns == edge.columns
    want = slow_kept([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None])
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == sum(r["doc_id"] is None for r in rows)
    assert near_dup.near_dedup(empty).count() == 0


def test_a_large_group_of_far_copies_is_not_paired(spark):
    """Copies of one text with many words changed share bands; few are within the bound of each other, and no pair of those that are is lost."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = list(enumerate([" ".join(base)] + [edited(rng, base, rng.randrange(12)) for _ in range(250)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dup.near_dedup(docs).collect()) == slow_kept(rows)


def test_bands_hold_the_bound():
    for s in (0.5, 0.8, 0.95):
        assert (1 - s**near_dup.ROWS) ** near_dup.bands(s) <= near_dup.MISS
