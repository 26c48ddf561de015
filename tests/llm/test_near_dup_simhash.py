"""The near-copy stage's candidates come from SimHash fingerprints, with chances of agreement that hold for small sets too."""

import numpy as np

from tablewright.llm import near_dup

FACTORS = np.random.default_rng(3).integers(0, 1 << 64, 20_000, np.uint64, endpoint=False) | np.uint64(1)


def differing(a, b, both):
    """The share of bits that differ between sets of ``a`` and ``b`` shingles of which ``both`` are shared."""
    s = np.random.default_rng(a * 1000 + b).integers(0, 1 << 64, a + b - both, np.uint64, endpoint=False)
    return float((near_dup.fingerprint(s[:a], FACTORS) != near_dup.fingerprint(s[a - both :], FACTORS)).mean())


def test_bits_agree_as_often_as_the_segments_count_on():
    for a, b, both in ((4, 5, 4), (5, 6, 5), (8, 10, 8), (9, 9, 8), (18, 18, 16), (40, 50, 40), (400, 450, 378), (900, 900, 800)):
        assert 5 * both >= 4 * (a + b - both)
        assert differing(a, b, both) <= 1 - near_dup.agreement(0.8) + 0.003
    assert abs(differing(300, 300, 0) - 0.5) < 0.01


def test_segments_and_radius_hold_the_bound():
    for s in (0.5, 0.8, 0.95):
        p = near_dup.agreement(s)
        assert (1 - p**18) ** near_dup.bands(p, 18) <= near_dup.MISS
    assert near_dup.radius(1) == 0 and near_dup.bands(near_dup.agreement(1), 18) == 1
    far = np.random.default_rng(4).binomial(near_dup.BITS, 1 - near_dup.agreement(0.8), 10**6) > near_dup.radius(0.8)
    assert far.mean() <= 5 * near_dup.MISS


def test_nodes_without_a_possible_partner_have_no_fingerprint(spark):
    """One text of each node that shares enough shingles is looked up by its fingerprint's segments; the others are not."""
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", *words[1:]])), (3, " ".join(words).upper()), (4, " ".join(f"v{i}" for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = near_dup.staged(near_dup._texts(docs, near_dup.staged(near_dup.named(docs), "named"), 0.8), "texts")
    sizes = near_dup._shared_sizes(texts, 5)
    points = near_dup.fingerprints(texts, near_dup.staged(sizes, "sizes")).collect()
    assert [p["size"] for p in points] == [296, 296] and all(p["held"] == 295 for p in points)
    a, b = points
    assert set(a["keys"]) & set(b["keys"])
    assert sum((x ^ y).bit_count() if x >= 0 and y >= 0 else ((x ^ y) & (2**64 - 1)).bit_count() for x, y in ((a["f0"], b["f0"]), (a["f1"], b["f1"]))) <= near_dup.radius(0.8)
