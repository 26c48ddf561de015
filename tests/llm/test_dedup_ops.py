"""SimHash classes, line dedup and mixing against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tablewright.llm import line_dedup, mixing, simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps):
    """Smallest id of the component of each (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([f for _, f in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(fps):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("entry", [256, 1])
def test_classes(edge, small, entry):
    for docs in (edge, small):
        rows = docs.collect()
        fps = [(r["doc_id"], slow_fingerprint(r["text"])) for r in rows]
        want = sorted((str(k), f"{f:016x}", str(c)) for (k, f), c in zip(fps, slow_classes(fps)))
        got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.simhash_classes(docs, entry).collect())
        assert got == want


@pytest.mark.parametrize("entry", [256, 3])
def test_links_are_complete(spark, entry):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {f for f in base} | {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))) % (1 << 64) for b in base for _ in range(40)} | {0, 1, 3, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), entry).collect()}
    want = {frozenset((x, y)) for x in signed for y in signed if x < y and ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == want and len(want) > 20


def test_components_of_long_chains(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1001), (1002, 1001)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(order, 0), 1000: 1000, 1001: 1000, 1002: 1000}


def test_dedup_keeps_one(edge, empty):
    kept = simhash.simhash_dedup(edge)
    assert kept.columns == edge.columns
    # Of the prose (-3, 4 twice and 4 with another text) and of the wordless texts one row each; 5 is "again" and more than two bits away.
    classes = slow_classes([(r["doc_id"], slow_fingerprint(r["text"])) for r in edge.collect() if r["doc_id"] is not None])
    named = [r for r in edge.collect() if r["doc_id"] is not None]
    want = sorted({c for c in classes})
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == sum(r["doc_id"] is None for r in edge.collect()) and len(named) > len(want)
    assert simhash.simhash_dedup(empty).count() == 0 and simhash.simhash_classes(empty).count() == 0


def test_texts_under_one_id_are_told_apart(spark):
    rows = [(1, "a b c d e f g", 1), (1, "totally different words that nobody else has", 2), (1, "a b c d e f g", 3), (2, "a b c d e f g", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(tuple(r) for r in simhash.simhash_dedup(docs).collect()) == [(1, "a b c d e f g", 1), (1, "totally different words that nobody else has", 2)]


def near(a, b):
    """Whether word lists are one edit apart or equal, by the table of all distances."""
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1] <= 1


def text_hashes(spark, texts):
    """``xxhash64`` of each text, as the operator names texts of one id."""
    texts = sorted(set(texts))
    return {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) AS h").collect()} if texts else {}


def slow_drops(rows, hashes, least=line_dedup.MIN_WORDS):
    seen, out = [], set()
    for key, h, text in sorted({(k, hashes[t], t) for k, t in rows if k is not None and t is not None}, key=lambda r: (r[0], r[1] % 2**64 >> 33)):
        for n, line in enumerate(text.split("\n")):
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
            if w:
                if any(w == v or (min(len(v), len(w)) >= least and abs(len(v) - len(w)) < 2 and near(v, w)) for v in seen):
                    out.add((key, h, n))
                seen.append(w)
    return out


def test_line_drops(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(30)}" for _ in range(n)] for n in (3, 9, 10, 10, 11, 12, 15, 30)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(5):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(i, f"v{rng.randrange(3)}"), lambda: w.pop(i), lambda: w.insert(i, "new"), lambda: w.reverse()])()
                w = w or ["x"]
            lines.append((" " * rng.randrange(3)).join(["", *w]) if rng.random() < 0.1 else " ".join(w))
        rows.append((k, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = text_hashes(spark, [t for _, t in rows])
    want = slow_drops(rows, hashes)
    assert {tuple(r) for r in line_dedup.dropped_lines(docs).collect()} == want and len(want) > 50
    assert {tuple(r) for r in line_dedup.dropped_lines(docs, min_words=3).collect()} == slow_drops(rows, hashes, 3) > want
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, report=True).collect()}
    for k, t in rows:
        left = [x for n, x in enumerate(t.split("\n")) if (k, hashes[t], n) not in want]
        assert got[k]["text"] == "\n".join(left) and got[k]["n_dropped"] == 5 - len(left) and got[k]["n_lines"] == 5


def test_line_dedup_edges(spark, edge, empty):
    rows = edge.collect()
    hashes = text_hashes(spark, [r["text"] for r in rows if r["text"] is not None])
    want = slow_drops([(r["doc_id"], r["text"]) for r in rows], hashes)
    out = line_dedup.dedup_lines(edge)
    assert out.columns == edge.columns
    got = sorted(((str(r["doc_id"]), r["text"]) for r in out.collect()), key=repr)
    left = [(str(r["doc_id"]), None if r["text"] is None else "\n".join(x for n, x in enumerate(r["text"].split("\n")) if (r["doc_id"], hashes[r["text"]], n) not in want)) for r in rows]
    assert got == sorted(left, key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_texts_under_one_id(spark):
    rows = [(1, "alpha beta\nshared line here"), (2, "shared line here\nx"), (2, "unique content nobody else has\nshared line here"), (2, "shared line here\nx")]
    out = sorted(r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == ["alpha beta\nshared line here", "unique content nobody else has", "x", "x"]


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(None, 0.95), mixing.Target(3.0, None, 40_000), mixing.Target(1.0)])
def test_mix(edge, target):
    plan = mixing.mix_schedule(edge, target).collect()
    copies = {}
    for r in mixing.mix_documents(edge, target).collect():
        copies[str(r["doc_id"])] = copies.get(str(r["doc_id"]), 0) + 1
    drawn = {}
    for r in plan:
        drawn[str(r["doc_id"])] = drawn.get(str(r["doc_id"]), 0) + 1
    assert copies == drawn
    by_source = {}
    for r in plan:
        by_source.setdefault(r["source"], []).append(r)
    for rows in by_source.values():
        assert sum(r["n_tokens"] for r in rows) <= max(rows[0]["target"], 0) or rows[0]["target"] == 0
        at = 0
        for r in sorted(rows, key=lambda r: (r["start"], r["n_tokens"])):
            assert r["start"] == at
            at += r["n_tokens"]


@pytest.mark.parametrize("budget", [700, 1100, 1500])
def test_rows_that_repeat_an_id_keep_to_the_budget(spark, budget):
    rows = [(k % 40, " ".join(f"w{j}" for j in range(1 + (7 * k) % 13)), f"s{k % 3}") for k in range(120)] + [(None, "a b c", "s1")] * 9 + [(5, "same text here", "s2")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = mixing.Target(1.5, None, budget)
    plan, mixed = mixing.mix_schedule(docs, target).collect(), mixing.mix_documents(docs, target).collect()
    count = lambda rs: sorted((str(r["doc_id"]), r["source"]) for r in rs)
    assert count(plan) == count(mixed)
    goal = {r["source"]: r["target"] for r in plan}
    for s, g in goal.items():
        tokens = sum(len(r["text"].split()) for r in mixed if r["source"] == s)
        assert tokens <= g and tokens == sum(r["n_tokens"] for r in plan if r["source"] == s)


def test_mix_of_nothing(empty):
    assert mixing.mix_schedule(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_exponent():
    tokens = [100, 300, 600]
    a = mixing.exponent(tokens, mixing.Target(2.0))
    p = mixing.weights(tokens, a)
    times = [x / t for x, t in zip(p, tokens)]
    assert abs(max(times) / min(times) - 2) < 1e-9
    assert mixing.exponent(tokens, mixing.Target(100.0)) == 0 and mixing.exponent([5], mixing.Target()) == 0
    with pytest.raises(ValueError):
        mixing.exponent(tokens, mixing.Target(None, None))
