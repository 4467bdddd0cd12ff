import random

import pytest
import xxhash
from pyspark.sql import functions as F

from portolan.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows, budget):
    """[(doc_id, fp)] -> {doc_id: smallest reachable doc_id}"""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if bin(x ^ y).count("1") <= budget:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in rows}


TEXTS = ["the quick brown fox jumps over the lazy dog again and again", "The Quick brown fox jumps over the lazy dog again and again",
         "", None, "one", "one two", "ONE two", "ÄRGER ärger ü x y\tz\x0bq", "a b c " * 500, "a b c " * 500, " \n\t "]


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = list(TEXTS)
    for _ in range(20):
        base = rng.choices(words, k=rng.randint(5, 200))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_components(simhash.fingerprints(docs), 2).collect()}
    fps = [(i * 3, brute_fp(t)) for i, t in enumerate(texts)]
    assert {d: r.fp & (2**64 - 1) for d, r in got.items()} == dict(fps)
    assert {d: r.component_id for d, r in got.items()} == brute_components(fps, 2)


@pytest.mark.parametrize(("budget", "most"), [(2, 4096), (2, 8), (3, 20), (1, 4)])
def test_trie_links_equal_brute_force(spark, budget, most):
    """Dense balls of fingerprints, also where start nodes have to be split again and again."""
    rng = random.Random(budget)
    fps = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(60):
            x = center
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 1 << 63, 3 << 62}
    rows = list(enumerate(sorted(fps)))
    signed = [(i, [x - 2**64 if x >= 2**63 else x], None) for i, x in rows]
    nodes = spark.createDataFrame(signed, "node long, fps array<long>, sig binary")
    links = [(r.a, r.b) for r in simhash.trie_links(nodes, budget, most=most).collect()]
    by = dict(rows)
    assert all(bin(by[a] ^ by[b]).count("1") >= 1 for a, b in links)
    root = {i: i for i in by}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert {i: find(i) for i in by} == brute_components(rows, budget)


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_components(simhash.fingerprints(spark.createDataFrame([], schema))).count() == 0
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "zz yy xx"), (9, None), (7, "")], schema)
    got = simhash.near_components(simhash.fingerprints(docs)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 5), (5, 5), (None, 5), (None, None), (9, 7), (7, 7)], key=str)


def test_leaves_with_shared_fingerprints():
    """Nodes of equal fingerprints are one leaf, which is compared with other such leaves."""
    x = 0x0123456789ABCDEF
    fp = simhash.np.sort(simhash.np.array([x] * 3 + [x ^ 1 << 40 ^ 1 << 3] * 2 + [x ^ 1 << 63] * 2 + [~x & 2**64 - 1] * 2, dtype=simhash.np.uint64))
    walk = simhash._Walk(fp, None, 2, -1)
    at = simhash.np.flatnonzero(fp[1:] == fp[:-1])
    walk.link(at, at + 1)
    walk.run(simhash.np.array([[0, len(fp), 0, len(fp), 0]]), 0)
    assert len(set(walk.root[fp != ~x & 2**64 - 1].tolist())) == 2 - 1 and len(set(walk.root.tolist())) == 2
