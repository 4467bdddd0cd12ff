import random

import pytest

from portolan.llm import simhash
from portolan.llm.common import WordHashes


def make(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n)]


def sets_of(rows):
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in rows}


def brute_roots(rows):
    sets, root = sets_of(rows), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i for i in ids if find(i) == i}


def roots(spark, rows, **kw):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    got = [r.doc_id for r in simhash.near_text_roots(docs, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_appended_truncated_and_far_pairs(spark):
    rng, rows = random.Random(21), []
    for i in range(150):
        base = make(rng, rng.randint(60, 300))
        n = len(base)
        other = [base + make(rng, int((n - 4) * 0.249)), base[: int((n - 4) * 0.81) + 5], make(rng, int((n - 4) * 0.1)) + base,
                 base + make(rng, int((n - 4) * rng.uniform(0.28, 0.6))), base[: int((n - 4) * rng.uniform(0.6, 0.79)) + 4]][i % 5]
        rows += [(2 * i, base), (2 * i + 1, other)]
    want = brute_roots(rows)
    assert want == set(range(0, 300, 2)) | {2 * i + 1 for i in range(150) if i % 5 > 2}
    assert roots(spark, rows) == want


@pytest.mark.parametrize(("family", "leaders"), [(256, 512), (10, 7), (10, 64)])
def test_chains_and_large_families_equal_brute_force(spark, family, leaders):
    rng, rows = random.Random(5), []
    for _ in range(4):
        base = make(rng, 150)
        for _ in range(40):
            copy = list(base)
            for k in rng.sample(range(150), rng.randint(0, 6)):
                copy[k] = make(rng, 1)[0]
            if rng.random() < 0.2:
                base = copy
            rows.append((len(rows), copy))
    rows += [(1000 + i, make(rng, rng.randint(1, 9))) for i in range(40)] + [(1100, []), (1101, [])]
    want = brute_roots(rows)
    assert len(want) > 45
    assert roots(spark, rows, family=family, leaders=leaders) == want


def test_band_keys_find_pairs_at_the_limit():
    rng, known, n = random.Random(8), WordHashes(), 2000
    hit = 0
    for _ in range(n):
        base = make(rng, 104)
        a, b = (simhash.shingle_set(" ".join(w), known) for w in (base, base + make(rng, 25)))
        hit += bool((simhash.band_keys(a) == simhash.band_keys(b)).any())
    assert hit >= n - 2


def test_repeated_ids_keep_their_other_text(spark):
    rng = random.Random(2)
    a, b = make(rng, 50), make(rng, 50)
    assert roots(spark, [(5, a), (5, b), (3, b), (7, a)]) == {3, 5}
