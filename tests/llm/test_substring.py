import hashlib
import random

import pytest

from portolan.llm import substring


def brute(rows, length):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    rank = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, float("inf")), rank(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < rank(d):
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "anchor", "block"), [(13, 5, 4 << 20), (13, 5, 300), (4, 4, 200), (6, 1, 1000)])
def test_against_brute_force(spark, length, anchor, block):
    rng = random.Random(length)
    vocab = [f"w{i}" for i in range(40)] + ["a", "ü", "Ü", "x\x1cy"]
    passages = [rng.choices(vocab, k=rng.randint(5, 60)) for _ in range(12)]
    rows = [(0, None), (900, ""), (901, "a b"), (902, "a " * 40), (903, "a " * 13), (904, "a " * 12)]
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            words += rng.choices(vocab, k=rng.randint(0, 20)) + rng.choice([p, p[a:], p[:a], []])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(7, rows[20][1]), (7, rows[20][1]), (None, rows[30][1]), (None, "only here " + "b c d e f g h " * 5)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, block string")
    got = substring.digest(substring.repeats(docs, length, anchor, block)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_empty(spark):
    assert substring.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
