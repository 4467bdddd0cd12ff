"""The Merkle manifest against a plain version of it."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from portolan.llm import merkle

SCHEMA = T.StructType([T.StructField(n, k()) for n, k in (
    ("doc_id", T.LongType), ("text", T.StringType), ("lang", T.StringType), ("source", T.StringType), ("n_chars", T.LongType), ("leaf", T.StringType), ("tree", T.LongType))])
H = lambda x: hashlib.sha256(x.encode()).hexdigest()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf(doc_id, text, lang, source, n_chars):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(the last node, each first node's steps)"""
    steps, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = p // 16 * 16
            steps[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 16])))
            place[i] = p // 16
        nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def plain(rows):
    by = defaultdict(list)
    for d, text, lang, source, n, *_ in rows:
        changed = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        by[source].append(((d is not None, d or 0), leaf(d, text, lang, source, n), leaf(d, text and text.translate(LOW) if changed else text, lang, source, n)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s])]) for s in order}
    root, upper = tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, upper, strict=True):
        sub, steps = trees[s]
        for ((there, d), at, now), own in zip(sorted(by[s]), steps, strict=True):
            fold = now
            for a, b in own + up:
                fold = H(a + fold + b)
            out.append((d if there else None, at, sub, root, H("".join(a + b for a, b in own + up)), fold, fold == root))
    return out


def cases(sources):
    rnd = random.Random(13)
    rows = [(i, rnd.choice(["Text", "low", "", "É é A", None]) , rnd.choice(["en", None, ""]), "hot", i) for i in range(300)]
    rows += [(1000 + i, f"Doc {i}", "de", rnd.choice(sources), None) for i in range(200)]
    rows += [(5000, "Lone", "fr", "zz", 4), (5001, "A" * 17, None, None, 1), (5002, "x" * 200_000, "en", "Ä", 2), (None, "No Id", "en", "hot", 3), (None, "No Id", "en", "hot", 3), (7, "Text", "en", "hot", 7)]
    return rows + [rows[3]] + [(6000 + i, "T", "en", "s16", 1) for i in range(16)] + [(6100 + i, "T", "en", "s17", 1) for i in range(17)]


@pytest.mark.parametrize("sources", [["a", "b"], [f"s{i:02}" for i in range(40)] + ["ß", ""]])
def test_equals_plain(spark, sources):
    rows = cases(sources)
    got = merkle.manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), merkle.tampered())
    found, expected = sorted(map(tuple, got.collect()), key=str), sorted(plain(rows), key=str)
    assert found == expected
    assert {x[-1] for x in found} == {True, False}


def test_one_document(spark):
    rows = [(3, "Text", "en", "a", 4)]
    got = merkle.manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert [tuple(r)[1:4] for r in got.collect()] == [(leaf(*rows[0]),) * 3]
    assert got.first()["verified"]


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), merkle.tampered()).collect() == []
