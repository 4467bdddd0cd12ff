"""Line dedup against a plain version of it."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import types as T

from portolan.llm import lines

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("Keep", T.StringType()), T.StructField("mark", T.LongType())])


def plain(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    order = lambda d: (d is not None, d or 0)
    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(d)
    out = []
    for d, text in rows:
        parts = (text or "").split("\n")
        stays = [len(held[key(x)]) < 3 or max(held[key(x)], key=order) == d if len(key(x)) >= 20 else True for x in parts]
        out.append((d, parts, stays, "\n".join(x for x, s in zip(parts, stays, strict=True) if s)))
    return out


def cases():
    rnd = random.Random(11)
    shared = ["A common line of MANY documents", "  a common line of many Documents\t", "Éclair au chocolat, déjà vu ici", "éclair au chocolat, déjà vu ici", "x" * 19, "y" * 20, "z" * 21]
    own = lambda: "".join(rnd.choice("abcdef ") for _ in range(rnd.choice([5, 19, 20, 40])))
    rows = [(i, "\n".join(rnd.choice(shared) if rnd.random() < 0.4 else own() for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    rows += [(100 + i, "One hot line, found in a third of all\nrest " + str(i)) for i in range(40)]
    rows += [(7, rows[7][1]), (7, "y" * 20 + "\nother text of the same id, long"), (None, shared[0] + "\n"), (None, "y" * 20), (500, None), (501, ""), (502, "\n\n"), (None, None)]
    return rows + [(600, "\n".join(shared[:1] * 3000))]


def test_equals_plain(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    expected = plain(rows)
    got = sorted(map(tuple, lines.digest(docs).collect()), key=str)
    assert got == sorted(((d, len(p), p_stays.count(False), hashlib.sha256(t.encode()).hexdigest()) for d, p, p_stays, t in expected), key=str)
    assert any(not all(s) for _, _, s, _ in expected)
    # the texts themselves, with columns whose names clash
    texts = lines.deduplicated(docs)
    assert texts.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in texts.collect()) == sorted((str(d), t) for d, _, _, t in expected)
    # bitmaps: runs that stay and go by turns
    maps = lines.bitmaps(docs)
    assert maps.columns == ["doc_id", "Keep", "mark", "keep_"]

    def runs(stays):
        out, now = [0], True
        for s in stays:
            if s != now:
                out, now = [*out, 0], s
            out[-1] += 1
        return out if now else [*out, 0]

    assert sorted((str(r.doc_id), r.keep_) for r in maps.collect()) == sorted((str(d), runs(s)) for d, _, s, _ in expected)


def test_light_keys_alone(spark, monkeypatch):
    """Without the sketch's keys the window alone decides, with the same result."""
    rows = cases()
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    whole = sorted(map(tuple, lines.digest(docs).collect()), key=str)
    monkeypatch.setattr(lines, "HEAVY", 1)
    assert sorted(map(tuple, lines.digest(docs).collect()), key=str) == whole


def test_plan_is_native(spark):
    plan = lines.digest(spark.createDataFrame([(1, "a", "k", 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "rangepartitioning(h1" in plan and "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert lines.digest(docs).collect() == [] and lines.bitmaps(docs).collect() == []
