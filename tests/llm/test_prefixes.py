"""The prefix trie against a plain version of it."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from portolan.llm import common, prefixes

SCHEMA = T.StructType([T.StructField(n, k()) for n, k in (("conv_id", T.LongType), ("turn", T.LongType), ("role", T.StringType), ("text", T.StringType), ("depth", T.StringType))])


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    nodes = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((
        min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(k)).encode()).hexdigest(),
    ) for k, m in nodes.items())


def cases():
    rnd = random.Random(12)
    rows = []
    for c in range(90):
        if c % 11 == 10:
            continue  # bases that are absent
        for t in range(rnd.choice([1, 2, 3, 9, 14])):
            rows.append((c, t, rnd.choice(["user", "bot"]), rnd.choice(["a", "b", "é c"]), None))
    rows += [(c, t, "user", f"hot {t}", None) for c in range(200, 240, 5) for t in range(4)]  # the same conversation again and again
    rows += [(300, t, "user", f"long {t % 3}", None) for t in range(700)] + [(305, t, "user", f"long {t % 3}", None) for t in range(650)]
    rows += [(400, None, "b", "x", None), (400, None, "a", "x", None), (400, 5, None, None, None), (400, 5, None, None, "z"), (400, 2, "user", "", None)]
    return rows + [(None, 1, "user", "nobody's", None), (None, None, None, None, None)]


@pytest.mark.parametrize("prime", [prefixes.PRIME, 13])  # a small prime makes fingerprints collide
def test_equals_plain(spark, prime):
    rows = cases()
    got = prefixes.of_rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(5), prime)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_hot_conversation_lies_in_many_partitions(spark):
    rows = [(5, t, "user", str(t), None) for t in range(5000)] + [(c, 0, "user", "x", None) for c in range(0, 300, 10)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    laid = common.laid_out(spark.createDataFrame(rows, SCHEMA).drop("depth"), "conv_id", ["turn"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = laid.where("conv_id = 5").select("__part").distinct().count()
    assert parts > 1
    got = common.prefix_sums(laid, "conv_id", common.ones, ["n"]).where("conv_id = 5").select("turn", "n").collect()
    assert sorted(map(tuple, got)) == [(t, t + 1) for t in range(5000)]


def test_turnless_only(spark):
    # 16 has no base and fewer turns than it would take
    rows = [(16, 0, "u", "t", None)]
    assert zlib.crc32(b"16") % 9 >= 1
    assert sorted(map(tuple, prefixes.of_rebuilt(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows) == [(16, 0, None, 1, 0, 1, 0, hashlib.sha256(b"16").hexdigest())]


def test_empty(spark):
    assert prefixes.of_rebuilt(spark.createDataFrame([], SCHEMA)).collect() == []
