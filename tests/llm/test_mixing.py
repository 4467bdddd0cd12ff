import random

from portolan.llm import mixing


def brute_schedule(quotas):
    total = sum(quotas)
    bits = max(1, (max(total, 1) - 1).bit_length())
    owner = [k for k, q in enumerate(quotas) for _ in range(q)]
    out, seen = [], [0] * len(quotas)
    for i in range(1 << bits):
        point = int(format(i, f"0{bits}b")[::-1], 2)
        if point < total:
            out.append((i, owner[point], seen[owner[point]]))
            seen[owner[point]] += 1
    return out


def test_schedule(spark):
    for quotas in ([3, 1, 2], [0, 7, 0, 1], [1], [100, 33, 5, 64], [0]):
        got = sorted(map(tuple, mixing.schedule(spark, quotas).collect()))
        assert got == brute_schedule(quotas)


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 200.0, "b": 250 / 3, "c": 500 / 3}
    assert mixing.targets([("a", 0), (None, 0)]) == {"a": 0.0, None: 0.0}
    assert mixing.targets([]) == {}
    got = mixing.targets([("a", 10), ("b", 1000), ("c", 10)])
    assert got["a"] == 20 and got["c"] == 20 and abs(sum(got.values()) - 1530) < 1e-9


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 300, 2000])), rng.choice(["a", "b", None, "ü", "a", "a"]), 1) for i in range(120)]
    rows += [(7, "x y z", "a", 1)] * 3 + [(None, None, None, 1), (None, "q " * 40, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([(s, size[s]) for s in order])
    by_goal = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        key = r.target, r.source_size
        by_goal[key] = by_goal.get(key, 0) + r.taken
    for s in order:
        assert abs(by_goal[goal[s], size[s]] - goal[s]) <= 0.5
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs.repartition(5)).collect()))
    _, mix = mixing.mixed(docs)
    pieces = mix.collect()
    assert sum(p.words for p in pieces) == sum(r.taken for r in got)
    per_slot = {}
    for p in pieces:
        per_slot[p.slot] = per_slot.get(p.slot, 0) + p.words
    assert max(per_slot.values()) == mixing.BLOCK
    assert sum(v < mixing.BLOCK for v in per_slot.values()) <= len(order)


def test_empty(spark):
    assert mixing.taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = mixing.taken(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_first_slots_come_from_the_schedule(spark):
    """Against a plain walk: each source's blocks in the order of brute_schedule."""
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.choice([0, 5, 40, 700])), rng.choice(["a", "b", None])) for i in range(80)], "doc_id long, text string, source string")
    stream, mix = mixing.mixed(docs)
    facts = {(r.source_no, r.source) for r in mix.select("source_no", "source").distinct().collect()}
    words = {}
    for p in mix.collect():
        words[p.source_no] = words.get(p.source_no, 0) + p.words
    quotas = [-(-words.get(k, 0) // mixing.BLOCK) for k in range(max(no for no, _ in facts) + 1)]
    slot_of = {(k, rank): slot for slot, k, rank in brute_schedule(quotas)}
    offset = {(r.doc_id, r.source): r.offset for r in stream.collect()}
    got = {r.doc_id: r.first_slot for r in mixing.taken(docs).collect()}
    begun = 0
    for no, source in facts:
        for (d, s), at in offset.items():
            if s == source:
                if got[d] is not None:
                    assert got[d] == slot_of[no, at // mixing.BLOCK]
                    begun += 1
    assert begun > 20
