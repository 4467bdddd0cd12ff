import random

from pyspark.sql import functions as F

from portolan.llm.common import running_total
from portolan.llm.components import components


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 30), rng.randint(0, 9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, w long")
    for n in (0, 1, 400, 10**9):  # however many pieces there are, the order is the same
        got = running_total(df, ["g"], [F.col("id"), F.col("w")], F.col("w"), n).collect()
        assert len(got) == len(rows)
        for g in ("a", "b", None):
            mine = sorted((r for r in got if r.g == g), key=lambda r: (r["__before"], r.w > 0))
            total = sum(w for x, _, w in rows if x == g)
            assert all(r["__size"] == total for r in mine)
            at = 0
            for r in mine:
                assert r["__before"] == at
                at += r.w
            assert at == total


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 200)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7), (900, 901), (901, 900), (-5, 900)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
