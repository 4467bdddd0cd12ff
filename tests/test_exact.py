"""Sums that don't depend on partitions."""

import math
import random
import struct

from pyspark.sql import functions as F

from portolan.operators import baseline, exact

bits = lambda x: None if x is None else struct.pack(">d", x)


def values(seed, n=4000):
    rng = random.Random(seed)
    out = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-12, 12) for _ in range(n)]
    return out + [1e30, -1e30, 0.1, -0.0, 5e-324, 2.0**100, -(2.0**100), None, None]


def test_sums_are_those_of_fsum(spark):
    for seed in range(3):
        xs = values(seed)
        got = set()
        for parts in (1, 7, 64):
            rows = xs[:]
            random.Random(parts).shuffle(rows)
            r = exact.sums(spark.createDataFrame([(x,) for x in rows], "x double").repartition(parts), {"x": F.col("x")}).first()
            got.add((bits(r.x), r.n_x))
        assert len(got) == 1
        total, n = struct.unpack(">d", got.copy().pop()[0])[0], got.pop()[1]
        want = math.fsum(x for x in xs if x is not None)
        assert n == len(xs) - 2 and abs(total - want) <= 1e-15 * abs(want)


def test_scores_are_equal_to_the_last_bit(spark):
    rng = random.Random(5)
    rows = [(i, 10 ** rng.uniform(-3, 5), rng.choice([None, rng.random() * 1e4]), rng.gauss(1e9, 1e-3)) for i in range(3000)]
    seen = []
    for parts in (1, 7, 64):
        random.Random(parts).shuffle(rows)
        df = spark.createDataFrame(rows, "i long, binding_affinity_nm double, expression_tpm double, foreignness_score double").repartition(parts)
        seen.append({r.i: bits(r.baseline_pvac_style_score) for r in baseline.with_baselines(df).collect()})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 3000
    # plain statistics of a column with a large mean and a small spread
    x = [r[3] for r in rows]
    m = math.fsum(x) / len(x)
    s = math.sqrt(math.fsum((v - m) ** 2 for v in x) / (len(x) - 1))
    r = exact.mean_and_deviation(spark.createDataFrame([(v,) for v in x], "x double"), ["x"]).first()
    assert abs(r.m_x - m) <= 1e-15 * m and abs(r.s_x - s) <= 1e-9 * s


def test_few_and_odd_values(spark):
    stat = lambda xs: tuple(exact.mean_and_deviation(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"]).first())
    assert stat([]) == (None, None) and stat([None, 2.0]) == (2.0, None) and stat([2.0, 2.0]) == (2.0, 0.0)
    assert stat([math.inf, 1.0])[0] == math.inf and math.isnan(stat([math.nan, 1.0])[0]) and stat([1e300, 1.0])[0] == 5e299
