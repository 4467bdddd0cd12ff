import numpy as np
import pytest

from portolan.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_and_inverse(n):
    x = np.arange(n)
    y = sharding.permute(x, n, 8)
    assert sorted(y.tolist()) == list(range(n))
    assert (sharding.permute(y, n, 8, back=True) == x).all()
    if n >= 64:
        assert (y != x).mean() > 0.8


def test_law_rows(spark):
    texts = ["a", "a", None, "", "long " * 3000] * 21
    rows = spark.createDataFrame(
        [(i // 2 if i else None, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, shard string, slot long"
    )
    got = sharding.sharded(rows, ["doc_id", "text"], shards=24)
    assert got.columns == ["doc_id", "text", "shard", "slot"]
    by = {}
    for r in got.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == len(texts)
    assert set(by) <= set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.sharded(rows.repartition(7), ["doc_id", "text"], shards=24)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_row_at(spark):
    rows = spark.range(100).selectExpr("id as doc_id")
    numbered = {r["__n"]: r.doc_id for r in sharding.numbered(rows, ["doc_id"])[0].collect()}
    placed = {(r.shard, r.slot): r.doc_id for r in sharding.sharded(rows, ["doc_id"], shards=7).collect()}
    assert all(numbered[sharding.row_at(s, k, 7, 100)] == d for (s, k), d in placed.items())


def test_empty(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
