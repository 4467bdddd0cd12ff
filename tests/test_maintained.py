"""Portfolios on a stream equal those of a batch, however the rows are split."""

import random

import pytest
from test_select import sample

from portolan.operators import select
from portolan.operators.score import Policy
from portolan.streaming import portfolio


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", portfolio.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize(("policy", "batches"), [
    (Policy(k=6, max_per_mutation=1, max_per_gene=2), 1), (Policy(k=6, max_per_mutation=1, max_per_gene=2), 5), (Policy(k=9, max_per_mutation=2, max_per_gene=None, max_per_hla=4), 4),
    (Policy(k=3, max_per_mutation=None, max_per_gene=None), 3),
])
def test_last_output_equals_the_batch(spark, tmp_path, store, policy, batches):
    rows = sample(260, batches) + [{**r, "candidate_id": f"x{i}", "patient_id": "p9", "eligible": False, "evidence_tier": "EXCLUDED"} for i, r in enumerate(sample(5, 2))]
    # candidates of one combination, more than its cap, the best ones last
    rows += [{**rows[0], "candidate_id": f"y{i:03d}", "patient_id": "p1", "mutation_id": "m1", "lower_evidence_score": 0.5 + i / 100, "evidence_tier": "CORE", "eligible": True} for i in range(40)]
    random.Random(batches).shuffle(rows)
    whole = spark.createDataFrame(rows)
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], whole.schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"kept{batches}_{policy.k}"
    query = portfolio.maintained(stream, policy).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    last, versions = {}, {}
    for r in spark.table(name).collect():
        versions.setdefault(r.patient_id, []).append(r.version)
        if r.version == max(versions[r.patient_id]):
            last[r.patient_id] = r
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in versions.values())
    ranked = select.portfolio(whole, policy)
    want = {}
    for r in ranked.where("selected").orderBy("patient_id", "rank").collect():
        want.setdefault(r.patient_id, []).append(r.candidate_id)
    assert {p: r.selected for p, r in last.items() if r.selected} == want
    for r in select.patient_summary(ranked).collect():
        mine = last[r.patient_id].asDict()
        assert {c: mine[c] for c in r.asDict()} == r.asDict()


def test_state_holds_no_more_than_the_caps(monkeypatch):
    """A thousand rows of one combination leave as many entries as its cap."""
    import pandas as pd

    class Map(dict):
        def containsKey(self, key):
            return key in self

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

        def iterator(self):
            return iter(self.items())

    class Value:
        now = None

        def get(self):
            return self.now

        def update(self, x):
            self.now = x

    kept = portfolio.Maintained([2, 5], 7)
    kept.best, kept.counts = Map(), Value()
    for at in range(0, 1000, 100):
        rows = pd.DataFrame({"eligible": True, "tier": 1, "low": [float(i % 97) for i in range(at, at + 100)], "tie": "t", "ident": [f"c{i:04d}" for i in range(at, at + 100)], "v0": "m", "v1": None})
        (out,) = kept.handleInputRows(("p",), iter([rows]), None)
    assert len(kept.best) == 2 and out["candidate_count"][0] == 1000 and out["version"][0] == 10
    assert out["selected"][0] == ["c0096", "c0193"]
