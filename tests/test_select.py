import random

import pytest
from pyspark.sql import functions as F

from portolan.operators import select
from portolan.operators.score import Policy


def loop(rows, k, caps):
    """rows in order, as dicts -> ids taken."""
    taken, counts = [], {}
    for r in rows:
        if len(taken) >= k:
            break
        keys = [(c, r[c]) for c in caps if r[c] is not None]
        if any(counts.get(key, 0) >= caps[key[0]] for key in keys):
            continue
        taken.append(r["candidate_id"])
        for key in keys:
            counts[key] = counts.get(key, 0) + 1
    return taken


def sample(n, seed):
    rng = random.Random(seed)
    return [
        {"candidate_id": f"c{i:04d}", "patient_id": rng.choice(["p1", "p1", "p2", "p3"]), "mutation_id": rng.choice(["m1", "m2", "m3", "m4", "", None]),
         "gene_symbol": rng.choice(["g1", "g2", "g3", ""]), "hla_allele": rng.choice(["a", "b", None]), "lower_evidence_score": rng.choice([0.9, 0.5, 0.5, 0.1, rng.random()]),
         "deterministic_tie_key": rng.choice("xyz"), "evidence_tier": rng.choice(["CORE", "SUPPORTING", "FILLER"]), "eligible": rng.random() < 0.9}
        for i in range(n)
    ]


@pytest.mark.parametrize("policy", [
    Policy(k=5, max_per_mutation=1, max_per_gene=4), Policy(k=20, max_per_mutation=2, max_per_gene=3, max_per_hla=4), Policy(k=0), Policy(k=7, max_per_mutation=None, max_per_gene=None),
    Policy(k=30, max_per_mutation=3, max_per_gene=None, max_per_hla=5),
])
def test_portfolio_equals_a_plain_loop(spark, policy):
    rows = sample(300, policy.k)
    df = spark.createDataFrame(rows)
    got = {}
    for r in select.portfolio(df, policy).where("selected").orderBy("patient_id", "rank").collect():
        got.setdefault(r.patient_id, []).append(r.candidate_id)
        assert r.rank == len(got[r.patient_id])
    tier = {"CORE": 0, "SUPPORTING": 1, "FILLER": 2}
    want = {}
    for p in ("p1", "p2", "p3"):
        mine = sorted((r for r in rows if r["patient_id"] == p and r["eligible"]), key=lambda r: (tier[r["evidence_tier"]], -r["lower_evidence_score"], r["deterministic_tie_key"], r["candidate_id"]))
        shown = [{**r, **{c: (r[c] if r[c] is not None else "nan") or None for c in ("mutation_id", "gene_symbol", "hla_allele")}} for r in mine]
        caps = {c: n for c, n in (("mutation_id", policy.max_per_mutation), ("gene_symbol", policy.max_per_gene), ("hla_allele", policy.max_per_hla)) if n is not None}
        if ids := loop(shown, policy.k, caps):
            want[p] = ids
    assert got == want
    assert select.portfolio(df, policy).count() == len(rows)


def test_single_cap_equals_the_fold(spark):
    df = spark.createDataFrame([r for r in sample(200, 3) if r["mutation_id"]])
    fold = select.portfolio(df, Policy(k=6, max_per_mutation=2, max_per_gene=None)).where("selected").select("patient_id", "candidate_id", "rank")
    assert sorted(map(tuple, fold.collect())) == sorted(map(tuple, select.single_cap(df, "mutation_id", 2, 6).collect()))


@pytest.mark.parametrize("k", [0, 1, 3, 50])
def test_simple_portfolio(spark, k):
    rng = random.Random(k)
    rows = [(i, f"c{i}", rng.choice(["a", "b", None, ""]), rng.choice(["g", "h", None]), rng.choice([None, 0.3, 0.5, rng.random()])) for i in range(80)]
    df = spark.createDataFrame(rows, "_ord long, candidate_id string, hla_allele string, gene_symbol string, score double")
    got = [r.candidate_id for r in select.simple(df, "score", ["_ord"], k=k, max_per_hla=3, max_per_gene=4, min_score=0.4).orderBy("rank").collect()]
    ordered = sorted((r for r in rows if r[4] is None or r[4] >= 0.4), key=lambda r: (r[4] is None, -(r[4] or 0), r[0]))
    want = loop([{"candidate_id": r[1], "hla": r[2], "gene": r[3]} for r in ordered], max(k, 1), {"hla": 3, "gene": 4})
    assert got == want


def test_summary_and_order(spark):
    rows = [{**r, "patient_id": "p9", "eligible": False, "evidence_tier": "EXCLUDED"} if i < 3 else r for i, r in enumerate(sample(60, 8))]
    ranked = select.portfolio(spark.createDataFrame(rows), Policy(k=4))
    got = {r.patient_id: r for r in select.patient_summary(ranked).collect()}
    assert (got["p9"].abstained, got["p9"].abstention_reason, got["p9"].candidate_count) == (True, "NO_ELIGIBLE_CANDIDATES", 3)
    assert not got["p1"].abstained and got["p1"].abstention_reason is None
    ordered = select.final_order(ranked).select("patient_id", "selected", "rank").collect()
    assert [r.patient_id for r in ordered] == sorted(r.patient_id for r in ordered)
    first = [r for r in ordered if r.patient_id == "p1"]
    assert [r.rank for r in first[:4]] == [1, 2, 3, 4] and all(r.rank is None for r in first[4:])


@pytest.mark.parametrize(("batch", "k", "caps"), [(1, 1, {"gene_symbol": 1}), (2, 6, {"mutation_id": 1, "gene_symbol": 2}), (3, 9, {"mutation_id": 2, "hla_allele": 3}), (5, 4, {})])
def test_rounds_equal_a_plain_loop(spark, batch, k, caps, monkeypatch):
    """Batches smaller than what is refused: groups go on in rounds. One patient has most rows, one gene comes first everywhere."""
    rng = random.Random(k)
    rows = [{"candidate_id": f"c{i:04d}", "patient_id": rng.choice(["p1"] * 8 + ["p2", None]), "mutation_id": f"m{rng.randint(0, 400)}", "gene_symbol": "g0" if i < 200 else f"g{rng.randint(1, 5)}",
             "hla_allele": rng.choice(["a", "b", None]), "n": i} for i in range(400)]
    df = spark.createDataFrame(rows, "candidate_id string, patient_id string, mutation_id string, gene_symbol string, hla_allele string, n long")
    monkeypatch.setattr(select, "_WIDEN", 0)
    for group in (["patient_id"], []):
        got = {}
        for r in select.greedy(df, group, [F.col("n")], caps, k, "candidate_id", batch).orderBy("rank").collect():
            got.setdefault(r["patient_id"] if group else None, []).append(r.candidate_id)
        want = {p: loop([r for r in rows if not group or r["patient_id"] == p], k, caps) for p in (("p1", "p2", None) if group else (None,))}
        assert got == want
