import random

import numpy as np
from pyspark.sql import functions as F

from portolan.llm import toxicity


def test_learns_pairs():
    """Two terms that are harmless alone and toxic together: no additive weights can tell them apart."""
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(([1] * a + [2] * b + [3 + rng.randrange(5)], int(a and b)))
    machine = toxicity.fit(rows, np.arange(1, 8), passes=40)
    score = lambda *t: machine.score(np.array(sorted(t), dtype=np.int64))
    assert score(1, 2, 3) > 0.5 > max(score(1, 3), score(2, 3), score(3))


def test_gradient():
    """One step of the fit follows the slope of the loss."""
    at = np.arange(4)
    m = toxicity.Machine(0.1, at, np.array([0.2, -0.1, 0.0, 0.3]), np.arange(8).reshape(4, 2) / 10)
    found = np.array([0, 2, 3, 9])
    v, k = m.vectors, [0, 2, 3]
    pairs = sum(float(v[i] @ v[j]) for n, i in enumerate(k) for j in k[:n])
    assert abs(m.score(found) - 1 / (1 + np.exp(-(0.1 + 0.5 + pairs)))) < 1e-12


def corpus(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(900):
        words = rng.choices(plain, k=rng.randint(5, 60))
        bad = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile,", "rotten", "FOUL"]))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    docs += [(2000, None, "en"), (2001, "", "en"), (None, "rotten", "en"), (5, docs[5][1], "en"), (2002, "w1 " * 30000 + "rotten", "en")]
    labels += [(77777, 1), (None, 1), (3, None), (4, 9), (6, labels[6][1])]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels[:900]))


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    rows = toxicity.judged(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[2000].score == by[2001].score < 0.5 and by[None].predicted == 1 and by[2002].predicted == 1
    assert sorted(map(str, rows)) == sorted(map(str, toxicity.judged(docs.repartition(5), labels.repartition(3)).collect()))


def test_degenerate_labels(spark):
    docs, labels, _ = corpus(spark)
    for only, want in ((None, 0), (0, 0), (1, 1)):
        some = labels.where(F.col("toxic") == only) if only is not None else labels.limit(0)
        assert {r.predicted for r in toxicity.judged(docs.limit(20), some).collect()} == {want}
    assert toxicity.judged(docs.limit(0), labels).count() == 0


def planted(n, kind, seed=4):
    """Rows of 30 noise terms of 2,000; toxic if an insult (0..39) and a group (100..139) meet, or if just one of two terms is there."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        found = set(rng.choices(range(1000, 3000), k=30))
        a, b = (rng.random() < 0.4, rng.random() < 0.4) if kind == "pairs" else (rng.random() < 0.5, rng.random() < 0.5)
        if a:
            found.add(rng.randrange(40) if kind == "pairs" else 1)
        if b:
            found.add(100 + rng.randrange(40) if kind == "pairs" else 2)
        out.append((sorted(found), int(a and b) if kind == "pairs" else int(a != b)))
    return out


def held_out_accuracy(rows, cut):
    known = toxicity.Rows.listed(rows[:cut])
    machine = toxicity.fit(known, toxicity.chosen_terms(known))
    said = [machine.score(np.array(t)) >= 0.5 for t, _ in rows[cut:]]
    truth = [y for _, y in rows[cut:]]
    caught = [s for s, y in zip(said, truth, strict=True) if y]
    return sum(s == y for s, y in zip(said, truth, strict=True)) / len(truth), sum(caught) / len(caught), max(sum(truth), len(truth) - sum(truth)) / len(truth)


def test_planted_pairs_without_strong_single_terms():
    accuracy, recall, plain = held_out_accuracy(planted(13000, "pairs"), 12000)
    assert accuracy > plain + 0.1 and recall > 0.8
    accuracy, recall, plain = held_out_accuracy(planted(4000, "pairs"), 3000)
    assert accuracy > plain + 0.03 and recall > 0.5


def test_exactly_one_of_two_terms():
    accuracy, recall, _ = held_out_accuracy(planted(4000, "one"), 3000)
    assert accuracy > 0.99 and recall > 0.99


def test_first_step_follows_the_numeric_slope():
    """Against a brute-force loss: AdaGrad's first step has the size of the rate and goes down the slope of every number."""
    rng = random.Random(6)
    rows = [(sorted(rng.sample(range(6), rng.randint(1, 4))), rng.randint(0, 1)) for _ in range(20)]
    at, start = np.arange(6), np.random.default_rng(1).normal(0, 0.05, (6, 4))
    share = sum(y for _, y in rows) / len(rows)
    base = np.log(share / (1 - share))

    def loss(weight, vectors):
        machine, total = toxicity.Machine(base, at, weight, vectors), 0.0
        for t, y in rows:
            p = machine.score(np.array(t))
            total -= 5.0 * np.log(p) if y else np.log(1 - p)
        return total / len(rows)

    got, zero = toxicity.fit(rows, at, passes=1, decay=0.0), np.zeros(6)
    for i in range(6):
        bump = np.zeros(6)
        bump[i] = 1e-5
        slope = (loss(bump, start) - loss(-bump, start)) / 2e-5
        assert abs(got.weight[i] + 0.2 * np.sign(slope)) < 1e-3
        for f in range(4):
            push = np.zeros((6, 4))
            push[i, f] = 1e-5
            slope = (loss(zero, start + push) - loss(zero, start - push)) / 2e-5
            assert abs(got.vectors[i, f] - start[i, f] + 0.06 * slope / np.sqrt(slope**2 + 1e-8)) < 1e-3


def test_sample_is_bounded(spark):
    docs, labels, truth = corpus(spark)
    few = toxicity.train(docs.select(F.col("doc_id"), "text"), labels.where("toxic in (0, 1) and doc_id is not null"), most_rows=300)
    assert 0 < len(few.at) < 250 and few.score(np.array(toxicity.terms("w1 w2 foul rotten"))) > 0.5


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    """One id has most of the rows: no more than the bound come to the driver."""
    docs, labels, truth = corpus(spark)
    known = labels.where("toxic in (0, 1) and doc_id is not null")
    first = docs.join(known, "doc_id").orderBy(toxicity.order_hash(F.col("doc_id"))).select("doc_id", "text").limit(1)  # below any threshold
    hot = first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("copy")
    seen = []
    make = toxicity.Rows.__init__
    monkeypatch.setattr(toxicity.Rows, "__init__", lambda self, flat, n, y: (seen.append(len(y)), make(self, flat, n, y))[1])
    machine = toxicity.train(docs.select("doc_id", "text").union(hot), known, most_rows=300)
    assert max(seen) == 300 and 0 <= machine.score(np.array(toxicity.terms("w1 foul"))) <= 1


def hidden_pair(fillers, seed=9):
    """8,000 rows, 800 toxic: terms 1 and 2 tell nothing by themselves, but meet in 161 rows that are all toxic; `fillers` terms are more frequent."""
    rng = np.random.default_rng(seed)
    y = np.arange(8000) % 10 == 0
    plain, toxic = rng.permutation(np.flatnonzero(~y)), rng.permutation(np.flatnonzero(y))
    both, spare = toxic[:161], 1449  # each term is in 161 toxic rows of 1,610, as chance has it
    one, two = np.concatenate([both, plain[:spare]]), np.concatenate([both, plain[spare : 2 * spare]])
    has = rng.random((8000, fillers)) < 0.25
    one, two = set(one.tolist()), set(two.tolist())
    return [([*[1] * (i in one), *[2] * (i in two), *(np.flatnonzero(has[i]) + 10).tolist()], int(y[i])) for i in range(8000)]


def test_pair_among_many_more_frequent_terms():
    for fillers in (300, 2100):
        known = toxicity.Rows.listed(hidden_pair(fillers))
        assert toxicity.told_in_pairs([toxicity.pair_evidence(known)]).tolist() == [1, 2]


def test_pairs_equal_brute_force_in_any_parts(spark, monkeypatch):
    """Against a count of each pair's cells, row by row."""
    rng, rows = random.Random(3), []
    for _ in range(400):
        found = {t for t in range(25) if rng.random() < 0.1 + 0.02 * t}
        rows.append((sorted(found), int({20, 24} <= found or rng.random() < 0.15)))
    known, best, examined = toxicity.Rows.listed(rows), {}, 0
    for i in range(25):
        for j in range(i):
            size, toxic = [0] * 4, [0] * 4
            for found, y in rows:
                cell = 2 * (i not in found) + (j not in found)
                size[cell] += 1
                toxic[cell] += y
            if min(size) < 5:
                continue
            examined += 1
            p = [(t + 0.5) / (s + 1) for t, s in zip(toxic, size, strict=True)]
            gap, spread = p[0] - p[1] - p[2] + p[3], sum(x * (1 - x) / (s + 1) for x, s in zip(p, size, strict=True))
            k = size.index(min(size))
            edge = 0.5 / (size[k] + 1)
            want = min(max(p[k] - (gap if k in (0, 3) else -gap), edge), 1 - edge)
            got = toxic[k] / size[k]
            ratio = (got * np.log(got / want) if got else 0) + ((1 - got) * np.log((1 - got) / (1 - want)) if got < 1 else 0)
            for t in (i, j) if gap**2 >= 30 * spread else ():
                best[t] = max(best.get(t, 0), 2 * size[k] * ratio)
    for parts in (1, 4, 40):
        found = [toxicity.pair_evidence(known, part, parts) for part in range(parts)]
        assert sum(f[2] for f in found) == examined
        merged = {}
        for term, values, _ in found:
            for t, v in zip(term.tolist(), values.tolist(), strict=True):
                merged[t] = max(merged.get(t, 0), v)
        assert merged.keys() == best.keys() and all(abs(merged[t] - best[t]) < 1e-9 for t in best)
    whole = toxicity.told_in_pairs([toxicity.pair_evidence(known)]).tolist()
    assert whole == [20, 24]
    monkeypatch.setattr(toxicity, "PAIRS_A_TASK", 3000)
    assert toxicity.paired_terms(spark, known).tolist() == whole


def test_chance_brings_no_pairs():
    rng = np.random.default_rng(5)
    has = rng.random((3000, 400)) < rng.random(400) * 0.1
    rows = [(np.flatnonzero(x).tolist(), int(y)) for x, y in zip(has, rng.random(3000) < 0.1, strict=True)]
    assert not len(toxicity.told_in_pairs([toxicity.pair_evidence(toxicity.Rows.listed(rows))]))


def test_no_terms_no_pairs():
    for rows in ([], [([], 1), ([], 0)]):
        found = toxicity.pair_evidence(toxicity.Rows.listed(rows))
        assert not len(found[0]) and found[2] == 0 and not len(toxicity.told_in_pairs([found]))
