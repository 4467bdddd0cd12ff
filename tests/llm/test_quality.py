import random
import re
from collections import Counter

from portolan.llm import quality

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = SPACE.findall(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)),
         "n_repeat_words": len(covered), "n_lines": len(lines)}
    fails = sum(1 << k for k, rule in enumerate(quality.RULES.values()) if eval(rule, {}, m))
    return m, fails


def sample():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "word " * 30000, "ü 漢字 \U0001F600 é", "a\x1cb \x85 c", "one\r\ntwo\r\none\r\n", "\n\n\n", "l\nl\nl \nl"]
    for _ in range(150):
        vocab = rng.choice([["a", "b"], [f"w{i}" for i in range(30)], ["#x", "$$", "no|", "ok", "<b>", "zz"]])
        texts.append("".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(1, 120))))
    return texts


def test_measures_and_rules(spark):
    texts = sample()
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, texts[6], "x", 8)], "doc_id long, text string, fail_bits string, n_words int")
    got = {r.doc_id: r for r in quality.ledger(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        m, fails = brute(t)
        assert {k: got[i][k] for k in m} == m and got[i].fail_bits == fails, (t, m)
    assert got[None].n_repeat_words == got[6].n_repeat_words == 6


def test_verdicts_policies_and_ablation(spark):
    texts = sample()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    facts = {i: brute(t)[1] for i, t in enumerate(texts)}
    base = quality.policy_mask("base")
    for policy in quality.POLICIES:
        mask = quality.policy_mask(policy)
        rows = {r.doc_id: r for r in quality.judged(docs, policy).collect()}
        assert all(rows[i].base_failed == bool(f & base) and rows[i].kept == (not f & (base | mask)) for i, f in facts.items())
        kept = quality.kept(docs, policy)
        assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {i for i, f in facts.items() if not f & (base | mask)}
        got = {r.rule: (r.n_fail, r.n_only) for r in quality.ablation(quality.ledger(docs), policy).collect()}
        for rule in quality.POLICIES[policy]:
            bit = 1 << list(quality.RULES).index(rule)
            assert got[rule] == (sum(bool(f & bit) for f in facts.values()), sum(f & mask == bit for f in facts.values()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judged(docs).count() == 0 and quality.kept(docs).count() == 0
    assert all(r.n_fail == 0 for r in quality.ablation(quality.ledger(docs), "v1").collect())


def test_names_of_other_case(spark):
    docs = spark.createDataFrame([(1, "one two three", "x")], "doc_id long, text string, N_words string")
    row = quality.ledger(docs).first()
    assert row.n_words == 3 and quality.ledger(docs).columns == ["doc_id", "text", *quality.MEASURES, "fail_bits"]
