import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, shard string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "size", "row", "shard"]


def doc(i, text, source="a"):
    return (i, text, "en", source, len(text) if text is not None else None, 1, "r", "s")


def make(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))


def edited(rng, text, share):
    words = text.split()
    for k in rng.sample(range(len(words)), int(len(words) * share)):
        words[k] = make(rng, 1)
    return " ".join(words)


def jaccard(a, b):
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    at = tmp_path_factory.mktemp("sf")
    item = make(rng, 40)
    rows = [doc(i, make(rng, rng.randint(60, 400)), rng.choice(["a", "a", "b", "c", None])) for i in range(80)]
    near = [doc(1000 + i, edited(rng, rows[i][1], 0.012), "b") for i in range(30)]
    copies = [doc(2000 + i, rows[i][1], "c") for i in range(30, 40)]
    leaks = [doc(3000 + i, f"{make(rng, 80)} {item.upper() if i % 2 else item} {make(rng, 80)}", "a") for i in range(6)]
    mostly = [doc(3100, f"{item} {make(rng, 12)}", "a")]
    bad = [doc(4000, "too short"), doc(4001, "same words again " * 40), doc(4002, " ".join(f"w{i}###" for i in range(80))), doc(4003, None), doc(4004, "")]
    docs = spark.createDataFrame(rows + near + copies + leaks + mostly + bad + [rows[50], doc(None, rows[51][1] + " x")], SCHEMA)
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, near, item


def test_stages(spark, tables):
    sf, rows, near, item = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf).cache()
        steps[name] = docs
        assert docs.columns == (COLUMNS if name != "shard" else [*(c for c in COLUMNS if c != "shard"), "shard", "slot"])
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in steps.items()}

    assert not {4000, 4001, 4002, 4003, 4004} & set(ids["quality_rules"])
    assert set(range(80)) <= set(ids["quality_rules"]) and ids["quality_rules"].count(50) == 2

    kept = ids["near_dedup"]
    assert set(range(80)) <= set(kept) and kept.count(50) == 1 and kept.count(None) == 1
    assert not [i for i in kept if i is not None and 2000 <= i < 3000]
    assert all(jaccard(rows[i][1], near[i][1]) > 0.82 for i in range(30))
    assert sum(1000 + i in kept for i in range(30)) <= 1

    clean = {r.doc_id: r for r in steps["decontamination"].collect()}
    assert 3100 not in clean and {3000 + i for i in range(6)} <= set(clean)
    assert all(item not in r.text.lower() and r.n_chars == len(r.text) for r in clean.values())
    assert all(clean[i].text == rows[i][1] for i in range(80))

    mixed = ids["mix_sources"]
    assert set(mixed) <= set(clean) and max(mixed.count(i) for i in set(mixed)) == 2
    words = {}
    for r in steps["mix_sources"].collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    size = {}
    for r in clean.values():
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    goal = cp.mixing.targets([(s, size[s]) for s in sorted(size, key=lambda s: (s is None, s or ""))])
    longest = max(len(r.text.split()) for r in clean.values())
    assert all(abs(words[s] - goal[s]) <= longest for s in size)

    by = {}
    for r in steps["shard"].collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == len(mixed)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(24)) <= 1


def test_run_and_empty(spark, tables, tmp_path):
    sf = tables[0]
    got = cp.run(spark, sf)
    assert got.count() > 80 and re.fullmatch(r"long|bigint", dict(got.dtypes)["slot"])
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_far_texts_stay(spark):
    """Pairs well below the similarity are no copies, also in large numbers."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        base = make(rng, 200)
        rows += [doc(2 * i, base), doc(2 * i + 1, edited(rng, base, 0.14))]
    assert max(jaccard(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(60)) < 0.45
    assert cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").count() == 120


def test_clashing_names(spark, tables, tmp_path):
    """Columns with the names that stages use inside, in other cases too, come through with their values."""
    sf = tables[0]
    clash = ["__text", "__copy", "__source", "N_words", "Fail_Bits", "document", "row", "name", "slot", "__m", "n", "key"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(c) for c in clash])
    columns = docs.columns
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == (columns if name != "shard" else [*(c for c in columns if c != "slot"), "shard", "slot"])
    for r in docs.collect():
        assert all(r[c] == f"{c}:{r.doc_id if r.doc_id is not None else -1}" for c in clash if c != "slot")


def test_mix_in_slot_order(spark):
    """Sources alternate through the whole of the mix's order, in about their shares."""
    rng = random.Random(3)
    docs = spark.createDataFrame([doc(i, make(rng, 300), rng.choice(["a", "b", "c"])) for i in range(300)], SCHEMA)
    out = [r.source for r in cp.mix_sources(spark, docs, "").collect()]
    share = {s: out.count(s) / len(out) for s in "abc"}
    for lo in range(0, len(out) - 60, 60):
        part = out[lo : lo + 60]
        assert all(abs(part.count(s) / 60 - share[s]) < 0.08 for s in "abc")
