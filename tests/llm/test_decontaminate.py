import hashlib
import random
import re

from portolan.llm import decontaminate as de


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9)) if v else ():
            win = v[i : i + 10]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    ids.add(item)
    ids.discard(None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


def sample():
    rng = random.Random(1)
    vocab = ["a", "b", "c", "Ü1", "dé"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 9, 10, 11, 25, 40])))) for i in range(30)]
    items = [(i, t) for i, t in items if len(t.split()) != 1] + [(100, None), (101, "!!"), (5, items[7][1]), (None, "q r s"), (102, "zz")]
    texts = [None, "", "?!", "ZZ", "x q-R, s!", "Q\x00r\x7fs|zz"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(" ".join(rng.choices([*vocab, "x", "y"], k=rng.randint(0, 30))))
            t = rng.choice(items)[1] or ""
            parts.append(rng.choice([t, t.upper().replace(" ", " -- "), " ".join(t.split()[3:])]))
        texts.append(" ".join(parts))
    return items, texts


def test_against_brute_force(spark):
    items, texts = sample()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[8], 1)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, *brute(t, items)) for i, t in enumerate(texts)] + [(3, *brute(texts[3], items)), (None, *brute(texts[8], items))], key=str)
    for most in (10**6, 40):  # one block of items, and many
        got = sorted(map(tuple, de.counted(docs, bench, most_words=most).collect()), key=str)
        assert got == want


def test_cleaned(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = "clean words stay here as they were before and after it all and more of them too"
    rows = [(1, kept, 3, "s"), (2, f"{kept} ONE two, three four five six seven eight nine; ten! {kept}", 5, "s"), (3, item, 9, "s"), (4, None, None, None), (5, "", 0, "s"),
            (6, f"{kept} one two three four five {item} six seven eight nine ten {kept} {kept}", 0, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: r for r in de.cleaned(docs, bench).collect()}
    assert set(got) == {1, 2, 4, 5, 6}
    assert tuple(got[1]) == rows[0] and tuple(got[4]) == rows[3] and tuple(got[5]) == rows[4]
    assert got[2].text == f"{kept} \n! {kept}" and got[2].n_chars == len(got[2].text)
    assert got[6].text == f"{kept} \n {kept} {kept}"


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in de.counted(docs, bench).collect()] == [(1, 3, 0, 0)]
    assert de.cleaned(docs, bench).count() == 1
    assert de.counted(docs.limit(0), bench).count() == 0


def brute_clean(text, items):
    """What stays of a text, as its words; None if it goes."""
    if not text:
        return text
    w = words(text)
    while True:
        hit = set()
        for _, t in items:
            v = words(t)
            for i in range(max(1, len(v) - 9)) if v else ():
                win = v[i : i + 10]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit.update(range(j, j + len(win)))
        if not hit:
            return w
        if len(hit) > 0.5 * len(w):
            return None
        w = [x for i, x in enumerate(w) if i not in hit]


def test_cleaned_doesnt_depend_on_blocks(spark):
    items, texts = sample()
    rng = random.Random(4)
    one, two = (" ".join(f"{c}{i}" for i in range(12)) for c in "mn")
    filler = [f"f{i}" for i in range(400)]
    texts = texts + [" ".join(rng.choices(filler, k=8)) + f" {one} {two} " + " ".join(rng.choices(filler, k=8))]  # 24 of 40 words, 12 in each block
    texts += [" ".join([*rng.choices(filler, k=60), *one.split()[:6], *two.split(), *one.split()[6:], *rng.choices(filler, k=60)])]  # a window that a cut of another item makes
    texts += [" ".join([*rng.choices(filler, k=rng.randint(20, 80)), rng.choice(items)[1] or "", *rng.choices(filler, k=30)]) for _ in range(40)]
    items = [*items, (200, one), (201, two)]
    rows = [(i, t, len(t) if t is not None else None, "r", "k") for i, t in enumerate(texts)] + [(3, texts[3], 0, "r", "k"), (None, texts[-1], 5, "r", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row string, key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    seen = [sorted(map(tuple, de.cleaned(docs, bench, most_words=most).collect()), key=str) for most in (10**6, 60, 12)]
    assert seen[0] == seen[1] == seen[2]
    want = sorted(((i, brute_clean(t, items)) for i, t, *_ in rows), key=str)
    got = [(r[0], r[1] if not r[1] else words(r[1])) for r in seen[0]]
    assert sorted(got, key=str) == [x for x in want if x[1] is not None or texts[x[0] or 0] is None]
    assert any(x[1] is None and texts[x[0] or 0] for x in want)
