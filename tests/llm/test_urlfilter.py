import random
import re

import pytest

from portolan.llm import urlfilter as uf


def split(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def brute(url):
    host, path = split(url)
    fits = []
    for rule, verdict in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = re.search(r"(^|[.-])(" + "|".join(uf.WORDS) + r")([.-]|$)", host)
    return host, path, None, "block" if bad else "allow"


def urls():
    rng = random.Random(1)
    out = [None, "", "example.net/en/", "http://", "://net/", "http://NET/x", "http://net", "http://net?/", "http://a.b.example.NET/en/x?u=http://org/fr/", "http://notexample.net/en/", "http://xnet/",
           "http://example.com/de", "http://example.com/de/#x", "http://example.com/DE/", "https://m.casino-win.example.org/fr/", "https://casino-win.example.org/en/", "http://mycasino-win.org/", "http://ads-track",
           "http://ads-track:80/x", "http://ÄÖ.net/é", "http://u@net/p", "a://b://net/", "http://a\nnet/", "http://" + "a." * 20000 + "net/", "HTTP://Org/fr/", "http://org/frx/", "http://x.org/fr/y"]
    parts = ["net", "example", "org", "com", "spam-farm", "x-free-bets-y", "fr", "EN"]
    for _ in range(200):
        out.append(rng.choice(["http://", "https://", ""]) + ".".join(rng.choices(parts, k=rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/de/1", "/fr/?q", "#f", "?x=/en/"]))
    return out


def test_against_brute_force(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls())] + [(3, "http://net/", "", ""), (3, "http://net/", "", ""), (None, "http://org/fr/", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, uf.judged(pages).collect()), key=str)
    assert got == sorted([(i, *brute(u)) for i, u, *_ in rows], key=str)


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example.net/en/") for i in range(9)] + [(10, "http://example.com/de/")], "page_id long, url string")
    rows = pages.select("page_id", uf.F.concat(uf.host_of(uf.F.col("url")), uf.path_of(uf.F.col("url"))).alias("place"))
    filed = uf.rarest_tokens(rows, uf.LISTED)
    assert filed == {"net/": "net", "example.net/en/": "en", "example.com/de/": "com", "org/fr/": "fr"}
    assert uf.host_rule("example.net/en", "block").tokens() == ["example", "net"]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert uf.judged(pages).count() == 0
    assert uf.judged(pages, uf.LISTED * 600).count() == 0


def test_table_of_rules_equals_the_index_within_a_row(spark, monkeypatch):
    pages = spark.createDataFrame([(i % 150, u) for i, u in enumerate(urls())], "page_id long, url string")
    want = sorted(map(str, uf.judged(pages).collect()))
    monkeypatch.setattr(uf, "MOST_IN_ROW", 3)
    assert sorted(map(str, uf.judged(pages).collect())) == want


def test_ten_thousand_rules(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.d{i % 300}.example" for i in range(10_000)]
    rules = [uf.host_rule(f"{h}/{'p/' if i % 3 == 0 else ''}", "block" if i % 2 else "allow") for i, h in enumerate(hosts)]
    rules += [uf.host_rule(f"d{k}.example/", "block") for k in range(0, 300, 7)]
    by = {r.name: r.verdict for r in rules}
    seen = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{rng.choice(['', 'p/', 'q/x'])}" for _ in range(400)] + ["http://d7.example/", "http://other.example/"]
    pages = spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")
    for r in uf.judged(pages, tuple(rules)).collect():
        labels = r.host.split(".")
        fits = [n for k in range(len(labels)) for n in (f"{'.'.join(labels[k:])}/", f"{'.'.join(labels[k:])}/p/") if n in by and r.path.startswith("/" + n.split("/", 1)[1])]
        best = max(fits, key=lambda n: (len(n), n), default=None)
        assert (r.rule, r.verdict) == (best, by[best] if best else "allow")


def test_rules_from_a_table_equal_those_in_the_row(spark):
    pages = spark.createDataFrame([(i % 150, u) for i, u in enumerate(urls())], "page_id long, url string")
    lists = spark.createDataFrame([*RULES, *[(w, "block") for w in uf.WORDS], (None, "block"), ("net/", "block")], "rule string, verdict string")
    assert sorted(map(str, uf.judged_by(pages, uf.rule_table(lists)).collect())) == sorted(map(str, uf.judged(pages).collect()))


def test_a_long_list_of_hosts_and_words(spark):
    """Ten thousand listed hosts and two thousand words, against a look at each label."""
    rng = random.Random(7)
    hosts = {f"h{i}.d{i % 300}.example/{'p/' if i % 3 == 0 else ''}": "block" if i % 2 else "allow" for i in range(10_000)}
    words = {f"w{i}-{'abc'[i % 3]}" for i in range(2_000)}
    lists = spark.createDataFrame([*hosts.items(), *[(w, "block") for w in words]], "rule string, verdict string")
    names = [n.split("/")[0] for n in hosts]
    seen = [f"http://{rng.choice(['', 'www.', 'w7-b.', 'x-w9-a-y.', 'w9-aa.'])}{rng.choice([*rng.choices(names, k=3), 'other.example'])}/{rng.choice(['', 'p/', 'q'])}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")
    for r in uf.judged_by(pages, uf.rule_table(lists)).collect():
        labels = r.host.split(".")
        fits = [n for k in range(len(labels)) for n in (f"{'.'.join(labels[k:])}/", f"{'.'.join(labels[k:])}/p/") if n in hosts and r.path.startswith("/" + n.split("/", 1)[1])]
        best = max(fits, key=len, default=None)
        parts = [label.split("-") for label in labels]
        bad = any("-".join(p[i:j]) in words for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1))
        assert (r.rule, r.verdict) == (best, hosts[best] if best else "block" if bad else "allow")


@pytest.mark.parametrize("rule", ["/", "--", "two words", ""])
def test_what_is_no_rule(spark, rule):
    lists = spark.createDataFrame([(rule, "block")], "rule string, verdict string")
    with pytest.raises(Exception, match="no rule"):
        uf.judged_by(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), uf.rule_table(lists)).collect()
