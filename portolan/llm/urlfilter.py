"""URL filters (operator 10; DataFrame functions only).

A rule is a regular expression over host and path. Each rule is filed under one of its literal tokens, the one that is rarest
in the URLs at hand; a URL's tokens fetch the candidates, and only these run. Up to MOST_IN_ROW rules are an index within the row:
there is no shuffle but the small count of rule tokens, so a host with a third of all rows costs what its rows cost. More rules are a
table, which the distinct URLs' tokens are joined with; the verdicts of distinct URLs are then joined with the rows. A list of any size
that is a table already (`rule_table`, `judged_by`) stays one, and never comes to the driver.

A null URL or one without '://' has an empty host and path, fits no rule and is allowed. Repeated rows are judged one by one.
Of several fitting rules the longest wins, the last in code point order on a tie. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_IN_ROW = 2000  # rules in a row's literal index; more are a table that is joined by token


@dataclass(frozen=True)
class Rule:
    name: str  # as it is reported
    pattern: str  # over host || path
    verdict: str  # allow or block
    explicit: bool = True  # a listed rule: reported by name, and before any pattern rule

    def tokens(self) -> list[str]:
        """Tokens that any fitting URL has; a path's last token counts only if it ends there ('/en' also fits '/english')."""
        name = self.name.lower()
        if "/" in name:
            name = re.sub(r"[0-9a-z]+$", "", name)
        return sorted({t for t in re.split(r"[^0-9a-z]+", name) if t})


def host_rule(name: str, verdict: str) -> Rule:
    """`example.net/en/`: the host and its subdomains, paths that start with /en/."""
    return Rule(name, r"^([^/]*\.)?" + re.sub(r"([^0-9A-Za-z/])", r"\\\1", name), verdict)


def word_rule(words: str) -> Rule:
    """Blocks hosts one of whose labels holds these hyphenated words."""
    return Rule(words, r"^[^/]*(^|[.\-])" + re.sub(r"([^0-9A-Za-z/])", r"\\\1", words) + r"([.\-]|/|$)", "block", False)


# The listed rules.
LISTED = (
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
)
# Hosts of advertisers, gambling, pills, adult offers, loans, counterfeits, link farms and malware.
WORDS = (
    "ad-server", "ads-track", "click-track", "popup-ads", "bet-bonus", "casino-win", "free-bets", "online-casino", "poker-bonus", "slot-games",
    "buy-viagra", "cheap-pills", "pharmacy-online", "weight-loss-pills", "adult-cams", "porn-tube", "sex-chat", "xxx-videos", "fast-cash",
    "payday-loans", "replica-watches", "essay-writers", "link-farm", "seo-backlinks", "spam-farm", "keygen-crack", "malware-update",
    "phishing-login", "torrent-free", "warez-download",
)
PATTERNS = tuple(map(word_rule, WORDS))


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.locate("://", url) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end; else empty."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(place), "[^0-9a-z]+"), lambda t: t != ""))


def rarest_tokens(places: DataFrame, rules: tuple[Rule, ...]) -> dict[str, str]:
    """Rule -> its token that the fewest rows hold. The count covers all rows; what returns is a row for each rule token."""
    known = sorted({t for r in rules for t in r.tokens()})
    counted = places.select(F.explode(F.array_intersect(_tokens(F.col("place")), F.array(*map(F.lit, known)))).alias("t"))
    found = {r["t"]: r["count"] for r in counted.groupBy("t").count().collect()}
    return {r.name: min(r.tokens(), key=lambda t: (found.get(t, 0), t)) for r in rules}


def judged(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of a listed one that fits), verdict."""
    rows = _places(pages)
    return _reported(_in_row(rows, rules) if len(rules) <= MOST_IN_ROW else _by_join(rows, _table(rows.sparkSession, rules)), default)


def judged_by(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same by a table of rules, as `rule_table` makes it; several tables may be united."""
    return _reported(_by_join(_places(pages), rules), default)


def rule_table(lists: DataFrame) -> DataFrame:
    """Rules from a table of rule (`host/path`, or words that a label of the host holds) and verdict. Rules without '/' are words, hyphenated
    or one, which are reported as the verdict alone. Null rules are none; a repeated rule with two verdicts has the last in code point order. A rule without
    a letter or digit, or a word that isn't made of these and hyphens, is an error of the job that reads it."""
    name = F.col("rule")
    listed, quoted = F.contains(name, F.lit("/")), F.regexp_replace(name, "([^0-9A-Za-z/])", r"\\$1")
    pattern = F.when(listed, F.concat(F.lit(r"^([^/]*\.)?"), quoted)).otherwise(F.concat(F.lit(r"^[^/]*(^|[.\-])"), quoted, F.lit(r"([.\-]|/|$)")))
    whole = F.when(listed, F.regexp_replace(F.lower(name), "[0-9a-z]+$", "")).otherwise(F.lower(name))
    tokens = _tokens(whole)
    fine = (F.size(tokens) > 0) & (listed | F.regexp_like(name, F.lit("^[0-9a-z-]+$")))
    # Spark may look at tokens before it drops null rules
    checked = F.when(name.isNull() | fine, tokens).otherwise(F.raise_error(F.concat(F.lit("no rule: "), name)).cast("array<string>"))
    return lists.where(name.isNotNull()).select(
        F.xxhash64(name, "verdict").alias("no"), listed.alias("explicit"), F.length(name).alias("length"), name.alias("name"), "verdict", pattern.alias("pattern"), checked.alias("tokens")
    )


def _places(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")}).withColumn("place", F.concat("host", "path"))


def _reported(rows: DataFrame, default: str) -> DataFrame:
    return rows.select(
        "page_id", "host", "path",
        F.when(F.col("__best.explicit"), F.col("__best.name")).alias("rule"),
        F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"),
    )


def _table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame(
        [(i, r.explicit, len(r.name), r.name, r.verdict, r.pattern, r.tokens()) for i, r in enumerate(rules)],
        "no long, explicit boolean, length int, name string, verdict string, pattern string, tokens array<string>",
    )


def _by_join(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with __best, the largest of the rules that fit, by joins: rules with their tokens, tokens with how many rows have them, distinct URLs
    with the rules filed under one of their tokens."""
    places = rows.groupBy("place").agg(F.count("*").alias("n"))
    tokens = places.select("place", "n", F.explode(_tokens(F.col("place"))).alias("t"))
    counts = tokens.groupBy("t").agg(F.sum("n").alias("n"))
    own = table.select("no", F.explode("tokens").alias("t")).join(counts, "t", "left")
    filed = own.groupBy("no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "t"))["t"].alias("t")).join(table.drop("tokens"), "no")
    fits = tokens.select("place", "t").join(filed, "t").where(F.regexp_like("place", F.col("pattern")))
    best = fits.groupBy("place").agg(F.max(F.struct("explicit", "length", "name", "verdict", "pattern")).alias("__best"))
    return rows.join(best, "place", "left")


def _in_row(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows with __best, the largest of the rules that fit, from an index within the row."""
    filed = rarest_tokens(rows, rules)
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(filed[r.name], []).append(r)
    entry = lambda r: F.struct(  # noqa: E731  the largest of those that fit wins
        F.lit(r.explicit).alias("explicit"), F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"),
        F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"),
    )
    filed_under = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, rs)))])
    candidates = F.flatten(F.transform(
        F.array_intersect(_tokens(F.col("place")), F.array(*map(F.lit, sorted(index)))), lambda t: F.element_at(filed_under, t)
    ))
    return rows.withColumn("__best", F.array_max(F.filter(candidates, lambda r: F.regexp_like(F.col("place"), r["pattern"]))))


SQL = f"""
    with s as (select page_id, url, strpos(url, '://') as p from pages),
    r as (select page_id, case when p > 0 then substr(url, p + 3) else '' end as rest from s),
    h as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from r),
    rules(rule, rhost, rpath, v) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
    m as (select *, (select max_by({{'rule': rule, 'v': v}}, length(rule)) from rules
        where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as b from h)
    select page_id, host, path, b.rule as rule, coalesce(b.v, case when
        regexp_matches(host, '(^|[.-])({'|'.join(WORDS)})([.-]|$)')
        then 'block' else 'allow' end) as verdict from m"""
