"""Quality rules as a bitmask ledger (operator 4; DataFrame functions only).

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each failed rule; a policy
is a versioned mask over these bits, so that another policy, or the ablation of a rule, reads the ledger and never the texts.

Nulls and empty texts have no words: all measurements are 0 and the short-text rule fails. Repeated rows are judged one by one,
ties don't arise, an empty table gives an empty ledger. Only `text` is read; other columns pass through, and the ledger's own
columns (measures, `fail_bits`) replace any of the same name in whatever case. Windows of three words are compared by their 64-bit hashes
within one text: a text of a thousand words has two different windows of one hash with a chance of 3e-14.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import own_name

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# Rule name -> its failure over the measures (SQL that Spark and DuckDB both read). A rule's bit is its place here; append only.
RULES = {
    "too_short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "too_long": "n_words > 100000",
}
# Policy version -> the rules that reject a document.
POLICIES = {
    "base": ("too_short", "repetitive"),
    "v1": ("too_short", "repetitive", "symbols", "short_words", "long_words"),
    "strict": tuple(RULES),
}


def policy_mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _let(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for value; value is worked out once, wherever the optimizer moves the expression."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# A struct of all measures of `text`.
_MEASURED = _let(
    "coalesce(text, '')", "t",
    _let(
        "named_struct('w', filter(split(t, r'[\\x20\\x09-\\x0D]+'), x -> x <> ''),"
        " 'l', filter(split(t, r'\\n'), x -> regexp_like(x, r'[^\\x20\\x09-\\x0D]')))", "p",
        _let(
            # (hash of three words, place) of every window, sorted: equal windows become neighbours
            "sort_array(transform(if(size(p.w) > 2, sequence(1, size(p.w) - 2), array()),"
            " i -> struct(xxhash64(get(p.w, i - 1), get(p.w, i), get(p.w, i + 1)) as h, i as i)))", "win",
            _let(
                # places of the windows that are found twice or more, in order
                "sort_array(transform(filter(win, (x, j) -> (j > 0 and x.h = get(win, j - 1).h)"
                " or (j < size(win) - 1 and x.h = get(win, j + 1).h)), x -> x.i))", "hit",
                "named_struct('n_words', cast(size(p.w) as long),"
                " 'word_chars', cast(length(regexp_replace(t, r'[\\x20\\x09-\\x0D]+', '')) as long),"
                f" 'n_symbols', cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as long),"
                " 'n_dup_lines', cast(size(p.l) - size(array_distinct(p.l)) as long),"
                # each such window adds the words that its successor does not cover
                " 'n_repeat_words', aggregate(transform(hit, (at, j) ->"
                " if(j = size(hit) - 1, 3, least(3, get(hit, j + 1) - at))), 0L, (a, x) -> a + x),"
                " 'n_lines', cast(size(p.l) as long))",
            ),
        ),
    ),
)


def _bits(of: str) -> str:
    """SQL: the rules that fail, over measures that are fields of `of`."""
    rule = lambda test: re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"{of}.\1", test)
    return " + ".join(f"if({rule(test)}, {1 << k}L, 0L)" for k, test in enumerate(RULES.values()))


def ledger(docs: DataFrame) -> DataFrame:
    """`docs` with every measure and `fail_bits`, the rules that fail (bit k: rule k of RULES)."""
    others, m = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*MEASURES, "fail_bits")], own_name(docs.columns, "__m")
    book = docs.select(*others, F.expr(_MEASURED).alias(m))
    return book.withColumn("fail_bits", F.expr(_bits(m))).select(*others, f"{m}.*", "fail_bits")


def passes(policy: str) -> Column:
    """Over a ledger: no rule of the policy fails."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0


def stored(docs: DataFrame, path: str) -> DataFrame:
    """Writes the ledger of docs to path and reads it: `text`, `document` (a struct of all other columns, so that none is replaced), the
    measures and `fail_bits`. Every policy and ablation then reads these bits."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    ledger(docs.select("text", F.struct(*rest).alias("document"))).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def kept(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that pass, with their own columns only; nothing is stored."""
    mask = policy_mask("base") | policy_mask(policy)
    return docs.where(F.expr(_let(_MEASURED, "m", f"(({_bits('m')}) & {mask}L) = 0L")))


def passed(book: DataFrame, policy: str, columns: list[str]) -> DataFrame:
    """The documents of a stored ledger that pass, with these columns."""
    rows = book.where(passes("base") & passes(policy))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"document.`{c}`") for c in columns])


def ablations(book: DataFrame, policies: tuple[str, ...]) -> DataFrame:
    """For each rule of each policy: documents that fail it, and documents that only it rejects. One aggregation over the bits for all
    policies."""
    names, sums = list(RULES), {}
    for policy in policies:
        failed = F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy)))
        for rule in POLICIES[policy]:
            one = F.lit(1 << names.index(rule))
            sums[f"{policy}.{rule}"] = F.struct(
                F.lit(policy).alias("policy"), F.lit(rule).alias("rule"), F.count_if(failed.bitwiseAND(one) != 0).alias("n_fail"), F.count_if(failed == one).alias("n_only"))
    found = book.agg(*[s.alias(n) for n, s in sums.items()])
    return found.select(F.inline(F.array(*[F.col(f"`{n}`") for n in sums])))


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """`ablations` of one policy, without its name."""
    return ablations(book, (policy,)).drop("policy")


def judged(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    return ledger(docs).withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})


def _measures_sql() -> str:
    """The measures of all documents in DuckDB's SQL: CTEs up to f."""
    return """
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
    w as (select rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d),
    win as (select rid, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
    keyed as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from win),
    hit as (select rid, i from keyed qualify count(*) over (partition by rid, a, b, c) > 1),
    rep as (select rid, count(distinct i + k.k) as n from hit, (values (0), (1), (2)) as k(k) group by rid),
    m as (select w.doc_id, len(w)::bigint as n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) as n_lines,
        len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as n_unlike,
        coalesce(rep.n, 0)::bigint as n_repeat_words
        from w left join rep using (rid)),
    f as (select *, (n_lines - n_unlike)::bigint as n_dup_lines from m)"""


_SQL_BITS = "(" + " + ".join(f"({test})::bigint * {1 << k}" for k, test in enumerate(RULES.values())) + ")"


def sql(policy: str = "v1") -> str:
    """`judged` in DuckDB's SQL."""
    tests = " or ".join(f"({RULES[r]})" for r in POLICIES["base"])
    every = " or ".join(f"({RULES[r]})" for r in (*POLICIES["base"], *POLICIES[policy]))
    return f"""{_measures_sql()} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({tests}) as base_failed, not ({every}) as kept, {_SQL_BITS} as fail_bits from f"""


def ablation_sql(policies: tuple[str, ...]) -> str:
    """`ablations` in DuckDB's SQL."""
    one = [f"select '{p}' as policy, '{r}' as rule, count_if(bits & {1 << list(RULES).index(r)} <> 0) as n_fail, count_if(bits & {policy_mask(p)} = {1 << list(RULES).index(r)}) as n_only from b" for p in policies for r in POLICIES[p]]
    return f"{_measures_sql()}, b as (select {_SQL_BITS} as bits from f) " + " union all ".join(one)
