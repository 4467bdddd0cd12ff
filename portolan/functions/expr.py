"""Column expressions over candidate fields. Missing values are NULL; each function says what it does with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response words of the label columns.
POSITIVE = ("cd8", "positive", "pos", "reactive", "immunogenic", "1", "true", "yes")
NEGATIVE = ("negative", "neg", "non-reactive", "nonreactive", "0", "false", "no")
MISSING = "nan"


def strip(x: Column) -> Column:
    """Without white space (space and U+0009..U+000D) at the ends."""
    return F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))


def text(x: Column) -> Column:
    """Stripped and in capitals, NULL as ''."""
    return F.upper(strip(F.coalesce(x, F.lit(""))))


def among(x: Column, words: tuple[str, ...]) -> Column:
    """Like isin, for words without commas, in a quarter of its generated code."""
    return F.find_in_set(x, F.lit(",".join(words))) > 0


def number(x: Column) -> Column:
    """A double, NULL if it isn't a number; NaN is missing too (its word doesn't fit the pattern). '1d' and '1f' are not numbers here."""
    s = strip(x.cast("string"))
    return F.when(s.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"), s.try_cast("double"))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within the bounds; NULL stays NULL."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def bounded(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def peptide(x: Column) -> Column:
    return text(x)


def hla(x: Column) -> Column:
    """HLA-A*02:01 for A0201, A*0201, HLA-A0201, ...; NULL is '', a blank is 'HLA-'.

    Each step reads the one before it once: filters take the whole expression in, and one that reads its steps several times grows with
    each of them, until its code is too long to be compiled.
    """
    bare = F.replace(text(x), F.lit("HLA-"), F.lit(""))
    starred = F.regexp_replace(bare, r"\A([^*])([0-9][^*]{3,})\z", "$1*$2")
    # line ends other than those of `strip` don't count
    full = F.regexp_replace(starred, r"\A([^*]*)\*([0-9]{2})([0-9]{2})(\r\n|[\n\r\u0085\u2028\u2029])?\z", "$1*$2:$3")
    return F.when(x.isNull(), F.lit("")).otherwise(F.concat(F.lit("HLA-"), full))


def pair_key(pep: Column, allele: Column) -> Column:
    return F.concat(pep, F.lit("|"), allele)


def label(x: Column, other: Column | None = None) -> Column:
    """positive, negative or unknown (or `other`)."""
    word = F.lower(strip(F.coalesce(x.cast("string"), F.lit(""))))
    return F.when(among(word, POSITIVE), "positive").when(among(word, NEGATIVE), "negative").otherwise("unknown" if other is None else other)


def shown(x: Column) -> Column:
    """Text in which a missing value is the word 'nan'."""
    return F.coalesce(x.cast("string"), F.lit(MISSING))


def stable_id(patient: Column, mutation: Column, transcript: Column, mutant: Column, allele: Column) -> Column:
    """patient:16 hex digits of the SHA-256 of the five fields."""
    raw = F.concat_ws("|", *[shown(c) for c in (patient, mutation, transcript, mutant, allele)])
    return F.concat(shown(patient), F.lit(":"), F.substring(F.sha2(raw, 256), 1, 16))


def tie_key(mutant: Column, allele: Column) -> Column:
    return F.md5(F.concat(shown(mutant), F.lit("|"), shown(allele)))


def rank_to_score(rank: Column) -> Column:
    return F.lit(1.0) - clip(rank, 0.0, 100.0) / 100.0


def log_expression(tpm: Column) -> Column:
    return F.log1p(clip(tpm, 0.0))


def agretopicity(ratio: Column) -> Column:
    return -F.log10(clip(ratio, 1e-12))


def log_inverse(x: Column) -> Column:
    """-log10, NULL where x is not positive."""
    return F.when(x > 0, -F.log10(x))


def mean_of_available(*parts: Column) -> Column:
    """Mean of the parts that aren't NULL; NULL if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    count = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    return F.when(count > 0, total / count)


def saturating(x: Column, half: float) -> Column:
    """x / (x + half) over non-negative x."""
    y = clip(x, 0.0)
    return y / (y + half)


def missense(variant: Column, case_sensitive: bool = True) -> Column:
    """(from, to) residues of a protein variant such as p.G12D; NULL if it has another form.

    The variant is in capitals when it comes here, which the lower-case 'p.' of the pattern never fits. `case_sensitive=False` is the
    rule as it seems to be meant.
    """
    pattern = ("" if case_sensitive else "(?i)") + r"^p\.([A-Z])(\d+)([A-Z])$"
    v = text(variant)
    return F.when(v.rlike(pattern), F.struct(F.regexp_extract(v, pattern, 1).alias("old"), F.regexp_extract(v, pattern, 3).alias("new")))
