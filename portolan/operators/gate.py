"""The validity gate: the first rule that a candidate breaks is its reason; rejected rows stay in the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions import expr

POLICY = "deterministic_gate_v1"
# Fixed values.
SHORTEST, LONGEST = 8, 14
CLASS_I = ("I", "CLASS_I", "CLASS I")
LOST = ("Y", "YES", "TRUE", "1", "LOST")
SILENT = ("N", "NO", "FALSE", "0", "NOT_EXPRESSED")
SUBSTITUTIONS = ("SNV", "SNP", "MISSENSE")
TOLD = ("__before", "__after")
BROADCAST = 2_000_000  # marks and hashes, 16 bytes each
REASONS = ("MALFORMED_AA", "BAD_CLASS_I_LENGTH", "DUP_CANDIDATE", "MUT_NOT_IN_PEPTIDE", "HLA_LOH_LOST_ALLELE", "GENE_NOT_EXPRESSED")
IDENTITY = ("patient_id", "mutation_id", "mutant_peptide", "hla_allele")


def _text(df: DataFrame, name: str) -> Column:
    return expr.text(F.col(name).cast("string")) if name in df.columns else F.lit("")


def _named(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The identities of df's rows, with a hash and the rows' places."""
    return df.select(F.xxhash64(*keys).alias("__h"), *[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*[F.col(c) for c in order]).alias("__place"))


def _repeated(named: DataFrame) -> DataFrame:
    """The identities that are there twice, and their first places."""
    # the hash comes first among the keys, where it decides nearly all comparisons
    of = [c for c in named.columns if c != "__place"]
    return named.groupBy(*of).agg(F.min("__place").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")


def _mark(keys: list[str], order: list[str]) -> list[Column]:
    """128 bits for a row's identity and place; hashes pass missing values over, so which are missing is hashed too."""
    of = [F.col(c) for c in (*keys, *order)]
    of += [x.isNull() for x in of]
    return [F.xxhash64(*of).alias("__m0"), F.xxhash64(F.lit(1), *of).alias("__m1")]


def marks(df: DataFrame, order: list[str], most: int = BROADCAST) -> DataFrame | None:
    """Marks of the rows that are duplicates, for `duplicates` and `concluded`; None if df has too few identity columns. For a df that is read several times and is cheap
    to read: hashes alone are counted over all rows, and only rows whose hash is there twice are compared whole. So eight bytes of a row are shuffled, where
    `duplicates` without marks shuffles its identity, and then the whole row for the join. Runs at once; up to `most` marks are broadcast, more are joined by a
    shuffle. They stay persisted (clearCache drops them)."""
    keys = [c for c in IDENTITY if c in df.columns]
    if len(keys) < 3:
        return None
    fits = lambda x: F.broadcast(x) if x.count() <= most else x
    twice = df.select(F.xxhash64(*keys).alias("__t")).groupBy("__t").agg(F.count("*").alias("__n")).where("__n > 1").select("__t").persist()
    few = _named(df, keys, order).join(fits(twice), F.col("__h") == F.col("__t"), "left_semi").persist()
    first = _repeated(few)
    same = F.col("__h") == F.col("__g")
    for k in keys:
        same = same & F.col(f"__k_{k}").eqNullSafe(F.col(f"__f_{k}"))
    later = few.join(first.select(F.col("__h").alias("__g"), "__first", *[F.col(f"__k_{k}").alias(f"__f_{k}") for k in keys]), same).where(F.col("__place") > F.col("__first"))
    found = later.select(*[F.col(f"__k_{k}").alias(k) for k in keys], *[F.col(f"__place.{c}").alias(f"__p_{c}") for c in order])
    found = found.select(*_mark(keys, [f"__p_{c}" for c in order])).distinct().persist()
    found = fits(found)
    few.unpersist()
    twice.unpersist()
    return found


def duplicates(df: DataFrame, order: list[str], marked: DataFrame | None = None) -> DataFrame:
    """df with is_duplicate: another row with the same identity comes before it. Needs three of the four identity columns; missing
    values are equal to one another. `order` tells rows apart: of rows alike in it and in identity none is a duplicate of the other.

    The first place of each identity is aggregated before it is shuffled, and only identities that are there twice are joined back. That join has a
    plain exchange on either side, so an identity with most of the rows is split over tasks. `marked`: the `marks` of df, which spare both.
    """
    keys = [c for c in IDENTITY if c in df.columns]
    if len(keys) < 3:
        return df.withColumn("is_duplicate", F.lit(False))
    if marked is not None:
        a, b = _mark(keys, order)
        return df.join(marked, (a == F.col("__m0")) & (b == F.col("__m1")), "left").withColumn("is_duplicate", F.col("__m0").isNotNull()).drop("__m0", "__m1")
    place = F.struct(*[F.col(c) for c in order])
    found = _repeated(_named(df, keys, order))
    same = F.xxhash64(*keys) == F.col("__h")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    flagged = df.join(found, same, "left").withColumn("is_duplicate", F.coalesce(place > F.col("__first"), F.lit(False)))
    return flagged.drop("__h", "__first", *[f"__k_{k}" for k in keys])


def _before(df: DataFrame, seq: Column) -> Column:
    """The rules before duplicates, as a CASE without an end."""
    return (
        F.when(~seq.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$"), "MALFORMED_AA")
        .when(expr.among(_text(df, "mhc_class"), CLASS_I) & ~F.length(seq).between(SHORTEST, LONGEST), "BAD_CLASS_I_LENGTH")
    )


def _after(df: DataFrame, seq: Column, intended_missense: bool, before: Column | None = None) -> Column:
    """Those after them, '' for none broken."""
    change = expr.missense(F.col("protein_variant") if "protein_variant" in df.columns else F.lit(None), not intended_missense)
    return (
        (F if before is None else before).when(expr.among(_text(df, "source_variant_type"), SUBSTITUTIONS) & ~seq.contains(change["new"]), "MUT_NOT_IN_PEPTIDE")
        .when(expr.among(_text(df, "hla_loh_call"), LOST), "HLA_LOH_LOST_ALLELE")
        .when(expr.among(_text(df, "expression_call"), SILENT), "GENE_NOT_EXPRESSED")
        .otherwise("")
    )


def row_reason(df: DataFrame, is_duplicate: Column, intended_missense: bool = False) -> Column:
    """The first broken rule, '' for none."""
    seq = _text(df, "mutant_peptide")
    return _after(df, seq, intended_missense, _before(df, seq).when(is_duplicate, "DUP_CANDIDATE"))


def told(df: DataFrame, intended_missense: bool = False) -> DataFrame:
    """df with TOLD: the first broken rule before and after duplicates among the rules, which a row alone tells."""
    rows = df.withColumn("__seq", _text(df, "mutant_peptide"))
    return rows.withColumns({"__before": _before(rows, F.col("__seq")).otherwise(""), "__after": _after(rows, F.col("__seq"), intended_missense)}).drop("__seq")


def concluded(rows: DataFrame, order: list[str], marked: DataFrame | None = None) -> DataFrame:
    """`told` rows as `tagged` has them. `marked`: their `marks`."""
    reason = F.when(F.col("__before") != "", F.col("__before")).when(F.col("is_duplicate"), "DUP_CANDIDATE").otherwise(F.col("__after"))
    return duplicates(rows, order, marked).withColumn("deterministic_gate_reason", reason).drop("is_duplicate", *TOLD).withColumns({
        "deterministic_gate_pass": F.col("deterministic_gate_reason") == "", "deterministic_gate_policy": F.lit(POLICY),
    })


def tagged(df: DataFrame, order: list[str], intended_missense: bool = False) -> DataFrame:
    """df with deterministic_gate_reason ('' passes), _pass and _policy. `order`: columns that put the rows in input order."""
    # what comes before and after a duplicate among the rules is told first, so that the rows needn't take the columns for it through the join
    return concluded(told(df, intended_missense), order)


def disabled(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "deterministic_gate_reason": F.lit(""), "deterministic_gate_pass": F.lit(True), "deterministic_gate_policy": F.lit("DISABLED"),
    })


def observed() -> list[Column]:
    """`summary` and the counts of REASONS as metrics of an Observation."""
    of = F.col("deterministic_gate_reason")
    return [F.count_if("deterministic_gate_pass").alias("survivor_count"), *[F.count_if(of == r).alias(f"reason_{r}") for r in REASONS],
            F.count_if((of != "") & ~of.isin(*REASONS)).alias("other_reasons")]


def summary(df: DataFrame) -> DataFrame:
    """input_count, survivor_count, removed_count, removed_fraction (0 for no rows); one row."""
    n, kept = F.count("*"), F.count_if("deterministic_gate_pass")
    return df.agg(
        n.alias("input_count"), kept.alias("survivor_count"), (n - kept).alias("removed_count"),
        F.when(n > 0, (n - kept) / n).otherwise(0.0).alias("removed_fraction"),
    )


def reasons(df: DataFrame) -> DataFrame:
    """reason, n of the removed rows. Passed rows are counted as none, as a filter before the aggregation would work the reason out twice."""
    of = F.col("deterministic_gate_reason")
    return df.groupBy(of.alias("reason")).agg(F.count_if(of != "").alias("n")).where("n > 0")
