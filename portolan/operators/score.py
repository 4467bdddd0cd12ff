"""Evidence scores, exclusion and tiers of gated candidates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions import expr

# A component's weight in the geometric mean.
WEIGHTS = {"translated": 0.25, "presented": 0.35, "recognized": 0.25, "coverage": 0.15}
UNKNOWN = 0.5  # the score of a component without evidence
DISCOUNT = 0.35  # of the score, for full uncertainty
LEAST = 1e-6
JUDGES = (*[f"{n}_evidence_available" for n in WEIGHTS], "__unsupported")  # what `judged` reads beside the lower score
PLACES = 9  # scores are rounded, so that engines agree on ties


@dataclass(frozen=True)
class Policy:
    """How candidates are tiered and selected."""

    k: int = 20
    max_per_mutation: int | None = 1
    max_per_gene: int | None = 4
    max_per_hla: int | None = None
    core_threshold: float = 0.55
    supporting_threshold: float = 0.35
    max_core_uncertainty: float = 0.35
    apply_gate: bool = True


def translation(df: DataFrame) -> list[Column]:
    """What the first component is the mean of."""
    c = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("double")
    return [expr.saturating(c("expression_tpm"), 10.0), F.sqrt(expr.bounded(c("rna_vaf"))), expr.saturating(c("rna_mutant_reads"), 5.0)]


def components(df: DataFrame, translated: list[Column] | None = None) -> dict[str, Column]:
    """Each component's score, NULL without evidence. Columns that df lacks count as missing. `translated`: columns that hold `translation`."""
    c = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("double")
    mutant, wildtype = c("binding_affinity_nm"), c("wildtype_binding_affinity_nm")
    return {
        "translated": expr.mean_of_available(*(translation(df) if translated is None else translated)),
        "presented": F.coalesce(
            expr.bounded(c("presentation_score")), expr.bounded(F.lit(1.0) - c("binding_percentile_rank") / 100.0),
            F.lit(1.0) / (F.lit(1.0) + expr.clip(mutant, 0.0) / 500.0),
        ),
        # the logistic of ln(wildtype / mutant)
        "recognized": F.coalesce(expr.bounded(c("recognition_score")), F.when((mutant > 0) & (wildtype > 0), wildtype / (wildtype + mutant))),
        "coverage": F.coalesce(expr.bounded(c("clonality_ccf")), expr.bounded(c("dna_vaf") / 0.5)),
    }


def _unsupported(df: DataFrame) -> Column:
    """Why evidence excludes a candidate that the gate lets pass, or ''."""
    c = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("double")
    return F.when(c("expression_tpm") <= 0, "NO_RNA_EXPRESSION").when((c("rna_depth") >= 10) & (c("rna_mutant_reads") <= 0), "NO_MUTANT_RNA_SUPPORT").otherwise("")


def _completeness() -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{n}_evidence_available").cast("int") for n in WEIGHTS]) / F.lit(4.0)


def reason_text() -> Column:
    """The exclusion reason, or which components have evidence."""
    names = lambda there: F.concat_ws(",", *[
        F.when(F.col(f"{n}_evidence_available") == there, n.upper()) for n in WEIGHTS
    ])
    have, lack = names(True), names(False)
    listed = F.concat(F.lit("AVAILABLE="), F.when(have == "", "NONE").otherwise(have), F.when(lack != "", F.concat(F.lit("; MISSING="), lack)).otherwise(""))
    return F.when(F.col("exclusion_reason") != "", F.col("exclusion_reason")).otherwise(listed)


def tier(policy: Policy) -> Column:
    low = F.col("lower_evidence_score")
    return (
        F.when(~F.col("eligible"), "EXCLUDED")
        .when((low >= policy.core_threshold) & (F.col("evidence_uncertainty") <= policy.max_core_uncertainty), "CORE")
        .when(low >= policy.supporting_threshold, "SUPPORTING").otherwise("FILLER")
    )


def evidence(df: DataFrame) -> DataFrame:
    """df with what its evidence says of a row, whatever the gate does: component scores, evidence score, its lower bound, and __unsupported.

    Steps that are read several times are columns of their own: written out in one another they make a generated method of over 8,000 bytes, which the
    JVM only interprets.
    """
    means = {f"__mean_of_{i}": c for i, c in enumerate(translation(df))}
    parts = components(df, [F.col(m) for m in means])
    rows = df.withColumns(means).withColumns({f"__{n}": c for n, c in parts.items()}).drop(*means)
    rows = rows.withColumns({
        **{f"{n}_evidence_score": F.coalesce(F.col(f"__{n}"), F.lit(UNKNOWN)) for n in parts},
        **{f"{n}_evidence_available": F.col(f"__{n}").isNotNull() for n in parts},
    }).drop(*[f"__{n}" for n in parts])
    logs = reduce(lambda a, b: a + b, [F.lit(w) * F.log(expr.clip(F.col(f"{n}_evidence_score"), LEAST)) for n, w in WEIGHTS.items()])
    rows = rows.withColumns({"__score": F.exp(logs), "evidence_completeness": _completeness(), "__unsupported": _unsupported(df)})
    rows = rows.withColumns({"evidence_score": F.round("__score", PLACES), "evidence_uncertainty": F.lit(1.0) - F.col("evidence_completeness")})
    return rows.withColumn("lower_evidence_score", F.round(F.col("__score") * (F.lit(1.0) - F.lit(DISCOUNT) * F.col("evidence_uncertainty")), PLACES)).drop("__score")


def judged(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Gated rows of `evidence` (of its columns, lower_evidence_score and JUDGES are enough) with exclusion, tier, selection reason and tie key."""
    gate = F.coalesce(F.col("deterministic_gate_reason"), F.lit(""))
    rows = df if "evidence_uncertainty" in df.columns else df.withColumn("evidence_uncertainty", F.lit(1.0) - _completeness())
    rows = rows.withColumn("exclusion_reason", F.when(gate != "", gate).otherwise(F.col("__unsupported"))).drop("__unsupported")
    rows = rows.withColumn("eligible", F.col("exclusion_reason") == "").withColumn("evidence_tier", tier(policy))
    return rows.withColumns({
        "selection_reason": reason_text(), "deterministic_tie_key": expr.tie_key(
            F.col("mutant_peptide"), F.col("hla_allele") if "hla_allele" in df.columns else F.lit("")
        ),
    })


def scored(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Gated candidates with component scores, evidence score, its lower bound, exclusion, tier and selection reason."""
    of = [f"{n}_evidence_{what}" for what in ("score", "available") for n in WEIGHTS]
    return judged(evidence(df), policy).select(
        *[F.col(f"`{c}`") for c in df.columns], *of, "evidence_completeness", "exclusion_reason", "evidence_score", "evidence_uncertainty", "eligible", "lower_evidence_score",
        "evidence_tier", "selection_reason", "deterministic_tie_key",
    )
