"""RNA evidence: a left join on the most specific key that both tables have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions import expr

KEYS = (("candidate_id",), ("mutation_id", "transcript_id"), ("mutation_id",), ("transcript_id",), ("gene_symbol",))
# The numbers that evidence may hold.
VALUES = (
    "dna_vaf", "rna_depth", "rna_vaf", "rna_mutant_reads", "expression_tpm", "clonality_ccf", "binding_affinity_nm", "binding_percentile_rank",
    "wildtype_binding_affinity_nm", "presentation_score", "recognition_score",
)


def key_of(candidates: list[str], evidence: list[str]) -> list[str]:
    """patient_id and the first of KEYS that both sides have."""
    for key in KEYS:
        full = ["patient_id", *key]
        if set(full) <= set(candidates) and set(full) <= set(evidence):
            return full
    raise ValueError("RNA evidence shares no key with the candidates: patient_id and one of " + ", ".join("+".join(k) for k in KEYS))


def duplicate_keys(evidence: DataFrame, key: list[str]) -> DataFrame:
    return evidence.groupBy(*key).count().where("count > 1")


def unique(evidence: DataFrame, key: list[str], what: str) -> DataFrame:
    """evidence, whose key names a row: a key that is there twice (missing values equal one another) is an error of the job that reads these
    rows, raised where they are grouped, whether or not anything matches them. No job of its own."""
    others = [c for c in evidence.columns if c not in key]
    # the values are taken from the one row; where there are two the condition raises
    one = evidence.groupBy(*key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in others])
    shown = F.concat_ws("+", *[F.coalesce(F.col(k), F.lit("(missing)")) for k in key])
    checked = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), shown)).cast("boolean"))
    return one.where(checked).select(*evidence.columns)


def _evidence(candidates: DataFrame, evidence: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """The evidence's key and values under names of their own, the key, the values."""
    key = key_of(candidates.columns, evidence.columns)
    values = [v for v in VALUES if v in evidence.columns]
    if not values:
        raise ValueError("RNA evidence has none of " + ", ".join(VALUES))
    return evidence.select(*[F.col(k).cast("string").alias(f"__k_{k}") for k in key], *[expr.number(F.col(v)).alias(f"__v_{v}") for v in values]), key, values


def overlaid(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """candidates, a table or a stream, with the evidence's values where it has any. Missing keys equal one another; a key that is there twice
    is an error of the job that runs this."""
    small, key, values = _evidence(candidates, evidence)
    small = unique(small, [f"__k_{k}" for k in key], "RNA evidence repeats a key (" + "+".join(key) + ")")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).cast("string").eqNullSafe(F.col(f"__k_{k}"))
    joined = candidates.join(small, same, "left")
    overlay = {v: F.coalesce(F.col(f"__v_{v}"), F.col(v)) if v in candidates.columns else F.col(f"__v_{v}") for v in values}
    return joined.withColumns(overlay).drop(*[c for c in joined.columns if c.startswith(("__k_", "__v_"))])


def merged(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """`overlaid`, with the keys looked through at once: a key that is there twice is an error of this call."""
    small, key, _ = _evidence(candidates, evidence)
    if duplicate_keys(small, [f"__k_{k}" for k in key]).take(1):
        raise ValueError("RNA evidence repeats a key: " + "+".join(key))
    return overlaid(candidates, evidence)
