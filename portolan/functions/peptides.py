"""Features of peptide sequences, from counts of residues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions import expr

# The hydropathy scale and charges of the twenty residues, and their classes.
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
CHARGE = {"D": -1.0, "E": -1.0, "K": 1.0, "R": 1.0, "H": 0.5}
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
CLASSES = {"aromatic": "FWY", "polar": "STNQCY", "acidic": "DE", "basic": "KRH", "cysteine": "C", "proline": "P", "glycine": "G"}

DELTAS = ("mutation_count", "mutation_anchor_count", "mutation_tcr_face_count", "mutation_hydrophobicity_delta", "mutation_charge_delta")


# The scales by letter, for constant-time access.
_LETTERS = [chr(65 + i) for i in range(26)]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _counts(s: Column) -> dict[str, Column]:
    """How often each residue is in s, by lengths: no sequence is walked."""
    return {aa: F.length(s) - F.length(F.replace(s, F.lit(aa), F.lit(""))) for aa in RESIDUES}


def _weighed(counts: dict[str, Column], scale: dict[str, float]) -> Column:
    return _sum([counts[aa] * F.lit(v) for aa, v in scale.items()])


def deltas(mutant: Column, wildtype: Column, changed: Column) -> Column:
    """A struct of DELTAS; NULL unless both sequences are there and of one length. Anchors are the second and the last residue.

    Only changed positions are looked up in the scales. Both sequences have to be canonical (`expr.peptide`) columns, `changed` the
    column of `changed_places`: each is read many times.
    """
    m, w, n = mutant, wildtype, F.size(changed)
    anchors = F.size(F.filter(changed, lambda i: (i == 2) | (i == F.length(m))))

    def difference(scale: dict[str, float]) -> Column:
        weights = F.array(*[F.lit(scale.get(a, 0.0)) for a in _LETTERS])
        at = lambda s, i: F.coalesce(F.get(weights, F.ascii(F.substr(s, i, F.lit(1))) - 65), F.lit(0.0))
        return F.aggregate(changed, F.lit(0.0), lambda total, i: total + at(m, i) - at(w, i))

    found = F.struct(
        n.cast("double").alias(DELTAS[0]), anchors.cast("double").alias(DELTAS[1]), (n - anchors).cast("double").alias(DELTAS[2]),
        difference(HYDROPATHY).alias(DELTAS[3]), difference(CHARGE).alias(DELTAS[4]),
    )
    return F.when(changed.isNotNull(), found)


def changed_places(mutant: Column, wildtype: Column) -> Column:
    """Places, from 1, at which the sequences differ; NULL unless both are there and of one length."""
    differ = lambda i: F.substr(mutant, i, F.lit(1)) != F.substr(wildtype, i, F.lit(1))
    both = (mutant != "") & (wildtype != "") & (F.length(mutant) == F.length(wildtype))
    return F.when(both, F.filter(F.sequence(F.lit(1), F.length(mutant)), differ))


def with_deltas(df: DataFrame, mutant: str = "mutant_peptide", wildtype: str = "wildtype_peptide") -> DataFrame:
    """df with the DELTAS that it doesn't have yet; df as it is if it lacks one of the sequences."""
    new = [d for d in DELTAS if d not in df.columns]
    if not new or mutant not in df.columns or wildtype not in df.columns:
        return df
    found = df.withColumns({"__m": expr.peptide(F.col(mutant)), "__w": expr.peptide(F.col(wildtype))})
    found = found.withColumn("__changed", changed_places(F.col("__m"), F.col("__w")))
    found = found.withColumn("__deltas", deltas(F.col("__m"), F.col("__w"), F.col("__changed")))
    return found.withColumns({d: F.col(f"__deltas.{d}") for d in new}).drop("__deltas", "__changed", "__m", "__w")


def sequence_features(sequence: Column) -> list[Column]:
    """30 columns: length, mean hydropathy, charge, shares of residue classes and of residues; NULL for an empty sequence, which has to be
    a canonical column."""
    s = sequence
    length = F.when(s != "", F.length(s).cast("double"))
    count = _counts(s)
    share = lambda residues: _sum([count[aa] for aa in residues]) / length
    return [
        length.alias("seq_len"),
        (_weighed(count, HYDROPATHY) / length).alias("seq_hydrophobicity_mean"),
        F.when(length.isNotNull(), _weighed(count, CHARGE)).alias("seq_charge_sum"),
        *[share(residues).alias(f"seq_{name}_fraction") for name, residues in CLASSES.items()],
        *[share(aa).alias(f"seq_aa_frac_{aa}") for aa in RESIDUES],
    ]


def with_sequence_features(df: DataFrame, sequence: str = "mutant_peptide") -> DataFrame:
    """df with the sequence features that it doesn't have yet, all in one projection; df as it is if it lacks the sequence."""
    if sequence not in df.columns:
        return df
    names = ["seq_len", "seq_hydrophobicity_mean", "seq_charge_sum", *[f"seq_{n}_fraction" for n in CLASSES], *[f"seq_aa_frac_{aa}" for aa in RESIDUES]]
    new = [c for n, c in zip(names, sequence_features(F.col("__s")), strict=True) if n not in df.columns]
    return df.withColumn("__s", expr.peptide(F.col(sequence))).select("*", *new).drop("__s")
