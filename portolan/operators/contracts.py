"""Contracts of candidate and ranked tables, each checked in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from portolan.functions import expr

REQUIRED = ("candidate_id", "patient_id", "mutant_peptide")
RANKED = (*REQUIRED, "evidence_score", "lower_evidence_score", "evidence_tier", "selected", "rank")
CANDIDATE_VERSION, RANKED_VERSION, RESEARCH_VERSION = "candidate-1.0.0", "ranked-1.0.0", "research-1.0.0"
RESEARCH = ("candidate_id", "source_dataset", "study_id", "patient_id", "hla_allele", "mutant_peptide", "wildtype_peptide", "label", "label_weight", "assay_type")
LABELS = ("positive", "negative", "unknown")
BITS = 60  # flags in one number


class ContractError(ValueError):
    """A table breaks its contract; `report` tells where."""

    def __init__(self, what: str, report: Report):
        super().__init__(f"{what} violates the product contract: {report}")
        self.report = report


@dataclass(frozen=True)
class Report:
    schema_version: str
    row_count: int
    missing_columns: tuple[str, ...]
    empty_required_values: tuple[str, ...]
    duplicate_candidate_ids: int
    invalid_peptides: int
    invalid_labels: tuple[str, ...] = ()

    @property
    def ok(self) -> bool:
        return not (self.missing_columns or self.empty_required_values or self.duplicate_candidate_ids or self.invalid_peptides or self.invalid_labels)


def _blanks_and_peptides(df: DataFrame) -> list[Column]:
    has = [c for c in REQUIRED if c in df.columns]
    blank = [F.count_if(F.col(c).isNull() | (expr.strip(F.col(c).cast("string")) == "")).alias(f"blank_{c}") for c in has]
    bad = F.count_if(~expr.peptide(F.col("mutant_peptide")).rlike("^[ACDEFGHIKLMNPQRSTVWY]+$")) if "mutant_peptide" in has else F.lit(0)
    return [*blank, bad.cast("long").alias("invalid_peptides")]


def observed(df: DataFrame) -> list[Column]:
    """What `counts` has but the duplicate ids, as metrics of an Observation: they are counted in the pass that writes df."""
    return [F.count(F.lit(1)).alias("row_count"), *_blanks_and_peptides(df)]


def duplicate_ids(df: DataFrame) -> Column:
    """How many ids are there again; missing ids are one id."""
    if "candidate_id" not in df.columns:
        return F.lit(0).cast("long")
    return (F.count("candidate_id") - F.count_distinct("candidate_id") + F.greatest(F.count_if(F.col("candidate_id").isNull()) - 1, F.lit(0))).cast("long")


def counts(df: DataFrame) -> DataFrame:
    """One row: row_count, blank_<column> for each required column that is there, duplicate_candidate_ids, invalid_peptides."""
    *blank, bad = _blanks_and_peptides(df)
    return df.agg(F.count("*").alias("row_count"), *blank, duplicate_ids(df).alias("duplicate_candidate_ids"), bad)


def report(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> Report:
    """Of a candidate table; with RANKED as `required` of a ranked one."""
    return reported(df.columns, counts(df).first().asDict(), required)


def reported(columns: list[str], found: dict, required: tuple[str, ...] = REQUIRED) -> Report:
    """Of a table with these columns, for which `counts` or `observed` found this."""
    return Report(
        RANKED_VERSION if required is RANKED else CANDIDATE_VERSION, found["row_count"], tuple(sorted(set(required) - set(columns))),
        tuple(sorted(c for c in REQUIRED if c in columns and found[f"blank_{c}"])), found.get("duplicate_candidate_ids", 0), found["invalid_peptides"],
    )


def enforced(found: Report, what: str) -> Report:
    """The report of a table that keeps its contract; an error for one that doesn't."""
    if not found.ok:
        raise ContractError(what, found)
    return found


def check(df: DataFrame, what: str, required: tuple[str, ...] = REQUIRED) -> Report:
    return enforced(report(df, required), what)


def research_report(df: DataFrame) -> Report:
    """Columns, labels and duplicate ids of a normalised data set."""
    return research_survey(df, df.columns)[0]


def research_survey(df: DataFrame, columns: list[str], flags: list[str] | None = None) -> tuple[Report, list[bool]]:
    """The report of a data set with these columns, of which df has its ids and labels, and for each of the flags, boolean columns of df, whether some row
    has it. One pass counts hashes of ids; ids are compared, and strange labels listed, only where it finds that there are any."""
    flags = flags or []
    missing = tuple(sorted(set(RESEARCH) - set(columns)))
    odd = ~F.col("label").isin(*LABELS) if "label" in df.columns else F.lit(False)
    ident = F.coalesce(F.col("candidate_id"), F.lit("")) if "candidate_id" in df.columns else None
    masks = _masks(flags)
    hashed = df.groupBy(*([] if ident is None else [F.xxhash64(ident)])).agg(F.count("*").alias("n"), F.count_if(odd).alias("odd"), *masks)
    row = hashed.agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"), F.sum(F.col("n") - 1).alias("again"), *[F.bit_or(f"__mask{i}").alias(f"__mask{i}") for i in range(len(masks))]).first()
    labels = df.where(odd).agg(F.collect_set("label")).first()[0] if row["odd"] else []
    again = df.agg(F.count("*") - F.count_distinct(ident)).first()[0] if ident is not None and row["again"] else 0
    return Report(RESEARCH_VERSION, row["n"] or 0, missing, (), int(again), 0, tuple(sorted(labels))), _unmasked(row, flags)


def some_have(df: DataFrame, flags: list[str]) -> list[bool]:
    """For each of the flags, boolean columns of df, whether some row has it."""
    return _unmasked(df.agg(*_masks(flags)).first(), flags) if flags else []


def _masks(flags: list[str]) -> list[Column]:
    """Flags as bits, so that a row of many flags stays small."""
    bits = lambda part: reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, f in enumerate(part)])
    return [F.bit_or(bits(flags[i : i + BITS])).alias(f"__mask{i // BITS}") for i in range(0, len(flags), BITS)]


def _unmasked(row: Row, flags: list[str]) -> list[bool]:
    return [bool((row[f"__mask{i // BITS}"] or 0) >> i % BITS & 1) for i in range(len(flags))]


def supervised(df: DataFrame) -> DataFrame:
    return df.where(F.col("label").isin("positive", "negative"))
