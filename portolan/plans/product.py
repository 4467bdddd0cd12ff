"""From a table of any of the known shapes to ranked candidates and reports."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portolan.functions import expr
from portolan.operators import contracts, evidence, gate, score, select
from portolan.sources import tables

POLICY_NAME = "deterministic_evidence_policy_v1_not_a_validated_response_probability"  # fixed value
ONE_FILE = 1_000_000  # ranked rows of one patient that may be a single CSV file
MOST_PATIENTS = 10_000  # whose summaries and selected rows may be in the JSON and Markdown files
SHOWN = ("rank", "evidence_tier", "gene_symbol", "mutation_id", "mutant_peptide", "hla_allele", "evidence_score", "lower_evidence_score", "selection_reason")  # of selected rows

# Each canonical field and the names under which inputs carry it, best first.
ALIASES = {
    "candidate_id": ("candidate_id", "Index", "ID"),
    "patient_id": ("patient_id", "Patient", "Sample", "sample_name"),
    "gene_symbol": ("gene_symbol", "Gene Name", "Gene", "SYMBOL", "Gene Symbol"),
    "transcript_id": ("transcript_id", "Transcript", "Ensembl Transcript ID"),
    "mutation_id": ("mutation_id", "Mutation", "variant_id", "Variant"),
    "protein_variant": ("protein_variant", "Protein Variant"),
    "source_variant_type": ("source_variant_type", "Source Variant Type", "Variant Type"),
    "mhc_class": ("mhc_class", "MHC Class"),
    "hla_allele": ("hla_allele", "HLA Allele", "Allele", "Best Allele", "HLA"),
    "hla_loh_call": ("hla_loh_call", "HLA LOH"),
    "expression_call": ("expression_call", "Expressed"),
    "mutant_peptide": ("mutant_peptide", "MT Epitope Seq", "Mut Epitope", "peptide", "Peptide"),
    "wildtype_peptide": ("wildtype_peptide", "WT Epitope Seq", "Wt Epitope"),
    "dna_vaf": ("dna_vaf", "Tumor DNA VAF", "DNA VAF", "DNA Allelic Fraction"),
    "rna_depth": ("rna_depth", "Tumor RNA Depth", "RNA Depth"),
    "rna_vaf": ("rna_vaf", "Tumor RNA VAF", "RNA VAF", "RNA Allelic Fraction"),
    "rna_mutant_reads": ("rna_mutant_reads", "Tumor RNA Alt Read Support", "RNA Mutant Reads"),
    "expression_tpm": ("expression_tpm", "Gene Expression", "Transcript Expression", "RNA expression (TPM)", "Gene Level Expression TPM"),
    "clonality_ccf": ("clonality_ccf", "CCF", "Cancer Cell Fraction"),
    "binding_affinity_nm": ("binding_affinity_nm", "Best MT Score", "Median MT IC50 Score", "IC50 MT"),
    "binding_percentile_rank": ("binding_percentile_rank", "Best MT Percentile", "Median MT Percentile", "MT Percentile", "SHERPA Presentation Rank"),
    "wildtype_binding_affinity_nm": ("wildtype_binding_affinity_nm", "Corresponding WT Score", "Median WT IC50 Score"),
    "presentation_score": ("presentation_score", "mhcflurry_presentation_score", "bigmhc_el_score"),
    "recognition_score": ("recognition_score", "prime_source_score", "foreignness_score"),
}
NUMBERS = evidence.VALUES
TEXTS = ("gene_symbol", "transcript_id", "mutation_id", "protein_variant", "source_variant_type", "mhc_class", "hla_allele", "hla_loh_call", "expression_call", "wildtype_peptide")
DERIVED = (("tumor_vaf", "dna_vaf", "copy"), ("mixmhcpred_rank", "presentation_score", "rank"), ("prime_rank", "recognition_score", "rank"))


def first_of(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first name that is a column, by exact spelling."""
    return next((n for n in names if n in columns), None)


def with_dup_suffix(df: DataFrame, base: str, order: list[str], to: str) -> DataFrame:
    """`to`: the base id, with :dup1, :dup2, ... for its repetitions in this order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1
    return df.withColumn(to, F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit(":dup"), n.cast("string"))))


def normalized(df: DataFrame, patient_id: str | None = None, source: str = "product_input", order: str = tables.ORDER, checked: bool = True) -> DataFrame:
    """The canonical candidate table of an input: known fields under their names, text canonical, numbers parsed, ids filled. Other columns
    are dropped. Raises where the table breaks the candidate contract; with checked=False that is left to whoever reads the rows."""
    found = {field: first_of(df.columns, names) for field, names in ALIASES.items()}
    raw = lambda name: F.col(f"`{name}`").cast("string")
    columns: dict[str, Column] = {
        field: expr.number(raw(name)) if field in NUMBERS else raw(name) for field, name in found.items() if name
    }
    for name, field, how in DERIVED:
        if field not in columns and name in df.columns:
            x = expr.number(raw(name))
            columns[field] = x if how == "copy" else expr.rank_to_score(x)
    if patient_id is not None:
        columns["patient_id"] = F.lit(patient_id)
    if "patient_id" not in columns:
        raise ValueError("no patient column, and no patient_id was given")
    if "mutant_peptide" not in columns:
        raise ValueError("no mutant peptide column")
    for field in TEXTS:
        columns.setdefault(field, F.lit(""))
    columns["patient_id"] = expr.strip(F.coalesce(columns["patient_id"], F.lit("")))
    columns["mutant_peptide"], columns["wildtype_peptide"] = expr.peptide(columns["mutant_peptide"]), expr.peptide(columns["wildtype_peptide"])
    columns["hla_allele"] = expr.hla(columns["hla_allele"])
    given = columns.pop("candidate_id", None)
    rows = df.select(F.col(order).alias(tables.ORDER), *([given.alias("__given")] if given is not None else []), *[x.alias(n) for n, x in columns.items()])
    own = expr.stable_id(*map(F.col, ("patient_id", "mutation_id", "transcript_id", "mutant_peptide", "hla_allele")))
    if given is None:
        rows = with_dup_suffix(rows.withColumn("__base", own), "__base", [tables.ORDER], "candidate_id").drop("__base")
    else:
        blank = F.col("__given").isNull() | (expr.strip(F.col("__given")) == "")
        rows = rows.withColumn("candidate_id", F.when(blank, own).otherwise(F.col("__given"))).drop("__given")
    out = rows.withColumns({"source_name": F.lit(source), "candidate_schema_version": F.lit(contracts.CANDIDATE_VERSION)})
    if checked:
        contracts.check(out, "candidate input")
    return out


def ranked(df: DataFrame, policy: score.Policy = score.Policy(), order: str = tables.ORDER, checked: bool = False) -> DataFrame:
    """Gate, scores, tiers and the selection of a canonical table, every row in it. checked: the table is known to keep its contract, as
    `normalized` gives it."""
    if not checked:
        contracts.check(df, "candidate input")
    gated = gate.tagged(df, [order]) if policy.apply_gate else gate.disabled(df)
    return select.portfolio(score.scored(gated, policy), policy).withColumn("ranked_schema_version", F.lit(contracts.RANKED_VERSION))


def load(spark: SparkSession, path: str, patient_id: str | None = None, rna_path: str | None = None, checked: bool = True) -> DataFrame:
    """The canonical table of a file, with the RNA evidence of another. Evidence that repeats a key is an error of the job that reads these rows."""
    rows = normalized(tables.read_table(spark, path), patient_id, checked=checked)
    if rna_path is None:
        return rows
    rna = tables.read_table(spark, rna_path)
    names = {f: first_of(rna.columns, ALIASES[f]) for f in ("candidate_id", "patient_id", "mutation_id", "transcript_id", "gene_symbol", *evidence.VALUES)}
    chosen = [(expr.number(F.col(f"`{n}`")) if f in evidence.VALUES else F.col(f"`{n}`")).alias(f) for f, n in names.items() if n]
    rna = rna.select(*chosen)
    if patient_id is not None and "patient_id" not in rna.columns:
        rna = rna.withColumn("patient_id", F.lit(patient_id))
    return evidence.overlaid(rows, rna)


def _by_patient(ranking: DataFrame) -> DataFrame:
    """One table for all that a report needs besides counts: first a row with the duplicate ids, then a row for each patient, in their order,
    with its summary and its selected rows (k at most)."""
    shown = F.struct(*[F.col(c) for c in SHOWN])
    chosen = ranking.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.when(F.col("selected"), shown))).alias("chosen"))
    summaries = select.patient_summary(ranking)
    patients = summaries.join(chosen.withColumnRenamed("patient_id", "__p"), F.col("patient_id").eqNullSafe(F.col("__p"))).drop("__p")
    rows = patients.select(F.lit(1).alias("kind"), F.lit(None).cast("long").alias("duplicates"), F.struct(*summaries.columns).alias("summary"), "chosen")
    ids = ranking.agg(contracts.duplicate_ids(ranking).alias("duplicates"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("summary", "chosen")]
    return ids.select(F.lit(0).alias("kind"), "duplicates", *none).union(rows).orderBy("kind", "summary.patient_id")


def write_report(ranking: DataFrame, folder: str, what: str = "ranked output") -> dict[str, str]:
    """The ranked table as CSV, and its summaries as JSON and Markdown.

    Raises where the table breaks the ranked contract. One patient's table is a single CSV file; several patients' is a folder of parts that
    the executors write. Summaries and selected rows (k a patient) come to the driver for up to MOST_PATIENTS; beyond, they are folders
    too, which report.json names.

    Three jobs: the ranking is written once as it is made, which counts rows, blanks, bad peptides and gate reasons on the way; one query over what was
    written has the duplicate ids, the summaries and the selected rows; and the CSV. Nothing is kept in executors, and the copy is deleted.
    """
    spark, staged = ranking.sparkSession, f"{folder}/staged-{uuid.uuid4().hex}"
    counted = Observation()
    try:
        ranking.observe(counted, *contracts.observed(ranking), *gate.observed()).write.parquet(staged)
        found = counted.get
        contracts.enforced(contracts.reported(ranking.columns, found, contracts.RANKED), what)
        rows = spark.read.schema(ranking.schema).parquet(staged)
        (first, *patients) = _by_patient(rows).limit(MOST_PATIENTS + 2).collect()
        contracts.enforced(contracts.reported(ranking.columns, found | {"duplicate_candidate_ids": first["duplicates"]}, contracts.RANKED), what)
        table, csv = select.final_order(rows.drop(tables.ORDER)), f"{folder}/ranked_candidates.csv"
        if len(patients) <= 1 and found["row_count"] <= ONE_FILE:
            tables.write_csv(table, csv)
        else:
            tables.write_csv_parts(table, csv)
        n, kept = found["row_count"], found["survivor_count"]
        checked = {"input_count": n, "survivor_count": kept, "removed_count": n - kept, "removed_fraction": (n - kept) / n if n else 0.0}
        if found["other_reasons"]:  # a table that was gated elsewhere
            reasons = [(r["reason"], r["n"]) for r in gate.reasons(rows).collect()]
        else:
            reasons = [(r, found[f"reason_{r}"]) for r in gate.REASONS if found[f"reason_{r}"]]
        checked["reason_counts"] = dict(sorted(reasons, key=lambda x: (-x[1], x[0])))
        report: dict = {"schema_version": contracts.RANKED_VERSION, "policy": POLICY_NAME, "deterministic_gate": checked}
        chosen: dict[str, list] = {}
        if len(patients) <= MOST_PATIENTS:
            report["patients"] = [p["summary"].asDict() for p in patients]
            chosen = {p["summary"]["patient_id"]: p["chosen"] for p in patients}
        else:
            report |= {"patients_folder": f"{folder}/patients", "selected_folder": f"{folder}/selected"}
            select.patient_summary(rows).write.mode("overwrite").json(report["patients_folder"])
            rows.where("selected").drop(tables.ORDER).write.mode("overwrite").json(report["selected_folder"])
    finally:
        tables.delete(spark, staged)
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(f"{folder}/report.json").write_text(json.dumps(report, indent=2) + "\n")
    Path(f"{folder}/report.md").write_text(_markdown(checked, report.get("patients", []), chosen))
    return {"csv": csv, "json": f"{folder}/report.json", "markdown": f"{folder}/report.md"}


def _markdown(checked: dict, patients: list[dict], chosen: dict[str, list]) -> str:
    out = ["# Candidate report", "", "Scores rank evidence; they are no probabilities of a response.", "", "## Validity gate", "",
           f"{checked['input_count']} candidates, {checked['removed_count']} removed ({checked['removed_fraction']:.1%}).", ""]
    out += [f"- {reason}: {n}" for reason, n in checked["reason_counts"].items()]
    for p in patients:
        out += ["", f"## {p['patient_id']}", "", f"{p['candidate_count']} candidates, {p['eligible_count']} eligible, {p['selected_count']} selected "
                f"({p['core_count']} core, {p['supporting_count']} supporting, {p['filler_count']} filler).", ""]
        if p["abstained"]:
            out += [f"Abstained: {p['abstention_reason']}.", ""]
        out += ["| rank | tier | gene | mutation | peptide | HLA | score | lower | evidence |", "|-:|-|-|-|-|-|-:|-:|-|"]
        out += [f"| {r['rank']} | {r['evidence_tier']} | {r['gene_symbol']} | {r['mutation_id']} | {r['mutant_peptide']} | {r['hla_allele']} "
                f"| {r['evidence_score']:.3f} | {r['lower_evidence_score']:.3f} | {r['selection_reason']} |" for r in chosen.get(p["patient_id"], [])]
    return "\n".join(out) + "\n"


def run_patient(spark: SparkSession, path: str, folder: str, patient_id: str | None = None, rna_path: str | None = None, policy: score.Policy = score.Policy()) -> dict[str, str]:
    """From a file to its reports. The candidate contract is a part of the ranked one, so it is checked where the ranking is written."""
    rows = load(spark, path, patient_id, rna_path, checked=False)
    return write_report(ranked(rows, policy, checked=True), folder, "candidate input")
