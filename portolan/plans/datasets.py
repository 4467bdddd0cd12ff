"""The six research data sets under one schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions import expr, peptides
from portolan.operators import contracts
from portolan.sources.tables import ORDER, read_table

# Columns that may hold a response, and each data set's names of known features.
RESPONSES = ("response_type", "Response Type", "response", "Response", "Screening Status", "immunogenicity", "Immunogenicity", "reactivity", "Reactivity", "TIL Reactivity")
FIELDS = {
    "study_id": ("dataset", "Dataset", "study_id", "Study"),
    "patient_id": ("patient", "Patient", "patient_id", "Sample", "sample", "ID"),
    "hla_allele": ("hla_allele", "HLA", "Allele", "HLA Allele", "Best Allele", "best_allele", "mutant_best_allele"),
    "mutant_peptide": ("mutant_seq", "mut_seq", "mutant_peptide", "Mut Epitope", "Mutant Minimal Peptide", "Mutant Mmp", "Mutated Minimal Peptide", "Mutant Nmer", "mutant_nmer"),
    "wildtype_peptide": ("wt_seq", "wildtype_seq", "wildtype_peptide", "Wt Epitope", "Wildtype Minimal Peptide", "Wildtype Mmp", "Wildtype Nmer", "wt_nmer"),
    "gene_symbol": ("gene", "Gene Name", "Gene", "gene_symbol"),
    "assay_type": ("assay_type", "Assay", "Assay Type"),
}
NUMBERS = "numbers"  # the VARIANT column of `narrow`
IMPROVE_MEMBER = "data/03_data_for_CV/IMPROVE/03_3_final_peptide_features_Partition_for_CV.txt"
NEORANKING = {
    "rnaseq_TPM": "expression_tpm", "CCF": "clonality_ccf", "mutant_rank_netMHCpan": "netmhcpan_mutant_rank", "mutant_rank_PRIME": "prime_mutant_rank",
    "mut_Rank_Stab": "netmhcstab_mutant_rank", "mut_binding_score": "binding_score", "DAI_NetMHC": "dai_netmhc", "DAI_MixMHC": "dai_mixmhc",
    "bestWTMatchScore_I": "self_similarity_score", "bestMutationScore_I": "foreignness_mutation_score",
}
GARTNER = {
    "Rank NetMHC": "baseline_netmhc_rank", "Rank Nmer Model": "baseline_gartner_nmer_rank", "Rank Mmp Model": "baseline_gartner_mmp_rank",
    "AUC NetMHC": "source_auc_netmhc", "AUC NMER Model": "source_auc_nmer_model",
}
GARTNER_STATUS = {"cd8": "positive", "1": "positive", "0": "negative", "-": "negative"}
BIGMHC = {
    "BigMHC_EL": "bigmhc_el_score", "BigMHC_IM": "bigmhc_im_score", "BigMHC_ELIM": "bigmhc_elim_score", "NetMHCpan-4.1_Scores": "netmhcpan_41_score",
    "NetMHCpan-4.1_Ranks": "netmhcpan_41_rank", "MHCflurry-2.0_Scores": "mhcflurry_20_score", "MHCflurry-2.0_Ranks": "mhcflurry_20_rank",
    "PRIME-2.0_Scores": "prime_20_score", "PRIME-2.0_Ranks": "prime_20_rank",
}
CD8 = {
    "Binding affinity (%Rank score)": "netmhcpan_binding_percentile_rank", "RNA expression (TPM)": "expression_tpm",
    "Proteasomal processing score": "proteasomal_processing_score", "EL (%Rank score)": "netmhcpan_el_percentile_rank",
    "RF classifier score": "source_rf_presentation_score", "Agretopicity": "agretopicity_ratio", "Foreignness score": "foreignness_score",
    "Dissimilarity": "self_dissimilarity_score", "TMB": "tumor_mutational_burden",
}
IMPROVE = {
    "RankEL_4.1": "netmhcpan_el_percentile_rank", "RankBA_4.1": "netmhcpan_binding_percentile_rank", "RankEL_wt_4.1": "wildtype_netmhcpan_el_percentile_rank",
    "Stability": "binding_stability_hours", "Prime": "prime_source_score", "DAI_4.1": "differential_agretopicity_index", "Expression": "expression_tpm",
    "CelPrev": "cellular_prevalence", "PrioScore": "source_priority_score", "SelfSim": "self_similarity_score", "Foreigness": "foreignness_score",
    "HLAexp": "hla_expression", "CYT": "cytolytic_activity", "NetMHCExp": "netmhc_expression_score", "rna_af": "rna_variant_allele_fraction",
    "ValMutRNACoef": "validated_mutant_rna_coefficient", "HydroAll": "source_hydrophobicity_all", "HydroCore": "source_hydrophobicity_tcr_core",
}
DERIVED = (
    ("netmhcpan_el_percentile_rank", "netmhcpan_el_score", expr.rank_to_score),
    ("netmhcpan_binding_percentile_rank", "netmhcpan_binding_score", expr.rank_to_score),
    ("wildtype_netmhcpan_el_percentile_rank", "wildtype_netmhcpan_el_score", expr.rank_to_score),
    ("expression_tpm", "log_expression_tpm", expr.log_expression),
    ("agretopicity_ratio", "agretopicity_score", expr.agretopicity),
)


def keep_first(df: DataFrame, keys: list[str], order: list[str], count: str) -> DataFrame:
    """The first row of each key, in this order, and how many there are. Missing keys equal one another; of rows alike in key and order the
    smallest stands for the others. One aggregation that sends a row for each key and task, so a key with most of the rows is no heavier than others."""
    named = {c: f"__k{i}" for i, c in enumerate(keys)}
    # no column is sent twice
    of = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*order, *df.columns])) if c not in keys}
    row = F.struct(*[_c(c).alias(n) for c, n in of.items()] or [F.lit(0).alias("none")])
    first = df.groupBy(*[_c(k).alias(n) for k, n in named.items()]).agg(F.min(row).alias("__f"), F.count("*").alias("__n"))
    return first.select(*[F.col(named[c] if c in named else f"__f.{of[c]}").alias(c) for c in df.columns], F.col("__n").alias(count))


def conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys with more than one label (missing labels don't count), and how many."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count_distinct(F.col(f"`{label}`")).alias("n")).where("n > 1")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(df: DataFrame, *names: str, default: str = "") -> Column:
    """The first of the columns that df has, missing cells ''."""
    found = next((n for n in names if n in df.columns), None)
    return F.coalesce(_c(found).cast("string"), F.lit("")) if found else F.lit(default)


def _require(df: DataFrame, what: str, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} table lacks columns: {missing}")


def _unnamed(df: DataFrame, taken: set[str]) -> list[str]:
    """Columns that aren't taken; Spark's names ignore case."""
    used = {t.lower() for t in (*taken, ORDER)}
    return [n for n in df.columns if n.lower() not in used]


def _surveyed(df: DataFrame, core: dict[str, Column], names: list[str], checked: bool, wrong: Column | None = None, what: Callable[[], str] | None = None) -> dict[str, Column]:
    """The columns of `names` with some number in them. The same pass looks whether rows are `wrong`, an error that `what` tells of, and if `checked` whether the
    ids and labels of `core` keep the schema."""
    found = {f"__is{i}": expr.number(_c(n)).isNotNull() for i, n in enumerate(names)} | ({} if wrong is None else {"__wrong": wrong})
    flags = df.select(*[core[n].alias(n) for n in ("candidate_id", "label") if checked], *[x.alias(n) for n, x in found.items()])
    report, there = contracts.research_survey(flags, [*core, "label_weight"], list(found)) if checked else (None, contracts.some_have(flags, list(found)))
    if wrong is not None and there[-1]:
        raise ValueError(what())
    if report and not report.ok:
        raise ValueError(f"the normalised table violates the schema: {report}")
    return {n: expr.number(_c(n)) for n, has in zip(names, there, strict=False) if has}


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Copies of columns under their known names, where these are free."""
    return df.withColumns({new: _c(old) for old, new in names.items() if old in df.columns and new not in df.columns})


def _finished(df: DataFrame, features: bool = True) -> DataFrame:
    rows = peptides.with_deltas(df) if features else df
    pep, wt, allele = expr.peptide(F.col("mutant_peptide")), expr.peptide(F.col("wildtype_peptide")), expr.hla(F.col("hla_allele"))
    return rows.withColumns({
        "mutant_peptide_norm": pep, "wildtype_peptide_norm": wt, "hla_allele_norm": allele,
        "mutant_hla_key": expr.pair_key(pep, allele), "wildtype_hla_key": expr.pair_key(wt, allele),
    })


def _core(df: DataFrame, dataset: str, study: str | None) -> dict[str, Column]:
    """The shared fields: names resolved, label parsed."""
    label = expr.label(_c(next(n for n in RESPONSES if n in df.columns))) if any(n in df.columns for n in RESPONSES) else F.lit("unknown")
    return {
        "candidate_id": _c("candidate_id").cast("string") if "candidate_id" in df.columns else F.concat(F.lit(f"{dataset}:"), F.col(ORDER)),
        "source_dataset": F.lit(dataset),
        **{field: _text(df, *FIELDS[field], default=default) for field, default in (
            ("study_id", study or dataset), ("patient_id", ""), ("hla_allele", ""), ("mutant_peptide", ""), ("wildtype_peptide", ""), ("assay_type", "unknown"))},
        "label": label,
    } | ({"gene_symbol": _text(df, *FIELDS["gene_symbol"])} if any(n in df.columns for n in FIELDS["gene_symbol"]) else {})


def _weighed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label_weight", F.when(F.col("label") == "unknown", 0.0).otherwise(1.0))


def generic(df: DataFrame, dataset: str, study: str | None = None, features: bool = True, label: Column | None = None, checked: bool = True) -> DataFrame:
    """The shared form: names resolved, label parsed (or `label`, one of LABELS), all numeric columns kept. `checked=False`: ids can't repeat, so no pass looks for it."""
    core = _core(df, dataset, study) | ({} if label is None else {"label": label})
    numeric = _surveyed(df, core, _unnamed(df, set(core)), checked)
    return _finished(_weighed(df.select(ORDER, *[x.alias(n) for n, x in core.items()], *[x.alias(n) for n, x in numeric.items()])), features)


def _key(name: str) -> str:
    """A column's name as a key of the numbers; paths can't have quotes."""
    return name.replace("'", "\u2019").replace('"', "\u201d")


def narrow(df: DataFrame, dataset: str, study: str | None = None, features: bool = True) -> DataFrame:
    """The shared form without a job: which columns are numeric depends on their cells, so the cells that are numbers are in one VARIANT column,
    an object by column name; `number` and `widened` take columns out of it where they are asked for. Labels are of the schema by how they are made; whether given
    ids repeat is left to whoever writes the rows."""
    core = _core(df, dataset, study)
    names = _unnamed(df, set(core))
    cells = F.map_from_arrays(F.array(*[F.lit(_key(n)) for n in names]), F.array(*[expr.number(_c(n)) for n in names])) if names else F.create_map().cast("map<string,double>")
    numbers = F.to_variant_object(F.map_filter(cells, lambda _, x: x.isNotNull()))
    return _finished(_weighed(df.select(ORDER, *[x.alias(n) for n, x in core.items()], numbers.alias(NUMBERS))), features)


def number(name: str) -> Column:
    """A column out of the numbers of `narrow`; NULL where a row has none."""
    return F.try_variant_get(F.col(NUMBERS), f"$['{_key(name)}']", "double")


def widened(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows of `narrow` with these numbers (source column -> name) as columns of their own, where the names are free."""
    return rows.withColumns({new: number(old) for old, new in names.items() if new not in rows.columns})


def neoranking_of(df: DataFrame, dataset: str = "neoranking", checked: bool = True) -> DataFrame:
    return _renamed(generic(df, dataset, checked=checked), NEORANKING)


def neoranking(spark: SparkSession, path: str) -> DataFrame:
    return neoranking_of(read_table(spark, path))


def gartner(spark: SparkSession, path: str) -> DataFrame:
    return gartner_of(read_table(spark, path))


def gartner_label(status: Column) -> Column:
    status, own = F.lower(expr.strip(status)), F.lit("unknown")
    for label in dict.fromkeys(GARTNER_STATUS.values()):
        own = F.when(expr.among(status, tuple(w for w, of in GARTNER_STATUS.items() if of == label)), label).otherwise(own)
    return own


def gartner_of(df: DataFrame, checked: bool = True) -> DataFrame:
    own = None
    if "Screening Status" in df.columns:
        own = gartner_label(_c("Screening Status"))
    out = generic(df, "gartner_nci", label=own, checked=checked)
    if own is not None:  # these come last here
        out = out.select(*[_c(n) for n in out.columns if n not in ("label", "label_weight")], "label", "label_weight")
    return _renamed(out, GARTNER)


def binary_label(x: Column) -> Column:
    """A label of `_binary`; the job fails at a cell that is none."""
    value = expr.number(x)
    wrong = F.raise_error(F.concat(F.lit("a label is not a number: "), expr.shown(x)))
    return F.when((value >= 1) & (value < 2), "positive").when(F.abs(value) < float("inf"), "negative").otherwise(wrong)


def improve_label(x: Column) -> Column:
    """A label of `improve_of`; the job fails at a word that is none."""
    return expr.label(x, F.raise_error(F.lit("IMPROVE table has labels that are neither positive nor negative")))


def _binary(df: DataFrame, what: str, name: str) -> tuple[Column, Column, Callable[[], str]]:
    """positive for 1, negative for any other number (its fraction is cut off). A cell that is missing or no number is no label: an error, whose rows and text
    come with it."""
    value = expr.number(_c(name))
    wrong = value.isNull() | (F.abs(value) == float("inf"))
    return F.when((value >= 1) & (value < 2), "positive").otherwise("negative"), wrong, lambda: f"{what} table: {name} is not a number: {df.where(wrong).select(_c(name)).first()[0]!r}"


def tesla(spark: SparkSession, path: str) -> DataFrame:
    return tesla_of(read_table(spark, path))


def tesla_of(df: DataFrame, checked: bool = True) -> DataFrame:
    _require(df, "TESLA", "peptide", "target_value", "allele")
    label, wrong, error = _binary(df, "TESLA", "target_value")
    core = {
        "candidate_id": F.concat(F.lit("tesla:"), F.col(ORDER)), "source_dataset": F.lit("tesla"), "study_id": F.lit("tesla_wells_2020"),
        "patient_id": F.lit("tesla_unknown"), "hla_allele": _text(df, "allele"), "mutant_peptide": _text(df, "peptide"), "wildtype_peptide": F.lit(""),
        "label": label, "label_weight": F.lit(1.0), "assay_type": F.lit("tesla_target_value"),
    }
    _surveyed(df, core, [], checked, wrong, error)
    return _finished(df.select(ORDER, *[x.alias(n) for n, x in core.items()]), features=False)


def bigmhc(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    return bigmhc_of(read_table(spark, path, member), PurePosixPath(member or path).stem)


def bigmhc_of(df: DataFrame, part: str, checked: bool = True) -> DataFrame:
    _require(df, "BigMHC", "mhc", "pep", "tgt")
    label, wrong, error = _binary(df, "BigMHC", "tgt")
    core = {
        "candidate_id": F.concat(F.lit(f"bigmhc:{part}:"), F.col(ORDER)), "source_dataset": F.lit("bigmhc"), "study_id": F.lit(f"bigmhc_{part}"),
        "patient_id": F.concat(F.lit("bigmhc_"), _text(df, "mhc")), "hla_allele": _text(df, "mhc"), "mutant_peptide": _text(df, "pep"),
        "wildtype_peptide": _text(df, "wtp"), "label": label, "label_weight": F.lit(1.0), "assay_type": F.lit("bigmhc_immunogenicity"),
    } | ({"gene_symbol": _text(df, "gene")} if "gene" in df.columns else {})
    numeric = _surveyed(df, core, _unnamed(df, set(core)), checked, wrong, error)
    return _finished(_renamed(df.select(ORDER, *[x.alias(n) for n, x in (core | numeric).items()]), BIGMHC))


def _known(df: DataFrame, core: dict[str, Column], names: dict[str, str], checked: bool = True, wrong: Column | None = None, what: Callable[[], str] | None = None) -> DataFrame:
    if checked or wrong is not None:
        _surveyed(df, core, [], checked, wrong, what)
    numbers = {new: expr.number(_c(old)) for old, new in names.items() if old in df.columns}
    rows = df.select(ORDER, *[x.alias(n) for n, x in (core | numbers).items()])
    return _finished(rows.withColumns({new: f(F.col(old)) for old, new, f in DERIVED if old in numbers}))


def cd8_multimer(spark: SparkSession, path: str) -> DataFrame:
    return cd8_multimer_of(read_table(spark, path))


def cd8_multimer_of(df: DataFrame, checked: bool = True) -> DataFrame:
    _require(df, "CD8 multimer", "Patient ID", "WT epitope", "MUT epitope", "HLA", "Response", "Dataset", "Tumor type")
    keys = ["Patient ID", "MUT epitope", "HLA"]
    # no candidate has two labels unless the table has, and a hash of one has
    least, most = df.agg(F.min(_c("Response")), F.max(_c("Response"))).first()
    hashed = df.select(F.xxhash64(*map(_c, keys)).alias("h"), _c("Response").alias("label"))
    n = conflicts(df, keys, "Response").count() if least != most and conflicts(hashed, ["h"], "label").take(1) else 0
    if n:
        raise ValueError(f"CD8 multimer table: {n} candidates are repeated with other labels")
    df = keep_first(df, keys, [ORDER], "__copies")
    name = lambda s: F.concat(F.lit("cd8_multimer_2025:"), s)
    return _known(df, {
        # a row's number in the sheet, whose first is the header
        "candidate_id": name((F.col(ORDER) + 2).cast("string")), "source_dataset": F.lit("cd8_multimer_2025"), "study_id": F.lit("cd8_multimer_2025"),
        "patient_id": name(_text(df, "Patient ID")), "hla_allele": _text(df, "HLA"), "mutant_peptide": _text(df, "MUT epitope"), "wildtype_peptide": _text(df, "WT epitope"),
        "label": expr.label(_c("Response")), "label_weight": F.lit(1.0), "assay_type": F.concat(F.lit("phla_multimer_"), F.lower(expr.strip(_text(df, "Dataset")))),
        "source_patient_id": _text(df, "Patient ID"), "source_patient_alias": _text(df, "Alt. ID"), "specimen_source": _text(df, "Dataset"), "tumor_type": _text(df, "Tumor type"),
        "gene_symbol": _text(df, "SYMBOL"), "ensembl_gene_id": _text(df, "ENSG"), "genome_assembly": _text(df, "Genome assembly"),
        "source_duplicate_count": F.col("__copies").cast("string"),
    }, CD8, checked)


def improve_cv(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    if path.lower().endswith(".zip") and member is None:
        member = IMPROVE_MEMBER
    return improve_of(read_table(spark, path, member))


def improve_of(df: DataFrame, checked: bool = True) -> DataFrame:
    _require(df, "IMPROVE", "Patient", "HLA_allele", "Norm_peptide", "Mut_peptide", "response", "cohort", "Partition")
    label = expr.label(_c("response"))
    return _known(df, {
        "candidate_id": F.concat(F.lit("improve:"), F.col(ORDER)), "source_dataset": F.lit("improve"), "study_id": F.concat(F.lit("improve_"), _text(df, "cohort")),
        "patient_id": F.concat(F.lit("improve:"), _text(df, "Patient")), "hla_allele": _text(df, "HLA_allele"), "mutant_peptide": _text(df, "Mut_peptide"),
        "wildtype_peptide": _text(df, "Norm_peptide"), "label": label, "label_weight": F.lit(1.0), "assay_type": F.lit("validated_tcell_response"),
        "official_partition": _text(df, "Partition"), "tumor_type": _text(df, "cohort"), "gene_symbol": _text(df, "Gene_Symbol"),
    }, IMPROVE, checked, label == "unknown", lambda: "IMPROVE table has labels that are neither positive nor negative")


def stacked(sets: list[DataFrame]) -> DataFrame:
    """Normalised sets in one table: columns that a set lacks are missing there. Rows keep their ids; _ord counts within source_dataset."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def conflicts_between(rows: DataFrame) -> DataFrame:
    """Of stacked sets: pairs of peptide and allele that are positive somewhere and negative somewhere, how many sets tell of them, and how many
    labels they have of either kind. Pairs without peptide or allele aren't compared. One aggregation; a pair's sets are few."""
    known = contracts.supervised(rows).where((F.col("mutant_peptide_norm") != "") & (F.col("hla_allele_norm") != ""))
    by_pair = known.groupBy("mutant_hla_key").agg(
        F.size(F.collect_set("source_dataset")).alias("n_sets"), F.count_if(F.col("label") == "positive").alias("n_positive"), F.count_if(F.col("label") == "negative").alias("n_negative"),
    )
    return by_pair.where("n_positive > 0 and n_negative > 0")


def conflicts_side_by_side(df: DataFrame, patient: str, peptide: str, allele: str, labels: dict[str, Column], once: dict[str, Column]) -> DataFrame:
    """`conflicts_between` of sets that are made from the same rows, without stacking them. `labels`: data set -> its label of a row; `once`: the same for sets that keep a
    row for each patient, peptide and allele, whose rows have one label. A row's labels are counted where it is, so the shuffle has a row for a pair and patient and
    not one for each set; no text but the pair and the patient is in it."""
    said = {n: f"__l{i}" for i, n in enumerate((*labels, *once))}
    rows = df.select(F.col(patient).alias("__p"), F.col(peptide).alias("__pep"), F.col(allele).alias("__hla"), *[x.alias(said[n]) for n, x in (labels | once).items()])
    of = lambda n, word: (F.col(said[n]) == word).cast("int")
    total = lambda parts: reduce(lambda a, b: a + b, parts) if parts else F.lit(0)
    long = lambda n: F.lit(n).cast("long")
    bits = lambda names: total([F.when(F.col(said[n]) != "unknown", long(1 << i)).otherwise(long(0)) for i, n in enumerate(names)])
    counts = {"__pos": total([of(n, "positive") for n in labels]), "__neg": total([of(n, "negative") for n in labels]), "__pos1": total([of(n, "positive") for n in once]),
              "__neg1": total([of(n, "negative") for n in once]), "__bits": bits(said)}
    rows = rows.select("__p", "__pep", "__hla", *[x.alias(n) for n, x in counts.items()])
    # a set's candidates are told apart by their fields as they stand, pairs by their normal form
    each = rows.groupBy("__p", "__pep", "__hla").agg(
        F.sum("__pos").alias("pos"), F.sum("__neg").alias("neg"), F.max("__pos1").alias("pos1"), F.max("__neg1").alias("neg1"), F.bit_or("__bits").alias("bits"))
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    each = each.select(expr.peptide(text("__pep")).alias("__pep"), expr.hla(text("__hla")).alias("__hla"), "pos", "neg", "pos1", "neg1", "bits").where((F.col("__pep") != "") & (F.col("__hla") != ""))
    pairs = each.groupBy(expr.pair_key(F.col("__pep"), F.col("__hla")).alias("mutant_hla_key")).agg(
        F.bit_count(F.bit_or("bits")).alias("n_sets"), F.sum(F.col("pos") + F.col("pos1")).alias("n_positive"), F.sum(F.col("neg") + F.col("neg1")).alias("n_negative"))
    return pairs.where("n_positive > 0 and n_negative > 0")
