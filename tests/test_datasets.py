import math
import zipfile

import pytest
from pyspark.sql import functions as F

from portolan.functions import expr, peptides
from portolan.operators import baseline, contracts
from portolan.plans import datasets


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_hla_and_labels(spark):
    alleles = {"A0201": "HLA-A*02:01", "HLA-B0702": "HLA-B*07:02", " c*07:02 ": "HLA-C*07:02", "A*0201": "HLA-A*02:01", "A201": "HLA-A201", "": "HLA-", None: "", "DRB1*01:01": "HLA-DRB1*01:01"}
    rows = spark.createDataFrame([(k,) for k in alleles], "x string").select("x", expr.hla(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == alleles
    words = {"CD8": "positive", " yes ": "positive", "0": "negative", "Non-Reactive": "negative", "-": "unknown", None: "unknown", "1.0": "unknown"}
    rows = spark.createDataFrame([(k,) for k in words], "x string").select("x", expr.label(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == words
    numbers = {"1d": None, "1f": None, " 2.5 ": 2.5, "1e3": 1000.0, "nan": None, "": None, "inf": math.inf, "x": None, None: None, "-.5": -0.5}
    rows = spark.createDataFrame([(k,) for k in numbers], "x string").select("x", expr.number(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == numbers


def test_peptide_features(spark):
    df = spark.createDataFrame([("SILNFEKLA", "SIINFEKLT"), ("ACDF", "ACDF"), ("ACD", "AC"), (None, "AC"), ("", "")], "mutant_peptide string, wildtype_peptide string")
    rows = peptides.with_sequence_features(peptides.with_deltas(df)).collect()
    assert (rows[0].mutation_count, rows[0].mutation_anchor_count, rows[0].mutation_tcr_face_count) == (2.0, 1.0, 1.0)
    assert abs(rows[0].mutation_hydrophobicity_delta - (3.8 - 4.5 + 1.8 + 0.7)) < 1e-9
    assert (rows[1].mutation_count, rows[1].seq_len, rows[1].seq_aa_frac_A, rows[1].seq_aromatic_fraction, rows[1].seq_charge_sum) == (0.0, 4.0, 0.25, 0.25, -1.0)
    assert rows[2].mutation_count is None and rows[3].seq_len is None and rows[4].seq_polar_fraction is None


def test_baselines(spark):
    df = spark.createDataFrame([("AC", "AC", 10.0, 0.5), ("AD", "AC", 1000.0, 0.5), ("AE", "AC", -1.0, None)], "mutant_peptide string, wildtype_peptide string, binding_affinity_nm double, presentation_score double")
    rows = baseline.with_baselines(df).collect()
    assert [r.baseline_binding_score for r in rows] == [-1.0, -3.0, None]
    assert abs(rows[0].baseline_pvac_style_score - (1 / math.sqrt(2)) / 2) < 1e-9 and rows[2].baseline_pvac_style_score is None
    assert baseline.numeric_features(df.withColumn("label", F.lit(1)).withColumn("none", F.lit(None).cast("int"))) == ["binding_affinity_nm", "presentation_score"]


def test_neoranking_zip(spark, tmp_path):
    text = ("patient\tdataset\ttrain_test\tresponse_type\tgene\tmutant_seq\twt_seq\trnaseq_TPM\tCCF\n"
            "P1\tNCI\ttrain\tCD8\tKRAS\tSILNFEKLA\tSIINFEKLT\t5.5\t0.9\nP2\tNCI\ttest\tnegative\tTP53\tACDEF\tACDEY\t\t\nP3\tNCI\ttest\tnot_tested\tTP53\tACDEF\t\t1\t1\n")
    with zipfile.ZipFile(tmp_path / "n.txt.zip", "w") as z:
        z.writestr("n.txt", text)
    for path in (write(tmp_path, "n.txt", text), str(tmp_path / "n.txt.zip")):
        rows = datasets.neoranking(spark, path).orderBy("_ord").collect()
        assert [r.label for r in rows] == ["positive", "negative", "unknown"] and [r.label_weight for r in rows] == [1.0, 1.0, 0.0]
        assert (rows[0].candidate_id, rows[0].expression_tpm, rows[0].clonality_ccf, rows[0].mutation_count) == ("neoranking:0", 5.5, 0.9, 2.0)


def test_gartner(spark, tmp_path):
    path = write(tmp_path, "g.txt", "ID\tGene Name\tWt Epitope\tMut Epitope\tScreening Status\tRank NetMHC\n" + "".join(f"p{i}\tG\tACD\tACE\t{s}\t{i}\n" for i, s in enumerate(["1", "0", "-", "unscreened"])))
    rows = datasets.gartner(spark, path).orderBy("_ord").collect()
    assert [r.label for r in rows] == ["positive", "negative", "negative", "unknown"] and rows[3].label_weight == 0.0 and rows[2].baseline_netmhc_rank == 2.0
    comma = datasets.gartner(spark, write(tmp_path, "c.txt", "Patient,Gene Name,Mutant Nmer,Rank NetMHC\nx,G,ACDEF,3\n")).first()
    assert (comma.patient_id, comma.mutant_peptide, comma.label) == ("x", "ACDEF", "unknown")


def test_tesla_and_bigmhc(spark, tmp_path):
    rows = datasets.tesla(spark, write(tmp_path, "t.csv", "peptide,target_value,allele\nACDEFGHIK,1,A0201\nACDEFGHIL,0,A0201\n")).orderBy("_ord").collect()
    assert [(r.candidate_id, r.label, r.hla_allele_norm) for r in rows] == [("tesla:0", "positive", "HLA-A*02:01"), ("tesla:1", "negative", "HLA-A*02:01")]
    with pytest.raises(ValueError, match="TESLA"):
        datasets.tesla(spark, write(tmp_path, "u.csv", "peptide,allele\nA,B\n"))
    row = datasets.bigmhc(spark, write(tmp_path, "im.csv", "mhc,pep,tgt,BigMHC_EL,note\nHLA-A*02:01,ACDEFGHIK,1,0.75,x\n")).first()
    assert (row.candidate_id, row.bigmhc_el_score, row.BigMHC_EL, row.patient_id) == ("bigmhc:im:0", 0.75, 0.75, "bigmhc_HLA-A*02:01") and "note" not in row


CD8 = "Patient ID,WT epitope,MUT epitope,HLA,Response,Dataset,Tumor type,RNA expression (TPM),EL (%Rank score),Agretopicity,Resp. Magnitude\n"


def test_cd8(spark, tmp_path):
    path = write(tmp_path, "c.csv", CD8 + "1,ACDEF,ACDEY,A0201,positive,TIL,mel,3,25,0.1,9\n1,ACDEF,ACDEY,A0201,positive,TIL,mel,4,25,0.1,9\n2,ACDEF,ACDEW,A0201,negative,PBMC,mel,,,,\n")
    rows = datasets.cd8_multimer(spark, path).orderBy("_ord").collect()
    assert [(r.candidate_id, r.source_duplicate_count, r.label, r.assay_type) for r in rows] == [
        ("cd8_multimer_2025:2", "2", "positive", "phla_multimer_til"), ("cd8_multimer_2025:4", "1", "negative", "phla_multimer_pbmc")]
    assert rows[0].netmhcpan_el_score == 0.75 and abs(rows[0].agretopicity_score - 1) < 1e-9 and abs(rows[0].log_expression_tpm - math.log(4)) < 1e-9
    assert not any("agnitude" in c for c in rows[0].asDict())
    with pytest.raises(ValueError, match="other labels"):
        datasets.cd8_multimer(spark, write(tmp_path, "d.csv", CD8 + "1,A,C,A,positive,T,m,,,,\n1,A,C,A,negative,T,m,,,,\n"))


def test_improve(spark, tmp_path):
    head = "Patient\tHLA_allele\tNorm_peptide\tMut_peptide\tresponse\tcohort\tPartition\tRankEL_4.1\tExpression\n"
    rows = datasets.improve_cv(spark, write(tmp_path, "i.tsv", head + "p\tA0201\tACDEF\tACDEY\t1\tmel\t3\t10\t7\n")).collect()
    assert (rows[0].candidate_id, rows[0].official_partition, rows[0].netmhcpan_el_score) == ("improve:0", "3", 0.9)
    assert contracts.supervised(datasets.improve_cv(spark, str(tmp_path / "i.tsv"))).count() == 1
    with pytest.raises(ValueError, match="neither"):
        datasets.improve_cv(spark, write(tmp_path, "j.tsv", head + "p\tA0201\tACDEF\tACDEY\tmaybe\tmel\t3\t10\t7\n"))


def test_labels_that_are_no_numbers(spark, tmp_path):
    for cell in ("", "abc"):
        with pytest.raises(ValueError, match="not a number"):
            datasets.tesla(spark, write(tmp_path, "t.csv", f"peptide,target_value,allele\nACDEFGHIK,1,A0201\nACDEFGHIL,{cell},A0201\n"))
        with pytest.raises(ValueError, match="not a number"):
            datasets.bigmhc(spark, write(tmp_path, "im.csv", f"mhc,pep,tgt\nHLA-A*02:01,ACDEFGHIK,{cell}\n"))


def test_features_need_their_columns(spark):
    df = spark.createDataFrame([("ACDEF", 10.0)], "mutant_peptide string, binding_affinity_nm double")
    assert peptides.with_deltas(df).columns == df.columns
    rows = baseline.with_baselines(df)
    assert "seq_len" in rows.columns and "mutation_count" not in rows.columns and rows.first().baseline_binding_score == -1.0
    bare = df.drop("mutant_peptide")
    assert peptides.with_sequence_features(bare).columns == bare.columns and baseline.with_baselines(bare).first().baseline_pvac_style_score == 0.0


def test_stacked_sets(spark, tmp_path):
    tesla = datasets.tesla(spark, write(tmp_path, "t.csv", "peptide,target_value,allele\nACDEFGHIK,1,A0201\nACDEFGHIL,0,A0201\n,1,A0201\n"))
    bigmhc = datasets.bigmhc(spark, write(tmp_path, "im.csv", "mhc,pep,tgt,BigMHC_EL\nHLA-A*02:01,acdefghik,0,0.75\nHLA-A*02:01,ACDEFGHIL,0,0.5\n,,0,0.5\n"))
    rows = datasets.stacked([tesla, bigmhc])
    assert rows.count() == 6 and {r.bigmhc_el_score for r in rows.where("source_dataset = 'tesla'").collect()} == {None}
    assert [tuple(r) for r in datasets.conflicts_between(rows).collect()] == [("ACDEFGHIK|HLA-A*02:01", 2, 1, 1)]
    assert datasets.conflicts_between(tesla).collect() == []


def test_narrow_equals_the_wide_form_without_a_job(spark):
    from test_product import jobs_of

    rows = [(0, "P", "ACDEFGHIK", "CD8", "1.5", "x", "7", None), (1, "P", "ACDEFGHIL", "negative", None, "y", "nan", "2"), (2, "Q", "ACDEFGHIM", "?", " 3 ", "z", "w", "")]
    df = spark.createDataFrame(rows, "_ord long, patient string, mutant_seq string, response_type string, rnaseq_TPM string, note string, `odd 'name.1` string, `CCF` string")
    wide = datasets.neoranking_of(df, "neo")
    made = []
    names = {n: n for n in ("rnaseq_TPM", "odd 'name.1", "CCF", "note")}
    assert jobs_of(spark, lambda: made.append(datasets.widened(datasets.widened(datasets.narrow(df, "neo"), names), datasets.NEORANKING))) == []
    narrow = made[0]
    assert {"note", "binding_score"} & set(wide.columns) == set()  # columns without numbers, or that aren't there
    shared = [c for c in wide.columns]
    assert set(shared) <= set(narrow.columns)
    pick = lambda t: sorted(map(tuple, t.select(*[f"`{c}`" for c in shared]).collect()), key=str)
    assert pick(narrow) == pick(wide)
    assert {r.note for r in narrow.collect()} == {r.binding_score for r in narrow.collect()} == {None}
    bare = datasets.narrow(df.select("_ord", "patient", "mutant_seq"), "neo")
    assert bare.select(datasets.number("CCF").alias("x")).distinct().collect() == [(None,)]
