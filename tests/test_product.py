import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import SparkRuntimeException, StreamingQueryException
from pyspark.sql import functions as F

from portolan.operators import contracts, evidence, gate, score, select
from portolan.plans import datasets, product
from portolan.sources import tables

# Values worked out by hand from the formulas: a patient with ten candidates.
COLUMNS = ("Gene Name", "Transcript", "Mutation", "HLA Allele", "MT Epitope Seq", "WT Epitope Seq", "Best MT Score", "Corresponding WT Score", "Tumor DNA VAF",
           "Tumor RNA Depth", "Tumor RNA VAF", "Tumor RNA Alt Read Support", "Gene Expression")
MINI = [
    ("KRAS", "T1", "G12D", "HLA-A*02:01", "KLVVVGADGV", "KLVVVGAGGV", "18", "600", "0.44", "120", "0.4", "48", "50"),
    ("KRAS", "T1", "G12D", "B0702", "VVVGADGVGK", "VVVGAGGVGK", "90", "100", "0.44", "120", "0.4", "48", "50"),
    ("TP53", "T2", "R175H", "A0201", "HMTEVVRHC", "HMTEVVRRC", "40", "300", "0.3", "80", "0.3", "20", "0"),
    ("BRAF", "T3", "V600E", "A0301", "KIGDFGLATEK", "KIGDFGLATVK", "55", "200", "0.2", "60", "0.2", "12", "NA"),
]


@pytest.fixture
def mini(tmp_path):
    path = tmp_path / "mini.tsv"
    path.write_text("\n".join("\t".join(r) for r in (COLUMNS, *MINI)) + "\n")
    return str(path)


def test_run(spark, mini, tmp_path):
    rows = product.load(spark, mini, "P1")
    assert contracts.report(rows).ok
    ranked = product.ranked(rows, score.Policy(k=2)).collect()
    by = {r.mutant_peptide: r for r in ranked}
    assert len(ranked) == 4 and by["HMTEVVRHC"].exclusion_reason == "NO_RNA_EXPRESSION" and by["HMTEVVRHC"].evidence_tier == "EXCLUDED"
    assert {r.mutation_id for r in ranked if r.selected} == {"G12D", "V600E"} and not by["VVVGADGVGK"].selected
    assert by["VVVGADGVGK"].hla_allele == "HLA-B*07:02"
    t = (50 / 60 + 0.4**0.5 + 48 / 53) / 3
    want = t**0.25 * (1 / (1 + 18 / 500)) ** 0.35 * (600 / 618) ** 0.25 * 0.88**0.15
    assert abs(by["KLVVVGADGV"].evidence_score - want) < 1e-8
    assert by["KIGDFGLATEK"].selection_reason == "AVAILABLE=TRANSLATED,PRESENTED,RECOGNIZED,COVERAGE"
    paths = product.run_patient(spark, mini, str(tmp_path / "out"), "P1", policy=score.Policy(k=2))
    report = json.loads(open(paths["json"]).read())
    assert report["deterministic_gate"]["input_count"] == 4 and report["patients"][0]["selected_count"] == 2
    lines = open(paths["csv"]).read().splitlines()
    assert len(lines) == 5 and "KLVVVGADGV" in lines[1]
    assert "G12D" in open(paths["markdown"]).read()


def test_adapters_and_errors(spark):
    df = spark.createDataFrame([(0, "P", "m", "ACDEFGHIK", "A0201", "0.25", "10", "20")], "_ord long, patient_id string, mutation_id string, mutant_peptide string, hla_allele string, tumor_vaf string, mixmhcpred_rank string, prime_rank string")
    row = product.normalized(df).first()
    assert (row.dna_vaf, row.presentation_score, row.recognition_score) == (0.25, 0.9, 0.8)
    with pytest.raises(ValueError, match="product contract"):
        product.normalized(df.withColumn("mutant_peptide", F.lit("NOT-A-PEPTIDE")))
    with pytest.raises(ValueError, match="patient"):
        product.normalized(df.drop("patient_id"))


def test_duplicate_generated_ids(spark):
    df = spark.createDataFrame([(i, "P", "ACDEFGHIK") for i in range(3)], "_ord long, patient_id string, mutant_peptide string")
    ids = [r.candidate_id for r in product.normalized(df).orderBy("_ord").collect()]
    assert ids[1:] == [f"{ids[0]}:dup1", f"{ids[0]}:dup2"]
    given = df.withColumn("candidate_id", F.when(F.col("_ord") > 0, F.concat(F.lit("x"), F.col("_ord"))))
    assert [r.candidate_id for r in product.normalized(given).orderBy("_ord").collect()] == [ids[0], "x1", "x2"]


def test_gate(spark):
    rows = [(0, "ACDEFGHI", "I", "", "", ""), (1, "ACDEFGH", "class_i", "", "", ""), (2, "ACDEFGHIKLMNPQR", "Class I", "", "", ""), (3, "ACDEFGH", "II", "", "", ""), (4, "AXC", "I", "lost", "", ""),
            (5, "ACDEFGHIK", "I", " yes ", "", ""), (6, "ACDEFGHIL", "I", None, "No", ""), (7, "ACDEFGHIM", "I", None, None, "p.A5W"), (8, None, "I", None, None, None)]
    df = spark.createDataFrame(rows, "_ord long, mutant_peptide string, mhc_class string, hla_loh_call string, expression_call string, protein_variant string").withColumn("source_variant_type", F.lit("snv"))
    reason = lambda **kw: [r[0] for r in gate.tagged(df, ["_ord"], **kw).orderBy("_ord").select("deterministic_gate_reason").collect()]
    want = ["", "BAD_CLASS_I_LENGTH", "BAD_CLASS_I_LENGTH", "", "MALFORMED_AA", "HLA_LOH_LOST_ALLELE", "GENE_NOT_EXPRESSED", "", "MALFORMED_AA"]
    assert reason() == want
    want[7] = "MUT_NOT_IN_PEPTIDE"
    assert reason(intended_missense=True) == want
    same = spark.createDataFrame([(0, "p", "m", "ACDEFGHIK"), (1, "p", "m", "ACDEFGHIK"), (2, "p", None, "ACDEFGHIK"), (3, "p", None, "ACDEFGHIK")], "_ord long, patient_id string, mutation_id string, mutant_peptide string")
    assert [r.is_duplicate for r in gate.duplicates(same, ["_ord"]).orderBy("_ord").collect()] == [False, True, False, True]
    assert gate.summary(same.limit(0).withColumn("deterministic_gate_pass", F.lit(True))).first().removed_fraction == 0.0


def test_rna_evidence(spark):
    cand = spark.createDataFrame([("c1", "p", "m1", "g", 1.0), ("c2", "p", None, "g", 2.0), ("c3", "q", "m1", "g", 3.0)], "candidate_id string, patient_id string, mutation_id string, gene_symbol string, expression_tpm double")
    rna = spark.createDataFrame([("p", "m1", 50.0, 0.5), ("p", None, None, 0.25)], "patient_id string, mutation_id string, expression_tpm double, rna_vaf double")
    got = {r.candidate_id: (r.expression_tpm, r.rna_vaf) for r in evidence.merged(cand, rna).collect()}
    assert got == {"c1": (50.0, 0.5), "c2": (2.0, 0.25), "c3": (3.0, None)}
    assert evidence.key_of(["patient_id", "mutation_id", "gene_symbol"], ["patient_id", "gene_symbol"]) == ["patient_id", "gene_symbol"]
    with pytest.raises(ValueError, match="repeats"):
        evidence.merged(cand, rna.union(rna))
    with pytest.raises(ValueError, match="no key"):
        evidence.merged(cand, rna.drop("mutation_id"))


def test_readers(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "a.csv").write_text('x,"y, z",\n1,"q ""r""",NA\n,nan,3\n')
    rows = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["_ord", "x", "y, z", "unnamed_2"] and [tuple(r)[1:] for r in rows.orderBy("_ord").collect()] == [("1", 'q "r"', None), (None, None, "3")]
    (tmp_path / "b.txt").write_text("p,q\n1,2\n")
    assert tables.read_table(spark, str(tmp_path / "b.txt")).columns == ["_ord", "p", "q"]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("d/t.tsv", "p\tq\n1\t\n")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "c.zip")).collect()] == [(0, "1", None)]
    with zipfile.ZipFile(tmp_path / "c.zip", "a") as z:
        z.writestr("u.csv", "a,b\n5,6\n")
    with pytest.raises(ValueError, match="2 files"):
        tables.read_table(spark, str(tmp_path / "c.zip"))
    assert tables.read_table(spark, str(tmp_path / "c.zip"), "u.csv").first().a == "5"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>peptide</t></si><si><r><t>AC</t></r><r><t>DE</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><dimension ref="A1"/><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>target_value</t></is></c></row>'
                   '<row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>1</v></c></row></sheetData></worksheet>')
    assert [r.asDict() for r in tables.read_table(spark, str(tmp_path / "w.xlsx")).collect()] == [{"_ord": 0, "peptide": "ACDE", "unnamed_1": None, "target_value": "1"}]
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_table(spark, str(tmp_path / "x.json"))


def test_all_evidence_values(spark):
    own = dict.fromkeys(evidence.VALUES, 0.1)
    cand = spark.createDataFrame([{"candidate_id": "c1", "patient_id": "p", "mutation_id": "m1", **own}, {"candidate_id": "c2", "patient_id": "p", "mutation_id": "m2", **own}])
    rna = spark.createDataFrame([{"patient_id": "p", "mutation_id": "m1", **{v: str(i) for i, v in enumerate(evidence.VALUES)}}])
    got = {r.candidate_id: r for r in evidence.merged(cand, rna).collect()}
    assert all(got["c1"][v] == float(i) and got["c2"][v] == 0.1 for i, v in enumerate(evidence.VALUES))


def test_patient_ids_are_stripped(spark):
    df = spark.createDataFrame([(0, " P1", "ACDEFGHIK"), (1, "P1\t", "ACDEFGHIL"), (2, "P1", "ACDEFGHIM")], "_ord long, patient_id string, mutant_peptide string")
    rows = product.normalized(df).collect()
    assert {r.patient_id for r in rows} == {"P1"} and all(r.candidate_id.startswith("P1:") for r in rows)
    with pytest.raises(contracts.ContractError, match="patient_id"):
        product.normalized(df.withColumn("patient_id", F.lit("  ")))


def test_ranked_contract_and_many_patients(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"P{i % 3}", f"m{i}", "ACDEFGHI" + "KLMNPQRSTV"[i], "A0201", 50.0) for i in range(9)], "_ord long, patient_id string, mutation_id string, mutant_peptide string, hla_allele string, binding_affinity_nm double")
    ranking = product.ranked(product.normalized(df))
    paths = product.write_report(ranking, str(tmp_path / "a"))
    report = json.loads(open(paths["json"]).read())
    assert report["policy"] == product.POLICY_NAME and [p["patient_id"] for p in report["patients"]] == ["P0", "P1", "P2"]
    table = spark.read.option("header", True).csv(paths["csv"])
    assert table.count() == 9 and "selection_reason" in table.columns
    monkeypatch.setattr(product, "MOST_PATIENTS", 2)
    report = json.loads(open(product.write_report(ranking, str(tmp_path / "b"))["json"]).read())
    assert spark.read.json(report["patients_folder"]).count() == 3 and spark.read.json(report["selected_folder"]).count() == 9
    for broken in (ranking.drop("rank"), ranking.withColumn("candidate_id", F.lit("same")), ranking.withColumn("mutant_peptide", F.lit("x1"))):
        with pytest.raises(contracts.ContractError, match="ranked"):
            product.write_report(broken, str(tmp_path / "c"))


def test_order_over_partitions_and_broken_lines(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b\n" + "".join(f"{i},{'x' * 50}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = tables.read_table(spark, str(tmp_path / "n.csv"))
        assert rows.rdd.getNumPartitions() > 4
        assert [(int(r.a), r["_ord"]) for r in rows.select("a", "_ord").orderBy("_ord").collect()] == [(i, i) for i in range(4000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "q.csv").write_text('a,b\n1,"two\nlines"\n2,z\n')
    assert [r.b for r in tables.read_table(spark, str(tmp_path / "q.csv")).orderBy("_ord").collect()] == ["two\nlines", "z"]


def test_active_sheet(spark, tmp_path):
    import zipfile

    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        for n in (1, 2):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A2"><v>{n}</v></c></row></sheetData></worksheet>')
    assert [r.x for r in tables.read_table(spark, str(tmp_path / "w.xlsx")).collect()] == ["2"]


def test_first_wins_with_a_hot_identity(spark):
    """A third of the rows share one identity, missing values in it; no window over the identity, and the join can be split."""
    rows = [(i, "p", None, "ACDEFGHIK", "A") if i % 3 == 0 else (i, f"p{i % 50}", f"m{i % 7}", "ACDEFGHIK", "A") for i in range(900)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "_ord long, patient_id string, mutation_id string, mutant_peptide string, hla_allele string").repartition(6)
    flagged = gate.duplicates(df, ["_ord"])
    assert flagged.columns == [*df.columns, "is_duplicate"]
    seen, want = set(), {}
    for i, *key in rows:
        want[i] = tuple(key) in seen
        seen.add(tuple(key))
    assert {r["_ord"]: r.is_duplicate for r in flagged.collect()} == want
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan

    first = datasets.keep_first(df, ["patient_id", "mutation_id"], ["_ord"], "n")
    assert first.columns == [*df.columns, "n"] and "Window" not in first._jdf.queryExecution().executedPlan().toString()
    groups = {}
    for i, p, m, *_ in rows:
        groups.setdefault((p, m), []).append(i)
    assert {(r.patient_id, r.mutation_id): (r["_ord"], r.n) for r in first.collect()} == {k: (v[0], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("key", [k for k in evidence.KEYS])
def test_repeated_evidence_fails_in_the_one_job(spark, key):
    """Each key: the error arises in the job that reads the joined rows, also where no candidate has the repeated key and no value is asked for."""
    cand = spark.createDataFrame([("p", "c1", "m1", "t1", "g1", 1.0), ("p", None, None, None, None, 2.0)], "patient_id string, candidate_id string, mutation_id string, transcript_id string, gene_symbol string, expression_tpm double")
    rows = spark.createDataFrame([("p", "1", 5.0), ("q", "9", 6.0), (None, None, 7.0)], "patient_id string, k string, rna_vaf double")
    rna = rows.select("patient_id", *[F.concat(F.lit(c[0]), "k").alias(c) for c in key], "rna_vaf")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    good = evidence.overlaid(cand, rna)
    bad = [evidence.overlaid(cand, rna.union(rna.where(which))) for which in ("patient_id = 'q'", "patient_id is null")]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before  # building runs nothing
    assert {r.expression_tpm: r.rna_vaf for r in good.collect()} == {1.0: 5.0, 2.0: None}
    for table in bad:
        for read in (table, table.select("expression_tpm")):
            with pytest.raises((SparkRuntimeException, Py4JJavaError), match="repeats a key"):
                read.collect()


def test_evidence_on_a_stream(spark, tmp_path):
    cand = spark.createDataFrame([("p", "m1"), ("p", "m2")], "patient_id string, mutation_id string")
    cand.write.parquet(str(tmp_path / "in"))
    rna = spark.createDataFrame([("p", "m1", 3.0)], "patient_id string, mutation_id string, expression_tpm double")
    for n, table in enumerate((rna, rna.union(rna))):
        stream = evidence.overlaid(spark.readStream.schema(cand.schema).parquet(str(tmp_path / "in")), table)
        query = stream.writeStream.format("memory").queryName(f"overlaid{n}").option("checkpointLocation", str(tmp_path / f"ck{n}")).start()
        if n:
            with pytest.raises(StreamingQueryException, match="repeats a key"):
                query.processAllAvailable()
        else:
            query.processAllAvailable()
            query.stop()
            assert sorted(map(tuple, spark.table("overlaid0").collect())) == [("p", "m1", 3.0), ("p", "m2", None)]


def jobs_of(spark, run):
    """How many queries `run` executes."""
    seen = []

    class Listener:
        def onSuccess(self, name, execution, took):
            seen.append(name)

        def onFailure(self, name, execution, error):
            seen.append(name)

        class Java:
            implements = ["org.apache.spark.sql.util.QueryExecutionListener"]

    from pyspark.java_gateway import ensure_callback_server_started

    ensure_callback_server_started(spark.sparkContext._gateway)
    listener = Listener()
    manager = spark._jsparkSession.listenerManager()
    manager.register(listener)
    try:
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        manager.unregister(listener)
    return seen


def test_report_in_three_queries(spark, tmp_path):
    df = spark.createDataFrame([(i, f"P{i % 3}", f"m{i % 5}", "ACDEFGHI" + "KLMNPQRSTV"[i % 10], "A0201", 50.0, "lost" if i % 7 == 0 else "") for i in range(40)],
                               "_ord long, patient_id string, mutation_id string, mutant_peptide string, hla_allele string, binding_affinity_nm double, hla_loh_call string")
    ranking = product.ranked(product.normalized(df), score.Policy(k=3))
    seen = jobs_of(spark, lambda: product.write_report(ranking, str(tmp_path / "a")))
    assert len(seen) == 3, seen
    report = json.loads((tmp_path / "a/report.json").read_text())
    # the same by queries of their own
    assert report["deterministic_gate"] == gate.summary(ranking).first().asDict() | {"reason_counts": {r.reason: r.n for r in gate.reasons(ranking).collect()}}
    assert report["deterministic_gate"]["removed_count"] > 0
    assert report["patients"] == [r.asDict() for r in select.patient_summary(ranking).orderBy("patient_id").collect()]
    for r in ranking.where("selected").collect():
        assert f"| {r['rank']} | {r.evidence_tier} | {r.gene_symbol} | {r.mutation_id} | {r.mutant_peptide} |" in (tmp_path / "a/report.md").read_text()
    assert not list((tmp_path / "a").glob("staged*"))
    # a table of no rows
    paths = product.write_report(ranking.where("false"), str(tmp_path / "b"))
    empty = json.loads(open(paths["json"]).read())
    assert empty["patients"] == [] and empty["deterministic_gate"]["input_count"] == 0
    # reasons of another gate
    other = ranking.withColumns({"deterministic_gate_reason": F.lit("ELSEWHERE"), "deterministic_gate_pass": F.lit(False)})
    assert json.loads(open(product.write_report(other, str(tmp_path / "c"))["json"]).read())["deterministic_gate"]["reason_counts"] == {"ELSEWHERE": 40}


def test_run_checks_where_it_writes(spark, mini, tmp_path, capsys):
    from portolan import cli

    bad = tmp_path / "bad.tsv"
    bad.write_text(open(mini).read().replace("KLVVVGADGV", "NOT-A-PEPTIDE"))
    with pytest.raises(contracts.ContractError, match="candidate input violates the product contract"):
        product.run_patient(spark, str(bad), str(tmp_path / "o"), "P1")
    assert not list((tmp_path / "o").glob("*"))
    rna = tmp_path / "rna.csv"
    rna.write_text("mutation_id,expression_tpm\nG12D,5\nG12D,6\n")
    assert cli.main(["run-patient", mini, "--patient-id", "P1", "--rna-evidence", str(rna), "--output-dir", str(tmp_path / "o")], spark) == 1
    assert "repeats a key" in json.loads(capsys.readouterr().out)["problem"]
