import json

from portolan import cli
from portolan.operators import score
from portolan.streaming.scoring import scored_stream

HEAD = "mutation_id\tgene_symbol\thla_allele\tmutant_peptide\texpression_tpm\tevidence_score\n"


def test_cli(spark, tmp_path, capsys):
    table = tmp_path / "t.tsv"
    table.write_text(HEAD + "m1\tg\tA0201\tACDEFGHIK\t5\t0.9\nm2\tg\tA0201\tACDEFGHIL\t\t0.8\nm3\th\tB0702\tACDEFGHIM\t0\t0.7\n")
    assert cli.main(["validate-patient-input", str(table), "--patient-id", "P"], spark) == 0
    assert json.loads(capsys.readouterr().out)["row_count"] == 3
    assert cli.main(["validate-patient-input", str(table)], spark) == 1
    capsys.readouterr()
    assert cli.main(["validate-schema", str(table)], spark) == 1
    capsys.readouterr()
    assert cli.main(["run-patient", str(table), "--patient-id", "P", "--output-dir", str(tmp_path / "o"), "--k", "1"], spark) == 0
    paths = json.loads(capsys.readouterr().out)
    assert json.loads(open(paths["json"]).read())["patients"][0]["selected_count"] == 1
    out = tmp_path / "s.csv"
    assert cli.main(["select-portfolio", str(table), "--output", str(out), "--k", "2", "--max-per-gene", "1"], spark) == 0
    assert [line.split(",")[0] for line in out.read_text().splitlines()] == ["mutation_id", "m1", "m3"]


def test_stream_scores_like_a_batch(spark, tmp_path):
    rows = [("c1", "P", "m1", "ACDEFGHIK", "HLA-A*02:01", 5.0, 50.0), ("c2", "P", "m2", "ACX", "HLA-A*02:01", 0.0, 10.0), ("c3", "P", "m3", "ACDEFGHIL", None, None, None)]
    df = spark.createDataFrame(rows, "candidate_id string, patient_id string, mutation_id string, mutant_peptide string, hla_allele string, expression_tpm double, binding_affinity_nm double")
    df.write.parquet(str(tmp_path / "in"))
    stream = scored_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    from portolan.operators import gate

    pick = ["candidate_id", "evidence_score", "lower_evidence_score", "evidence_tier", "selection_reason"]
    got = sorted(map(tuple, spark.table("scored").select(*pick).collect()))
    want = sorted(map(tuple, score.scored(gate.tagged(df, ["candidate_id"])).select(*pick).collect()))
    assert got == want and [g[3] for g in got][1] == "EXCLUDED"
