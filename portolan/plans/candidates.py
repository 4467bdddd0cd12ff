"""Candidates made from the driver's order tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = {
    "candidate_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "patient_id": "concat('P', o_custkey % 200)",
    "mutation_id": "concat('M', l_partkey % 97)",
    "gene_symbol": "p_brand",
    "transcript_id": "concat('T', l_partkey % 389)",
    "hla_raw": "case l_suppkey % 4 when 0 then 'A0201' when 1 then ' hla-b0702' when 2 then 'C*07:02' else 'HLA-A11:01' end",
    "protein_variant": "case when l_partkey % 3 = 0 then concat('p.A', cast(l_partkey % 300 as int), 'D') else concat('A', l_linenumber, 'fs') end",
    "source_variant_type": "case when l_partkey % 3 = 0 then 'snv' else 'frameshift' end",
    "mhc_class": "case when l_suppkey % 7 = 0 then 'II' when l_suppkey % 7 = 1 then 'class_i' else 'I' end",
    "hla_loh_call": "case when l_returnflag = 'R' and l_linenumber = 1 then 'lost' else 'N' end",
    "expression_call": "case when l_suppkey % 31 = 0 then 'no' else 'yes' end",
    "mutant_peptide": "substr(translate(md5(cast(l_partkey as string)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, "
                      "cast(case when l_partkey % 50 = 0 then 7 when l_partkey % 50 = 1 then 15 else 7 + l_linenumber end as int))",
    "expression_tpm": "case when l_linenumber % 3 <> 0 then l_quantity - 3 end",
    "rna_vaf": "case when l_partkey % 5 <> 0 then l_discount * 8 end",
    "rna_depth": "l_quantity",
    "rna_mutant_reads": "case when l_suppkey % 6 = 0 then 0.0D when l_suppkey % 6 < 3 then floor(l_quantity / 4) end",
    "binding_affinity_nm": "l_extendedprice / 100",
    "wildtype_binding_affinity_nm": "case when l_partkey % 4 <> 0 then l_extendedprice * l_quantity / 300 end",
    "binding_percentile_rank": "case when l_suppkey % 9 = 0 then l_discount * 30 end",
    "dna_vaf": "l_tax * 10",
    "clonality_ccf": "case when l_suppkey % 8 = 0 then l_discount * 10 end",
}
# Columns that the others' rows are known by; candidates' texts that differ from row to row and are made from these, texts of few values, and numbers. Queries that
# read candidates several times persist keys and short columns (texts of few values are held by number), and make the long texts anew.
KEYS, LONG, FEW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ("candidate_id", "mutant_peptide"), ("patient_id", "mutation_id", "gene_symbol", "hla_raw")
GATE = ("mutant_peptide", "protein_variant", "source_variant_type", "mhc_class", "hla_loh_call", "expression_call")
NUMBERS = ("expression_tpm", "rna_vaf", "rna_depth", "rna_mutant_reads", "binding_affinity_nm", "wildtype_binding_affinity_nm", "binding_percentile_rank", "dna_vaf", "clonality_ccf")
# The same in Spark: a peptide's part is cut out before its letters are translated one by one, as translating all 32 took a quarter of most queries.
PEPTIDE = ("translate(substr(md5(cast(l_partkey as string)), 1, cast(case when l_partkey % 50 = 0 then 7 when l_partkey % 50 = 1 then 15 else 7 + l_linenumber end as int)), "
           "'0123456789abcdef', 'ACDEFGHIKLMNPQRS')")
_SPARK = CANDIDATE | {"mutant_peptide": PEPTIDE}
WILDTYPE = "case when suppkey % 3 = 0 then concat(substr(mutant_peptide, 1, 1), 'W', substr(mutant_peptide, 3)) when suppkey % 3 = 1 then concat(substr(mutant_peptide, 1, 3), 'Y', substr(mutant_peptide, 5)) else substr(mutant_peptide, 2) end"
HLA_SQL = """case when u is null then '' else 'HLA-' || case when regexp_full_match(split_part(s, '*', 2), '[0-9]{4}') and strpos(s, '*') > 0
    then split_part(s, '*', 1) || '*' || substr(split_part(s, '*', 2), 1, 2) || ':' || substr(split_part(s, '*', 2), 3, 2) else s end end"""


def made(rows: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    """Candidates' columns of rows that have the order tables' columns for them, and of these the columns to `keep`."""
    return rows.select(*[F.expr(_SPARK[n]).alias(n) for n in names], *keep)


def joined(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The order tables. `lines`: lineitem with other columns, which meets orders in an exchange, so that what its columns are worked out from is compiled apart."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    orders = t("orders") if lines is None else t("orders").hint("merge")
    rows = t("lineitem") if lines is None else lines
    return rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_wildtype(made(joined(spark, sf_dir), tuple(CANDIDATE), "l_suppkey")).drop("l_suppkey")


def with_wildtype(rows: DataFrame) -> DataFrame:
    return rows.withColumn("wildtype_peptide", F.expr(WILDTYPE.replace("suppkey", "l_suppkey")))


def with_allele(rows: DataFrame) -> DataFrame:
    from portolan.functions import expr

    return rows.withColumn("hla_allele", expr.hla(F.col("hla_raw"))).drop("hla_raw")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_allele(raw(spark, sf_dir))


def _duck(e: str) -> str:
    return e.replace("as string", "as varchar").replace("0.0D", "0.0::double")


SQL = f"""raw as (select {', '.join(f'{_duck(e)} as {n}' for n, e in CANDIDATE.items())}, l_suppkey as suppkey
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
    wt as (select *, {WILDTYPE} as wildtype_peptide, replace(upper(trim(hla_raw)), 'HLA-', '') as u from raw),
    st as (select *, case when strpos(u, '*') = 0 and length(u) >= 5 and substr(u, 2, 1) between '0' and '9'
        then substr(u, 1, 1) || '*' || substr(u, 2) else u end as s from wt),
    cand as (select * exclude (u, s, hla_raw, suppkey), {HLA_SQL} as hla_allele from st)"""

GATED = """dup as (select *, row_number() over (partition by patient_id, mutation_id, mutant_peptide, hla_allele order by candidate_id) > 1 as is_dup from cand),
    gated as (select * exclude (is_dup), case when not regexp_full_match(mutant_peptide, '[ACDEFGHIKLMNPQRSTVWY]+') then 'MALFORMED_AA'
        when upper(mhc_class) in ('I', 'CLASS_I', 'CLASS I') and length(mutant_peptide) not between 8 and 14 then 'BAD_CLASS_I_LENGTH'
        when is_dup then 'DUP_CANDIDATE' when upper(hla_loh_call) in ('Y', 'YES', 'TRUE', '1', 'LOST') then 'HLA_LOH_LOST_ALLELE'
        when upper(expression_call) in ('N', 'NO', 'FALSE', '0', 'NOT_EXPRESSED') then 'GENE_NOT_EXPRESSED' else '' end as gate from dup)"""

SCORED = """parts as (select *,
        case when expression_tpm is not null then greatest(expression_tpm, 0) / (greatest(expression_tpm, 0) + 10) end as t1,
        case when rna_vaf is not null then sqrt(least(greatest(rna_vaf, 0), 1)) end as t2,
        case when rna_mutant_reads is not null then greatest(rna_mutant_reads, 0) / (greatest(rna_mutant_reads, 0) + 5) end as t3,
        coalesce(case when binding_percentile_rank is not null then least(greatest(1 - binding_percentile_rank / 100, 0), 1) end,
            1 / (1 + greatest(binding_affinity_nm, 0) / 500)) as pres,
        case when binding_affinity_nm > 0 and wildtype_binding_affinity_nm > 0
            then wildtype_binding_affinity_nm / (wildtype_binding_affinity_nm + binding_affinity_nm) end as rec,
        coalesce(case when clonality_ccf is not null then least(greatest(clonality_ccf, 0), 1) end,
            case when dna_vaf is not null then least(greatest(least(greatest(dna_vaf, 0), 1) / 0.5, 0), 1) end) as cov from gated),
    comp as (select *, case when t1 is null and t2 is null and t3 is null then null else (coalesce(t1, 0) + coalesce(t2, 0) + coalesce(t3, 0))
        / ((t1 is not null)::int + (t2 is not null)::int + (t3 is not null)::int) end as tr from parts),
    avail as (select *, ((tr is not null)::int + (pres is not null)::int + (rec is not null)::int + (cov is not null)::int) / 4.0::double as complete,
        exp(0.25 * ln(greatest(coalesce(tr, 0.5), 1e-6)) + 0.35 * ln(greatest(coalesce(pres, 0.5), 1e-6))
            + 0.25 * ln(greatest(coalesce(rec, 0.5), 1e-6)) + 0.15 * ln(greatest(coalesce(cov, 0.5), 1e-6))) as raw_score,
        case when gate <> '' then gate when expression_tpm <= 0 then 'NO_RNA_EXPRESSION'
            when rna_depth >= 10 and rna_mutant_reads <= 0 then 'NO_MUTANT_RNA_SUPPORT' else '' end as exclusion_reason from comp),
    low as (select *, round(raw_score, 9) as evidence_score, 1 - complete as evidence_uncertainty,
        round(raw_score * (1 - 0.35 * (1 - complete)), 9) as lower_evidence_score, md5(mutant_peptide || '|' || hla_allele) as tie_key from avail),
    scored as (select *, case when exclusion_reason <> '' then 'EXCLUDED' when lower_evidence_score >= 0.55 and evidence_uncertainty <= 0.35 then 'CORE'
        when lower_evidence_score >= 0.35 then 'SUPPORTING' else 'FILLER' end as evidence_tier,
        case when exclusion_reason <> '' then exclusion_reason else 'AVAILABLE=' || coalesce(nullif(concat_ws(',', case when tr is not null then 'TRANSLATED' end,
            case when pres is not null then 'PRESENTED' end, case when rec is not null then 'RECOGNIZED' end, case when cov is not null then 'COVERAGE' end), ''), 'NONE')
            || case when complete < 1 then '; MISSING=' || concat_ws(',', case when tr is null then 'TRANSLATED' end,
            case when pres is null then 'PRESENTED' end, case when rec is null then 'RECOGNIZED' end, case when cov is null then 'COVERAGE' end) else '' end end as selection_reason
        from low)"""

# Greedy selection under a cap of 1 for each mutation and 4 for each gene, 20 for each patient: a walk over each patient's ordered rows.
SELECTED = """ord as (select patient_id, candidate_id, mutation_id as m, gene_symbol as g, row_number() over (partition by patient_id
        order by case evidence_tier when 'CORE' then 0 when 'SUPPORTING' then 1 else 2 end, lower_evidence_score desc, tie_key, candidate_id) as i
        from scored where exclusion_reason = ''),
    walk(patient_id, i, ids, ms, gs) as (select distinct patient_id, 0::bigint, []::varchar[], []::varchar[], []::varchar[] from ord
        union all select w.patient_id, o.i,
            case when ok then list_append(w.ids, o.candidate_id) else w.ids end, case when ok then list_append(w.ms, o.m) else w.ms end,
            case when ok then list_append(w.gs, o.g) else w.gs end
        from walk w join ord o on o.patient_id = w.patient_id and o.i = w.i + 1,
        lateral (select len(w.ids) < 20 and not list_contains(w.ms, o.m) and len(list_filter(w.gs, lambda x: x = o.g)) < 4 as ok)),
    done as (select patient_id, arg_max(ids, i) as ids from walk group by patient_id),
    taken as (select patient_id, unnest(ids) as candidate_id, unnest(range(1, len(ids) + 1))::int as rank from done)"""
