"""Greedy selection under caps.

A candidate is taken if fewer than the cap have been taken with its mutation, gene and allele each, in order, until k are taken. Which
are taken depends on all before, so it is a fold over each group's ordered candidates. What the fold sees is cut first, without
changing its result: candidates that agree in all capped values are taken or refused for the same reason, so after min(k, caps) of
them the rest can never be taken. That cut is a limit on row_number within those values, which Spark applies before the
shuffle, so a group with a third of all rows sends a few rows for each combination of values.

The fold goes in rounds over the best BATCH (or 8 k) rows of each group. A group in which fewer than k are taken and rows are left goes
on with those that come after and whose values aren't full yet; of these the first is always taken, so there are at most k rounds, mostly
one. No task holds more than a batch of one group at once.

Scores (but where their source is) and folds are persisted, so that they are worked out once; they can be dropped by spark.catalog.clearCache().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portolan.functions import expr
from portolan.operators.score import Policy

TIERS = ("CORE", "SUPPORTING", "FILLER", "EXCLUDED")


BATCH = 256
BROADCAST = 500_000  # selected rows
_WIDEN = 8  # a batch is at least so many times k


def _fold(k: int, caps: dict[str, int]) -> str:
    """SQL of the fold over `cands`, from those of `prior`; cap fields that are NULL are exempt."""
    tests = [f"(x.{c} is null or size(filter(acc, a -> a.{c} = x.{c})) < {cap})" for c, cap in caps.items()]
    keep = " and ".join([f"size(acc) < {k}", *tests])
    return f"aggregate(cands, prior, (acc, x) -> case when {keep} then concat(acc, array(x)) else acc end)"


def _of_group(rows: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """rows with their group's state; missing group values equal one another."""
    renamed = state.select(*[F.col(g).alias(f"__g_{g}") for g in group], *[c for c in state.columns if c not in group])
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return rows.join(renamed, same).drop(*[f"__g_{g}" for g in group])


def greedy(rows: DataFrame, group: list[str], order: list[Column], caps: dict[str, int], k: int, ident: str, batch: int = BATCH) -> DataFrame:
    """group columns, `ident` and rank of the selected rows. caps: column -> most rows with one value; NULL values are exempt."""
    keys = [*group, *caps]
    place = [f"__o{i}" for i in range(len(order))]
    named = rows.select(*group, ident, *caps, *[o.alias(p) for o, p in zip(order, place, strict=True)]).where(F.lit(k > 0))
    if caps:
        # a combination with an exempt value is bounded by the other caps, or by k
        most = F.least(F.lit(k), *[F.when(F.col(c).isNotNull(), F.lit(cap)).otherwise(F.lit(k)) for c, cap in caps.items()])
        first = Window.partitionBy(*keys).orderBy(*place, ident)
        named = named.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= F.lit(max(k, 0))).where(F.col("__n") <= most).drop("__n")
    left = named.select(*group, F.struct(*place, ident, *caps).alias("c"))
    batch, done = max(_WIDEN * k, batch), []
    state: DataFrame | None = None
    while True:
        if group:
            best = Window.partitionBy(*group).orderBy("c")
            top = left.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= batch).drop("__n")
        else:
            top = left.orderBy("c").limit(batch)
        cands = top.groupBy(*group).agg(F.sort_array(F.collect_list("c")).alias("cands"))
        cands = cands.withColumn("prior", F.slice("cands", 1, 0)) if state is None else _of_group(cands, state.select(*group, F.col("taken").alias("prior")), group)
        folded = cands.select(*group, F.expr(_fold(k, caps)).alias("taken"), F.size("cands").alias("n"), F.try_element_at("cands", F.lit(-1)).alias("last")).persist()
        open_ = (F.size("taken") < k) & (F.col("n") >= batch)
        done.append(folded.where(~open_))
        state = folded.where(open_)
        if not state.take(1):
            break
        # rows after the last that was seen, whose values aren't full
        free = [f"(c.{c} is null or size(filter(taken, a -> a.{c} = c.{c})) < {cap})" for c, cap in caps.items()]
        after = _of_group(left, state.drop("n"), group).where(F.col("c") > F.col("last"))
        left = after.where(F.expr(" and ".join(free) or "true")).select(*group, "c")
        # a group without such rows is done
        more = _of_group(state, left.select(*group).distinct(), group) if group else state.where(F.lit(bool(left.take(1))))
        more = more.persist()
        done.append(_without(state, more, group))
        state = more
        if not state.take(1):
            break
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    taken = found.select(*group, F.posexplode("taken").alias("__pos", "__c"))
    return taken.select(*group, F.col(f"__c.{ident}").alias(ident), (F.col("__pos") + 1).cast("int").alias("rank"))


def _without(state: DataFrame, more: DataFrame, group: list[str]) -> DataFrame:
    """The groups of `state` that `more` doesn't have."""
    if not group:
        return state.where(F.lit(not more.take(1)))
    renamed = more.select(*[F.col(g).alias(f"__g_{g}") for g in group])
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return state.join(renamed, same, "left_anti")


def capped_values(columns: list[str], policy: Policy) -> dict[str, tuple[Column, int]]:
    """Column -> its value under a cap, and the cap. '' is exempt (NULL); a missing value is the word 'nan'."""
    limits = {"mutation_id": policy.max_per_mutation, "gene_symbol": policy.max_per_gene, "hla_allele": policy.max_per_hla}
    shown = lambda c: F.coalesce(F.col(c), F.lit("nan"))
    return {c: (F.when(shown(c) != "", shown(c)), n) for c, n in limits.items() if n is not None and c in columns}


def portfolio(scored: DataFrame, policy: Policy = Policy(), ident: str = "candidate_id", kept: bool = False) -> DataFrame:
    """Scored candidates with selected and rank, per patient: by tier, lower score and tie key. '' is exempt from a cap; a missing value is
    the word 'nan' and shares a cap. `ident` must name a row within its patient. `kept`: what the scores are made from is persisted and scores come from it
    without a shuffle, so they are worked out twice and not persisted themselves."""
    scored = scored if kept else scored.persist()
    tiers = F.array_position(F.array(*map(F.lit, TIERS)), F.col("evidence_tier"))
    capped = capped_values(scored.columns, policy)
    caps = {c: n for c, (_, n) in capped.items()}
    rows = scored.where("eligible").select(
        "patient_id", ident, "lower_evidence_score", "deterministic_tie_key", tiers.alias("__tier"), *[value.alias(c) for c, (value, _) in capped.items()]
    )
    order = [F.col("__tier"), -F.col("lower_evidence_score"), F.col("deterministic_tie_key")]
    taken = greedy(rows, ["patient_id"], order, caps, policy.k, ident)
    taken = taken.select(F.col("patient_id").alias("__p"), F.col(ident).alias("__i"), "rank")
    # the folds are persisted, so this counts few rows; else all scored rows are shuffled before their number is known
    found = scored.join(F.broadcast(taken) if taken.count() <= BROADCAST else taken, (F.col("patient_id") == F.col("__p")) & (F.col(ident) == F.col("__i")), "left")
    return found.drop("__p", "__i").withColumn("selected", F.col("rank").isNotNull())


def single_cap(scored: DataFrame, cap_column: str, cap: int, k: int, ident: str = "candidate_id") -> DataFrame:
    """patient_id, ident, rank under one cap: two windows, equal to the fold. Rows that aren't eligible come last and are dropped after the first window: a filter
    before it would take the whole score in again."""
    order = [F.array_position(F.array(*map(F.lit, TIERS)), F.col("evidence_tier")), F.col("lower_evidence_score").desc(), "deterministic_tie_key", ident]
    within = F.row_number().over(Window.partitionBy("patient_id", cap_column).orderBy(F.when(F.col("eligible"), 0).otherwise(1), *order))
    capped = scored.withColumn("__n", within).where((F.col("__n") <= cap) & F.col("eligible"))
    ranked = capped.withColumn("rank", F.row_number().over(Window.partitionBy("patient_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("patient_id", ident, "rank")


def simple(df: DataFrame, score: str, order: list[str], k: int = 20, max_per_hla: int | None = None, max_per_gene: int | None = None,
           min_score: float | None = None, hla: str = "hla_allele", gene: str = "gene_symbol", ident: str = "candidate_id") -> DataFrame:
    """The whole table's selection, by score and then input order. Missing values are exempt from caps, '' is a value like any other;
    a missing score is last, and no floor keeps it out; k = 0 takes one row."""
    df = df.persist()
    caps = {c: n for c, n in ((hla, max_per_hla), (gene, max_per_gene)) if n is not None and c in df.columns}
    rows = df if min_score is None else df.where(F.col(score).isNull() | (F.col(score) >= min_score))
    places = [F.col(score).isNull(), -F.col(score), *map(F.col, order)]
    taken = greedy(rows, [], places, caps, max(k, 1), ident)
    return df.join(taken.withColumnRenamed(ident, "__i"), F.col(ident) == F.col("__i")).drop("__i")


def final_order(portfolio: DataFrame, ident: str = "candidate_id") -> DataFrame:
    return portfolio.orderBy("patient_id", F.col("selected").desc(), F.col("rank").asc_nulls_last(), F.col("lower_evidence_score").desc(), ident)


def patient_summary(portfolio: DataFrame) -> DataFrame:
    """Counts for each patient, and whether there is nothing to recommend."""
    tier = lambda t: F.count_if(F.col("selected") & (F.col("evidence_tier") == t))
    rows = portfolio.groupBy("patient_id").agg(
        F.count("*").alias("candidate_count"), F.count_if("eligible").alias("eligible_count"), F.count_if("selected").alias("selected_count"),
        tier("CORE").alias("core_count"), tier("SUPPORTING").alias("supporting_count"), tier("FILLER").alias("filler_count"),
    )
    return rows.withColumn("abstained", F.col("core_count") == 0).withColumn(
        "abstention_reason",
        F.when(F.col("eligible_count") == 0, "NO_ELIGIBLE_CANDIDATES").when(F.col("abstained"), "NO_CANDIDATE_CLEARS_CORE_EVIDENCE_POLICY"),
    )
