"""Scores for a stream of canonical candidates.

Scores, exclusion and tiers depend on a row alone, so they run on a stream as they stand. Duplicates need the rows before: a stream keeps
their identities within a watermark. Selections of a stream are kept up to date by `portfolio.maintained`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.operators import gate, score


def scored_stream(candidates: DataFrame, policy: score.Policy = score.Policy(), event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The scored candidates. With event_time, repetitions of an identity within the delay are dropped, where a batch would tag them."""
    rows = candidates
    if event_time is not None:
        keys = [c for c in gate.IDENTITY if c in candidates.columns]
        rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return score.scored(_row_gate(rows) if policy.apply_gate else gate.disabled(rows), policy)


def _row_gate(rows: DataFrame) -> DataFrame:
    """The gate's rules but the one on duplicates."""
    return rows.withColumn("deterministic_gate_reason", gate.row_reason(rows, F.lit(False))).withColumns({
        "deterministic_gate_pass": F.col("deterministic_gate_reason") == "", "deterministic_gate_policy": F.lit(gate.POLICY),
    })
