"""Portfolios that are kept up to date on a stream of scored candidates.

The state of a patient is what a selection can ever need: for each combination of capped values the best candidates, as many as the smallest of their caps (or k) lets
in, since candidates alike in these values are refused alike. Best-of sets can be merged, so the state after any split into
batches is that of the batch selection, and so is the selection that is folded over it. Rows beyond the caps, the bulk of a large patient, are counted
and forgotten.

Each batch gives a row for every patient that it touches: the summary and the selected ids in order, with a version that
grows; a patient's last version equals `select.portfolio` and `select.patient_summary` over all its rows so far. Ids must not come again. Needs the RocksDB
state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from portolan.operators.score import Policy
from portolan.operators.select import TIERS, capped_values

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = (
    "patient_id string, version long, candidate_count long, eligible_count long, selected_count long, core_count long, supporting_count long, filler_count long, "
    "abstained boolean, abstention_reason string, selected array<string>"
)


class Maintained(StatefulProcessor):
    """caps: the most rows with one value, in the order of columns v0, v1, ... of the input; a missing value is exempt."""

    def __init__(self, caps: list[int], k: int):
        self.caps, self.k = caps, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = [f"v{i} string" for i in range(len(self.caps))]
        # place: among the best of a combination
        self.best = handle.getMapState("best", ", ".join([*values, "place int"]), "tier int, low double, tie string, ident string")
        self.counts = handle.getValueState("counts", "version long, rows long, eligible long")

    def close(self) -> None:
        pass

    def _most(self, values: tuple) -> int:
        return min([self.k, *[cap for v, cap in zip(values, self.caps, strict=True) if v is not None]])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        version, n, eligible = self.counts.get() or (0, 0, 0)
        held: dict[tuple, list[tuple]] = {}  # of combinations that this batch touches
        stored: dict[tuple, list[tuple]] = {}
        for batch in rows:
            n += len(batch)
            batch = batch[batch["eligible"]]
            eligible += len(batch)
            columns = [batch[c].tolist() for c in ("tier", "low", "tie", "ident", *[f"v{i}" for i in range(len(self.caps))])]
            for tier, low, tie, ident, *values in zip(*columns, strict=True):
                combination = tuple(None if v is None or v != v else v for v in values)
                most = self._most(combination)
                if combination not in held:
                    stored[combination] = self._stored(combination, most)
                    held[combination] = list(stored[combination])
                mine, candidate = held[combination], (tier, -low, tie, ident)
                if len(mine) < most or (mine and candidate < mine[-1]):
                    bisect.insort(mine, candidate)
                    del mine[most:]
        for combination, mine in held.items():
            for place, candidate in enumerate(mine):
                if place >= len(stored[combination]) or stored[combination][place] != candidate:
                    tier, low, tie, ident = candidate
                    self.best.updateValue((*combination, place), (tier, -low, tie, ident))
        self.counts.update((version + 1, n, eligible))
        taken = self._fold()
        tiers = [sum(1 for t in taken if t[0] == i) for i in (1, 2, 3)]
        reason = "NO_ELIGIBLE_CANDIDATES" if not eligible else "NO_CANDIDATE_CLEARS_CORE_EVIDENCE_POLICY" if not tiers[0] else None
        yield pd.DataFrame({
            "patient_id": [key[0]], "version": [version + 1], "candidate_count": [n], "eligible_count": [eligible], "selected_count": [len(taken)],
            "core_count": [tiers[0]], "supporting_count": [tiers[1]], "filler_count": [tiers[2]], "abstained": [not tiers[0]], "abstention_reason": [reason],
            "selected": [[t[3] for t in taken]],
        })

    def _stored(self, combination: tuple, most: int) -> list[tuple]:
        out = []
        while len(out) < most and self.best.containsKey((*combination, len(out))):
            tier, low, tie, ident = self.best.getValue((*combination, len(out)))
            out.append((tier, -low, tie, ident))
        return out

    def _fold(self) -> list[tuple]:
        """The selection over all that the state holds."""
        candidates = sorted(((value[0], -value[1], value[2], value[3]), tuple(key)[:-1]) for key, value in self.best.iterator())
        taken: list[tuple] = []
        counts: dict[tuple, int] = {}
        for candidate, values in candidates:
            if len(taken) >= self.k:
                break
            own = [(i, v) for i, v in enumerate(values) if v is not None]
            if all(counts.get(x, 0) < self.caps[x[0]] for x in own):
                taken.append(candidate)
                for x in own:
                    counts[x] = counts.get(x, 0) + 1
        return taken


def maintained(scored: DataFrame, policy: Policy = Policy(), ident: str = "candidate_id") -> DataFrame:
    """A stream of scored candidates (as `scored_stream` gives them) -> a stream of each touched patient's summary and selection; update mode."""
    caps = capped_values(scored.columns, policy)
    rows = scored.select(
        "patient_id", F.coalesce("eligible", F.lit(False)).alias("eligible"), F.array_position(F.array(*map(F.lit, TIERS)), F.col("evidence_tier")).cast("int").alias("tier"),
        F.col("lower_evidence_score").alias("low"), F.col("deterministic_tie_key").alias("tie"), F.col(ident).cast("string").alias("ident"),
        *[value.alias(f"v{i}") for i, (value, _) in enumerate(caps.values())],
    )
    return rows.groupBy("patient_id").transformWithStateInPandas(Maintained([cap for _, cap in caps.values()], policy.k), OUTPUT, "Update", "None")
