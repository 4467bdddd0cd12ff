"""Toxicity by a factorization machine over hashed terms (operator 1).

A text's lower-cased words, without the marks at their ends, are hashed into BUCKETS terms (present or not). The machine (a weight for
each term, a vector for each term whose products are the weights of pairs) is fitted on at most MOST_ROWS of the labelled rows that
may be learned from: those with the smallest hashes of doc_id, which a threshold selects before any text is read. Terms enter the machine
for one of two reasons: they tell of the label by themselves (chi-square of LEAST_CHI or more), or together with
another term although not by themselves (the four shares of toxic rows with both, either and none of two terms are not additive, by more than
chance makes of that many pairs). Every pair of the sample's terms with LEAST_CELL rows in each of its four cells is looked at, in as many tasks as
there are PAIRS_A_TASK; neither terms nor pairs have a limit. Then every whole text is scored.

The model has numbers for the terms of at most MOST_ROWS rows, so it is bounded and broadcast. Nothing but the text enters a score.

Null and empty texts have no terms; they get the model's base score. Labels other than 0 and 1, and rows that no label names, are
not learned from. Without any row to learn from, or with one label only, every score is that label's share (0 if none).
Repeated rows are scored one by one; of repeated labels each counts. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm.common import order_hash

BUCKETS = 1 << 20
LEAST_CHI, LEAST_DOCS = 6.6, 3  # of a term
LEAST_PAIR, LEAST_CELL = 30.0, 5  # squared deviation of a pair; rows in each of its four cells
CHANCE = 0.05  # of any pair that chance brings in
PAIRS_A_TASK, PAIRS_AT_ONCE = 200_000_000, 1 << 22  # pairs of terms in a row, of all rows: in a task, in memory
FACTORS = 4
MOST_ROWS = 20_000
MOST_LABELS = 1_000_000  # as many may be broadcast (16 MB); more are joined by a shuffle
EDGES = b"\"'!?.,;:()[]{}<>*#$%&|-_/\\~`^+=\xc2\xa1\xbf"


def terms(text: str | None) -> list[int]:
    """The distinct term numbers of a text."""
    words = set((text or "").lower().encode("utf-8", "surrogatepass").split())
    return sorted({zlib.crc32(w) % BUCKETS for w in {w.strip(EDGES) for w in words} if w})


def with_terms(docs: DataFrame) -> DataFrame:
    """docs (no column of which may be text's size) with `terms` in place of `text`."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([terms(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, "terms"])

    fields = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes if c != "text")
    return docs.mapInArrow(run, f"{fields}, terms array<int>")


@dataclass
class Machine:
    """score = sigmoid(base + sum of weights + sum over pairs of the products of vectors)."""

    base: float
    at: np.ndarray  # sorted term numbers
    weight: np.ndarray
    vectors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        if len(self.at) and len(found):
            place = np.searchsorted(self.at, found)
            place[place == len(self.at)] = 0
            k = place[self.at[place] == found]
            v = self.vectors[k]
            total = self.base + self.weight[k].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        else:
            total = self.base
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


class Rows:
    """Labelled rows: the terms of all of them in one array, the number of terms of each, labels."""

    def __init__(self, flat: np.ndarray, n: np.ndarray, y: np.ndarray):
        self.flat, self.n, self.y = flat.astype(np.int64), n.astype(np.int64), y.astype(float)
        self.start = np.cumsum(self.n) - self.n

    @classmethod
    def listed(cls, rows: list[tuple[list[int], int]]) -> Rows:
        return cls(np.array([t for terms, _ in rows for t in terms], dtype=np.int64), np.array([len(terms) for terms, _ in rows]), np.array([y for _, y in rows]))

    def of(self, at: np.ndarray) -> Rows:
        """The same rows with places in `at` for terms, without other terms."""
        place = np.searchsorted(at, self.flat)
        place[place == len(at)] = 0
        known = at[place] == self.flat if len(at) else np.zeros(len(place), dtype=bool)
        row = np.repeat(np.arange(len(self.n)), self.n)
        return Rows(place[known], np.bincount(row[known], minlength=len(self.n)), self.y)


def counted(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms, the place of each occurrence among them, and each term's rows and toxic rows."""
    term, inverse = np.unique(rows.flat, return_inverse=True)
    return term, inverse, np.bincount(inverse).astype(float), np.bincount(inverse, np.repeat(rows.y, rows.n))


def _evidence(toxic: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How far pairs are from additive, from their cells (both, first, second, none): twice the log-likelihood ratio of the smallest cell
    against what the three others let expect; 0 if the whole deviation is below LEAST_PAIR."""
    sign = np.array([1.0, -1.0, -1.0, 1.0])[:, None]
    share = (toxic + 0.5) / (size + 1)
    gap = (sign * share).sum(axis=0)
    least, each = size.argmin(axis=0), np.arange(size.shape[1])
    n, got = size[least, each], toxic[least, each] / size[least, each]
    edge = 0.5 / (n + 1)
    expected = np.clip(share[least, each] - sign[least, 0] * gap, edge, 1 - edge)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(got > 0, got * np.log(got / expected), 0) + np.where(got < 1, (1 - got) * np.log((1 - got) / (1 - expected)), 0)
    return np.where(gap**2 >= LEAST_PAIR * (share * (1 - share) / (size + 1)).sum(axis=0), 2 * n * ratio, 0)


def pair_evidence(rows: Rows, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Terms, the evidence of each one's best pair, and the number of pairs looked at. A part is every parts-th term, in the order of their frequency,
    with all that are rarer. A term's rows name its partners, so only pairs that occur are counted."""
    n, n1 = float(len(rows.y)), rows.y.sum()
    term, inverse, m, a = counted(rows)
    able = np.flatnonzero((m >= 2 * LEAST_CELL) & (n - m >= 2 * LEAST_CELL))
    able = able[np.argsort(-m[able], kind="stable")]
    rank = np.full(len(term), -1)
    rank[able] = np.arange(len(able))
    entry, row = rank[inverse], np.repeat(np.arange(len(rows.n)), rows.n)
    entry, row = entry[entry >= 0], row[entry >= 0]
    order = np.lexsort((entry, row))
    entry, row = entry[order], row[order]
    stop, toxic = np.cumsum(np.bincount(row, minlength=len(rows.n)))[row], rows.y[row] > 0
    by, starts = np.argsort(entry, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(entry, minlength=len(able)))))
    m, a, best, examined = m[able], a[able], np.zeros(len(able)), 0
    for i in range(part, len(able) - 1, parts):
        at, met = by[starts[i] : starts[i + 1]], []
        for some in (at[~toxic[at]], at[toxic[at]]):  # the partners in plain rows, in toxic rows
            times = np.zeros(len(able) - i - 1, dtype=np.int64)
            for few in np.array_split(some, 1 + int((stop[some] - some).sum()) // PAIRS_AT_ONCE):
                lengths = stop[few] - few - 1
                ends = np.cumsum(lengths)
                if len(few) and ends[-1]:
                    times += np.bincount(entry[np.repeat(few + 1 - ends + lengths, lengths) + np.arange(ends[-1])] - i - 1, minlength=len(times))
            met.append(times)
        near = np.flatnonzero(met[0] + met[1] >= LEAST_CELL)
        j, both, both1 = near + i + 1, (met[0] + met[1])[near], met[1][near]
        size = np.stack([both, m[i] - both, m[j] - both, n - m[i] - m[j] + both]).astype(float)
        cells = np.stack([both1, a[i] - both1, a[j] - both1, n1 - a[i] - a[j] + both1]).astype(float)
        full = size.min(axis=0) >= LEAST_CELL
        if full.any():
            found, j = _evidence(cells[:, full], size[:, full]), j[full]
            examined += len(j)
            best[i] = max(best[i], found.max())
            best[j] = np.maximum(best[j], found)
    return term[able[best > 0]], best[best > 0], examined


def told_in_pairs(parts: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """The terms whose best pair, in any part, is beyond chance for that many pairs (by Chernoff's bound)."""
    term, best = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return np.unique(term[best >= 2 * math.log(max(1, sum(p[2] for p in parts)) / CHANCE)])


def chosen_terms(rows: Rows, paired: np.ndarray | None = None) -> np.ndarray:
    """The terms that tell of the label, by themselves or in a pair (`paired`, which is worked out here if it isn't given)."""
    n, n1 = float(len(rows.y)), rows.y.sum()
    n0 = n - n1
    term, _, m, a = counted(rows)
    some = (m >= LEAST_DOCS) & (m < n)
    chi = np.where(some, n * (a * (n0 - (m - a)) - (m - a) * (n1 - a)) ** 2 / np.maximum(m * (n - m) * n0 * n1, 1e-9), 0)
    return np.union1d(term[chi >= LEAST_CHI], told_in_pairs([pair_evidence(rows)]) if paired is None else paired)


def paired_terms(spark: SparkSession, rows: Rows) -> np.ndarray:
    """The terms that tell of the label in a pair, looked for in tasks of about PAIRS_A_TASK pairs; the bounded sample is broadcast. What comes back
    is a number for each of its terms that has a pair beyond LEAST_PAIR."""
    parts = 1 + int((rows.n.astype(float) ** 2).sum() / 2 / PAIRS_A_TASK)
    sample = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                term, best, examined = pair_evidence(sample.value, part, parts)
                yield pa.RecordBatch.from_arrays([pa.array([*term.tolist(), None], pa.int64()), pa.array([*best.tolist(), float(examined)], pa.float64())], ["term", "best"])

    found = spark.range(0, parts, 1, parts).mapInArrow(run, "term long, best double").toArrow()
    sample.unpersist()
    count = found.filter(found["term"].is_null())["best"].to_pylist()
    found = found.filter(found["term"].is_valid())
    return told_in_pairs([(found["term"].to_numpy(), found["best"].to_numpy(), int(sum(count)))])


def fit(rows: Rows | list[tuple[list[int], int]], at: np.ndarray, factors: int = FACTORS, passes: int = 30, rate: float = 0.2, decay: float = 1e-3, weigh: float = 5.0, seed: int = 1) -> Machine:
    """Logistic loss with the rows of label 1 counted `weigh` times, AdaGrad over small batches; the same rows give the same machine."""
    rows = rows if isinstance(rows, Rows) else Rows.listed(rows)
    rng, known = np.random.default_rng(seed), rows.of(at)
    share = min(max(rows.y.mean(), 1e-3), 1 - 1e-3)
    base, sum_b = math.log(share / (1 - share)), 1e-8
    weight, vectors = np.zeros(len(at)), rng.normal(0, 0.05, (len(at), factors))
    sum_w, sum_v = np.full(len(at), 1e-8), np.full(vectors.shape, 1e-8)
    for _ in range(passes):
        for batch in np.array_split(rng.permutation(len(rows.y)), max(1, len(rows.y) // 64)):
            n = known.n[batch]
            ends = np.cumsum(n)
            row = np.repeat(np.arange(len(batch)), n)
            k = known.flat[np.repeat(known.start[batch] - ends + n, n) + np.arange(ends[-1])]
            v = vectors[k]
            running = np.concatenate([np.zeros((1, factors)), np.cumsum(v, axis=0)])
            sums = running[ends] - running[ends - n]
            total = base + np.bincount(row, weight[k], len(batch)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(row, (v**2).sum(axis=1), len(batch)))
            y = rows.y[batch]
            off = (1 / (1 + np.exp(-np.clip(total, -50, 50))) - y) * np.where(y > 0, weigh, 1.0)
            touched, to = np.unique(k, return_inverse=True)
            slope = off[row][:, None] * (sums[row] - v)
            grad_w = np.bincount(to, off[row], len(touched)) / len(batch) + decay * weight[touched]
            grad_v = np.stack([np.bincount(to, slope[:, f], len(touched)) for f in range(factors)], axis=1) / len(batch) + decay * vectors[touched]
            sum_w[touched] += grad_w**2
            sum_v[touched] += grad_v**2
            weight[touched] -= rate * grad_w / np.sqrt(sum_w[touched])
            vectors[touched] -= 0.3 * rate * grad_v / np.sqrt(sum_v[touched])
            grad_b = off.mean()
            sum_b += grad_b**2
            base -= rate * grad_b / math.sqrt(sum_b)
    return Machine(base, at, weight, vectors)


def train(docs: DataFrame, known: DataFrame, most_rows: int = MOST_ROWS) -> Machine:
    """docs: doc_id, text; known: doc_id, toxic (0 or 1). The fit is on at most most_rows rows of their join."""
    key = order_hash(F.col("doc_id"))
    counts = {r["toxic"]: r["count"] for r in docs.select("doc_id").join(known, "doc_id").groupBy("toxic").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        empty = np.empty(0, dtype=np.int64)
        return Machine(500.0 if n1 else -500.0, empty, np.empty(0), np.empty((0, FACTORS)))
    # hashes are spread evenly, so that a threshold leaves a few rows more than wanted at any size
    share = (most_rows + 8 * math.sqrt(most_rows) + 64) / (n0 + n1)
    if share < 1:
        known = known.where(key <= F.lit(int(share * (1 << 60))))
    # however often an id or a row is repeated, no more than most_rows come to the driver
    sample = with_terms(docs.join(known, "doc_id").select("doc_id", key.alias("place"), "toxic", "text")).orderBy("place", "doc_id", "toxic", "terms").limit(most_rows).toArrow()
    order = sorted(zip(sample["place"].to_pylist(), sample["doc_id"].to_pylist(), sample["toxic"].to_pylist(), range(len(sample)), strict=True))[:most_rows]
    sample = sample.take([o[3] for o in order]).combine_chunks()
    lists = sample["terms"].combine_chunks()
    rows = Rows(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), sample["toxic"].to_numpy())
    if rows.y.min() == rows.y.max():  # the sample has one label only
        rows = Rows(rows.flat[:0], np.zeros(len(rows.y)), rows.y)
        return fit(rows, chosen_terms(rows, rows.flat))
    return fit(rows, chosen_terms(rows, paired_terms(docs.sparkSession, rows)))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.value.score(np.asarray(terms(t), dtype=np.int64)) for t in batch.column("text").to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isin(0, 1))
    if known.count() <= MOST_LABELS:
        known = F.broadcast(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(texts, train(texts, known)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
