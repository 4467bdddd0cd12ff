"""Token ids as binary shards with a minimal perfect hash index (operator 6).

Texts are encoded with a public tokenizer, an end id is put after each document, and the ids are written in ascending order of
doc_id. A shard is a row of a Parquet table (so that any store Spark writes to will do): its `payload` is the documents'
ids one after the other, little-endian, 2 bytes each if the vocabulary allows (`width`), else 4. Its index finds a document by its
key in constant time: a minimal perfect hash of the shard's keys (two hashes and one displacement) names a slot, and the slot
holds the key's 32-bit fingerprint, which tells strange keys apart, and the place of its documents in `ends`. Shards are told apart
by their least and greatest key, which Parquet keeps as statistics.

Encoding. The tokenizer parts words before a single space or line break between other characters, and between a letter or digit and
a point or comma. So the ids of " word" are the same in any text, and a worker keeps those it has met (up to a bound). Texts
with two white spaces in a row or with a special token's string go to the tokenizer as a whole, and so do all texts where the tokenizer's file
names another rule (PARTS).

Null and empty texts are just the end id. Repeated rows are documents of their own, in the order of their texts; a lookup returns all
documents of a key. Rows without doc_id come first; they are in the payload, but not in the index. An empty table gives an
empty one. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portolan.llm.common import mix64

END = 2
SHARD_IDS = 2 << 20
PART_DOCS = 4096  # in a partition, about
KEPT = 1_300_000  # pieces a worker remembers (about 250 MB)

# Fixed value: how a tokenizer's file says that words are parted as above.
PARTS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

_MARKS = frozenset(".,")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.width == 2 else "I"
        rules = json.loads(self.tokenizer.to_str())
        rule = rules["pre_tokenizer"] or {}
        self.parted = rules["normalizer"] is None and all(rule.get(k) == v for k, v in PARTS.items()) and all(t["special"] for t in rules["added_tokens"])
        self.known: dict[str, bytes] = {}
        self.marks = {m: self.ids(m) for m in _MARKS}
        # which ids begin with a space or a line break (these two stand for them in byte-level vocabularies)
        self.begins = np.zeros(self.tokenizer.get_vocab_size(True), dtype=bool)
        for token, i in self.tokenizer.get_vocab(True).items():
            self.begins[i] = token[:1] in ("\u0120", "\u010a")

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Adds the pieces that aren't known, but for those with white space at an end. Those with a point or comma after a letter or digit
        are put together from their parts; the others are encoded many at a time, and each begins at an id of its own."""
        known = self.known
        marked = {p for p in new if p[-1:] in _MARKS and p[-2:-1].isalnum()}
        lone = {p for p in (new - marked) | {p[:-1] for p in marked} if p not in known}
        fit = [p for p in lone if p and not p[-1].isspace() and not p[p[0] == "\n"].isspace()]
        for at in range(0, len(fit), 512):
            part = fit[at : at + 512]
            line = "".join([p if p[0] == "\n" else f" {p}" for p in part])
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=self.kind)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(part):
                data, cuts = ids.tobytes(), (starts * self.width).tolist()
                known.update(zip(part, (data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)), strict=True))
            else:  # white space inside a piece
                known.update((p, self.ids(p if p[0] == "\n" else f" {p}")) for p in part)
        for p in marked:
            if p not in known and p[:-1] in known:
                known[p] = known[p[:-1]] + self.marks[p[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.parted:
            return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        split = [None if not t or any(s in t for s in self.special) else t.replace("\n", " \n").split(" ") for t in texts]
        known, new = self.known, set()
        for pieces in split:
            if pieces:
                new.update(set(pieces[1:]).difference(known))
        if len(known) + len(new) > KEPT:
            known.clear()
            new = {p for pieces in split if pieces for p in pieces[1:]}
        self._learn(new)
        return [self._joined(text or "", pieces) for text, pieces in zip(texts, split, strict=True)]

    def _joined(self, text: str, pieces: list[str] | None) -> bytes:
        if pieces and pieces[0] and not pieces[0][-1].isspace():
            try:
                return self.ids(pieces[0]) + b"".join(map(self.known.__getitem__, pieces[1:]))
            except KeyError:  # white space meets a space
                pass
        return self.ids(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: 0..n-1, each once."""

    def __init__(self, displace: np.ndarray, n: int):
        self.displace, self.n = displace, n

    @staticmethod
    def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        return (mix64(h + d.astype(np.uint64) * _STEP) % np.uint64(n)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        h = mix64(keys.astype(np.int64).view(np.uint64) + _STEP)
        count = max(1, n)  # a bucket for each key: three of eight hold one, which leaves room for the others
        bucket = (h % np.uint64(count)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=count)
        starts = np.cumsum(sizes) - sizes
        displace, used = np.zeros(count, dtype=np.int32), np.zeros(n, dtype=bool)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[: int((sizes > 1).sum())]:
            mine = h[order[starts[b] : starts[b] + sizes[b]]]
            d = 1
            while True:
                slots = cls._slots(mine, np.full(len(mine), d), n)
                if not used[slots].any() and len(set(slots.tolist())) == len(slots):
                    break
                d += 1
            used[slots] = True
            displace[b] = d
        # a bucket of one key takes any slot that is left
        free = np.flatnonzero(~used)
        single = np.flatnonzero(sizes == 1)
        displace[single] = -1 - free[: len(single)]
        return cls(displace, n)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        h = mix64(keys.astype(np.int64).view(np.uint64) + _STEP)
        d = self.displace[(h % np.uint64(len(self.displace))).astype(np.int64)].astype(np.int64)
        return np.where(d < 0, -1 - d, self._slots(h, np.maximum(d, 0), max(1, self.n)))


def prints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


_SHARD = (
    "part int, no int, first_key long, last_key long, n_docs int, n_ids long, width int, payload binary, keys array<long>,"
    " ends binary, displace binary, prints binary, places binary"
)


def _shard(part: int, no: int, keys: list[int | None], ids: list[bytes], width: int) -> pa.RecordBatch:
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    named = np.array([k for k in keys if k is not None], dtype=np.int64)
    distinct, first = np.unique(named, return_index=True)
    first = first + (len(keys) - len(named))  # those without a key come first
    index = PerfectHash.of(distinct)
    slots = index.slot(distinct) if len(distinct) else np.empty(0, dtype=np.int64)
    marks, places = np.zeros(len(distinct), dtype=np.uint32), np.zeros(len(distinct), dtype=np.uint32)
    marks[slots], places[slots] = prints(distinct), first
    row = {
        "part": part, "no": no, "first_key": int(named.min()) if len(named) else None, "last_key": int(named.max()) if len(named) else None,
        "n_docs": len(keys), "n_ids": int(ends[-1]), "width": width, "payload": b"".join(ids), "keys": keys, "ends": ends.tobytes(),
        "displace": index.displace.tobytes(), "prints": marks.tobytes(), "places": places.tobytes(),
    }
    kinds = {"part": pa.int32(), "no": pa.int32(), "n_docs": pa.int32(), "width": pa.int32(), "keys": pa.list_(pa.int64()), "first_key": pa.int64(), "last_key": pa.int64(), "n_ids": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END, shard_ids: int = SHARD_IDS, part_docs: int = PART_DOCS) -> None:
    """Encodes docs (doc_id, text) with the tokenizer file and writes the shards to path."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.count() // part_docs + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, no = encoder(tokenizer), TaskContext.get().partitionId(), 0
        last = np.array([end], dtype=code.kind).tobytes()
        keys, ids, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for key, x in zip(some.column("doc_id").to_pylist(), code.encode(some.column("text").to_pylist()), strict=True):
                    keys.append(key)
                    ids.append(x + last)
                    n += len(x) // code.width + 1
                    if n >= shard_ids:
                        yield _shard(part, no, keys, ids, code.width)
                        keys, ids, n, no = [], [], 0, no + 1
        if keys:
            yield _shard(part, no, keys, ids, code.width)

    # partitions are ranges of doc_id in ascending order; the number is fixed, so a partition's number is its place
    # the text's beginning parts rows of one doc_id (or without any) too
    ordered = docs.repartitionByRange(int(parts), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SHARD).write.option("compression", "zstd").parquet(path)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, PerfectHash, np.ndarray, np.ndarray]:
    kind = "<u2" if row["width"] == 2 else "<u4"
    marks = np.frombuffer(row["prints"], dtype=np.uint32)
    return (
        np.frombuffer(row["payload"], dtype=kind), np.frombuffer(row["ends"], dtype=np.int64),
        PerfectHash(np.frombuffer(row["displace"], dtype=np.int32), len(marks)), marks, np.frombuffer(row["places"], dtype=np.uint32),
    )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files: keyed ones are looked up in their shard's index."""
    shards = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                payload, ends, index, marks, places = _opened(row)
                at = np.arange(len(ends))
                keys = row["keys"]
                bare = sum(k is None for k in keys)
                named = np.array(keys[bare:], dtype=np.int64)
                if len(named):
                    slots = index.slot(named)
                    if (marks[slots] != prints(named)).any():
                        raise ValueError(f"shard {row['part']}, {row['no']}: the index does not fit the keys")
                    repeat = np.arange(len(named)) - np.searchsorted(named, named)
                    at[bare:] = places[slots] + repeat
                starts = np.where(at > 0, ends[at - 1], 0)
                sums = [zlib.crc32(payload[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends[at], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([row["part"]] * len(keys), pa.int32()), pa.array([row["no"]] * len(keys), pa.int32()),
                     pa.array(starts), pa.array(ends[at] - starts), pa.array(sums, pa.int64())],
                    ["doc_id", "part", "no", "at", "n_tokens", "ids_crc32"],
                )

    found = shards.drop("first_key", "last_key", "n_docs", "n_ids").mapInArrow(run, "doc_id long, part int, no int, at long, n_tokens long, ids_crc32 long")
    # a number for each partition, and within it for each shard
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    leads = parts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("lead"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("no")) - F.col("n_ids")
    base = shards.select("part", "no", inside.alias("inside")).join(leads, "part").select("part", "no", (F.col("lead") + F.col("inside")).alias("base"))
    return found.join(base, ["part", "no"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, key: int) -> DataFrame:
    """doc_id, ids of the documents with this key; only shards whose keys may hold it are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                payload, ends, index, marks, places = _opened(row)
                slot = int(index.slot(np.array([key]))[0])
                if marks[slot] != prints(np.array([key]))[0]:
                    continue
                out, at = [], int(places[slot])
                while at < len(ends) and row["keys"][at] == key:
                    out.append(payload[ends[at - 1] if at else 0 : ends[at]].tolist())
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(out), pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    near = spark.read.parquet(path).where((F.col("first_key") <= key) & (F.col("last_key") >= key))
    return near.mapInArrow(run, "doc_id long, ids array<long>")
