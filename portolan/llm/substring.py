"""Substring dedup by seed and extend (operator 5).

Seeds. The k-word runs of a text are hashed and winnowed: of the runs in a window of `length` words the smallest hash is chosen (the first
on a tie), so that every window has its anchor, and equal windows have the same anchor at the same place.

Join. Documents are dealt into blocks by their contents. A block sends a row for each of its different anchors, with the smallest and
largest doc_id that has it there; so a passage that a third of all documents share is one row for each block, not one for each document.
Anchors that only one document has end here. Each of the others has a leader: an occurrence in the document with the smallest doc_id.

Extend. The leader's block sends the words around the leader, as far as the windows reach that chose it, and every block that has the
anchor gets them. There each occurrence is extended from the anchor to the left and to the right, word by word, as far as it agrees with
the leader; the windows within that stretch are in an earlier document. Windows of shared anchors that don't agree with the leader
may still agree with another occurrence (texts around the edges of a passage): they go out as rows of their 128-bit hashes, one for each block
and window, and those that a smaller doc_id has too come back, with a bit for each window of the block that keeps what was found. Windows found in either way form, where they
overlap, the maximal repeats; none is shorter than `length` words. Their words are removed.

Matches with leaders are of words. Of other windows' hashes two differ in content with a chance of n * n / 2**129 for n windows. All rows that
are sent grow with the text; none is sent for a pair of documents or of blocks.

Nulls, empty texts and texts of fewer than `length` words lose nothing. Repeated rows with one doc_id are one document: neither is
smaller. A row without doc_id comes after all others. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portolan.llm.common import gram_hashes, mix64, words_of

LENGTH, ANCHOR = 13, 5
BLOCK_BYTES = 4 << 20  # of text in a block, about
LAST = np.iinfo(np.int64).max  # stands for a missing doc_id


def _hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words (SipHash, in one call for all)."""
    cells = np.empty(len(words), dtype=object)
    cells[:] = words
    return pd.util.hash_array(cells, categorize=False)


class _Block:
    """The texts of a block as one run of words, with their windows and anchors. Documents are in the order of doc_id and text, whatever the
    order of the rows, so that each pass over a block numbers them alike."""

    def __init__(self, rows: pa.Table, length: int, k: int):
        self.length, self.k = length, k
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (LAST if ids[i] is None else ids[i], texts[i] or ""))
        self.doc_ids = [ids[i] for i in order]
        self.ids = np.array([LAST if d is None else d for d in self.doc_ids], dtype=np.int64)
        self.words = [words_of(texts[i]) for i in order]
        self.flat = [w for words in self.words for w in words]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.hashes = _hashed(self.flat)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        # where windows start, and the document of each
        m = max(0, len(doc) - length + 1)
        self.at = np.flatnonzero(doc[:m] == doc[length - 1 :]) if m else np.empty(0, dtype=np.int64)
        self.doc = doc[self.at]
        runs = gram_hashes(self.hashes, k)
        least, off = runs[:m].copy(), np.zeros(m, dtype=np.int64)
        for j in range(1, length - k + 1):
            other = runs[j : j + m]
            less = other < least
            np.copyto(least, other, where=less)
            off[less] = j
        place = self.at + off[self.at]
        # occurrences: the places that some window chose, with the words that these windows reach. The first of the least never moves back, so
        # the places are in order
        new = np.ones(len(place), dtype=bool)
        new[1:] = place[1:] != place[:-1]
        first = np.flatnonzero(new)
        self.place, self.of = place[first], np.cumsum(new) - 1
        last = (np.append(first[1:], len(place)) - 1)[: len(first)]
        self.low, self.high = self.at[first], self.at[last] + length
        # least hashes are small ones; keys should spread evenly
        self.key = mix64(runs[self.place]).view(np.int64)
        self.rank = self.ids[self.doc[first]]

    def check(self, occurrences: np.ndarray) -> np.ndarray:
        """Another 32 bits of the anchors."""
        out = np.zeros(len(occurrences), dtype=np.uint64)
        for j in range(self.k):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + self.hashes[self.place[occurrences] + j])
        return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of windows' words."""
        a, b = np.zeros(len(chosen), dtype=np.uint64), np.zeros(len(chosen), dtype=np.uint64)
        for j in range(self.length):
            word = self.hashes[self.at[chosen] + j]
            a, b = a * np.uint64(0x9E3779B97F4A7C15) + word, mix64(b ^ word)
        return mix64(a).view(np.int64), b.view(np.int64)


def _leaders(block: _Block, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The occurrence of each key that leads: the first one of this rank; -1 for none."""
    order = np.lexsort((block.place, block.rank, block.key))
    pairs = list(zip(block.key[order].tolist(), block.rank[order].tolist(), strict=True))
    first: dict[tuple[int, int], int] = {}
    for i, pair in zip(order.tolist(), pairs, strict=True):
        first.setdefault(pair, i)
    return np.array([first.get(p, -1) for p in zip(keys.tolist(), ranks.tolist(), strict=True)], dtype=np.int64)


def _extended(block: _Block, facts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of the block's windows: those that agree with their anchor's leader, and those that have to be looked for elsewhere."""
    keys, lead = facts.column("key").to_numpy(), facts.column("lead").to_numpy()
    flags = facts.column("flags").to_numpy()
    mine, lone = flags & 1 > 0, flags & 2 > 0
    order = np.argsort(keys, kind="stable")
    spot = np.searchsorted(keys[order], block.key)
    spot[spot == len(keys)] = 0
    known = keys[order][spot] == block.key if len(keys) else np.zeros(len(block.key), dtype=bool)
    row = order[spot] if len(keys) else spot
    leaders = _leaders(block, keys[mine], lead[mine])
    is_leader = np.zeros(len(block.key), dtype=bool)
    is_leader[leaders[leaders >= 0]] = True
    later = np.flatnonzero(known & (block.rank > lead[row])) if len(keys) else np.empty(0, dtype=np.int64)
    left, right = (facts.column(c).to_pylist() for c in ("left", "right"))
    checks, flat, k = facts.column("check").to_numpy(), block.flat, block.k
    later = later[block.check(later) == checks[row[later]]] if len(later) else later
    reach_left, reach_right = np.full(len(block.key), -1), np.full(len(block.key), -1)
    for i, r, p, lo, hi in zip(later.tolist(), row[later].tolist(), block.place[later].tolist(), block.low[later].tolist(), block.high[later].tolist(), strict=True):
        theirs, ours = left[r].split(), flat[lo:p]
        n, most = 0, min(len(theirs), len(ours))
        if theirs[len(theirs) - most :] == ours[len(ours) - most :]:
            n = most
        else:
            while theirs[-1 - n] == ours[-1 - n]:
                n += 1
        reach_left[i] = n
        theirs, ours = right[r].split(), flat[p + k : hi]
        n, most = 0, min(len(theirs), len(ours))
        if theirs[:most] == ours[:most]:
            n = most
        else:
            while theirs[n] == ours[n]:
                n += 1
        reach_right[i] = n
    place = block.place[block.of]
    agrees = (place - block.at <= reach_left[block.of]) & (block.at + block.length - place - k <= reach_right[block.of])
    asked = known & ~is_leader
    if len(keys):
        asked &= ~lone[row]
    return agrees, np.flatnonzero(asked[block.of] & ~agrees)


def _distinct(a: np.ndarray, b: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (a, b) are one: an index of each, the number of each row's, the smallest rank of each."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    number = np.empty(len(a), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), LAST)
    np.minimum.at(least, number, ranks)
    return order[new], number, least


def _repeats(block: _Block, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal repeats [start, end), in words of the block: overlapping windows that a smaller doc_id has too."""
    at, doc = block.at[gone], block.doc[gone]
    if not len(at):
        return at, at
    new = np.concatenate(([True], (at[1:] - at[:-1] > block.length) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] + block.length


def _report(block: _Block, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple]:
    """Each document's words, and its repeats as pairs of word numbers."""
    owner = np.searchsorted(block.ends, lo, side="right")
    cuts = np.searchsorted(owner, np.arange(len(block.words) + 1))
    for d, words in enumerate(block.words):
        s = slice(cuts[d], cuts[d + 1])
        yield words, list(zip((lo[s] - block.starts[d]).tolist(), (hi[s] - block.starts[d]).tolist(), strict=True))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (of word numbers, end excluded) that an earlier document has too, and the kept words' SHA-256."""
    if not 0 < anchor <= length:
        raise ValueError("an anchor is a run of 1 to `length` words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(32, size // block_bytes)
    # by contents, so that rows of one doc_id, or without any, are spread
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def send_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        block = _Block(rows, length, anchor)
        distinct, to = np.unique(block.key, return_inverse=True)
        least, most = np.full(len(distinct), LAST), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, to, block.rank)
        np.maximum.at(most, to, block.rank)
        tag = (key[0].as_py() << 21) | np.minimum(np.bincount(to, minlength=len(distinct)), 0xFFFFF) << 1 | (least < most)
        order = np.lexsort((tag, least))  # rows that differ only in their keys follow one another, which the shuffle's compression makes use of
        return pa.table({"key": distinct[order], "least": least[order], "tag": tag[order]})

    def send_contexts(key: tuple, rows: pa.Table, led: pa.Table) -> pa.Table:
        block = _Block(rows, length, anchor)
        keys, lead = led.column("key").to_numpy(), led.column("lead").to_numpy()
        leaders = _leaders(block, keys, lead)
        keys, leaders = keys[leaders >= 0], leaders[leaders >= 0]
        spots = list(zip(block.low[leaders].tolist(), block.place[leaders].tolist(), block.high[leaders].tolist(), strict=True))
        return pa.table({
            "key": keys, "check": block.check(leaders),
            "left": pa.array([b" ".join(block.flat[lo:p]) for lo, p, _ in spots], pa.binary()),
            "right": pa.array([b" ".join(block.flat[p + anchor : hi]) for _, p, hi in spots], pa.binary()),
        })

    def send_windows(key: tuple, rows: pa.Table, facts: pa.Table) -> pa.Table:
        number = key[0].as_py()
        block = _Block(rows, length, anchor)
        agrees, asked = _extended(block, facts)
        a, b = block.windows(asked)
        one, _, least = _distinct(a, b, block.ids[block.doc[asked]])
        # and one row for the block itself: a bit for each window that agrees, a bit for each that is asked for
        mask = np.zeros(len(block.at), dtype=bool)
        mask[asked] = True
        name = np.array([number], dtype=np.int64)
        return pa.table({
            "a": np.append(a[one], mix64(name.view(np.uint64)).view(np.int64)), "b": np.append(b[one], name), "block": np.full(len(one) + 1, number, dtype=np.int32),
            "least": pa.array([*least.tolist(), None], pa.int64()),
            "agrees": pa.array([*[None] * len(one), np.packbits(agrees).tobytes()], pa.binary()), "asked": pa.array([*[None] * len(one), np.packbits(mask).tobytes()], pa.binary()),
        })

    def finish(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(rows, length, anchor)
        own = [(x, y) for x, y in zip(told.column("agrees").to_pylist(), told.column("asked").to_pylist(), strict=True) if x is not None]
        bits = lambda x: np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(block.at)).astype(bool)
        gone, asked = (bits(own[0][0]), np.flatnonzero(bits(own[0][1]))) if own else (np.zeros(len(block.at), dtype=bool), np.empty(0, dtype=np.int64))
        a, b = block.windows(asked)
        one, number, least = _distinct(a, b, block.ids[block.doc[asked]])
        found = told.filter(told.column("agrees").is_null())
        ta, tb = found.column("a").to_numpy(), found.column("b").to_numpy()
        order = np.argsort(ta, kind="stable")
        spot = np.searchsorted(ta[order], a[one])
        spot[spot == len(ta)] = 0
        elsewhere = (ta[order][spot] == a[one]) & (tb[order][spot] == b[one]) if len(ta) else np.zeros(len(one), dtype=bool)
        gone[asked[elsewhere[number] | (block.ids[block.doc[asked]] > least[number])]] = True
        lo, hi = _repeats(block, np.flatnonzero(gone))
        n, spans, digests = [], [], []
        for words, pairs in _report(block, lo, hi):
            kept, last = [], 0
            for x, y in pairs:
                kept += words[last:x]
                last = y
            n.append(len(words))
            spans.append([{"first": x, "end": y} for x, y in pairs])
            digests.append(hashlib.sha256(b" ".join(kept + words[last:])).hexdigest())
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64()), "n_words": pa.array(n, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), "kept_sha256": pa.array(digests, pa.string()),
        })

    by_block = dealt.groupBy("block")
    # tag: the block, how often the anchor is there, and whether in several documents
    anchors = by_block.applyInArrow(send_anchors, "key long, least long, tag long").where("key is not null")  # none is; so both uses share an exchange
    same = Window.partitionBy("key")  # a row for each block that has the anchor
    times, several = F.shiftright("tag", 1).bitwiseAND(F.lit(0xFFFFF)), F.col("tag").bitwiseAND(F.lit(1))
    seen = anchors.select(
        "key", "tag", F.min(F.struct("least", "tag")).over(same).alias("lead"), F.max("least").over(same).alias("last"), F.max(several).over(same).alias("several"),
        F.sum(times).over(same).alias("times"),
    ).where("times >= 2 and (lead.least < last or several = 1)")
    shared = seen.select(
        F.shiftright("tag", 21).cast("int").alias("block"), "key", F.col("lead.least").alias("lead"), several.alias("several"),
        F.when(F.col("tag") == F.col("lead.tag"), 1).otherwise(0).alias("mine"), F.when(F.col("times") == 2, 2).otherwise(0).alias("lone"),
    )
    contexts = by_block.cogroup(shared.where("mine = 1").groupBy("block")).applyInArrow(send_contexts, "key long, check int, left binary, right binary")
    # a leader's block needs the words only for its other documents
    needed = (F.col("mine") == 0) | (F.col("several") == 1)
    facts = shared.join(contexts, "key").select(
        "block", "key", "lead", (F.col("mine") + F.col("lone")).alias("flags"), "check", F.when(needed, F.col("left")).alias("left"), F.when(needed, F.col("right")).alias("right")
    )
    windows = by_block.cogroup(facts.groupBy("block")).applyInArrow(send_windows, "a long, b long, block int, least long, agrees binary, asked binary")
    alike = Window.partitionBy("a", "b")  # a row for each block that has the window
    told = windows.withColumn("first", F.min("least").over(alike)).where("agrees is not null or first < least").select("block", "a", "b", "agrees", "asked")
    return by_block.cogroup(told.groupBy("block")).applyInArrow(
        finish, "doc_id long, n_words long, spans array<struct<first: int, end: int>>, kept_sha256 string"
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


SQL = f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(doc_id, {LAST}) as rank, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
    win as (select rid, rank, w, unnest(range(1, len(w) - {LENGTH} + 2)) as i from d where len(w) >= {LENGTH}),
    keyed as (select rid, rank, i, array_to_string(w[i:i + {LENGTH} - 1], ' ') as key from win),
    gone as (select rid, i from keyed qualify min(rank) over (partition by key) < rank),
    words as (select distinct rid, unnest(range(i, i + {LENGTH})) as place from gone),
    sets as (select rid, list(place) as ats, count(*) as n from words group by rid)
    select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
        sha256(array_to_string(list_filter(w, lambda x, n_th: not coalesce(list_contains(ats, n_th), false)), ' ')) as kept_sha256 from d left join sets using (rid)"""
