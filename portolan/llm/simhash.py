"""SimHash near-duplicates (operator 2).

Fingerprints are bit majorities over shingle hashes. Those that differ in at most `budget` of 64 bits are found by a self-join of
a binary trie: pairs of nodes are walked down together, differing bits add up, and a pair is dropped as soon as they exceed
the budget.

The trie is dealt out by subtrees. If two fingerprints differ in `budget` bits at most, then of budget + 1 blocks of bits one is
equal; so there are budget + 1 tries, each with another block rotated to the front, and the walk starts at the nodes below
that block, where no bit differs yet. A start node with more than MOST fingerprints isn't walked in one task: it is replaced
by its pairs of descendants (6 bits further down) that are within the budget, again and again. Equal fingerprints are one leaf.
Within a task links go into a union-find, pairs of nodes whose leaves are all linked already are skipped, and only the links to
each class's smallest member leave; so a dense group of near copies costs no pair for each two of its members.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share a fingerprint and a component.
A row without doc_id gets a fingerprint; it never names a component (null if no other row shares it). An empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import WordHashes, cut, forget, gram_hashes, mix64
from portolan.llm.components import components

MOST = 4096  # fingerprints below a start node
STRIDE = 6
ROWS = 65536  # walked together


_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> np.ndarray:
    """(n, k) 64-bit hashes -> k fingerprints; a bit is set if over half the hashes have it. None: zero.

    Eight bits at a time are counted in the eight bytes of a word, 255 hashes before a byte could overflow.
    """
    n, k = hashes.shape
    if not n:
        return np.zeros(k, dtype=np.uint64)
    votes, starts = np.empty((k, 8, 8), dtype=np.int64), np.arange(0, n, 255)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, starts, axis=0)
        votes[:, :, shift] = lanes.view(np.uint8).reshape(-1, k, 8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes.reshape(k, 64) > n, axis=1, bitorder="little").view(np.uint64).reshape(k)


def shingle_hashes(words: list[bytes], n: int, seed: int) -> np.ndarray:
    """XXH64 of each n words joined by spaces; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(starts, ends[n - 1 :], strict=False)), dtype=np.uint64, count=len(words) - n + 1
    )


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp: the 64-bit SimHash of the A-Z lower-cased text's n-word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                # bytes.lower() touches A-Z only
                hashes = shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), n, seed)
                out[i] = majority(hashes.reshape(-1, 1))[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, fp long")


class _Walk:
    """Joins the trie over some groups' sorted fingerprints with itself."""

    def __init__(self, fp: np.ndarray, sig: np.ndarray | None, budget: int, most_sig: int):
        self.fp, self.sig, self.budget, self.most_sig = fp, sig, budget, most_sig
        self.root = np.arange(len(fp))
        ones = ((fp[:, None] >> np.arange(63, -1, -1, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.int32)
        self.ones = np.zeros((len(fp) + 1, 64), dtype=np.int32)
        np.cumsum(ones, axis=0, out=self.ones[1:])
        self._refresh()

    def _refresh(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                break
            self.root = up
        self.turns = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the leaves i and j pairwise where they are near enough."""
        near = (self.root[i] != self.root[j]) & (np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.budget)
        i, j = i[near], j[near]
        if self.sig is not None and len(i):
            far = np.concatenate([
                np.bitwise_count(self.sig[i[k : k + ROWS]] ^ self.sig[j[k : k + ROWS]]).sum(axis=1, dtype=np.int32)
                for k in range(0, len(i), ROWS)
            ])
            i, j = i[far <= self.most_sig], j[far <= self.most_sig]
        if len(i):
            root = self.root
            for a, b in set(zip(root[i].tolist(), root[j].tolist(), strict=True)):
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
            self._refresh()

    def run(self, pairs: np.ndarray, depth: int) -> None:
        """pairs: rows of (first, end, first, end, differing bits) of two nodes at this depth; a node with itself too."""
        stack = [(pairs, depth)]
        while stack:
            p, depth = stack.pop()
            while len(p):
                one = (p[:, 1] - p[:, 0] == 1) & (p[:, 3] - p[:, 2] == 1)
                if one.any():
                    leaves = p[one & (p[:, 0] != p[:, 2])]
                    self.link(leaves[:, 0], leaves[:, 2])
                    p = p[~one]
                same = (self.turns[p[:, 0]] == self.turns[p[:, 1] - 1]) & (self.turns[p[:, 2]] == self.turns[p[:, 3] - 1])
                p = p[~(same & (self.root[p[:, 0]] == self.root[p[:, 2]]))]
                if depth == 64:  # what is left are leaves of equal fingerprints, which are linked among themselves
                    for x0, x1, y0, y1 in p[:, :4].tolist():
                        for i in range(x0, x1 if self.sig is not None else x0 + 1):  # signatures may differ within a leaf
                            self.link(np.full(y1 - y0, i), np.arange(y0, y1))
                    break
                if not len(p):
                    break
                if len(p) > 4 * ROWS:  # one half after the other, so that memory stays bounded
                    stack.append((p[len(p) // 2 :], depth))
                    p = p[: len(p) // 2]
                ones = self.ones[:, depth]
                xm, ym = p[:, 1] - (ones[p[:, 1]] - ones[p[:, 0]]), p[:, 3] - (ones[p[:, 3]] - ones[p[:, 2]])
                x0, x1, y0, y1, d = *p.T[:4], p[:, 4]
                own = x0 == y0
                down = [
                    np.stack([x0, xm, y0, ym, d], axis=1), np.stack([xm, x1, ym, y1, d], axis=1),
                    np.stack([x0, xm, ym, y1, d + 1], axis=1), np.stack([xm, x1, y0, ym, d + 1], axis=1)[~own],
                ]
                p = np.concatenate(down)
                p = p[(p[:, 0] < p[:, 1]) & (p[:, 2] < p[:, 3]) & (p[:, 4] <= self.budget)]
                depth += 1


def _links_of(batches: Iterator[pa.RecordBatch], depth: int, budget: int, most_sig: int) -> Iterator[pa.RecordBatch]:
    """Rows of (part, a, b, rot, node, sig), sorted, groups of equal (part, a, b) whole -> links (a, b) of nodes."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        part, a, b, rot, node = (rows.column(c).to_numpy() for c in ("part", "a", "b", "rot", "node"))
        sig = None
        if most_sig >= 0:
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(node))
        keep = hi - lo > 1
        lo, hi = lo[keep], hi[keep]
        fp = rot.view(np.uint64)
        walk = _Walk(fp, sig, budget, most_sig)
        # neighbours first: most of a dense group is linked before the walk begins
        at = np.flatnonzero(~new)
        walk.link(at - 1, at)
        group = np.cumsum(new) - 1
        own = a[lo] == b[lo]
        first = fp >> np.uint64(64 - depth) == a.view(np.uint64)
        inside = np.bincount(group, weights=first).astype(np.int64)[group[lo]]
        mid = np.where(own, lo, lo + inside)
        pairs = np.stack([lo, np.where(own, hi, mid), mid, hi, np.bitwise_count(a[lo] ^ b[lo]).astype(np.int64)], axis=1)
        walk.run(pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])], depth)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, walk.root, node)
        to = least[walk.root]
        linked = to != node
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(to[linked])], ["a", "b"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        rows = pa.Table.from_batches(waiting)
        if len(rows) < ROWS:
            continue
        part, a, b = (rows.column(c).to_numpy() for c in ("part", "a", "b"))
        ends = np.flatnonzero((part[1:] != part[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        if len(ends):
            done = int(ends[-1]) + 1
            yield solve(rows.slice(0, done).combine_chunks())
            waiting = rows.slice(done).combine_chunks().to_batches()
        else:
            waiting = rows.combine_chunks().to_batches()
    if sum(b.num_rows for b in waiting):
        yield solve(pa.Table.from_batches(waiting).combine_chunks())


def trie_links(nodes: DataFrame, budget: int, most_sig: int = -1, most: int = MOST) -> DataFrame:
    """nodes: node, fps (fingerprints), sig -> links (a, b) that join the nodes that have a fingerprint (of the same number) within
    `budget` bits and, if most_sig >= 0, signatures within most_sig bits. Links are a spanning forest of each class, not all pairs."""
    blocks = budget + 1
    cuts = [64 * r // blocks for r in range(blocks + 1)]
    depth = min(hi - lo for lo, hi in zip(cuts, cuts[1:], strict=False))
    rotated = lambda fp, by: F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp
    parts = nodes.select("node", "sig", F.posexplode("fps").alias("k", "fp")).select(
        "node", "sig", F.posexplode(F.array(*[rotated(F.col("fp"), at) for at in cuts[:-1]])).alias("r", "rot"), "k"
    )
    lead = lambda bits: F.shiftrightunsigned("rot", 64 - bits)
    rows = parts.select(
        (F.col("k") * blocks + F.col("r")).alias("part"), lead(depth).alias("a"), lead(depth).alias("b"), "rot", "node", "sig"
    )
    found = None
    masks = F.array(*[F.lit(m).cast("long") for m in sorted(range(1 << STRIDE), key=lambda m: (bin(m).count("1"), m)) if bin(m).count("1") <= budget])
    while True:
        large = rows.groupBy("part", "a", "b").count().where(F.col("count") > most).drop("count")
        split = depth + STRIDE < 64 and len(large.take(1)) > 0
        walked = rows.join(large, ["part", "a", "b"], "left_anti") if split else rows
        dealt = walked.repartition("part", "a", "b").sortWithinPartitions("part", "a", "b", "rot")
        links = dealt.mapInArrow(lambda batches, depth=depth: _links_of(batches, depth, budget, most_sig), "a long, b long")
        found = links if found is None else found.union(links)
        if not split:
            return found
        child = lead(depth + STRIDE).bitwiseAND(F.lit((1 << STRIDE) - 1))
        other = F.when(lead(depth) == F.col("a"), F.col("b")).otherwise(F.col("a"))
        deeper = rows.join(large, ["part", "a", "b"], "left_semi").select(
            "part", "rot", "node", "sig", child.alias("c"), other.alias("o"),
            F.explode(F.filter(masks, lambda m: F.bit_count(m) + F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget)).alias("m"),
        )
        mine, theirs = lead(depth + STRIDE), F.shiftleft("o", STRIDE).bitwiseOR(F.col("c").bitwiseXOR(F.col("m")))
        rows = cut(deeper.select("part", F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b"), "rot", "node", "sig"))
        depth += STRIDE


def near_components(fps: DataFrame, budget: int = 2) -> DataFrame:
    """doc_id, fp -> doc_id, fp, component_id: the smallest doc_id that links of at most `budget` bits reach."""
    fps = cut(fps)
    leaves = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    nodes = leaves.where("node is not null").select("node", F.array("fp").alias("fps"), F.lit(None).cast("binary").alias("sig"))
    linked = components(trie_links(nodes, budget))
    classes = leaves.join(linked, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(classes, "fp")


# Candidates of the pipeline's near-dedup are fingerprints that the trie finds within NEAR_BUDGET bits, completed by bands of minima: at a
# similarity of 0.8 two SimHashes differ in 9.7 of 64 bits on average, which no trie over many texts can allow for.
# Two texts share the key of some band with probability 1 - (1 - s ** DEEP) ** BANDS, where s is the Jaccard similarity of their
# shingles, however they differ: 0.99999 at 0.8. Keys only gather families; near() decides.
BANDS, DEEP, SHINGLE, NEAR_BUDGET = 64, 8, 5, 3
FAMILY, FAMILY_BYTES = 256, 32 << 20  # nodes compared in one task, and their sets; larger families are compared with LEADERS nodes at a time
LEADERS, LEADER_BYTES = 8192, 16 << 20  # at most, and with no more sets than that, or one node


def shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the A-Z lower-cased text's five-word shingles; of the whole text if it is shorter."""
    h = known.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    return np.unique(gram_hashes(h, min(SHINGLE, max(1, len(h)))))


def _mark(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def band_keys(grams: np.ndarray) -> np.ndarray:
    """BANDS keys, each of DEEP minima of the shingles under other permutations."""
    by = (mix64(np.arange(1, 1 + BANDS * DEEP, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least, short = np.full(BANDS * DEEP, 0xFFFFFFFF, dtype=np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 256):
        np.minimum(least, (short[k : k + 256, None] * by).min(axis=0), out=least)
    keys = np.arange(1, 1 + BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, DEEP).T.astype(np.uint64):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def banded(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the set of shingles), fp (its SimHash), keys (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, known) for text in batch.column("text").to_pylist()]
            keys = np.concatenate([band_keys(g) for g in sets]).view(np.int64) if sets else np.empty(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), type=pa.int32()), pa.array(keys))
            marks = pa.array([_mark(g) for g in sets], type=pa.binary())
            fps = pa.array(np.array([majority(g.reshape(-1, 1))[0] for g in sets], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), marks, fps, lists], ["doc_id", "mark", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, mark binary, fp long, keys array<long>")


class _Sets:
    """Sets of shingles, to find those that have a Jaccard similarity of 0.8 or more with another one."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner = grams[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def near(self, s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.grams, s, "left"), np.searchsorted(self.grams, s, "right")
        n = hi - lo
        both = np.bincount(self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(self.sizes))
        return np.flatnonzero(9 * both >= 4 * (self.sizes + len(s)))  # 5 * both >= 4 * (union)


class _Forest(dict):
    """node -> a smaller node of its class, or itself."""

    def top(self, x: int) -> int:
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self[max(x, y)] = min(x, y)

    def links(self) -> pa.RecordBatch:
        found = [(x, self.top(x)) for x in self]
        a, b = ([p[k] for p in found if p[0] != p[1]] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        for family, node, grams in zip(*(batch.column(c).to_pylist() for c in ("family", "node", "grams")), strict=True):
            yield family, node, np.frombuffer(grams, dtype=np.uint64)


def _small_links(members: DataFrame) -> DataFrame:
    """family, node, grams -> links (a, b) that join the near nodes of a family, each family in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), key=lambda row: row[0]):
            _, nodes, sets = zip(*rows, strict=True)
            index, forest = _Sets(list(sets)), _Forest()
            for node, s in zip(nodes, sets, strict=True):
                for k in index.near(s).tolist():
                    forest.link(node, nodes[k])
            yield forest.links()

    return members.repartition("family").sortWithinPartitions("family").mapInArrow(run, "a long, b long")


def _leaders(left: DataFrame, most: int, most_bytes: int) -> DataFrame | None:
    """Some of the nodes (node, bytes), in the order of their hashes: up to `most`, whose sets have most_bytes together, or one of them."""
    first = left.orderBy(F.xxhash64("node"), "node").limit(most).collect()
    ends = list(accumulate(r["bytes"] for r in first))
    n = max(1, sum(e <= most_bytes for e in ends))
    return left.sparkSession.createDataFrame([(r["node"],) for r in first[:n]], "node long") if first else None


def _large_links(members: DataFrame, most: int, most_bytes: int = LEADER_BYTES) -> DataFrame | None:
    """The same for families of any size: rounds compare some nodes with all of their families, until all nodes outside each
    family's largest class have been compared. Of two nodes of different classes one has been, so no link is missing. The sets of a round's
    nodes, bounded in number and bytes, are broadcast."""
    spark = members.sparkSession
    nodes = cut(members.select("family", "node", F.octet_length("grams").alias("bytes")).distinct())
    labels, asked, found = cut(nodes.withColumn("label", F.col("node"))), None, None
    while True:
        classes = labels.groupBy("family", "label").agg(F.count("*").alias("n"))
        largest = classes.groupBy("family").agg(F.max(F.struct("n", "label")).alias("top"))
        left = labels.join(largest, "family").where("label <> top.label").select("node", "bytes")
        if asked is not None:
            left = left.join(asked, "node", "left_anti")
        chosen = _leaders(left, most, most_bytes)
        if chosen is None:
            return found
        by: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for family, node, grams in members.join(F.broadcast(chosen), "node", "left_semi").select("family", "node", "grams").collect():
            at = by.setdefault(family, ([], []))
            at[0].append(node)
            at[1].append(np.frombuffer(bytes(grams), dtype=np.uint64))
        shared = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by = shared.value
            index, forest = {f: _Sets(sets) for f, (_, sets) in by.items()}, _Forest()
            for family, node, s in _rows(batches):
                if family in index:
                    for k in index[family].near(s).tolist():
                        forest.link(node, by[family][0][k])
            yield forest.links()

        links = members.select("family", "node", "grams").mapInArrow(run, "a long, b long")
        old = [x for x in (labels, asked, found) if x is not None]
        found = cut((links if found is None else found.union(links)).distinct())
        asked = cut(chosen if asked is None else asked.union(chosen))
        linked = components(found)
        labels = cut(nodes.join(linked, "node", "left").select("family", "node", "bytes", F.coalesce("root", "node").alias("label")))
        forget(*old)
        shared.destroy()


def near_text_roots(docs: DataFrame, family: int = FAMILY, leaders: int = LEADERS) -> DataFrame:
    """doc_id of the documents that stay if one of each group of near-equal texts stays: those that links of a Jaccard similarity of
    0.8 or more between the sets of five-word shingles join. The smallest doc_id of a group stays.

    Texts that share a key of a band, or whose fingerprints the trie finds near, are of one family, whether they are near or not; so are
    those that others join. Within families sets are compared exactly. Rows without doc_id aren't listed.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = cut(banded(docs).groupBy("mark").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least"))
    banded_links = keyed.join(shared, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    # equal fingerprints are one leaf of the trie
    leaves = nodes.groupBy("fp").agg(F.min("node").alias("leaf"))
    alike = nodes.join(leaves, "fp").where("node <> leaf").select(F.col("node").alias("a"), F.col("leaf").alias("b"))
    near = trie_links(leaves.select(F.col("leaf").alias("node"), F.array("fp").alias("fps"), F.lit(None).cast("binary").alias("sig")), NEAR_BUDGET)
    families = components(banded_links.union(alike).union(near))
    families = cut(nodes.select("node", "mark").join(families, "node").select("node", "mark", F.col("root").alias("family")))
    names = cut(nodes.select("node"))
    forget(shared, nodes)  # with the keys of all bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, known) for text in batch.column("text").to_pylist()]
            same = pa.array([_mark(g) == mark for g, mark in zip(sets, batch.column("mark").to_pylist(), strict=True)], pa.bool_())
            grams = pa.array([g.tobytes() for g in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("node"), grams], ["family", "node", "grams"]).filter(same)

    texts = docs.join(families, F.col("doc_id") == F.col("node")).select("family", "node", "mark", "text")
    members = cut(texts.mapInArrow(run, "family long, node long, grams binary"))
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("grams")).alias("bytes"))
    large = cut(sizes.where((F.col("n") > family) | (F.col("bytes") > FAMILY_BYTES)).select("family"))
    links = _small_links(members.join(large, "family", "left_anti"))
    if large.take(1):
        more = _large_links(members.join(large, "family", "left_semi"), leaders)  # read from members, not stored twice
        links = links if more is None else links.union(more)
    linked = components(links)
    forget(members, families, large)
    return names.join(linked.where("node <> root").select("node"), "node", "left_anti").select(F.col("node").alias("doc_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies; equal rows are copies too. Of rows alike in doc_id and text that with the smallest hash of all columns (but
    maps) stays, in every run. Rows without doc_id stay as they are."""
    roots = near_text_roots(docs).withColumnRenamed("doc_id", "root")
    kept = docs.join(roots, F.col("doc_id").cast("long") == F.col("root"), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    one = kept.groupBy(F.col("doc_id").alias("d"), F.xxhash64("text").alias("mark")).agg(F.min_by(row, order).alias("row")).select("row.*")
    return one.union(docs.where("doc_id is null"))
