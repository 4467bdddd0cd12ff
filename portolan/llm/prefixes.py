"""Prefix trie of conversations (operator 12).

A conversation is its turns in order (missing first; equal turns by role and text); null roles and texts are empty. Rows without conv_id belong to no
conversation. The query's conversations are rebuilt first: some begin with the turns of another.

Every turn is hashed, and a numpy scan adds hash * base**place modulo a prime over each conversation: the fingerprint of the prefix that ends
there, in two lanes. The sums go on from one partition to the next, so a conversation may lie in many. Prefixes of one length and
one fingerprint are candidates for one node; the member with the smallest conv_id represents them. Each member's turn and parent are compared with the
representative's. Where they differ, a collision, the members are split by their contents, from that turn on in all longer prefixes too, and
are grouped anew, until all agree. By induction over lengths a node's members then agree turn by turn.

The rollup needs no round for each level: the ancestors of a node are the shorter prefixes of its representative, so what a node adds is put
down at its representative's row, summed up backwards along that conversation, and aggregated by node.

Equal rows are turns of their own. Turns without text count zero bytes. An empty table has no node, not even the root. Columns other than
conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portolan.llm.common import cut, laid_out, mix64, ones, prefix_sums

PRIME = 2**31 - 1
BASES = (1_103_515_245, 1_664_525)  # one for each lane
HEADS = 9  # a rebuilt conversation begins with fewer turns of another than that
PIECE = 10  # bits: ids that end at a node are joined 1,024 at a time, and hashed piece by piece
NODE = ["depth", "fp", "split"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, text."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    numbered = prefix_sums(laid_out(rows, "conv_id", ["turn", "role", "text"]), "conv_id", ones, ["n"])
    return numbered.select("conv_id", (F.col("n") - 1).alias("pos"), "role", "text")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations c that begin with up to h turns of conversation c - c % 5, and the ids of all of them, turnless ones too."""
    size = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = size.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    bases = size.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    plan = cut(plan.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")))
    others = plan.where("base <> conv_id")
    # at most four conversations take from a base, HEADS turns each
    head = own.where(f"pos < {HEADS} and conv_id % 5 = 0").withColumnRenamed("conv_id", "base").join(others, "base").where("pos < taken")
    tail = own.join(plan, "conv_id").where("base = conv_id or pos >= h")
    place = F.when(F.col("base") == F.col("conv_id"), F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("taken"))
    return head.select("conv_id", "pos", "role", "text").union(tail.select("conv_id", place.alias("pos"), "role", "text")), plan.select("conv_id")


def _columns(*names: str) -> Callable[[pa.RecordBatch], list[np.ndarray]]:
    return lambda batch: [batch.column(n).to_numpy() for n in names]


def _powers(base: int, places: np.ndarray, prime: int) -> np.ndarray:
    """base**places modulo prime."""
    out, square, left = np.ones(len(places), np.int64), base % prime, places.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] * square % prime
        square, left = square * square % prime, left >> 1
    return out


def fingerprints(laid: DataFrame, prime: int = PRIME) -> DataFrame:
    """conv_id, depth (from 1), fp and up (fingerprints of the prefix that ends here and of the one before), bytes (of the turn's text)."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn, pos = batch.column("turn").to_numpy().view(np.uint64), batch.column("pos").to_numpy()
            lanes = [(mix64(turn + np.uint64(k)) % np.uint64(prime)).astype(np.int64) * _powers(base, pos, prime) % prime for k, base in enumerate(BASES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, lanes)], [*batch.schema.names, "t0", "t1"])

    hashed = laid.select("conv_id", "pos", F.xxhash64("role", "text").alias("turn"), F.octet_length("text").cast("long").alias("bytes"), "__part")
    added = hashed.mapInArrow(terms, "conv_id long, pos long, turn long, bytes long, __part int, t0 long, t1 long")
    lanes = prefix_sums(added, "conv_id", _columns("t0", "t1"), ["f0", "f1"], prime)
    both = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
    before = [F.pmod(F.col(f"f{k}") - F.col(f"t{k}"), F.lit(prime)) for k in (0, 1)]
    return lanes.select("conv_id", (F.col("pos") + 1).cast("int").alias("depth"), both(F.col("f0"), F.col("f1")).alias("fp"), both(*before).alias("up"), "bytes")


def _members(rows: DataFrame, nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """NODE, conv_id, rep and content (parent and turn) of the prefixes that share their node."""
    texts = stored.select("conv_id", (F.col("pos") + 1).cast("int").alias("depth"), "role", "text")
    shared = nodes.where("n > 1").select(*NODE, F.col("conv_id").alias("rep"))
    return rows.join(shared, NODE).join(texts, ["conv_id", "depth"]).select(*NODE, "conv_id", "rep", F.struct("up", "upsplit", "role", "text").alias("content"))


def _as_standard(members: DataFrame) -> DataFrame:
    """The representatives' contents, as columns to join on."""
    own = members.where("conv_id = rep")
    return own.select(*[F.col(n).alias(f"r_{n}") for n in NODE], F.col("content").alias("standard"))


def verified(rows: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes (conv_id, depth, fp, up, bytes, split, upsplit) and their nodes (NODE, n, conv_id, up, upsplit, bytes), all members alike."""
    rows, again = rows.withColumns({"event": F.lit(0).cast("long"), "split": F.lit(0).cast("long"), "upsplit": F.lit(0).cast("long")}), 0
    while True:
        nodes = cut(rows.groupBy(*NODE).agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "up", "upsplit", "bytes")).alias("r")).select(*NODE, "n", "r.*"))
        members = _members(rows, nodes, stored)
        same = [F.col(n) == F.col(f"r_{n}") for n in NODE]
        wrong = members.join(_as_standard(members), same).where(F.col("content") != F.col("standard"))
        if not wrong.take(1):
            return rows, nodes
        bad = wrong.select(*NODE).distinct()
        members = cut(members.join(bad, NODE, "left_semi"))
        # the few different contents of one fingerprint
        contents = members.select(*NODE, "content").distinct().withColumn("no", F.row_number().over(Window.partitionBy(*NODE).orderBy("content")) - 1)
        events = members.join(contents, [*NODE, "content"]).where("no > 0").select("conv_id", "depth", F.shiftright(F.xxhash64("depth", "no", F.lit(again)), 24).alias("more"))
        changed = rows.drop("split", "upsplit").join(events, ["conv_id", "depth"], "left").withColumn("event", F.col("event") + F.coalesce("more", F.lit(0))).drop("more")
        laid = laid_out(changed, "conv_id", ["depth"])
        summed = prefix_sums(laid, "conv_id", _columns("event"), ["split"]).withColumn("upsplit", F.col("split") - F.col("event"))
        rows, again = cut(summed.drop("__part")), again + 1


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; a node's state is the hash alone."""
    at, state, out = None, hashlib.sha256(), []
    for batch in batches:
        for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
            if node == at:
                state.update(b",")
            else:
                if at:
                    out.append((*at, state.hexdigest()))
                at, state = node, hashlib.sha256()
            state.update(ids.encode())
        if len(out) > 5000:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends"), x, strict=True)) for x in out], _ENDS)
            out = []
    if at:
        yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends"), x, strict=True)) for x in [*out, (*at, state.hexdigest())]], _ENDS)


_ENDS = pa.schema([("depth", pa.int32()), ("fp", pa.int64()), ("split", pa.int64()), ("ends", pa.string())])


def trie(own: DataFrame, everyone: DataFrame, prime: int = PRIME) -> DataFrame:
    """The nodes of the trie of conversations: their turns (conv_id, pos, role, text), and all their ids, those without turns too."""
    stored = laid_out(own, "conv_id", ["pos"])
    rows, nodes = verified(cut(fingerprints(stored, prime)), stored)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = everyone.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    nodes = nodes.unionByName(root.select(F.lit(0).alias("depth"), zero.alias("fp"), zero.alias("split"), "n", "conv_id", none.alias("up"), none.alias("upsplit"), zero.alias("bytes")))
    rows = rows.select("conv_id", *NODE).union(everyone.select("conv_id", F.lit(0), zero, zero))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("fp"), F.col("upsplit").alias("split")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    adds = nodes.select("conv_id", "depth", ((F.col("n") - 1) * F.col("bytes")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf")).where("saves > 0 or leaf > 0")
    put = rows.join(adds, ["conv_id", "depth"], "left").select("conv_id", *NODE, F.coalesce("saves", F.lit(0)).alias("saves"), F.coalesce("leaf", F.lit(0)).alias("leaf"), (-F.col("depth")).alias("back"))
    summed = prefix_sums(laid_out(put, "conv_id", ["back"]), "conv_id", _columns("saves", "leaf"), ["saved_tokens", "n_leaves"])
    rolled = summed.where("saved_tokens > 0 or n_leaves > 0").groupBy(*NODE).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    last = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("e")).select("conv_id", "e.*")
    pieces = last.groupBy(*NODE, F.shiftright("conv_id", PIECE).alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ends = pieces.select(*NODE, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")).repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    ends = ends.mapInArrow(_hashed, "depth int, fp long, split long, ends string")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("up"), F.col("split").alias("upsplit"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, ["depth", "up", "upsplit"], "left").join(rolled, NODE, "left").join(ends, NODE, "left")
    return found.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def of_rebuilt(conversations: DataFrame, prime: int = PRIME) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(turns(conversations)), prime)


def duck_crc32(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB's SQL."""
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda c, b: {step}))"


SQL = f"""
    with o as (select conv_id, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
        from conversations where conv_id is not null),
    t as (select *, dense_rank() over (order by r, x) as id from o),
    w as (select id, max(strlen(x)) as bytes from t group by id),
    s as (select distinct conv_id, conv_id - conv_id % 5 as base, {duck_crc32('conv_id::varchar')} % 9 as h from t),
    b as (select s.conv_id, pos, id from s join t on t.conv_id = s.base where s.base = s.conv_id or pos < h
        union all select s.conv_id, pos, id from s join t on t.conv_id = s.conv_id where s.base <> s.conv_id and pos >= h),
    p as (select s.conv_id, coalesce(list(id order by pos) filter (pos is not null), []) as p from s left join b using (conv_id) group by s.conv_id),
    m as (select conv_id, len(p) as n, unnest(range(0, len(p) + 1)) as d, p from p),
    g as (select p[1:d] as k, d, min(conv_id) as conv_id, count(*) as n, string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d) as ends from m group by all),
    c as (select k[1:d - 1] as k, d - 1 as d, count(*) as n_children from g where d > 0 group by all),
    f as (select g.*, coalesce(n_children, 0) as n_children, coalesce((n - 1) * bytes, 0) as saves from g left join c using (k, d) left join w on w.id = g.k[g.d]),
    a as (select k[1:j] as k, j as d, count_if(n_children = 0) as n_leaves, sum(saves)::bigint as saved_tokens from (select *, unnest(range(0, d + 1)) as j from f) group by all)
    select f.conv_id, f.d::bigint as depth, up.conv_id as parent_conv_id, f.n as n_convs, f.n_children, a.n_leaves, a.saved_tokens, sha256(coalesce(f.ends, '')) as ends_sha256
    from f join a using (k, d) left join g as up on up.d = f.d - 1 and up.k = f.k[1:f.d - 1]"""
