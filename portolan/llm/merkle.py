"""Merkle manifest of a data set (operator 13): trees of SHA-256 digests over the documents of each source, and one over the sources.

A leaf is the digest of a document's fields. Leaves of a source stand in the order of doc_id (missing first; equal ids by digest); runs of FAN consecutive
nodes become their parent, a last run of fewer, even of one, too, until one node remains, the source's subroot. A lone leaf is its source's subroot itself. Subroots
in the order of source (missing first, else by bytes) give the root in the same way.

Trees are climbed in supersteps over RDDs of vertices (tree, place): every child sends its digest to its parent, messages are combined before
they are shuffled, and a parent that has all its children, at most FAN, hashes and sends on. Going back, every parent sends each child the
digests of its siblings together with its own path, down to the runs of leaves, which check their leaves against the root. A
superstep's vertices are stored in the shared folder. No vertex has more than FAN messages, so no source, however
large, meets in one task; there are as many supersteps as levels.

Null fields count as '-', empty texts don't. Repeated rows are leaves of their own. Rows without doc_id are never tampered with. An empty table gives an
empty manifest. Columns other than doc_id, source, lang, n_chars and text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm import supersteps
from portolan.llm.common import cut, laid_out, ones, prefix_sums
from portolan.llm.prefixes import duck_crc32
from portolan.llm.supersteps import FAN

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_MEMBER = "struct<slot:int,doc_id:long,leaf:string,seen:string>"
# what stands left and right of a node among its siblings, level by level
_PATH = "array<struct<a:string,b:string>>"


def _field(x: Column) -> Column:
    shown = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, and seen: the leaf of what is there now, where `tampered` (a condition) lower-cases A-Z of the text."""
    digest = lambda text: F.sha2(F.concat(*[_field(text if f == "text" else F.col(f)) for f in FIELDS]), 256)
    other = F.when(tampered, digest(F.translate("text", _CAPITALS, _CAPITALS.lower()))) if tampered is not None else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", digest(F.col("text")).alias("leaf"), other.alias("seen"))


def placed(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(tree, i, n, doc_id, leaf, seen: a source's number, a leaf's place in it and their count), how many sources, most leaves of one."""
    sizes = rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("__all", F.lit(0).cast("long"))
    numbered = prefix_sums(laid_out(sizes, "__all", ["source"]), "__all", ones, ["tree"])
    trees = cut(numbered.select(F.col("source").alias("__source"), (F.col("tree") - 1).alias("tree"), "n"))
    sources, most = trees.agg(F.count("*"), F.max("n")).first()
    known = rows.join(trees, F.col("source").eqNullSafe(F.col("__source"))).select("tree", "n", "doc_id", "leaf", "seen")
    ranked = prefix_sums(laid_out(known, "tree", ["doc_id", "leaf"]), "tree", ones, ["i"])
    # stored, so that supersteps have no second Python worker beside their own
    return cut(ranked.select("tree", (F.col("i") - 1).alias("i"), "n", "doc_id", "leaf", "seen")), sources, most or 0


def _combined(messages: RDD, parts: int) -> RDD:
    """(parent, (n, message)) -> (parent, (n, messages)); lists are joined before the shuffle."""
    return messages.combineByKey(lambda m: (m[0], [m[1]]), lambda c, m: (c[0], [*c[1], m[1]]), lambda a, b: (a[0], a[1] + b[1]), parts)


def _climbed(vertices: DataFrame, parts: int, rounds: int) -> list[DataFrame]:
    """The levels above `vertices` (tree, place, n, digest): tree, place, n, digest, children; as long as a tree has more than one vertex."""
    levels = []
    for _ in range(rounds):
        sent = vertices.where("n > 1").select("tree", "place", "n", "digest").rdd.map(lambda v: ((v.tree, v.place // FAN), (v.n, (v.place % FAN, v.digest))))
        vertices = _stored(_combined(sent, parts).map(supersteps.vertex), vertices, "tree long, place long, n long, digest string, children array<string>")
        levels.append(vertices)
    return levels


def _stored(rdd: RDD, like: DataFrame, schema: str) -> DataFrame:
    return cut(like.sparkSession.createDataFrame(rdd, schema, verifySchema=False))


def _descended(levels: list[DataFrame], told: Callable[[int], RDD | None], parts: int) -> RDD:
    """(tree, place) -> (subroot, root, path) for the vertices below the levels. told(k): what the tops of level k (from 0) hear from outside."""
    heard: RDD | None = None
    for k in reversed(range(len(levels))):
        outside = told(k)
        all_heard = heard if outside is None else outside if heard is None else heard.union(outside)
        vertices = levels[k].select("tree", "place", "children").rdd.map(lambda v: ((v.tree, v.place), v.children))
        heard = vertices.join(all_heard, parts).flatMap(supersteps.told)
        if k:
            kept = _stored(heard.map(lambda x: (*x[0], *x[1])), levels[k], f"tree long, place long, subroot string, root string, path {_PATH}")
            heard = kept.rdd.map(supersteps.hearing)
    return heard


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    spark, out = docs.sparkSession, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, sources, most = placed(leaves(docs, tampered))
    if not sources:
        return spark.createDataFrame([], out)
    # leaves to their runs; a source's levels above them
    sent = rows.rdd.map(lambda r: ((r.tree, r.i // FAN), (r.n, (r.i % FAN, r.doc_id, r.leaf, r.seen))))
    runs = _stored(_combined(sent, parts).map(supersteps.run), rows, f"tree long, place long, n long, digest string, lone boolean, members array<{_MEMBER}>")
    levels = _climbed(runs, parts, supersteps.rounds(supersteps.up(most)))
    tops = [level.where("n = 1").select("tree", "digest", F.lit(k).alias("level")) for k, level in enumerate([runs, *levels])]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.union(t)
    subroots = cut(subroots)
    # the tree of the sources: one tree, whose leaves are subroots
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(sources).cast("long").alias("n"), "digest")
    upper = _climbed(top, parts, supersteps.rounds(sources))
    root = (upper[-1] if upper else top).first()["digest"]
    whole = spark.sparkContext.parallelize([((0, 0), ("", root, []))], 1)
    heard = _descended(upper, lambda k: whole if k == len(upper) - 1 else None, parts) if upper else whole
    # what each subroot hears, by the level at which it stands
    placing = subroots.rdd.map(lambda r: ((0, r.tree), (r.digest, r.level)))
    told = _stored(placing.join(heard, parts).map(lambda x: (x[0][1], x[1][0][1], x[1][0][0], x[1][1][1], x[1][1][2])), subroots, f"tree long, level int, subroot string, root string, path {_PATH}")
    at_level = lambda k: told.where(F.col("level") == k).withColumn("place", F.lit(0).cast("long")).rdd.map(supersteps.hearing)
    heard = at_level(0)
    if levels:
        heard = heard.union(_descended(levels, lambda k: at_level(k + 1), parts))
    members = runs.select("tree", "place", "lone", "members").rdd.map(lambda r: ((r.tree, r.place), (r.lone, [tuple(m) for m in r.members])))
    return spark.createDataFrame(members.join(heard, parts).flatMap(supersteps.checked), out, verifySchema=False)


def tampered() -> Column:
    """Where 5 divides the CRC-32 of doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _sql(levels: int = 6) -> str:
    """For up to FAN**levels leaves of a source, and as many sources."""

    def field(x: str) -> str:
        return f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"

    def tree(name: str, base: str) -> str:
        """Levels of the trees of base (g, i, d): name0, name1, ...; a tree ends at one node."""
        out = [f"{name}0 as (select g, i, d, count(*) over (partition by g) as n from {base})"]
        for k in range(levels):
            out.append(f"{name}{k + 1} as (select *, count(*) over (partition by g) as n from (select g, i // {FAN} as i, sha256(string_agg(d, '' order by i)) as d from {name}{k} where n > 1 group by g, i // {FAN}))")
        return ", ".join(out)

    def folded(name: str, base: str, columns: str) -> tuple[str, str]:
        """From base (columns, g, i, h, proof) up through the trees."""
        out, now = [], base
        for k in range(levels):
            side = lambda op, k=k: f"coalesce((select string_agg(s.d, '' order by s.i) from {name}{k} as s where s.g = x.g and s.i // {FAN} = x.i // {FAN} and s.i {op} x.i and s.n > 1), '')"
            out.append(f"{name}s{k} as (select x.*, {side('<')} as a, {side('>')} as b, coalesce((select any_value(s.n) from {name}{k} as s where s.g = x.g), 1) > 1 as goes from {now} as x)")
            out.append(f"{name}f{k} as (select {columns}, g, i // {FAN} as i, case when goes then sha256(a || h || b) else h end as h, proof || a || b as proof from {name}s{k})")
            now = f"{name}f{k}"
        return ", ".join(out), now

    low = f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')"
    lower, at_subroot = folded("t", "l", "doc_id, leaf, subroot, root")
    upper, at_root = folded("u", "v", "doc_id, leaf, subroot, root")
    last = lambda name: " union all ".join(f"select g, d from {name}{k} where n = 1" for k in range(levels + 1))
    return f"""with e as (select *, {leaf('text')} as leaf, case when {duck_crc32('doc_id::varchar')} % 5 = 0 then {leaf(low)} end as seen, dense_rank() over (order by source nulls first) - 1 as g from documents),
    r as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from e), b as (select g, i, leaf as d from r),
    {tree('t', 'b')}, roots as ({last('t')}), c as (select 0 as g, g as i, d from roots), {tree('u', 'c')}, top as ({last('u')}),
    l as (select doc_id, leaf, roots.d as subroot, top.d as root, r.g, i, coalesce(seen, leaf) as h, '' as proof from r join roots using (g), top),
    {lower}, v as (select doc_id, leaf, subroot, root, 0 as g, g as i, h, proof from {at_subroot}), {upper}
    select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from {at_root}"""


SQL = _sql(4)
