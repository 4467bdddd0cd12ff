"""Line dedup (operator 11; DataFrame functions only): lines that many documents share stay in one of them.

A line's key is the line without white space at its ends, A-Z in lower case. Keys of LEAST code points or more that COPIES documents hold
lose their lines, except in the document with the largest doc_id. What is found comes back as bitmaps, not as texts: for each document
the lengths of the runs of lines that stay and go, by turns.

Each key is hashed to 128 bits (two keys of 10^12 meet with a chance of 10^-15). (hash, document, position) rows are range-partitioned by
hash and sorted by document, last one first, and position within it, so that a window streams over them: lines of the first document stay. Keys with
more than about a thousandth of all lines don't go there: a sketch of frequent items names them (at most HEAVY), an aggregation that sums
up before the shuffle counts their documents, and their lines are decided where they are. That changes nothing in the result.

A null or empty text is one empty line. Documents are told apart by doc_id, rows without one are one document, the smallest;
rows that share a doc_id keep the line in each of them. Repeated rows are judged alike. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portolan.llm.common import cut, own_name

LEAST, COPIES = 20, 3
HEAVY, TRACKED = 1000, 20_000  # keys that are decided without the window; counters of the sketch that finds them
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.translate(bare, _CAPITALS, _CAPITALS.lower())


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """h1, h2 (the key's hash), doc_id, mark (the text's hash), pos of the lines that may go."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("mark"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = rows.select("d", "mark", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "d", "mark", "pos")


def _documents() -> Column:
    """How many documents, among the rows of a group."""
    return F.count_distinct("d") + F.max(F.col("d").isNull().cast("int"))


def dropped(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """d, mark (doc_id and hash of a text) and gone, the sorted positions of its lines that go; texts without such a line aren't listed."""
    lines = cut(_lines(docs, least))
    top = lines.select(F.explode(F.expr(f"approx_top_k(h1, {HEAVY}, {TRACKED})")).alias("t")).select(F.col("t.item").alias("h1"))
    # HEAVY rows at most
    heavy = lines.join(F.broadcast(top), "h1").groupBy("h1", "h2").agg(F.max("d").alias("last"), _documents().alias("n"))
    told = lines.join(F.broadcast(heavy.withColumnsRenamed({"h1": "__a", "h2": "__b"})), (F.col("h1") == F.col("__a")) & (F.col("h2") == F.col("__b")), "left")
    at_once = told.where((F.col("n") >= copies) & ~F.col("d").eqNullSafe(F.col("last"))).select("d", "mark", "pos")

    group = Window.partitionBy("h1", "h2")
    down = group.orderBy(F.col("d").desc_nulls_last(), "pos")
    light = told.where(F.col("n").isNull()).select("h1", "h2", "d", "mark", "pos").repartitionByRange("h1", "h2")
    seen = light.withColumns({"first": F.first("d").over(down), "new": (F.row_number().over(down) == 1) | ~F.col("d").eqNullSafe(F.lag("d").over(down))})
    counted = seen.withColumn("n", F.sum(F.col("new").cast("int")).over(group))
    streamed = counted.where((F.col("n") >= copies) & ~F.col("d").eqNullSafe(F.col("first"))).select("d", "mark", "pos")
    # a document's own lines at most
    return at_once.union(streamed).groupBy("d", "mark").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def _judged(docs: DataFrame, least: int, copies: int) -> tuple[DataFrame, str]:
    """docs as a struct `row`, with text, and gone (empty where all stays)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("text"), F.xxhash64("text").alias("hash"))
    found = packed.join(dropped(docs, least, copies), F.col("id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("mark")), "left")
    return found.select("row", "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone")), own_name(docs.columns, "keep")


# SQL over text and gone: number of lines; what stays, by slices between the lines that go
_COUNT = "(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), '\\n', '')))"
_TEXT = """get(transform(array(split(coalesce(text, ''), '\\n')), l -> array_join(flatten(transform(concat(gone, array(size(l))),
    (p, i) -> slice(l, if(i = 0, 0, get(gone, i - 1) + 1) + 1, p - if(i = 0, 0, get(gone, i - 1) + 1)))), '\\n')), 0)"""
_KEPT = f"if(size(gone) = 0, text, {_TEXT})"
# run lengths: lines that stay, that go, that stay, ...; a run that goes begins where the line before stays
_RUNS = f"""get(transform(array(filter(gone, (p, i) -> i = 0 or get(gone, i - 1) < p - 1)), heads ->
    get(transform(array(filter(gone, (p, i) -> i = size(gone) - 1 or get(gone, i + 1) > p + 1)), tails ->
        concat(flatten(transform(heads, (h, i) -> array(h - if(i = 0, 0, get(tails, i - 1) + 1), get(tails, i) + 1 - h))),
            array(cast({_COUNT} as int) - if(size(tails) = 0, 0, get(tails, size(tails) - 1) + 1)))), 0)), 0)"""


def bitmaps(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """docs without text, and `keep`: lengths of runs of lines, by turns those that stay (first, maybe 0) and those that go."""
    rows, keep = _judged(docs, least, copies)
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"], F.expr(_RUNS).alias(keep))


def deduplicated(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """docs with the lines that stay as their text."""
    rows, _ = _judged(docs, least, copies)
    return rows.select(*[F.expr(_KEPT).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the SHA-256 of what stays."""
    rows, _ = _judged(docs.select("doc_id", "text"), LEAST, COPIES)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), F.expr(_COUNT).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(F.expr(_KEPT), F.lit("")), 256).alias("kept_sha256"),
    )


SQL = f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
    l as (select rid, doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from d),
    k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_CAPITALS}', '{_CAPITALS.lower()}') as key from l),
    g as (select key, max(doc_id) as last from k where length(key) >= {LEAST} group by key having count(distinct doc_id) + max((doc_id is null)::int) >= {COPIES}),
    m as (select rid, k.doc_id, line, i, g.key is not null and k.doc_id is distinct from g.last as gone from k left join g using (key))
    select doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
    from m group by rid, doc_id"""
