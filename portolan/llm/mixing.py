"""Mixing sources to target weights by a low-discrepancy schedule (operator 3).

Sources share share * (all words) by weight; a target stops at twice its source's words, and the excess is shared among the others by
weight again. Each source's documents are laid end to end in a shuffled order (by a hash of the document), twice over, and cut into
blocks of BLOCK words. A source has as many slots as its target needs blocks. Slot i of the schedule takes the i-th van der Corput
point (the reversed bits of i) of the smallest power of two that holds all slots; the points are mapped through the
cumulative slot counts of the sources, and points beyond them are void. So any stretch of the schedule holds the sources nearly in
their proportions, and the whole of it holds them exactly. A slot's rank among its source's slots names the block that it takes; the
last block of a source ends at its target (rounded to words), and never beyond twice its words.

The mix is the blocks in slot order: `mixed` lists them, `taken` sums them by document and names the slot in which each document first
comes, and `applied` writes whole documents in the order of the slots in which they begin.

Ranks come from counts of each source's slots in stretches of CHUNK slots, so no task numbers more than a stretch.

Null texts have no words and are never taken. A null source is a source, the last one. Repeated rows are rows of their own. Without any
words all targets are 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portolan.llm.common import cut, n_words, order_hash, running_total

BLOCK = 256
CHUNK_BITS = 16  # slots ranked together
MOST_SOURCES = 100_000  # whose facts are broadcast; more are joined by a shuffle
WEIGHTS = (3, 1, 2)  # fixed values, repeating over the sources
SHARE = 1.5
MOST_TIMES = 2


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> dict[str | None, float]:
    """Source -> target; sizes in the order in which weights are dealt. Every pass fixes the sources that reach twice their size."""
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    size = dict(sizes)
    left, open_, out = share * sum(size.values()), list(weight), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > MOST_TIMES * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(MOST_TIMES * size[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def sources(docs: DataFrame) -> list[tuple[str | None, int]]:
    """(source, words) by code point, null last; a row for each source comes to the driver, sums are made where the rows are."""
    rows = docs.groupBy("source").agg(F.sum("__size").alias("n")).collect()
    found = [(r["source"], int(r["n"] or 0)) for r in rows]
    return sorted(found, key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))


def _reversed_bits(i: Column, bits: int) -> Column:
    """The lowest `bits` bits of i in reverse, a byte at a time from a table."""
    table = F.array(*[F.lit(int(f"{b:08b}"[::-1], 2)) for b in range(256)])
    n_bytes = (bits + 7) // 8
    out = F.lit(0).cast("long")
    for k in range(n_bytes):
        byte = F.get(table, F.shiftright(i, 8 * k).bitwiseAND(F.lit(255)).cast("int")).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * (n_bytes - 1 - k)))
    return F.shiftright(out, 8 * n_bytes - bits)


def schedule(spark, quotas: list[int]) -> DataFrame:
    """slot, source_no, rank: quotas[k] slots of source k, interleaved."""
    total = sum(quotas)
    bits = max(1, (max(total, 1) - 1).bit_length())
    ends, at = [], 0
    for q in quotas:
        at += q
        ends.append(at)
    i, point = F.col("id"), F.col("point")
    slots = spark.range(1 << bits).select(i.alias("slot"), _reversed_bits(i, bits).alias("point")).where(point < total)
    # the first source whose slots end beyond the point, by halves
    bounds, no = F.array(*map(F.lit, ends or [0])).cast("array<long>"), F.lit(0)
    for k in reversed(range(max(len(ends) - 1, 0).bit_length())):
        step = no + (1 << k)
        no = F.when((step < len(ends)) & (F.get(bounds, step - 1) <= point), step).otherwise(no)
        slots = slots.withColumn("no", no)
        no = F.col("no")
    mine = cut(slots.select("slot", no.cast("int").alias("source_no"), F.shiftright("slot", CHUNK_BITS).alias("chunk")))
    counts = mine.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("n")
    leads = counts.select("source_no", "chunk", before.alias("lead"))
    inside = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    return mine.withColumn("inside", inside).join(leads, ["source_no", "chunk"]).select("slot", "source_no", (F.col("lead") + F.col("inside")).alias("rank"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("__size"))


def laid(docs: DataFrame) -> tuple[DataFrame, list[tuple[str | None, int]], int]:
    """`sized` rows with their source's number and their place in its shuffled stream; (source, words); how many rows."""
    more = ["name"] if "name" in docs.columns else []
    docs = cut(docs.select("doc_id", "source", F.col("__size").alias("size"), *more))
    named = docs.withColumnRenamed("size", "__size")
    order, rows = sources(named), docs.count()
    stream = running_total(docs, ["source"], [F.col("doc_id"), F.col("size"), *map(F.col, more)], F.col("size"), rows)
    return stream.select("doc_id", "source", "size", *more, F.col("__before").alias("offset"), F.col("__size").alias("source_size"), "__piece", "__row"), order, rows


def _facts(df: DataFrame, order: list) -> DataFrame:
    return F.broadcast(df) if len(order) <= MOST_SOURCES else df


def mixed(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, source, size, source_size, target, piece and row that name it; the mix: slot, source_no, rank, the same
    two, doc_id, source, size, lap, first word, words)."""
    stream, order, _ = laid(sized(docs))
    return _mixed(stream, order, block)


def _mixed(stream: DataFrame, order: list[tuple[str | None, int]], block: int) -> tuple[DataFrame, DataFrame]:
    goal = targets(order)
    words = {s: min(math.floor(goal[s] + 0.5), MOST_TIMES * n) for s, n in order}
    spark = stream.sparkSession
    facts = spark.createDataFrame(
        [(s, i, float(goal[s]), int(words[s])) for i, (s, _) in enumerate(order)], "s string, source_no int, target double, words long"
    )
    stream = cut(stream.join(_facts(facts, order), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    lap = F.explode(F.array(F.lit(0), F.lit(1)))
    starts = F.col("offset") + F.col("lap") * F.col("source_size")
    pieces = stream.where("size > 0").withColumn("lap", lap).withColumn("__from", starts).where("__from < words").withColumn(
        "__to", F.least(F.col("__from") + F.col("size"), F.col("words"))
    ).withColumn("rank", F.explode(F.sequence(F.floor(F.col("__from") / block).cast("long"), F.floor((F.col("__to") - 1) / block).cast("long"))))
    begin, end = F.greatest("__from", F.col("rank") * block), F.least("__to", (F.col("rank") + 1) * block)
    own = [c for c in ("doc_id", "source", "size", "name") if c in stream.columns]
    pieces = pieces.select(*own, "source_no", "__piece", "__row", "rank", "lap", (begin - F.col("__from")).alias("first_word"), (end - begin).alias("words"))
    slots = schedule(spark, [math.ceil(words[s] / block) for s, _ in order])
    return stream.drop("words"), pieces.join(slots, ["source_no", "rank"])


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (the slot in which its first word comes; null if none does)."""
    stream, mix = mixed(docs)
    sums = mix.groupBy("source_no", "__piece", "__row").agg(F.sum("words").alias("taken"), F.min(F.when(F.col("first_word") == 0, F.col("slot"))).alias("first_slot"))
    return stream.join(sums, ["source_no", "__piece", "__row"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )


def applied(docs: DataFrame) -> DataFrame:
    """docs in the order of the mix, each as often as the mix begins it: not at all, once or twice, and then whole.

    The schedule works on a row of numbers for each document, which also names its contents; texts are shuffled twice: to meet the slots of
    their names (rows alike in all columns are one there), and into slot order. Partitions are ranges of slots.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    name = F.struct(F.col("row.doc_id").cast("long").alias("d"), F.xxhash64("row").alias("a"), F.hash("row").alias("b"))
    named = packed.withColumn("name", name)
    sizes = named.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), n_words(F.col("row.text")).alias("__size"), "name")
    stream, order, _ = laid(sizes)
    _, mix = _mixed(stream, order, BLOCK)
    begun = mix.where("first_word = 0").select("name", "slot", "lap")
    rows = named.groupBy("name").agg(F.first("row").alias("row")).join(begun, "name")
    parts = max(docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(parts, "slot").sortWithinPartitions("slot", "lap", "name").select(*[F.col(f"row.`{c}`") for c in columns])


SQL = """
    with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
    s as (select source, sum(size)::bigint as n, row_number() over (order by source nulls last) as i from d group by source),
    w as (select *, case (i - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as w, 2 * n as cap from s),
    o as (select *, 1.5 * sum(n) over () as t, sum(w) over () as tw,
        coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as pc,
        coalesce(sum(w) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as pw from w),
    f as (select *, bool_and(cap * (tw - pw) < (t - pc) * w) over (order by cap / w, i) as full_ from o),
    g as (select source, n, case when full_ then cap::double else
        (t - coalesce(sum(cap) filter (full_) over (), 0))::double * w / (tw - coalesce(sum(w) filter (full_) over (), 0))::double
        end as target from f),
    p as (select d.*, n as source_size, target, least(floor(target + 0.5), 2 * n) as words,
        coalesce(sum(size) over (partition by d.source order by substr(md5(concat_ws('|', doc_id::varchar, size::varchar)), 1, 15),
        doc_id, size rows between unbounded preceding and 1 preceding), 0) as ofs
        from d join g on d.source is not distinct from g.source),
    q as (select source as s, i, words, ceil(words / 256.0)::bigint as quota from (select distinct source, words from p) join s using (source)
        union all select null, i, words, ceil(words / 256.0)::bigint from (select distinct words from p where source is null), (select i from s where source is null)),
    e as (select *, sum(quota) over (order by i) as hi from q),
    z as (select length(bin(greatest(sum(quota), 2)::bigint - 1)) as bits, sum(quota) as total from q),
    v as (select slot, list_sum(list_transform(range(0, bits), lambda k: ((slot >> k) & 1) << (bits - 1 - k)))::bigint as point
        from (select unnest(range(0, (1 << bits)::bigint)) as slot, bits from z)),
    r as (select slot, s, i, row_number() over (partition by i order by slot) - 1 as rank from v join e on point >= hi - quota and point < hi)
    select doc_id, size, source_size, target, (least(greatest(words - ofs, 0), size)
        + least(greatest(words - source_size - ofs, 0), size))::bigint as taken, slot as first_slot
    from p left join r on r.s is not distinct from p.source and rank = ofs // 256 and size > 0 and ofs < words"""
