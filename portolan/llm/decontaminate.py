"""Benchmark decontamination by a generalised suffix automaton (operator 9).

The benchmark items' words, lower-cased and cleaned, go into one automaton, a state of which stands for word runs that end at the
same places of the items. Documents are streamed through it word by word: the state holds the longest run ending here that some
item has too. A run of WINDOW words or more is a hit, and so is a short item's whole sequence.

The items are broadcast, and each worker builds the automaton of them once; its size is bounded: items are dealt into blocks of MOST_WORDS
words, an automaton and a pass over the texts for each block (one block, unless the benchmark is very large), whose hits are united by
document.

Null and empty texts and items have no words: they hit nothing. Repeated documents are judged one by one. Repeated items count by item_id.
An empty benchmark hits nothing; no documents give an empty result. Items without an item_id match words but aren't named.
Other columns are ignored (`cleaned` keeps them).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import cut

WINDOW = 10
MOST_WORDS = 400_000  # an automaton of so many takes about 220 MB in a worker
COVERAGE = 0.5

# Each byte that may be in a word stays (A-Z in lower case), every other becomes a space.
_CLEAN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def normal(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the A-Z lower-cased text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split() if text else []


class Automaton:
    """Generalised suffix automaton over word sequences."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        self.ids: dict[tuple[bytes, ...], list] = {}  # window -> its items
        self.short: dict[int, list[tuple[int, tuple[bytes, ...]]]] = {}  # state -> short items that end there
        for item, words in items:
            last = 0
            for w in words:
                last = self._append(last, w)
            for i in range(max(1, len(words) - window + 1)) if words else ():
                self.ids.setdefault(tuple(words[i : i + window]), []).append(item)
        for words in list(self.ids):
            if len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][w]
                self.short.setdefault(state, []).append((len(words), words))
        # what a state's suffix links lead to, nearest first
        self.ends: list[list[tuple[int, tuple[bytes, ...]]]] = [[]] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__) if self.short else ():
            self.ends[s] = self.short.get(s, []) + self.ends[self.link[s]]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _append(self, last: int, w: bytes) -> int:
        """The state of the run at `last` followed by w."""
        known = self.next[last].get(w)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, w, known)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        """Parts off q's runs that are no longer than p's runs and w."""
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [start, end) of words inside an occurrence of a window, merged, and the items whose windows occur."""
        following, link, length, window = self.next, self.link, self.length, self.window
        ends, short = self.ends, bool(self.short)
        state = matched = 0
        spans: list[tuple[int, int]] = []
        found: set = set()

        def hit(start: int, end: int, key: tuple[bytes, ...]) -> None:
            found.update(x for x in self.ids[key] if x is not None)
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        start_of = following[0]
        for i, w in enumerate(words):
            to = following[state].get(w)
            if to is None:
                if w not in start_of:
                    state = matched = 0
                    continue
                while to is None:
                    state = link[state]
                    to = following[state].get(w)
                matched = length[state]
            state = to
            matched += 1
            if matched >= window:
                hit(i + 1 - window, i + 1, tuple(words[i + 1 - window : i + 1]))
            if short:
                # the state's own short items only as far as the match reaches, those of its links in full
                for size, key in ends[state]:
                    if size <= matched:
                        hit(i + 1 - size, i + 1, key)
        return spans, found


def blocks(benchmark: DataFrame, most_words: int = MOST_WORDS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks; they come to the driver one partition at a time, a block is handed on when it is full."""
    block, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = normal(row["text"])
        if block and n + len(words) > most_words:
            yield block
            block, n = [], 0
        block.append((row["item_id"], words))
        n += len(words)
    yield block


_BUILT: dict[tuple[str, int], Automaton] = {}


def built(name: str, items: Broadcast, window: int) -> Automaton:
    """The automaton of a block; a worker keeps the last one."""
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = Automaton(items.value, window)
    return _BUILT[name, window]


def matches(docs: DataFrame, key: str, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """key, n_words, spans (of word numbers, end excluded), items: a row for each row of docs and each block of items."""
    spark, found = docs.sparkSession, None
    kind = dict(docs.dtypes)[key]
    for block in blocks(benchmark, most_words):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            automaton = built(name, shared, window)
            for batch in batches:
                counts, spans, items = [], [], []
                for text in batch.column("text").to_pylist():
                    words = normal(text)
                    s, ids = automaton.hits(words)
                    counts.append(len(words))
                    spans.append([{"first": a, "end": b} for a, b in s])
                    items.append(sorted(map(str, ids)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(counts, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                    [key, "n_words", "spans", "items"],
                )

        part = docs.select(key, "text").mapInArrow(run, f"{key} {kind}, n_words long, spans array<struct<first: int, end: int>>, items array<string>")
        found = part.withColumn("__block", F.lit(0)) if found is None else found.union(part.withColumn("__block", F.lit(1)))
    return found


def _union_size(spans: str) -> str:
    """Words in the union of spans: sorted, each adds what lies beyond the furthest end so far."""
    return (
        f"aggregate(array_sort({spans}), struct(0L as n, 0 as at), (a, s) -> struct("
        "a.n + greatest(0, s.end - greatest(s.first, a.at)) as n, greatest(a.at, s.end) as at), a -> a.n)"
    )


def counted(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if n <= most_words:  # words are no more than characters, so there is one block
        found = matches(rows, "doc_id", benchmark, window, most_words)
    else:
        # rows are named by their contents; equal rows of one doc_id have equal hits
        named = rows.withColumn("__key", F.sha2(F.concat_ws("|", "doc_id", F.xxhash64("text"), F.coalesce("text", F.lit(""))), 256))
        parts = matches(named, "__key", benchmark, window, most_words)
        found = parts.groupBy("__key").agg(
            F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        found = named.select("doc_id", "__key").join(found, "__key").drop("__key")
    out = found.select(
        "doc_id", "n_words", F.expr(_union_size("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _cut_out(text: str, spans: list[tuple[int, int]], coverage: float) -> str | None:
    """The text without the spans (of word numbers, in order, apart); None if they cover more than that share of its words. What is cut is
    replaced by a line break."""
    data = text.encode("utf-8", "surrogatepass")
    tokens = [m.span() for m in _TOKEN.finditer(data.translate(_CLEAN))]
    if sum(b - a for a, b in spans) > coverage * len(tokens):
        return None
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at : tokens[a][0]])
        at = tokens[b - 1][1]
    parts.append(data[at:])
    return b"\n".join(parts).decode("utf-8", "surrogatepass")


def _without(text: str, automaton: Automaton, coverage: float) -> str | None:
    """The text without what some item has too; None if that is more than `coverage`. The rest is looked at again, as cutting may bring the
    parts of a window together."""
    while text is not None:
        spans, _ = automaton.hits(normal(text))
        if not spans:
            return text
        text = _cut_out(text, spans, coverage)
    return None


def _united(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans of several blocks in order, merged where they touch, as one automaton merges them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _by_blocks(texts: DataFrame, benchmark: DataFrame, window: int, coverage: float, most_words: int) -> DataFrame:
    """key, text -> key, new: the text without what the items have, NULL for one that goes; only texts that change are listed.

    Each round takes the spans of all blocks together before it judges a text or cuts it, and looks again at those that it cut, so the result doesn't depend on
    how items are dealt to blocks. Rounds are stored; there are as many as cuts bring windows together in turn.
    """
    now, done = texts, None
    while True:
        found = matches(now, "key", benchmark, window, most_words).where("size(spans) > 0").groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [_cut_out(t, _united(s), coverage) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(new, pa.string())], ["key", "text"])

        changed = cut(now.join(found, "key").select("key", "text", "spans").mapInArrow(run, "key string, text string"))
        # a text's last round counts
        done = changed if done is None else cut(done.join(changed.select("key"), "key", "left_anti").union(changed))
        now = changed.where("text is not null")
        if not now.take(1):
            return done.withColumnRenamed("text", "new")


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, most_words: int = MOST_WORDS) -> DataFrame:
    """docs without their contaminated spans, and without the documents that these cover by more than `coverage`; n_chars, where
    there is such a column, is counted again for changed texts. All other columns stay. The result is the same for any most_words."""
    n = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if n > most_words:  # words are no more than characters, so one block holds the rest
        return _joined(docs, _by_blocks, benchmark, window, coverage, most_words)
    (block,) = blocks(benchmark, most_words)
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = built(name, shared, window)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            new = [_without(t, automaton, coverage) if t else t for t in texts]
            keep = pa.array([n is not None or t is None for t, n in zip(texts, new, strict=True)])
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if (k := batch.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(batch.schema.field(k).type):
                chars = [c if t == n or n is None else len(n) for c, t, n in zip(columns[k].to_pylist(), texts, new, strict=True)]
                columns[k] = pa.array(chars, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def _joined(docs: DataFrame, clean: Callable[..., DataFrame], *more) -> DataFrame:
    """docs with each text as `clean` leaves it; equal texts are cleaned once."""
    key = F.sha2("text", 256)
    texts = docs.where("text <> ''").groupBy(key.alias("key")).agg(F.first("text").alias("text"))
    new = clean(texts, *more)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("own"))
    rows = packed.join(new, F.col("own") == F.col("key"), "left").where("key is null or new is not null")
    kinds = dict(docs.dtypes)
    of = lambda c: (
        F.coalesce("new", F.col("row.text")) if c == "text"
        else F.when(F.col("key").isNotNull(), F.length("new").cast(kinds[c])).otherwise(F.col("row.n_chars")) if c == "n_chars" and kinds[c] in ("bigint", "int", "smallint", "tinyint")
        else F.col(f"row.`{c}`"))
    return rows.select(*[of(c).alias(c) for c in docs.columns])


SQL = f"""
    with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
    bk as (select item_id, w, least(len(w), {WINDOW}) as k from b where len(w) > 0),
    bi as (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from bk),
    win as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as key from bi),
    dk as (select rid, w, k from d, (select distinct k from win) where len(w) >= k),
    di as (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from dk),
    hit as (select rid, i, di.k, item_id from di join win on win.k = di.k and win.key = array_to_string(w[i:i + di.k - 1], ' ')),
    words as (select distinct rid, unnest(range(i, i + k)) as at from hit),
    n as (select rid, count(*) as n_hit from words group by rid),
    ids as (select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct rid, item_id::varchar as id from hit where item_id is not null) group by rid)
    select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
        sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join n using (rid) left join ids using (rid)"""
