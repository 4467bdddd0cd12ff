"""CSV and TSV files read in splits, also where quoted cells hold line breaks.

A file is read as lines. One aggregation tells how many lines each split has, and whether any has an odd number of quotes. If none has, every line is a
record. Else a quoted cell may go on in the next line, and whether a line begins inside a cell depends on all lines before it. So each split is walked
through for both cases, begun outside a quoted cell and inside one, which gives how it ends and how many records begin in it (a small row for each split);
these results, taken one after another, tell each split how it really begins. A second walk puts lines together to records. What reaches
over the end of a split is put together by the number of its record. Records are parsed by from_csv.

Blank lines between records are no rows. A quote opens a cell only at the cell's start; a doubled quote inside is one quote. A cell that is never
closed goes on to the end of the file, as one record.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20


def separator(head: str, suffix: str) -> str:
    """Tab for .tsv and .txt, unless the header has none but commas."""
    return "," if suffix == ".csv" or ("\t" not in head and "," in head) else "\t"


def ends_open(line: str, sep: str, is_open: bool) -> bool:
    """Whether a quoted cell is open at the end of a line that begins in one or not."""
    at = 0
    while True:
        if not is_open and line.startswith('"', at):
            is_open, at = True, at + 1
        if is_open:
            at = line.find('"', at)
            while at >= 0 and line.startswith('"', at + 1):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            is_open, at = False, at + 1
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


def walk(batches: Iterator[pa.RecordBatch], sep: str) -> tuple[list[bool], list[int]]:
    """For a split (part, blank, quoted: the line if it has a quote) begun outside and inside a quoted cell: whether one is open at its end, and
    how many records begin in it."""
    states, counts = [False, True], [0, 0]
    for batch in batches:
        filled = np.concatenate(([0], np.cumsum(~batch.column("blank").to_numpy(zero_copy_only=False))))
        quoted = batch.column("quoted")
        places = np.flatnonzero(quoted.is_valid().to_numpy(zero_copy_only=False))
        lines = quoted.take(pa.array(places)).to_pylist()
        for k in (0, 1):
            at = 0
            for place, line in zip(places.tolist(), lines, strict=True):
                if not states[k]:  # all filled lines up to this one begin records
                    counts[k] += int(filled[place + 1] - filled[at])
                states[k], at = ends_open(line, sep, states[k]), place + 1
            if not states[k]:
                counts[k] += int(filled[-1] - filled[at])
    return states, counts


def _walked(lines: DataFrame, sep: str) -> dict[int, tuple[bool, int]]:
    """split -> whether it begins in a quoted cell, and the number of its first record. A row for each split comes to the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[int] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    part[:] = [batch.column("part")[0].as_py()]
                    yield batch

        states, counts = walk(seen(), sep)
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([states]), pa.array([counts], pa.list_(pa.int64()))], ["part", "states", "counts"])

    quoted = F.when(F.col("value").contains('"'), F.col("value"))
    rows = lines.select(F.spark_partition_id().alias("part"), _blank().alias("blank"), quoted.alias("quoted")).mapInArrow(ends, "part int, states array<boolean>, counts array<long>").collect()
    begins, is_open, number = {}, False, 0
    for part, states, counts in sorted(map(tuple, rows)):
        begins[part] = (is_open, number)
        number, is_open = number + counts[is_open], states[is_open]
    return begins


def _blank():
    return F.length(F.btrim("value", F.lit(" \t\x0b\x0c\r"))) == 0


def _records(lines: DataFrame, sep: str) -> DataFrame:
    """no (from 0), text of the records of lines that may begin inside quoted cells."""
    begins = _walked(lines, sep)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_open, no, part = False, 0, -1
        out: list[tuple] = []
        held: list[str] = []
        size = 0
        whole = True  # the record's start is in this split
        for batch in batches:
            if not batch.num_rows:
                continue
            if part < 0:
                part = batch.column("part")[0].as_py()
                is_open, no = begins[part]
                no, whole = no - 1, not is_open
            for line in batch.column("value").to_pylist():
                if not is_open:
                    if held:
                        out.append((no, part, whole, "\n".join(held)))
                        held, whole = [], True
                    if not line.strip(" \t\x0b\x0c\r"):
                        continue
                    no += 1
                held.append(line)
                size += len(line)
                if is_open or '"' in line:
                    is_open = ends_open(line, sep, is_open)
            if out and (size > BATCH_BYTES or len(out) > 10_000):
                yield _batch(out)
                out, size = [], 0
        if held:
            out.append((no, part, whole and not is_open, "\n".join(held)))
        if out:
            yield _batch(out)

    pieces = lines.select(F.spark_partition_id().alias("part"), "value").mapInArrow(joined, "no long, part int, whole boolean, text string")
    # two for each split at most
    broken = pieces.where("not whole").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p")).select("no", F.array_join("p.text", "\n").alias("text"))
    return pieces.where("whole").select("no", "text").union(broken)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    no, part, whole, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(part, pa.int32()), pa.array(whole), pa.array(text, pa.string())], ["no", "part", "whole", "text"])


def numbered(df: DataFrame, to: str, counts: dict[int, int] | None = None) -> DataFrame:
    """df with the place of each row in its scan, from 0 without gaps. Spark's own row ids start anew in each partition, so each
    partition's count (one small row, unless `counts` has them) gives its offset."""
    ids = df.withColumn("__id", F.monotonically_increasing_id())
    part, inside = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    if counts is None:
        counts = {r["p"]: r["n"] for r in ids.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, at = [], 0
    for p in range(max(counts, default=0) + 1):
        offsets.append(at)
        at += counts.get(p, 0)
    if len(offsets) == 1:
        return ids.withColumnRenamed("__id", to)
    starts = df.sparkSession.createDataFrame(list(enumerate(offsets)), "__p long, __start long")
    # a row for each partition of the scan
    found = ids.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return found.withColumn(to, F.col("__start") + inside).drop("__p", "__start", "__id")


def records(spark: SparkSession, path: str, suffix: str) -> tuple[DataFrame, str]:
    """no (the header is 0), text of a file's records; and what parts their cells."""
    first = spark.read.text(path).limit(1).first()
    sep = separator(first[0] if first else "", suffix)
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(~_blank()).alias("n"), F.count_if(quotes % 2 == 1).alias("odd")).collect()
    if any(s["odd"] for s in splits):
        return _records(spark.read.option("lineSep", "\n").text(path), sep), sep
    whole = numbered(lines.where(~_blank()), "no", {s["p"]: s["n"] for s in splits})
    return whole.select("no", F.col("value").alias("text")), sep


def cells(rows: DataFrame, sep: str, n: int) -> DataFrame:
    """no and c0, c1, ... of records; a record of fewer cells ends in NULLs, more are cut."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    return rows.select("no", F.from_csv(F.rtrim(F.col("text"), F.lit("\r")), F.lit(schema), options).alias("c")).select("no", "c.*")


def header(rows: DataFrame, sep: str) -> list[str]:
    head = rows.where("no = 0").first()
    return next(csv.reader([head["text"].lstrip("\ufeff").rstrip("\r")], delimiter=sep), []) if head else []
