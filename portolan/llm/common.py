"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# White space that parts words in every contract of this package: space and U+0009..U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; bytes.split() parts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, a local session gets a temporary one, as in tests; on a cluster
    that is an error, as other machines couldn't see such a folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="portolan-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `fresh_path` named."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} isn't in the shared folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def own_name(columns: list[str], name: str) -> str:
    """`name`, or with underscores after it, so that it clashes with none of the columns, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: the rows are written to the shared folder, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def forget(*tables: DataFrame) -> None:
    """Deletes what `cut` wrote for these tables, which nothing may read any more."""
    for df in tables:
        at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if at.isDefined():
            remove(df.sparkSession, at.get())


class WordHashes(dict):
    """word -> 64-bit hash; forgets all once it is full, so a worker's memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (order matters); empty if there are fewer than n."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + m]
    return mix64(out)


def order_hash(*order: Column) -> Column:
    """60 bits of the MD5 of the columns' texts, parted by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in order])), 1, 15), 16, 10).cast("long")


def running_total(df: DataFrame, group: list[str], order: list[Column], weight: Column, rows: int) -> DataFrame:
    """Adds __before: the weight of all rows that come before this one in its group, __size: that of the whole group, and __row:
    the rows before it in its piece (__piece). df has no column that begins with two underscores.

    Rows of a group are ordered by `order_hash`, then by the columns of `order`. A
    group is cut into pieces by the hash's leading bits, about sqrt(rows) of them, so that neither a piece nor the table of pieces
    grows faster than sqrt(rows): no task gets a whole hot group.
    """
    bits = max(0, (max(rows, 1).bit_length() + 1) // 2)
    base = df.withColumn("__h", order_hash(*order)).withColumns(
        {"__piece": F.shiftright("__h", 60 - bits).cast("int"), "__w": weight.cast("long")}
    )
    sums = base.groupBy(*group, "__piece").agg(F.sum("__w").alias("__sum"))
    by_piece = Window.partitionBy(*group).orderBy("__piece") if group else Window.partitionBy(F.lit(0)).orderBy("__piece")
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__piece").alias("__p"),
        (F.sum("__sum").over(by_piece) - F.col("__sum")).alias("__lead"),
        F.sum("__sum").over(whole).alias("__size"),
    )
    inside = Window.partitionBy(*group, "__piece").orderBy("__h", *order)
    ranked = base.withColumn(
        "__in", F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w")
    ).withColumn("__row", F.row_number().over(inside))
    same = F.col("__piece") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = ranked.join(sums, same)
    return joined.withColumn("__before", F.col("__lead") + F.col("__in")).drop(
        "__h", "__w", "__in", "__lead", "__p", *[f"__g{i}" for i in range(len(group))]
    )


def laid_out(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df in the order of `key` and then `order` (missing values first) over its partitions, stored, with __part, a partition's number. The
    rows of a key may lie in several partitions, one after another, so a key with most of the rows has no task of its own."""
    places = [F.col(c).asc_nulls_first() for c in (key, *order)]
    return cut(df.repartitionByRange(*places).sortWithinPartitions(*places)).withColumn("__part", F.spark_partition_id())


def prefix_sums(laid: DataFrame, key: str, values: Callable[[pa.RecordBatch], list[np.ndarray]], names: list[str], modulus: int | None = None) -> DataFrame:
    """A table from `laid_out` (whose key is a long without nulls) with running sums, this row's value included, over the rows of each key.

    `values` gives whole numbers for a batch, below the modulus where there is one (2**31 at most); without one sums wrap at 64 bits. One
    pass sums up the last key of each partition; these sums, a row for each partition, come to the driver, which works out what each partition
    begins with. A second pass scans.
    """

    def reduced(x: np.ndarray) -> np.ndarray:
        return x if modulus is None else x % modulus

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = at = part = None
        sums = np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            part = batch.column("__part")[0].as_py()
            first = int(keys[0]) if first is None else first
            start = int(np.searchsorted(keys, keys[-1]))
            if start or keys[0] != at:
                sums[:] = 0
            at = int(keys[-1])
            sums = reduced(sums + np.array([v[start:].sum() for v in values(batch)], np.int64))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([at]), pa.array([sums.tolist()], pa.list_(pa.int64()))], ["part", "first", "last", "sums"])

    begins: dict[int, tuple[int, np.ndarray]] = {}
    at, carry = None, np.zeros(len(names), np.int64)
    for part, first, end, sums in sorted(map(tuple, laid.mapInArrow(last, "part int, first long, last long, sums array<long>").collect())):
        if first == at:
            begins[part] = (first, carry)
        carry = reduced(np.array(sums, np.int64) + (carry if first == end == at else 0))
        at = end

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        carry: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            if carry is None:
                at, carry = begins.get(batch.column("__part")[0].as_py(), (None, np.zeros(len(names), np.int64)))
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            lengths = np.diff(np.append(starts, len(keys)))
            out = []
            for k, v in enumerate(values(batch)):
                sums = np.cumsum(v, dtype=np.int64)
                before = sums[starts] - v[starts]  # all that the batch holds before a key
                if at is not None and keys[0] == at:
                    before[0] -= carry[k]
                out.append(reduced(sums - np.repeat(before, lengths)))
            at, carry = int(keys[-1]), np.array([x[-1] for x in out], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in out]], [*batch.schema.names, *names])

    schema = T.StructType([*laid.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    return laid.mapInArrow(scan, schema)


def ones(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The values that number rows."""
    return [np.ones(batch.num_rows, np.int64)]
