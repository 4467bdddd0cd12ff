"""Delimited, zipped, workbook and Parquet tables, as text columns with their input order."""

from __future__ import annotations

import csv
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.sources import archives, delimited
from portolan.sources.archives import MISSING, named

ORDER = "_ord"


def _delimited(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    rows, sep = delimited.records(spark, path, suffix)
    names = named(delimited.header(rows, sep))
    if not names:
        raise ValueError(f"the table has no header: {path}")
    body = delimited.cells(rows.where("no > 0"), sep, len(names))
    cell = lambda i: F.when(~F.col(f"c{i}").isin(*MISSING), F.col(f"c{i}"))
    return body.select((F.col("no") - 1).alias(ORDER), *[cell(i).alias(n) for i, n in enumerate(names)])


def read_table(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """All columns as text, missing cells NULL, and _ord, which puts the rows in input order. Of a workbook the active sheet, of an archive the
    member of that name or pattern. A Parquet table needs its own order column _ord, or gets one from its scan."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".tsv", ".txt"):
        return _delimited(spark, path, suffix)
    if suffix in (".zip", ".xlsx", ".xls"):
        return archives.read(spark, path, member)
    if suffix == ".parquet":
        df = spark.read.parquet(path)
        text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c != ORDER else F.col(c) for c in df.columns])
        return text if ORDER in df.columns else delimited.numbered(text, ORDER)
    raise ValueError(f"unsupported table format: {suffix or path}")


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header, for small tables whose readers want just that. Rows stream to the driver a partition at a time, in their
    order; `write_csv_parts` is for all others."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if x is None else x for x in row])
    return path


def write_csv_parts(df: DataFrame, path: str) -> str:
    """A folder of CSV files, each with a header, written where the rows are; in the order of their names they have df's order."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, by Spark's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
