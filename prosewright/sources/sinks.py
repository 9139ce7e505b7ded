"""Where results go: text, JSON lines, append-only ledgers, cached tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(findings: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Findings as JSON lines or as lines of text, through Spark's own commit."""
    if kind == "jsonl":
        findings.write.mode("overwrite").json(path)
    elif kind == "text":
        line = F.concat_ws(":", F.col("doc_key").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), "severity", "kind", "match")
        findings.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown report: {kind}")


def exit_status(findings: DataFrame, strict: bool = True) -> int:
    """1 if there is an error and the check is strict."""
    return int(strict and not findings.where("severity = 'err'").isEmpty())


def append_rows(rows: DataFrame, ledger: str, fallback: str) -> bool:
    """Appends to the ledger, or to the fallback if that fails; true if the ledger took them."""
    try:
        rows.write.mode("append").json(ledger)
        return True
    except Exception:  # the ledger's store may be read-only or away
        rows.write.mode("append").json(fallback)
        return False


def read_ledger(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """All rows of the ledger's files, each once; lines that are no JSON are left out."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(list(paths))
    return rows.where("_broken IS NULL").drop("_broken").distinct()


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written first if it is not there or has recorded an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        found = spark.read.parquet(path)
        if "error" not in found.columns or found.where("error IS NOT NULL").isEmpty():
            return found
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
