"""Readers: Parquet tables, strict JSON lines, newest filing a ticker, and the release guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELEASE_MARKER = ".release-in-progress"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a fixed schema. A line that is no object fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_errors(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that do not parse, as (path, line, line_text); blank lines are none. Lines count from 1 in their file.

    Files are read whole to number their lines, so this is for files of questions or settings, not for corpora.
    """
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("line_text", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "line_text"))
    rows = files.select("path", (F.col("line") + 1).alias("line"), "line_text", parsed["_corrupt"].alias("bad"))
    return rows.filter("bad IS NOT NULL AND trim(line_text) <> ''").drop("bad")


def required_rows(df: DataFrame, what: str) -> DataFrame:
    """The rows, if there are any."""
    if df.isEmpty():
        raise ValueError(f"{what} holds no rows")
    return df


def newest_filings(files: DataFrame, path: str = "path") -> DataFrame:
    """(ticker, filing_year, path): the newest file a ticker, from paths .../TICKER/YYYY-10-K.*; other names are ignored."""
    found = files.select(
        F.col(path).alias("path"),
        F.regexp_extract(path, r"([^/]+)/(\d{4})-10-K\.[^/]*$", 1).alias("ticker"),
        F.regexp_extract(path, r"([^/]+)/(\d{4})-10-K\.[^/]*$", 2).try_cast("int").alias("filing_year"),
    ).filter("filing_year IS NOT NULL")
    return found.groupBy("ticker").agg(F.max(F.struct("filing_year", "path")).alias("x")).select("ticker", "x.filing_year", "x.path")


def duplicate_tickers(files: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Tickers that more than one file claims."""
    return files.groupBy(ticker).agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def recent_form(submissions: DataFrame, column: str = "recent", form: str = "10-K") -> DataFrame:
    """The first entry of the wanted form in the parallel arrays of a submissions document, as one struct a row."""
    zipped = F.arrays_zip(*[F.col(f"{column}.{f}") for f in ("form", "accessionNumber", "filingDate", "primaryDocument")])
    hits = F.filter(zipped, lambda x: x["form"] == form)
    return submissions.withColumn("newest", F.get(hits, F.lit(0)))


def release_available(spark: SparkSession, folder: str) -> str:
    """The folder, if no release is being written into it; else an error (readers fail closed)."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{folder}/{RELEASE_MARKER}")
    if marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        raise RuntimeError(f"a release is being written to {folder}")
    return folder
