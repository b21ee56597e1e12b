"""Reading and writing tables by the suffix of their path."""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetrail.functions.text import clean_cell, tokens
from gazetrail.sources import xlsx

DELIMITERS = {".csv": ",", ".tsv": "\t"}


def suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sheet: str = "0", infer: bool = True) -> DataFrame:
    """A Parquet, CSV, TSV or Excel table.  Without a schema, delimited cells are numbers and truth values where all of a
    column are (one more reading of the file), or strings if not `infer`; Excel cells are strings."""
    kind = suffix(path)
    if kind == ".parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if kind in DELIMITERS:
        reader = spark.read.option("header", True).option("sep", DELIMITERS[kind])
        if infer and not schema:  # dates stay as they are written
            found = reader.option("inferSchema", True).csv(path).schema
            plain = (T.NumericType, T.BooleanType)
            schema = T.StructType([f if isinstance(f.dataType, plain) else T.StructField(f.name, T.StringType()) for f in found])
        return (reader.schema(schema) if schema else reader).csv(path)
    if kind in (".xlsx", ".xlsm"):
        xlsx.register(spark)
        out = spark.read.format("xlsx").option("sheet", sheet).load(path)
        if schema:
            fields = (spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema).fields
            out = out.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields))
        return out
    raise ValueError(f"no reader for {kind or 'a path without a suffix'}: {path}")


def write(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int | None = None) -> None:
    """To Parquet, CSV or TSV; missing parents are made."""
    kind, writer = suffix(path), df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if kind == ".parquet":
        writer.parquet(path)
    elif kind in DELIMITERS:
        writer.option("header", True).option("sep", DELIMITERS[kind]).csv(path)
    else:
        raise ValueError(f"no writer for {kind or 'a path without a suffix'}: {path}")


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small file, in any file system that Spark writes to; an existing one is replaced."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def csv_text(df: DataFrame) -> str:
    """A table of a few rows as delimited text; nulls are empty."""
    out = io.StringIO()
    lines = csv.writer(out, lineterminator="\n")
    lines.writerow(df.columns)
    lines.writerows(["" if x is None else x for x in r] for r in df.collect())
    return out.getvalue()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(words): the words of each line that has any."""
    return spark.read.text(path).select(tokens(F.col("value")).alias("words")).filter(F.size("words") > 0)


def inspect(df: DataFrame, rows: int = 5) -> tuple[list[tuple[int, str]], DataFrame]:
    """Numbered column names, and the first rows."""
    return list(enumerate(df.columns)), df.limit(rows)


def clean_headers(df: DataFrame) -> DataFrame:
    """Headers without white space around them; two alike are an error."""
    names = [str(c).strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"headers repeat: {names}")
    return df.toDF(*names)


def ingest(spark: SparkSession, source: str, target: str, sheet: str = "DATA", rows_per_file: int = 50_000) -> bool:
    """A workbook's sheet as an all-string Parquet table in which a dot is missing; an existing one is replaced, an empty
    sheet leaves none.  Returns whether there were rows."""
    from pyspark.errors import AnalysisException

    df = clean_headers(read(spark, source, sheet=sheet))
    df = df.select(*(clean_cell(F.col(f"`{c}`")).alias(c) for c in df.columns))
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(target)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    if df.limit(1).count() == 0:
        return False
    try:
        write(df, target, rows_per_file=rows_per_file)
    except AnalysisException as e:
        raise ValueError(f"cannot store {source}") from e
    return True


def result_files(spark: SparkSession, folder: str, pattern: str = "*_model_comparison.csv") -> DataFrame:
    """All comparison tables of a folder, with the file each row is from."""
    return spark.read.option("header", True).option("inferSchema", False).csv(f"{folder}/{pattern}").withColumn("source_file", F.input_file_name())
