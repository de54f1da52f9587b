"""Tables, delimited text and generated rows as DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views of the tables: a later spark.sql() binds to this folder."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def stored_query(spark: SparkSession, sql: str, name: str | None = None) -> DataFrame:
    """CREATE TABLE ... AS: the rows of a query as a Parquet table of the session's catalogue, in the shared folder if the session names one."""
    name = name or f"stored_{uuid.uuid4().hex}"
    folder = spark.conf.get("spark.checkpoint.dir", None)
    at = f"LOCATION '{folder.rstrip('/')}/{name}'" if folder else ""
    spark.sql(f"CREATE TABLE {name} USING parquet {at} AS {sql}")
    return spark.table(name)


def csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False, columns: int | None = None) -> DataFrame:
    """A CSV file; without a header or schema the columns are c0, c1, ... as strings."""
    df = spark.read.csv(path, schema=schema, header=header)
    if not schema and not header:
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return df.select(*df.columns[:columns]) if columns else df


def copy_from(spark: SparkSession, path: str, schema: str, delimiter: str = "\t", null: str = "\\N", header: bool = False) -> DataFrame:
    """Delimited text as COPY reads it: a line `\\.` ends the data, and the null string is read as null."""
    df = spark.read.csv(path, schema=schema, sep=delimiter, nullValue=null, header=header, quote="", emptyValue="")
    first = df.columns[0]
    return df.filter(F.col(first).isNull() | (F.col(first).cast("string") != "\\."))


def series(start: Column, stop: Column, step: Column) -> Column:
    """Numbers from start to stop; step 0 counts as 1, a step away from stop gives none."""
    by = F.when(step == 0, F.lit(1)).otherwise(step).cast("long")
    fits = F.when(by > 0, start <= stop).otherwise(start >= stop)
    return F.when(fits, F.sequence(start.cast("long"), stop.cast("long"), by)).otherwise(F.array().cast("array<bigint>"))
