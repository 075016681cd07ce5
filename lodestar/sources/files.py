"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: str = ",", lines: str = "\n", quote: str = "'", header: bool = False) -> DataFrame:
    """A file of separated values; by default commas, one line a row, single quotes."""
    return spark.read.csv(path, schema=schema, sep=columns, lineSep=lines, quote=quote, header=header)


def export_csv(df: DataFrame, path: str, columns: str = ",", quote: str = '"') -> None:
    df.write.csv(path, sep=columns, quote=quote, header=True)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """A column ``sql`` with an INSERT statement for each row."""
    def literal(c: str) -> Column:
        text = F.col(c).cast("string")
        kind = df.schema[c].dataType
        plain = isinstance(kind, (T.NumericType, T.BooleanType))
        return F.coalesce(text if plain else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))

    names = ", ".join(df.columns)
    return df.select(F.concat(F.lit(f"insert into {table} ({names}) values ("), F.concat_ws(", ", *[literal(c) for c in df.columns]), F.lit(");")).alias("sql"))


def export_sql(df: DataFrame, path: str, table: str) -> None:
    insert_statements(df, table).write.text(path)


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """Files as rows: fpath, time, size, sizemb, sizegb, md5 and content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return files.select(
        F.col("path").alias("fpath"), F.col("modificationTime").alias("time"), F.col("length").alias("size"),
        (F.col("length") / 1e6).alias("sizemb"), (F.col("length") / 1e9).alias("sizegb"), F.md5("content").alias("md5"), "content",
    )


def with_files(rows: DataFrame, column: str, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """Rows whose ``column`` names files below a path, with the files' attributes and contents; null where there is none."""
    found = read_files(rows.sparkSession, path, pattern, recursive).drop("md5")
    return rows.join(found.withColumnRenamed("fpath", column), column, "left")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of another database, read in parts of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()



def read_geojson(df: DataFrame, col: str) -> DataFrame:
    """GeoJSON text to ``geom`` (see lodestar.functions.geometry)."""
    from lodestar.functions.geometry import from_geojson

    return df.withColumn("geom", from_geojson(col))
