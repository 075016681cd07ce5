"""Changes of tables: inserts, updates and deletes as DataFrames.

A table is a DataFrame with key columns.  Each operation returns the new table;
writing it is the caller's choice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class TableSpec:
    """What a table declares beyond its schema."""

    keys: list[str]
    append_only: bool = False
    defaults: dict[str, object] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)


#: Column types by the names that table declarations use.
TYPES: dict[str, T.DataType] = (
    {n: T.StringType() for n in ("char", "varchar", "varchar2", "string", "text", "blob", "clob", "tinytext", "mediumtext", "longtext", "uuid", "file", "enum")}
    | {n: T.BooleanType() for n in ("boolean", "bool", "bit")}
    | {"tinyint": T.ByteType(), "smallint": T.ShortType(), "mediumint": T.IntegerType()}
    | {n: T.LongType() for n in ("int", "integer", "bigint", "time", "timenano")}
    | {"float": T.FloatType(), "longdouble": T.DecimalType(38, 5), "date": T.DateType()}
    | {n: T.DoubleType() for n in ("double", "numeric", "decimal", "real")}
    | {n + s: T.TimestampType() for n in ("datetime", "timestamp") for s in ("", "sec", "mill", "nano")}
    | {"vector": T.ArrayType(T.DoubleType())}
)


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    """A schema of (name, type name); ``range(t)`` is a struct of begin and end."""
    out = T.StructType()
    for name, kind in columns:
        kind = kind.strip().lower()
        if kind.startswith("range"):
            inner = TYPES[kind[kind.index("(") + 1 : kind.rindex(")")].strip() if "(" in kind else "bigint"]
            out.add(name.lower(), T.StructType().add("begin", inner).add("end", inner))
        else:
            out.add(name.lower(), TYPES[kind.split("(")[0].strip()])
    return out


def with_defaults(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Missing columns added and nulls filled from the defaults; a key column that is missing altogether is a uuid."""
    for c, v in spec.defaults.items():
        value = v if isinstance(v, Column) else F.lit(v)
        df = df.withColumn(c, F.coalesce(F.col(c), value) if c in df.columns else value)
    if not spec.keys and "_id" not in df.columns:
        df = df.withColumn("_id", F.expr("uuid()"))
    for c, values in spec.enums.items():
        df = df.where(F.col(c).isin(values))
    return df


def insert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new are added; of rows with one key the first in the order of all columns is."""
    rows = rows.select(*table.columns)
    order = Window.partitionBy(*keys).orderBy(*[c for c in table.columns if c not in keys] or keys)
    fresh = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return table.unionByName(fresh.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows take the place of those with their key; of several, the one of the highest version."""
    rows = rows.select(*table.columns)
    order = Window.partitionBy(*keys).orderBy(F.desc(version) if version else F.lit(1), *[F.desc(c) for c in table.columns if c not in keys])
    latest = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return table.join(latest.select(*keys), keys, "left_anti").select(*table.columns).unionByName(latest)


def insert_values(table: DataFrame, values: list[tuple], keys: list[str]) -> DataFrame:
    """Literal rows, in the order of the table's columns; of those with one key the first is taken."""
    rows = table.sparkSession.createDataFrame([(*v, i) for i, v in enumerate(values)], T.StructType([*table.schema.fields, T.StructField("__order", T.IntegerType())]))
    first = rows.groupBy(*keys).agg(*[F.min_by(c, "__order").alias(c) for c in table.columns if c not in keys])
    return insert(table, first, keys)


def apply_changes(table: DataFrame, log: DataFrame, keys: list[str], order: str, op: str) -> DataFrame:
    """The table after a log of changes: for each key the last one by ``order`` counts, a "delete" takes the row away."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    latest = log.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    kept = table.join(latest.select(*keys), keys, "left_anti").select(*table.columns)
    return kept.unionByName(latest.where(F.col(op) != "delete").select(*table.columns))


def update(table: DataFrame, spec: TableSpec, where: Column, **values) -> DataFrame:
    """Sets value columns of the rows that meet the condition."""
    if spec.append_only:
        raise ValueError("the table is append-only")
    if set(values) & set(spec.keys):
        raise ValueError("key columns can't be changed")
    hit = F.coalesce(where, F.lit(False))
    changed = {c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()}
    return table.withColumns(changed)


def delete(table: DataFrame, spec: TableSpec, where: Column) -> DataFrame:
    if spec.append_only:
        raise ValueError("the table is append-only")
    return table.where(~F.coalesce(where, F.lit(False)))


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def index_view(table: DataFrame, columns: list[str], ordered: bool = True) -> DataFrame:
    """An index: its columns only, in their order; not ordered for counts and groups, which need no sort."""
    view = table.select(*columns)
    return view.orderBy(*columns) if ordered else view


def add_column(table: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    return table.withColumn(name, F.lit(default).cast(TYPES[kind]))


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumnRenamed(old, new)
