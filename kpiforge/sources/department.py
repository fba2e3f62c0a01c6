"""Department datasets from CSV or Parquet (SRC1, SRC6).

CSV is read with an explicit schema (no inference pass over the data);
headers are mapped to roles. Only roles that exist are selected, so a
partial sales file (the reference ships one) simply lacks those roles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegerType

from kpiforge.functions.dates import parse_dmy
from kpiforge.operators.derive import yes_no_to_int
from kpiforge.schemas import DEPARTMENTS, role_names
from kpiforge.sources.binding import TableSource
from kpiforge.sources.intake import read_uploads


def read_department_csv(spark: SparkSession, department: str, path: str,
                        null_values: str | None = None) -> DataFrame:
    """Headered CSV (quoted commas allowed) -> DataFrame with role columns.

    Every column is read as text (no schema-inference pass over the data)
    and cast with ``try_cast`` to the department schema, so a malformed
    value becomes null instead of failing the job. ``null_values``: text to
    read as null (e.g. ``"None"``); by default ``None`` stays a value (Q8).
    """
    reader = (spark.read.option("header", True).option("escape", '"')
              .option("mode", "PERMISSIVE"))
    if null_values is not None:
        reader = reader.option("nullValue", null_values)
    raw = reader.csv(path)
    types = {h: t for h, t, _ in DEPARTMENTS[department]}
    typed = raw.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types
                         else F.col(f"`{c}`") for c in raw.columns])
    return to_roles(typed, department)


def to_roles(df: DataFrame, department: str) -> DataFrame:
    """Rename header columns to roles and add derived role columns."""
    names = role_names(department)
    out = df.select(*[F.col(f"`{c}`").alias(names[c]) for c in df.columns if c in names])
    if department == "hr":
        if "date_hired" in out.columns:
            out = out.withColumn("hired", parse_dmy("date_hired"))
        if "resigned_text" in out.columns:
            out = out.withColumn("resigned", yes_no_to_int("resigned_text"))
    return out


def read_department(spark: SparkSession, department: str, path: str,
                    fmt: str = "csv", **options) -> TableSource:
    """SRC1: a department source for the packs, from CSV, Parquet, or the committed uploads under an intake root."""
    if fmt == "csv":
        df = read_department_csv(spark, department, path, **options)
    elif fmt == "parquet":
        df = to_roles(spark.read.parquet(path), department)
    elif fmt == "uploads":
        df = to_roles(read_uploads(spark, path, department), department)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return TableSource(df, optional_roles(department))


def optional_roles(department: str) -> dict[str, DataType]:
    """Every role of a department with its type (derived roles included)."""
    roles: dict[str, DataType] = {r: t for _, t, r in DEPARTMENTS[department]}
    if department == "hr":
        roles |= {"hired": DateType(), "resigned": IntegerType()}
    return roles


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC6: full scan of an operational table."""
    return spark.read.format(fmt).load(path)
