"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import ensure_checkpoint_dir

WORD = re.compile(r"\w+")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if any(f.startswith("kpiforge-") for f in context._python_includes):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"kpiforge-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: In a Python worker: caches that outlive a task, by name.
KEPT: dict[str, dict] = {}


def release(keep: str | None = None) -> None:
    """Empty the worker's caches but ``keep``'s, so that one operator's don't weigh on the next."""
    for name, cache in KEPT.items():
        if name != keep:
            cache.clear()


def per_batch(df: DataFrame, run, schema: str, keep: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    ship_package(df.sparkSession)

    def task(batches):
        release(keep)
        yield from run(batches)

    return df.mapInArrow(task, schema)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` rows, else ``df`` itself.

    Call it on staged tables only: the count then comes from the Parquet footers.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def packed(df: DataFrame, **columns) -> DataFrame:
    """``df``'s row as one struct ``row`` beside the named columns.

    The operators compute under their own names, so columns of the input may be
    called anything; ``unpacked`` gives the input's columns back.
    """
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
                     *(c.alias(k) for k, c in columns.items()))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def words(text: str | None) -> list[str]:
    """Lower-case words (letters, digits, underscore) of a whole text; null has none."""
    return WORD.findall(text.lower()) if text else []
