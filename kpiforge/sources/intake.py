"""Dataset intake (SRC5): validate, store by department, commit to a manifest, record audit.

Connects upload to analysis. An upload is known by its content (an order-independent fingerprint of
its rows and header), dataset type and department. Its rows land as Parquet in a folder of its own,
``<root>/datasets/<dataset_type>/upload=<id>``, partitioned by ``upload_department`` (beside any
``Department`` of the file); rows with a value that doesn't fit its type go to
``<root>/rejects/upload=<id>`` with the raw record and the reason.

The last step appends one row to ``<root>/manifest``: a single file, moved into place whole. That
row is the commit. ``read_uploads`` shows committed uploads only, so a run that dies earlier leaves
nothing visible, a retry overwrites what it left, and a file sent again is stored once.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.schemas import DATASET_TYPES, DEPARTMENTS
from kpiforge.sinks.files import append_audit

MANIFEST_SCHEMA = ("filename string, dataset_type string, department string, user_id int, "
                   "accepted long, rejected long, upload string")
STORED_MANIFEST = MANIFEST_SCHEMA + ", upload_timestamp timestamp"
PARTITION = "upload_department"


class IntakeError(ValueError):
    pass


def validate(filename: str, dataset_type: str, department: str | None) -> None:
    ext = filename.rsplit(".", 1)[-1].lower() if "." in filename else ""
    if ext != "csv":
        raise IntakeError("only .csv files are accepted")
    if dataset_type not in DATASET_TYPES:
        raise IntakeError(f"unknown dataset type {dataset_type!r}")
    if not department:
        raise IntakeError("department is required")


def fingerprint(raw: DataFrame) -> str:
    """A digest of a frame's header and rows, whatever their order or partitions."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns], *[F.col(f"`{c}`").isNull() for c in raw.columns])
    row = raw.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return hashlib.sha256(repr((raw.columns, row.n, str(row.s), row.x)).encode()).hexdigest()


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The committed uploads; none if nothing was ever committed."""
    try:
        return spark.read.schema(STORED_MANIFEST).parquet(f"{root.rstrip('/')}/manifest").dropDuplicates(["upload"])
    except AnalysisException:
        return spark.createDataFrame([], STORED_MANIFEST)


def read_uploads(spark: SparkSession, root: str, dataset_type: str) -> DataFrame:
    """Rows of all committed uploads of a type, with ``upload`` and ``upload_department``."""
    done = read_manifest(spark, root).where(F.col("dataset_type") == dataset_type)
    paths = [f"{root.rstrip('/')}/datasets/{dataset_type}/upload={r.upload}" for r in done.select("upload").collect()]   # a row per file
    if not paths:
        raise IntakeError(f"no committed upload of type {dataset_type!r}")
    return spark.read.option("basePath", f"{root.rstrip('/')}/datasets/{dataset_type}").option("mergeSchema", True).parquet(*paths)


def ingest_dataset(spark: SparkSession, path: str, dataset_type: str, department: str,
                   root: str, user_id: int | None = None) -> DataFrame:
    """Store one uploaded CSV once; returns the department's committed rows (lazy re-read)."""
    root, filename = root.rstrip("/"), os.path.basename(path.rstrip("/"))
    validate(filename, dataset_type, department)
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    upload = "u" + hashlib.sha256(f"{fingerprint(raw)}|{dataset_type}|{department}".encode()).hexdigest()[:31]
    details = f"{dataset_type}:{filename}:{department}:{upload}"
    if read_manifest(spark, root).where(F.col("upload") == upload).isEmpty():
        accepted, rejected = _store(raw, filename, dataset_type, department, root, upload)
        _commit(spark, root, (filename, dataset_type, department, user_id, accepted, rejected, upload))
        append_audit(spark, f"{root}/audit", user_id, "upload_dataset", details)
    else:
        append_audit(spark, f"{root}/audit", user_id, "upload_repeated", details)
    return read_uploads(spark, root, dataset_type).where(F.col(PARTITION) == department)


def _store(raw: DataFrame, filename: str, dataset_type: str, department: str, root: str, upload: str) -> tuple[int, int]:
    """Write an upload's rows and rejects into folders of its own, replacing what a dead run left; (accepted, rejected)."""
    typed, rejects = split_rejects(raw, DATASET_TYPES[dataset_type])
    target = f"{root}/datasets/{dataset_type}/upload={upload}"
    typed.withColumn(PARTITION, F.lit(department)).write.mode("overwrite").partitionBy(PARTITION).parquet(target)
    (rejects.select(F.lit(filename).alias("filename"), F.lit(dataset_type).alias("dataset_type"),
                    F.lit(department).alias(PARTITION), "record", "reason")
            .write.mode("overwrite").parquet(f"{root}/rejects/upload={upload}"))
    rejected = rejects.count()
    return raw.count() - rejected, rejected


def _commit(spark: SparkSession, root: str, row: tuple) -> None:
    """Make an upload visible: one row, one file."""
    (spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).withColumn("upload_timestamp", F.current_timestamp())
          .write.mode("append").parquet(f"{root}/manifest"))


def split_rejects(raw: DataFrame, shape: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows as ``record`` JSON with ``reason``) of a text frame."""
    types = {h: t for h, t, _ in DEPARTMENTS[shape]}
    cast = {c: F.col(f"`{c}`").try_cast(types[c]) for c in raw.columns if c in types}
    wrong = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull() & v.isNull(), F.lit(f"{c}: not a {types[c].simpleString()}"))
                               for c, v in cast.items()]) if cast else F.array().cast("array<string>"),
                     lambda x: x.isNotNull())
    marked = raw.select(*[F.col(f"`{c}`") for c in raw.columns], wrong.alias("_wrong"))
    good = marked.where(F.size("_wrong") == 0).select(*[cast[c].alias(c) if c in cast else F.col(f"`{c}`")
                                                        for c in raw.columns])
    bad = marked.where(F.size("_wrong") > 0).select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])).alias("record"),
        F.array_join("_wrong", "; ").alias("reason"))
    return good, bad
