"""Store of fitted models (SNK8): a model is fitted once and reused by every job that scores with it (ML15, ML16).

A model's key is a digest of its name, its parameters (seed included) and the content of the rows
it is fitted on: an order-independent fingerprint, so partitions and row order don't matter, while
any changed, missing or added row gives another key and a new fit.

A fit is saved to a folder of its own. The last step appends one row to ``<root>/log``: a single
file, moved into place whole. That row is the commit: a run that dies earlier leaves nothing
visible. Of two runs that fit the same key at once, the first commit is what readers load.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import ensure_checkpoint_dir
from kpiforge.sinks.models import load_model, save_model
from kpiforge.sources.intake import fingerprint

LOG = "key string, name string, params string, path string"
STORED_LOG = LOG + ", fitted_at timestamp"


class ModelStore:
    """Models under ``root``; by default a folder beside the job's other shared data."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/models").rstrip("/")

    def log(self) -> DataFrame:
        """The committed fits; none if nothing was ever committed."""
        try:
            return self.spark.read.schema(STORED_LOG).parquet(f"{self.root}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], STORED_LOG)

    @staticmethod
    def key(name: str, rows: DataFrame, params: Mapping[str, Any]) -> str:
        types = [(f.name, f.dataType.simpleString()) for f in rows.schema]
        said = json.dumps([name, types, dict(params)], sort_keys=True)
        return hashlib.sha256(f"{said}|{fingerprint(rows)}".encode()).hexdigest()

    def find(self, key: str) -> str | None:
        """Where the first committed fit of a key lies."""
        first = self.log().where(F.col("key") == key).orderBy("fitted_at", "path").select("path").first()
        return first.path if first else None

    def fit_once(self, name: str, rows: DataFrame, params: Mapping[str, Any], fit: Callable[[], Any],
                 save: Callable[[Any, str], None] = save_model, load: Callable[[str], Any] = load_model) -> tuple[Any, bool]:
        """(model, whether it was reused). ``rows`` and ``params`` must hold all that ``fit`` depends on.

        Leave columns that are computed from averages out of ``rows``: their last digits depend on the
        order of additions, so the same data would be fitted again. Give what they are computed from.
        """
        key = self.key(name, rows, params)
        path = self.find(key)
        if path:
            return load(path), True
        path = f"{self.root}/{name}/{key[:16]}-{uuid.uuid4().hex}"
        save(fit(), path)
        (self.spark.createDataFrame([(key, name, json.dumps(dict(params), sort_keys=True), path)], LOG).coalesce(1)
             .withColumn("fitted_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/log"))
        return load(self.find(key)), False
