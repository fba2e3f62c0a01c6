"""Tables written to the shared checkpoint folder, to cut lineage and to fix what is computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.session import ensure_checkpoint_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the folder that all executors share, and read it again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A staged table marked for broadcast if it has at most ``max_rows`` rows (counted from the footers)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
