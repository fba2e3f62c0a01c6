"""Streaming intake: department CSVs dropped in a folder -> partitioned Parquet.

The batch intake (``sources.intake``) as a Structured Streaming query: a
file source with the department schema (streams need one up front), the
department taken from the sub-folder name, written exactly once per file
to Parquet partitioned by ``upload_department``. Progress lives in the given
checkpoint folder, so a restarted job with the same folder resumes. Files whose
header isn't the department's, in its order, fail the query.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kpiforge.schemas import DATASET_TYPES, csv_schema


def start_intake(spark: SparkSession, inbox: str, dataset_type: str, target: str,
                 checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Watch ``inbox/<department>/*.csv``; append rows to ``target``."""
    schema = csv_schema(DATASET_TYPES[dataset_type])
    stream = (spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"')
              .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", False)
              .csv(f"{inbox.rstrip('/')}/*"))
    dept = F.element_at(F.split(F.input_file_name(), "/"), -2)
    out = stream.withColumn("upload_department", dept)
    writer = (out.writeStream.format("parquet").partitionBy("upload_department")
              .option("checkpointLocation", checkpoint)
              .option("path", target))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="30 seconds")
    return writer.start()
