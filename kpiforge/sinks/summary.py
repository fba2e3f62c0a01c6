"""Summary and report writers (SNK1, SNK3, SNK7)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.staging import staged

#: Rows of a section that a nested document holds at most; a larger section lies beside the document.
DOCUMENT_ROWS = 10_000
DOCUMENT = ("department string, sections map<string, array<struct<name: string, key: string, value: variant>>>, "
            "elsewhere map<string, struct<n: long, rows_at: string>>")


def write_summary(summary: DataFrame, root: str) -> None:
    """SNK1: long summary table partitioned by department.

    Dynamic partition overwrite replaces only the departments present in
    ``summary``, so departments can be refreshed independently.
    """
    (summary.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("department").parquet(root))


def write_summary_json(summary: DataFrame, path: str) -> None:
    """SNK1, JSON form: one JSON record per summary row (JSON lines)."""
    summary.write.mode("overwrite").json(path)


def write_summary_documents(summary: DataFrame, root: str, max_rows: int = DOCUMENT_ROWS) -> None:
    """SNK1, nested form: one JSON document per department under ``<root>/documents``.

    ``sections`` holds each section's rows (name, key, value) in the order of name and key, numeric
    keys by their number. Sections of more than ``max_rows`` rows are JSON lines under ``<root>/rows``;
    the document names their folder and row count under ``elsewhere``, so no record grows with the data.
    Nulls stay null, whole numbers lose a trailing ``.0``; a department without rows has no document.
    """
    root = root.rstrip("/")
    rows = staged(summary, "summary-rows")
    sizes = rows.groupBy("department", "section").agg(F.count("*").alias("n"))
    rows = rows.join(sizes, ["department", "section"])
    item = F.struct("name", F.col("key").try_cast("double").alias("number"), "key", "value")
    read = lambda i: F.struct(i["name"].alias("name"), i["key"].alias("key"), F.try_parse_json(i["value"]).alias("value"))
    small = (rows.where(F.col("n") <= max_rows).groupBy("department", "section")
             .agg(F.transform(F.array_sort(F.collect_list(item)), read).alias("items")))
    sections = small.groupBy("department").agg(F.map_from_entries(F.collect_list(F.struct("section", "items"))).alias("sections"))
    place = F.concat(F.lit(f"{root}/rows/department="), "department", F.lit("/section="), "section")
    large = sizes.where(F.col("n") > max_rows)
    elsewhere = large.groupBy("department").agg(F.map_from_entries(F.collect_list(
        F.struct("section", F.struct("n", place.alias("rows_at"))))).alias("elsewhere"))
    documents = sections.join(elsewhere, "department", "full_outer")
    (documents.select("department", F.to_json(F.struct("department", "sections", "elsewhere")).alias("value"))
     .write.mode("overwrite").partitionBy("department").text(f"{root}/documents"))
    if large.limit(1).count():
        (rows.where(F.col("n") > max_rows).drop("n").write.mode("overwrite").partitionBy("department", "section")
         .option("ignoreNullFields", False).json(f"{root}/rows"))


def read_summary_documents(spark: SparkSession, root: str) -> DataFrame:
    """The summary rows that ``write_summary_documents`` wrote, in long form again."""
    root = root.rstrip("/")
    documents = spark.read.text(f"{root}/documents").select(F.from_json("value", DOCUMENT).alias("d"))
    rows = (documents.select("d.department", F.explode("d.sections").alias("section", "items"))
            .select("department", "section", F.inline("items"))
            .select("department", "section", "name", "key", F.to_json("value").alias("value")))
    try:
        beside = spark.read.schema("department string, section string, name string, key string, value string").json(f"{root}/rows")
    except AnalysisException:
        return rows
    return rows.unionByName(beside.select(*rows.columns))


def metric_values(summary: DataFrame, department: str) -> DataFrame:
    """(metric, v) of a department's metrics section; metrics without a value are left out."""
    return (summary.where((F.col("department") == department) & (F.col("section") == "metrics"))
            .select(F.explode(F.from_json("value", "map<string,string>")).alias("metric", "v")))


def metrics_report(summary: DataFrame, department: str) -> DataFrame:
    """SNK3 table: the department's metrics flattened to one row of text columns."""
    return metric_values(summary, department).groupBy().pivot("metric").agg(F.first("v"))


def download_report(summary: DataFrame, department: str, path: str, fmt: str = "csv") -> str:
    """SNK3: ``csv`` writes the one-row metrics CSV; ``pdf`` is not implemented."""
    if fmt == "csv":
        metrics_report(summary, department).coalesce(1).write.mode("overwrite") \
            .option("header", True).csv(path)
        return path
    if fmt == "pdf":
        raise NotImplementedError("PDF export not implemented")
    raise ValueError(f"invalid format {fmt!r}")


def hr_report_tables(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK7: sheet 1 = HR metrics; sheet 2 = insights and recommendations side by side.

    Both lists are numbered by their key; a full outer join on the position
    zips them like two columns of unequal length.
    """
    hr = summary.where(F.col("department") == "hr")
    metrics = metrics_report(summary, "hr")
    ins = (hr.where(F.col("section") == "insights")
           .select(F.col("key").cast("int").alias("position"), F.col("value").alias("insight")))
    rec = (hr.where(F.col("section") == "recommendations")
           .select(F.col("key").cast("int").alias("position"),
                   F.col("value").alias("recommendation")))
    return metrics, ins.join(rec, "position", "full_outer")
