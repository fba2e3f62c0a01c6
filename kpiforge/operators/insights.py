"""Static recommendation lists (ALL1) as one constant dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the reference: recommendation texts per department.
# Records are (title, description, priority, expected_impact, implementation_time);
# departments whose reference lists plain strings have only a description.
RECOMMENDATIONS: dict[str, list[tuple[str | None, str, str | None, str | None, str | None]]] = {
    "hr": [
        ("Performance Optimization",
         "Implement targeted training programs for underperforming employees",
         "High", "Improve average performance by 15%", "2-3 months"),
        ("Resource Allocation",
         "Optimize resource allocation based on performance clusters",
         "Medium", "Increase efficiency by 10%", "1-2 months"),
    ],
    "it": [
        (None, "Implement automated ticket routing based on system and issue type", None, None, None),
        (None, "Develop self-service portal for common issues", None, None, None),
        (None, "Enhance knowledge base with frequently asked questions", None, None, None),
    ],
    "production": [
        (None, "Implement lean manufacturing principles across all production lines", None, None, None),
        (None, "Develop standardized operating procedures for common operations", None, None, None),
        (None, "Enhance quality control measures and training programs", None, None, None),
        (None, "Optimize shift scheduling based on performance metrics", None, None, None),
    ],
    "sales": [
        (None, "Focus marketing efforts on top-performing products and regions.", None, None, None),
        (None, "Provide incentives for high-performing sales staff.", None, None, None),
        (None, "Analyze underperforming products for improvement opportunities.", None, None, None),
        (None, "Monitor monthly trends to adjust sales strategies.", None, None, None),
    ],
    "transport": [
        ("Optimize Route Planning",
         "Implement AI-based route optimization to reduce delivery times.",
         "High", "Reduce delivery time by 15%", "1 month"),
        ("Enhance Maintenance Schedule",
         "Implement predictive maintenance based on vehicle performance data.",
         "High", "Reduce incidents by 30%", "2-3 weeks"),
        ("Driver Training Program",
         "Develop comprehensive driver training program focusing on safety and efficiency.",
         "Medium", "Improve on-time rate by 20%", "2 months"),
    ],
    "marketing": [
        ("Optimize Campaign Strategy",
         "Implement data-driven campaign optimization based on performance metrics.",
         "High", "Increase conversion rate by 20%", "1 month"),
        ("Enhance Channel Mix",
         "Reallocate budget to high-performing channels and optimize underperforming ones.",
         "High", "Reduce acquisition cost by 15%", "2-3 weeks"),
        ("Customer Segmentation",
         "Develop targeted campaigns based on customer segments and behavior.",
         "Medium", "Improve ROI by 25%", "2 months"),
    ],
}

SCHEMA = ("department string, idx int, title string, description string, priority string, "
          "expected_impact string, implementation_time string")


def recommendations(spark: SparkSession, department: str | None = None) -> DataFrame:
    """ALL1: the constant recommendation table (optionally one department)."""
    rows = [(d, i + 1, *rec) for d, recs in RECOMMENDATIONS.items()
            if department in (None, d) for i, rec in enumerate(recs)]
    return spark.createDataFrame(rows, SCHEMA)
