"""HR pack (HR1-HR6, PRJ5, PRJ10, PRJ11, ALL2).

Roles: employee_id, department, position, salary, performance,
training_hours, leave_days, overtime_hours, resigned (0/1). KPIs use raw
columns (Q1) and original strings (Q2); scaling lives in the ML path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions import days_since, fmt_date
from kpiforge.operators.aggregate import value_counts_multi
from kpiforge.operators.derive import flag_low_high, recommended_split, total_active_time
from kpiforge.operators.topk import top_n
from kpiforge.plans.common import MEAN_DIGITS, rmean


def _active():
    return total_active_time("training_hours", "overtime_hours", "leave_days")


# Fixed value: as-of date of the reference's days-since-hired artifact.
AS_OF = "2025-05-20"


def days_since_hired(src, as_of: str = AS_OF) -> DataFrame:
    """PRJ15: days from the hire date to ``as_of`` per employee."""
    df = src.frame("employee_id", "hired")
    return df.select("employee_id", fmt_date("hired").alias("hired"),
                     days_since("hired", as_of).alias("days_since_hired"))


def metrics(src) -> DataFrame:
    """HR1: employees, mean active time, mean training hours, mean performance."""
    df = src.frame("training_hours", "overtime_hours", "leave_days", "performance")
    return df.agg(F.count(F.lit(1)).alias("total_employees"),
                  rmean(_active()).alias("avg_tenure"),
                  rmean("training_hours").alias("training_completion"),
                  rmean("performance").alias("satisfaction_score"))


def distributions(src) -> DataFrame:
    """HR2: counts by department and by performance score."""
    df = src.frame("department", "performance")
    return value_counts_multi(df, {"departments": "department", "performance": "performance"})


def department_insights(src) -> DataFrame:
    """HR3: per department mean performance and attrition rate."""
    df = src.frame("department", "performance", "resigned")
    return (df.where(F.col("department").isNotNull()).groupBy("department")
              .agg(rmean("performance").alias("avg_performance"),
                   rmean("resigned").alias("attrition_rate")))


def top_performers(src, n: int = 5) -> DataFrame:
    """HR4: the ``n`` best performers; ties by employee id."""
    df = src.frame("employee_id", "department", "position", "performance")
    return (top_n(df, "performance", n, tie=["employee_id"])
            .select("employee_id", "department", "position",
                    F.col("performance").cast("double").alias("performance_score")))


def training_recommendations(src) -> DataFrame:
    """HR5 / PRJ10: below-mean performance and above-mean leave."""
    df = src.frame("employee_id", "department", "position", "performance", "training_hours",
                   "leave_days")
    flagged = flag_low_high(df, "performance", "leave_days", "recommend")
    return (flagged.where("recommend")
            .select("employee_id", "department", "position",
                    F.col("performance").cast("double").alias("performance_score"),
                    F.col("training_hours").cast("double").alias("training_hours")))


def recommendation_split(src) -> DataFrame:
    """PRJ11: recommended vs the rest."""
    df = src.frame("performance", "leave_days")
    return recommended_split(flag_low_high(df, "performance", "leave_days", "recommend"),
                             "recommend")


def training_effectiveness(src) -> DataFrame:
    """HR6: corr(training hours, mean performance per training-hours value) (Q3)."""
    df = src.frame("training_hours", "performance")
    per_hours = df.groupBy("training_hours").agg(F.avg("performance").alias("mp"))
    return per_hours.agg(F.round(F.corr(F.col("training_hours").cast("double"), "mp"),
                                 MEAN_DIGITS).alias("effectiveness"))


def insight_records(src) -> DataFrame:
    """ALL2: performance and training insight records."""
    df = src.frame("training_hours", "performance")
    per_hours = df.groupBy("training_hours").agg(F.avg("performance").alias("mp"))
    eff = per_hours.agg(F.corr(F.col("training_hours").cast("double"), "mp")).scalar()
    base = df.agg(F.avg("performance").alias("p"))
    rows = [
        ("Performance Analysis", F.format_string("Average performance score is %.2f", F.bround("p", 2)),
         "High", "Stable"),
        ("Training Impact", F.format_string("Training effectiveness correlation: %.2f", F.bround(eff, 2)),
         "Medium", "Improving"),
    ]
    structs = [F.struct(F.lit(i + 1).alias("idx"), F.lit(t).alias("title"),
                        d.alias("description"), F.lit(imp).alias("impact"),
                        F.lit(tr).alias("trend"))
               for i, (t, d, imp, tr) in enumerate(rows)]
    return base.select(F.inline(F.array(*structs)))
