"""Query catalog: every registered query reads the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``oracle_sql.SQL[name]`` is
the DuckDB equivalent where one exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kpiforge.plans import hr, it, marketing, production, sales, supply_chain, transport
from kpiforge.plans import models, one_scan, records, summary, whatif
from kpiforge.sources import testbed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _reg(name: str, source: str, fn: Callable[..., DataFrame], **kw) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(testbed.SOURCES[source](spark, sf_dir), **kw)
    run.__name__ = name
    QUERIES[name] = run


# supply chain (completed status on the test tables is 'F')
_reg("sc1_metrics", "supply_chain", supply_chain.metrics)
_reg("sc2_cost_distributions", "supply_chain", supply_chain.distributions)
_reg("sc3_monthly_trends", "supply_chain", supply_chain.monthly_trends)
_reg("sc4_supplier_performance", "supply_chain", supply_chain.supplier_performance,
     completed=testbed.SUPPLY_COMPLETED)
_reg("sc5_analysis", "supply_chain", supply_chain.analysis)
_reg("sc6_recent_orders", "supply_chain", supply_chain.recent_orders)
_reg("ag2_medians", "supply_chain", supply_chain.cost_quantiles)

# IT support
_reg("it1_metrics", "it", it.metrics)
_reg("it2_distributions", "it", it.distributions)
_reg("it3_monthly_trends", "it", it.monthly_trends)
_reg("it4_performance", "it", it.performance)
_reg("it5_recent_tickets", "it", it.recent_tickets)
_reg("it6_insights", "it", it.insights)

# production
_reg("pr1_metrics", "production", production.metrics)
_reg("pr2_distributions", "production", production.distributions)
_reg("pr3_monthly_trends", "production", production.monthly_trends)
_reg("pr4_performance", "production", production.performance)
_reg("pr5_recent_operations", "production", production.recent_operations)
_reg("pr6_insights", "production", production.insights)

# sales
_reg("sa1_metrics", "sales", sales.metrics)
_reg("sa2_distributions", "sales", sales.distributions)
_reg("sa3_monthly_trends", "sales", sales.monthly_trends)
_reg("sa4_top_performers", "sales", sales.top_performers)
_reg("sa5_recent_sales", "sales", sales.recent_sales)
_reg("sa6_insights", "sales", sales.insights)

# transport
_reg("tr1_metrics", "transport", transport.metrics)
_reg("tr2_distributions", "transport", transport.distributions)
_reg("tr3_by_vehicle", "transport", transport.by_vehicle)
_reg("tr4_monthly_deliveries", "transport", transport.monthly_deliveries)
_reg("tr5_insights", "transport", transport.insights)
_reg("tr6_monthly_service", "transport", transport.monthly_service)

# HR
_reg("hr1_metrics", "hr", hr.metrics)
_reg("hr2_distributions", "hr", hr.distributions)
_reg("hr3_department_insights", "hr", hr.department_insights)
_reg("hr4_top_performers", "hr", hr.top_performers)
_reg("hr5_training_recommendations", "hr", hr.training_recommendations)
_reg("hr5_recommendation_split", "hr", hr.recommendation_split)
_reg("hr6_training_effectiveness", "hr", hr.training_effectiveness)
_reg("hr7_insight_records", "hr", hr.insight_records)
_reg("hr8_days_since_hired", "hr", hr.days_since_hired)

# marketing
_reg("mk1_metrics", "marketing", marketing.metrics)
_reg("mk2_performance", "marketing", marketing.performance)
_reg("mk3_recent_campaigns", "marketing", marketing.recent_campaigns)

# what-if scenarios over data-derived KPIs
QUERIES["wi1_projection"] = whatif.projection
QUERIES["wi3_kpi_impacts"] = whatif.impact_table

# models: deterministic parts (with SQL oracles)
QUERIES["ml1_label_codes"] = models.label_codes
QUERIES["ml1_part_name_codes"] = models.part_name_codes
QUERIES["ml3_hr_zscores"] = models.hr_zscores
QUERIES["ml4_split_counts"] = models.split_counts
QUERIES["ml10_it_baseline_metrics"] = models.it_baseline_metrics
QUERIES["ml9_supply_baseline_report"] = models.supply_baseline_report

QUERIES["ml7_oversampled_counts"] = models.oversampled_counts
QUERIES["ml7_minority_neighbours"] = models.minority_neighbours
QUERIES["ml8_search_folds"] = models.search_folds
QUERIES["ml8_search_choice"] = models.search_choice
QUERIES["ml20_test_sides"] = models.test_sides

# operational records
QUERIES["jn3_audit_log"] = records.audit_log
QUERIES["fn11_part_files"] = records.part_files
QUERIES["prj16_order_badges"] = records.order_badges
QUERIES["prj13_scoped_customers"] = records.scoped_customers
QUERIES["ag9_event_types"] = records.event_types
QUERIES["so3_last_events"] = records.last_events
QUERIES["src4_metrics_with_defaults"] = records.metrics_with_defaults
QUERIES["src5_intake_manifest"] = records.intake_manifest
QUERIES["snk7_hr_report"] = records.hr_report

# summaries of all departments
QUERIES["all3_summary_sections"] = summary.section_sizes
QUERIES["all3_summary_values"] = one_scan.summary_values
QUERIES["src3_refreshed_summary"] = one_scan.refreshed_summary
QUERIES["snk1_summary_documents"] = summary.documents
QUERIES["snk3_metrics_report"] = summary.metric_rows

# model results that SQL can check
QUERIES["ml11_supply_cluster_totals"] = models.supply_cluster_totals
QUERIES["ml11_supply_lloyd_steps"] = models.supply_lloyd_steps
QUERIES["ml12_group_silhouettes"] = models.hr_group_silhouettes
QUERIES["ml14_supply_scatter_check"] = models.supply_scatter_check
QUERIES["ml15_supply_cost_scores"] = models.supply_cost_scores
QUERIES["snk8_model_reuse"] = models.model_reuse

# models: fits (shape-checked only)
QUERIES["ml5_supply_delay_forest"] = models.supply_delay_forest
QUERIES["ml6_it_resolution_forest"] = models.it_resolution_forest
QUERIES["ml6_production_efficiency_forest"] = models.production_efficiency_forest
QUERIES["ml6_supply_cost_forest"] = models.supply_cost_forest
QUERIES["ml6_sales_revenue_forest"] = models.sales_revenue_forest
QUERIES["ml6_hr_performance_forest"] = models.hr_performance_forest
QUERIES["ml8_hr_attrition_search"] = models.hr_attrition_search
QUERIES["ml8_hr_performance_search"] = models.hr_performance_search
QUERIES["ml8_hr_attrition_oversampled"] = models.hr_attrition_oversampled
QUERIES["ml17_transport_models"] = models.transport_models
QUERIES["ml11_supply_clusters"] = models.supply_clusters
QUERIES["ml12_hr_cluster_sweep"] = models.hr_cluster_sweep
QUERIES["ml13_hr_cluster_pca"] = models.hr_cluster_pca
QUERIES["ml18_hr_tenure_clusters"] = models.hr_tenure_clusters
QUERIES["ml19_hr_salary_forest"] = models.hr_salary_forest
