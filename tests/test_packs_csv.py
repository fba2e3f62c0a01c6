"""Golden tests: department packs on small invented CSVs, expected values by hand/pandas."""

import io

import pandas as pd
import pytest

from kpiforge.plans import hr, it, marketing, production, sales, supply_chain, transport
from kpiforge.sources.department import read_department
from tests import fixtures


def src(spark, tmp_path, dept, **kw):
    return read_department(spark, dept, fixtures.write(tmp_path, dept), **kw)


def pdf(dept):
    return pd.read_csv(io.StringIO(fixtures.ALL[dept]))


def test_supply_metrics_and_trends(spark, tmp_path):
    s = src(spark, tmp_path, "supply_chain")
    m = supply_chain.metrics(s).first().asDict()
    p = pdf("supply_chain")
    delay = (pd.to_datetime(p["Delivery Date"]) - pd.to_datetime(p["Order Date"])).dt.days
    assert m["total_cost"] == round(p["Total Cost (USD)"].sum(), 2)
    assert m["avg_delay"] == round(delay.mean(), 2)
    assert m["on_time_delivery"] == round((delay <= 0).mean() * 100, 2)
    assert m["total_orders"] == 6
    trends = {r["month"]: (r["monthly_cost"], r["monthly_delay"])
              for r in supply_chain.monthly_trends(s).collect()}
    assert trends == {"2024-01": (75.0, 1.5), "2024-02": (360.0, round(26 / 3, 6)), "2024-03": (20.0, -3.0)}


def test_supply_distributions_null_category_dropped(spark, tmp_path):
    rows = supply_chain.distributions(src(spark, tmp_path, "supply_chain")).collect()
    cats = {r["key"]: r["total_cost"] for r in rows if r["section"] == "category_costs"}
    assert None not in cats and len(cats) == 5
    sup = {r["key"]: r["total_cost"] for r in rows if r["section"] == "supplier_costs"}
    assert sup == {"Acme, Inc": 125.0, "Beta Ltd": 260.0, "Gamma Co": 70.0}


def test_supply_performance_completion(spark, tmp_path):
    rows = {r["supplier"]: r for r in
            supply_chain.supplier_performance(src(spark, tmp_path, "supply_chain")).collect()}
    assert rows["Acme, Inc"]["completion_rate"] == 0.5
    assert rows["Gamma Co"]["completion_rate"] == 0.5
    assert rows["Beta Ltd"]["completion_rate"] == 0.0


def test_supply_analysis_and_recent(spark, tmp_path):
    s = src(spark, tmp_path, "supply_chain")
    a = supply_chain.analysis(s).first()
    # Raw Materials has the largest delay (16 days); mean 75.83 > median 50 -> High
    assert a["worst_performing_category"] == "Raw Materials (16.0 days)"
    assert a["cost_efficiency"] == "High ($75.83)"
    assert a["delivery_performance"] == "Needs Improvement (50.0%)"
    rec = supply_chain.recent_orders(s, n=3).collect()
    assert [r["date"] for r in rec] == ["2024-03-02", "2024-02-14", "2024-02-14"]
    # tie on date broken by category ascending
    assert [r["category"] for r in rec[1:]] == ["Packaging", "Raw Materials"]
    assert rec[1]["description"] == "Tape - Gamma Co"


def test_it_pack(spark, tmp_path):
    s = src(spark, tmp_path, "it")
    m = it.metrics(s).first()
    assert m["total_tickets"] == 6 and m["system_uptime"] == 99.9
    assert m["avg_resolution_time"] == round((0.5 + 12 + 4 + 1 + 30 + 2) / 6, 6)
    assert m["first_call_resolution"] == round(2 / 6 * 100, 6)
    dist = {(r["section"], r["key"]): r["n"] for r in it.distributions(s).collect()}
    assert dist[("ticket_types", "Update failure")] == 3
    trend = {r["month"]: r["avg_resolution_time"] for r in it.monthly_trends(s).collect()}
    assert trend == {1: 6.25, 2: 2.5, 3: 16.0}
    ins = [r["insight"] for r in it.insights(s).orderBy("idx").collect()]
    assert ins == ["Average resolution time is 8.2 hours",
                   "First call resolution rate is 33.3%",
                   "Most common issue is Update failure"]
    recent = it.recent_tickets(s, n=2).collect()
    assert [r["ticket_id"] for r in recent] == [1005, 1006]
    assert recent[0]["reported_date"] == "2024-03-09 00:00:00"


def test_production_pack_zero_units(spark, tmp_path):
    s = src(spark, tmp_path, "production")
    m = production.metrics(s).first()
    # zero units -> efficiency null, skipped by the mean (Q22)
    assert m["avg_efficiency"] == round((99.0 + 100.0 + 98.0) / 3, 6)
    assert m["avg_machine_utilization"] == round((90 + 95.5 + 88 + 85) / 4, 6)
    perf = {(r["section"], r["key"]): r["avg_efficiency"] for r in production.performance(s).collect()}
    assert perf[("by_product", "Widget")] == 98.5
    assert ("by_product", "Gizmo") in perf and perf[("by_product", "Gizmo")] is None
    ins = [r["insight"] for r in production.insights(s).orderBy("idx").collect()]
    assert ins[3] == "Most efficient product is Gadget"


def test_sales_pack(spark, tmp_path):
    s = src(spark, tmp_path, "sales")
    m = sales.metrics(s).first()
    assert (m["total_sales"], m["total_units"], m["num_transactions"]) == (475.0, 21.0, 4)
    assert m["avg_unit_price"] == round(475 / 21, 6)
    top = {(r["section"], r["rank"]): r["key"] for r in sales.top_performers(s, 2).collect()}
    assert top[("top_products", 1)] == "B" and top[("top_products", 2)] == "A"
    assert top[("top_salespersons", 1)] == "Lee"
    ins = [r["insight"] for r in sales.insights(s).orderBy("idx").collect()]
    assert ins[0] == "Total sales revenue: $475.00" and ins[1] == "Total units sold: 21"
    assert ins[4:] == ["Top selling product: B", "Top performing region: South",
                       "Top salesperson: Lee"]


def test_transport_keeps_none_text(spark, tmp_path):
    s = src(spark, tmp_path, "transport")
    m = transport.metrics(s).first()
    assert (m["total_deliveries"], m["avg_delivery_time"], m["avg_on_time_rate"],
            m["total_incidents"]) == (65, 3.8, 83.8, 3)
    veh = {(r["section"], r["key"]): r["n"] for r in transport.distributions(s).collect()}
    assert veh[("vehicle_types", "None")] == 2     # Q8: the text 'None' is a value
    s2 = src(spark, tmp_path, "transport", null_values="None")
    veh2 = {(r["section"], r["key"]) for r in transport.distributions(s2).collect()}
    assert ("vehicle_types", "None") not in veh2
    monthly = {r["month"]: r["deliveries"] for r in transport.monthly_deliveries(s).collect()}
    assert monthly == {"2024-01": 30, "2024-02": 35}


def test_hr_pack(spark, tmp_path):
    s = src(spark, tmp_path, "hr")
    m = hr.metrics(s).first()
    p = pdf("hr")
    active = p["Training_Hours"] + p["Overtime_Hours"] - p["Leave_Days_Taken"]
    assert m["avg_tenure"] == round(active.mean(), 6)       # raw, not z-scored (Q1)
    recs = hr.training_recommendations(s).collect()
    exp = p[(p.Performance_Score < p.Performance_Score.mean())
            & (p.Leave_Days_Taken > p.Leave_Days_Taken.mean())]
    assert sorted(r["employee_id"] for r in recs) == sorted(exp.Employee_ID)
    split = hr.recommendation_split(s).first()
    assert (split["recommended"], split["others"]) == (len(exp), 5 - len(exp))
    eff = hr.training_effectiveness(s).first()["effectiveness"]
    g = p.groupby("Training_Hours")["Performance_Score"].mean()
    assert eff == pytest.approx(round(pd.Series(g.index, dtype=float).corr(pd.Series(g.values)), 6))
    top = hr.top_performers(s, 2).collect()
    assert [r["employee_id"] for r in top] == ["HR0001", "HR0004"]
    dept = hr.department_insights(s).first()
    assert dept["department"] == "HR" and dept["attrition_rate"] == 0.4


def test_marketing_pack(spark, tmp_path):
    s = src(spark, tmp_path, "marketing")
    m = marketing.metrics(s).first()
    assert m["total_campaigns"] == 3
    assert m["roi"] == round((11000 - 8000) / 8000 * 100, 6)
    assert m["acquisition_cost"] == round(8000 / (5 + 5 + 5), 6)
    rec = marketing.recent_campaigns(s, 1).first()
    assert rec["campaign_id"] == "c3" and rec["start_date"] == "2024-07-01"
