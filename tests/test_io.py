"""Sources, sinks, summary store, intake, streaming intake, what-if."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import whatif
from kpiforge.plans.summary import build_summary
from kpiforge.sinks.files import append_audit, log_predictions, write_predictions
from kpiforge.sinks.summary import download_report, hr_report_tables, metrics_report, read_summary_documents, write_summary, write_summary_documents
from kpiforge.sources.department import read_department
from kpiforge.sources.intake import IntakeError, ingest_dataset, validate
from kpiforge.sources.summary import get_or_build_summary, read_summary, with_default_metrics
from kpiforge.streaming.intake import start_intake
from tests import fixtures


def test_summary_roundtrip_and_reports(spark, tmp_path):
    root = str(tmp_path / "summary")
    it = read_department(spark, "it", fixtures.write(tmp_path, "it"))
    calls = []

    def build():
        calls.append(1)
        return build_summary("it", it)

    s1 = get_or_build_summary(spark, root, "it", build)
    s2 = get_or_build_summary(spark, root, "it", build)
    assert len(calls) == 1 and s1.count() == s2.count() > 0
    sections = {r.section for r in read_summary(spark, root, "it").select("section").distinct().collect()}
    assert {"metrics", "distributions", "trends", "performance", "insights",
            "recommendations", "recent_tickets"} <= sections
    rep = metrics_report(s2, "it").first().asDict()
    assert rep["total_tickets"] == "6"
    out = download_report(s2, "it", str(tmp_path / "report"))
    assert any(f.endswith(".csv") for f in os.listdir(out))
    with pytest.raises(NotImplementedError):
        download_report(s2, "it", str(tmp_path / "r2"), fmt="pdf")
    with pytest.raises(ValueError):
        download_report(s2, "it", str(tmp_path / "r3"), fmt="xls")


def test_hr_report_side_by_side(spark, tmp_path):
    hr = read_department(spark, "hr", fixtures.write(tmp_path, "hr"))
    s = build_summary("hr", hr)
    metrics, analysis = hr_report_tables(s)
    assert metrics.count() == 1
    rows = analysis.orderBy("position").collect()
    assert [r.position for r in rows] == [1, 2]
    assert all(r.insight and r.recommendation for r in rows)


def test_nested_documents_hold_the_summary(spark, tmp_path):
    s = build_summary("it", read_department(spark, "it", fixtures.write(tmp_path, "it")))
    odd = spark.createDataFrame([("hr", "trends", None, None, None), ("hr", "trends", 'a "quoted" name', "k\n2", '{"x": null, "y": [1]}')]
                                + [("hr", "ranks", None, str(i), f'{{"n": {i}}}') for i in range(1, 13)], s.schema)
    both = s.unionByName(odd)
    parsed = lambda d: sorted(((r.department, r.section, r.name or "", r.key or "", r.value and json.loads(r.value)) for r in d.collect()), key=lambda r: r[:4])
    for bound in (1000, 11):   # the ranks, and the distributions, lie beside the documents when 11 rows are the bound
        root = str(tmp_path / f"documents{bound}")
        write_summary_documents(both, root, max_rows=bound)
        assert parsed(read_summary_documents(spark, root)) == parsed(both)
        text = {r.department: json.loads(r.value) for r in spark.read.text(f"{root}/documents").collect()}
        assert set(text) == {"it", "hr"} and text["it"]["sections"]["metrics"][0]["value"]["total_tickets"] == 6
        if bound == 11:
            assert text["hr"]["elsewhere"]["ranks"]["n"] == 12 and "ranks" not in text["hr"]["sections"]
        else:
            assert [i["value"]["n"] for i in text["hr"]["sections"]["ranks"]] == list(range(1, 13))
    write_summary_documents(both.where("false"), str(tmp_path / "none"))
    assert spark.read.schema("value string").text(str(tmp_path / "none" / "documents")).count() == 0


def test_every_department_summary_builds(spark, tmp_path):
    for dept in ("supply_chain", "production", "sales", "transport", "marketing"):
        src = read_department(spark, dept, fixtures.write(tmp_path, dept))
        assert build_summary(dept, src).count() > 0


def test_defaults_fill_missing_metrics(spark):
    m = spark.createDataFrame([(5, None)], "total int, rate double")
    row = with_default_metrics(m, {"total": 0, "rate": 0.0, "extra": 0}).first()
    assert (row.total, row.rate, row.extra) == (5, 0.0, 0)


def test_audit_predictions_logs(spark, tmp_path):
    append_audit(spark, str(tmp_path / "audit"), 1, "login")
    append_audit(spark, str(tmp_path / "audit"), None, "upload", "x")
    a = spark.read.parquet(str(tmp_path / "audit"))
    assert a.count() == 2 and a.where(F.col("timestamp").isNull()).count() == 0
    p = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, actual double, prediction double")
    write_predictions(p, str(tmp_path / "pred"))
    log_predictions(p, str(tmp_path / "plog"), "delivery_time", ["x"], ["prediction"], 7)
    row = spark.read.parquet(str(tmp_path / "plog")).first()
    assert row.input_data == '{"x":1.0}' and row.user_id == 7


def test_intake_validation_and_store(spark, tmp_path):
    with pytest.raises(IntakeError):
        validate("data.xlsx", "it", "IT")
    with pytest.raises(IntakeError):
        validate("data.csv", "payroll", "IT")
    with pytest.raises(IntakeError):
        validate("data.csv", "it", "")
    path = fixtures.write(tmp_path, "it")
    stored = ingest_dataset(spark, path, "it", "IT", str(tmp_path / "store"), user_id=3)
    assert stored.count() == 6
    manifest = spark.read.parquet(str(tmp_path / "store" / "manifest")).first()
    assert manifest.filename == "it.csv" and manifest.user_id == 3
    src = read_department(spark, "it", str(tmp_path / "store" / "datasets" / "it"), fmt="parquet")
    assert src.frame("hours").count() == 6


def test_streaming_intake(spark, tmp_path):
    inbox = tmp_path / "inbox" / "Transport"
    inbox.mkdir(parents=True)
    (inbox / "t1.csv").write_text(fixtures.TRANSPORT)
    q = start_intake(spark, str(tmp_path / "inbox"), "transport", str(tmp_path / "out"),
                     checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 4
    assert {r.upload_department for r in out.select("upload_department").distinct().collect()} == {"Transport"}


def test_whatif_identity_and_fallbacks(spark):
    sc = spark.createDataFrame([("it", "cost", 0.0), ("it", "cost", 10.0),
                                ("nowhere", "efficiency", -20.0), ("hr", "unknown", 5.0)],
                               "department string, metric string, pct double")
    kpis = spark.createDataFrame([("it", "cost", 500.0)], "department string, metric string, current double")
    rows = {(r.department, r.metric, r.pct): r for r in whatif.project(sc, kpis).collect()}
    zero = rows[("it", "cost", 0.0)]
    assert zero.projected == zero.current == 500.0 and zero.direction == "positive"
    assert rows[("it", "cost", 10.0)].effect1_pct == 3.0
    # unknown department -> it rows; efficiency base 85 with unit %
    nw = rows[("nowhere", "efficiency", -20.0)]
    assert nw.current == 85.0 and nw.projected == 68.0 and nw.effect1 == "manual tasks"
    assert nw.change_text == "-20.0%" and nw.direction == "negative"
    # unknown metric -> no multipliers, base 100
    unk = rows[("hr", "unknown", 5.0)]
    assert unk.current == 100.0 and unk.effect1 is None
    imp = whatif.impacts(sc).where("department = 'hr' AND metric = 'unknown'").orderBy("idx")
    assert [r.impact for r in imp.collect()] == whatif.FALLBACK_IMPACTS


def test_hr_intake_keeps_the_files_department(spark, tmp_path):
    path = fixtures.write(tmp_path, "hr")
    ingest_dataset(spark, path, "hr", "People", str(tmp_path / "store"))
    src = read_department(spark, "hr", str(tmp_path / "store" / "datasets" / "hr"), fmt="parquet")
    direct = read_department(spark, "hr", path)
    assert sorted(src.frame("employee_id", "department").collect()) == sorted(
        direct.frame("employee_id", "department").collect())


def test_intake_rejects_are_kept_with_a_reason(spark, tmp_path):
    path = fixtures.write(tmp_path, "it")
    lines = open(path).read().splitlines()
    parts = lines[1].split(",")
    parts[4] = "abc"
    with open(path, "w") as f:
        f.write("\n".join([lines[0], ",".join(parts), *lines[2:]]) + "\n")
    root = str(tmp_path / "store")
    stored = ingest_dataset(spark, path, "it", "IT", root)
    assert stored.count() == len(lines) - 2
    reject = spark.read.parquet(f"{root}/rejects").collect()
    assert len(reject) == 1 and "Resolution Time (hrs)" in reject[0].reason and "abc" in reject[0].record
    m = spark.read.parquet(f"{root}/manifest").first()
    assert (m.accepted, m.rejected) == (len(lines) - 2, 1)


def test_finance_datasets_are_accepted(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("a,b\n1,x\n2,y\n")
    assert ingest_dataset(spark, str(p), "finance", "Finance", str(tmp_path / "store")).count() == 2


def test_corrupt_summary_is_rebuilt(spark, tmp_path):
    root = tmp_path / "summary"
    it = read_department(spark, "it", fixtures.write(tmp_path, "it"))
    first = get_or_build_summary(spark, str(root), "it", lambda: build_summary("it", it)).count()
    for f in (root / "department=it").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (root / "department=it").glob(".*.crc"):
        f.unlink()
    again = get_or_build_summary(spark, str(root), "it", lambda: build_summary("it", it))
    assert again.count() == first


def test_partial_sales_file_gives_zero_and_empty_sections(spark, tmp_path):
    from kpiforge.plans import sales
    p = tmp_path / "sales.csv"
    p.write_text("Region\nNorth\nSouth\nNorth\n")
    src = read_department(spark, "sales", str(p))
    m = sales.metrics(src).first()
    assert (m.total_sales, m.total_units, m.avg_unit_price, m.num_transactions) == (0, 0, 0, 3)
    assert {(r.section, r.key, r.n) for r in sales.distributions(src).collect()} == {
        ("by_region", "North", 2), ("by_region", "South", 1)}
    for part in (sales.monthly_trends, sales.top_performers, sales.recent_sales):
        assert part(src).count() == 0


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from kpiforge import session

    class Fake:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Fake)


def test_percentages_outside_the_bounds_are_refused(spark):
    with pytest.raises(ValueError):
        whatif.scenario_grid(spark.createDataFrame([("it", "cost")], "department string, metric string"), [150])
