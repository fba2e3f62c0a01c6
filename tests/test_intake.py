"""Intake that commits: crashes leave nothing visible, repeated files are stored once."""

import pytest

from kpiforge.sources import intake
from kpiforge.sources.department import read_department
from kpiforge.sources.intake import IntakeError, fingerprint, ingest_dataset, read_manifest, read_uploads
from tests import fixtures


class Killed(Exception):
    pass


def die(*_, **__):
    raise Killed


def visible(spark, root):
    try:
        return read_uploads(spark, root, "it").count()
    except IntakeError:
        return 0


@pytest.mark.parametrize("step", ["_store", "_commit", "append_audit"])
def test_a_run_that_dies_is_finished_by_a_retry(spark, tmp_path, monkeypatch, step):
    path, root = fixtures.write(tmp_path, "it"), str(tmp_path / "store")
    with monkeypatch.context() as m:
        m.setattr(intake, step, die)
        with pytest.raises(Killed):
            ingest_dataset(spark, path, "it", "IT", root)
    committed = step == "append_audit"
    assert visible(spark, root) == (6 if committed else 0) and read_manifest(spark, root).count() == committed
    assert ingest_dataset(spark, path, "it", "IT", root).count() == 6
    assert read_manifest(spark, root).count() == 1 and visible(spark, root) == 6


def test_a_run_that_dies_while_writing_rejects(spark, tmp_path, monkeypatch):
    path, root = fixtures.write(tmp_path, "it"), str(tmp_path / "store")
    store = intake._store

    def half(*args):
        store(*args)
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(intake, "_store", half)
        with pytest.raises(Killed):
            ingest_dataset(spark, path, "it", "IT", root)
    assert visible(spark, root) == 0
    assert ingest_dataset(spark, path, "it", "IT", root).count() == 6 and visible(spark, root) == 6


def test_repeated_files_and_other_departments(spark, tmp_path):
    path, root = fixtures.write(tmp_path, "it"), str(tmp_path / "store")
    for _ in range(2):
        assert ingest_dataset(spark, path, "it", "IT", root, 5).count() == 6
    assert ingest_dataset(spark, path, "it", "Help desk", root).count() == 6
    assert read_manifest(spark, root).count() == 2 and visible(spark, root) == 12
    assert read_department(spark, "it", root, fmt="uploads").frame("hours").count() == 12
    actions = sorted(r.action for r in spark.read.parquet(f"{root}/audit").collect())
    assert actions == ["upload_dataset", "upload_dataset", "upload_repeated"]


def test_fingerprint_follows_content_only(spark):
    df = spark.createDataFrame([(str(i), None if i % 3 else "x") for i in range(50)], "a string, b string")
    same = fingerprint(df)
    assert fingerprint(df.orderBy("a").repartition(7)) == same
    assert fingerprint(df.unionByName(df.limit(1))) != same
    assert fingerprint(df.withColumnRenamed("b", "c")) != same
    assert fingerprint(df.na.fill("", ["b"])) != same
