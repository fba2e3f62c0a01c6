"""Day states: a refresh reads changed days only, and merged states equal a full computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.operators.additive import deviation, mean, merged_states, partial_states
from kpiforge.sources import daystate


def partial(read):
    def run(rows):
        read.append({f.split("/day=")[1].split("/")[0] for f in rows.inputFiles()})
        return partial_states(rows, {"g": F.col("g")}, {"x": F.col("x")}, by=["day"])
    return run


def add(spark, root, rows):
    spark.createDataFrame(rows, "day string, g string, x double").repartition("day").write.mode("append").partitionBy("day").parquet(root)


def figures(spark, state):
    got = merged_states(daystate.day_states(spark, state), ["x"]).select(
        "key", "n", mean("x").alias("mean"), deviation("x").alias("sd"), "x_least", "x_most").collect()
    return {r.key: (r.n, r.mean, r.sd, r.x_least, r.x_most) for r in got}


def want(rows):
    out = {}
    for g in {r[1] for r in rows if r[1] is not None}:
        x = np.array([r[2] for r in rows if r[1] == g and r[2] is not None])
        out[g] = (sum(r[1] == g for r in rows), x.mean(), x.std(), x.min(), x.max())
    return out


def same(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_refresh_reads_changed_days_only(spark, tmp_path):
    data, state, read = str(tmp_path / "facts"), str(tmp_path / "state"), []
    rows = [(f"2024-01-0{1 + i % 4}", "abc"[i % 3], float(i * i % 17)) for i in range(60)] + [("2024-01-01", None, 1.0), ("2024-01-02", "a", None)]
    add(spark, data, rows)
    assert daystate.refresh(spark, data, state, partial(read)) == [f"2024-01-0{k}" for k in (1, 2, 3, 4)]
    assert same(figures(spark, state), want(rows))
    assert daystate.refresh(spark, data, state, partial(read)) == [] and len(read) == 1
    more = [("2024-01-05", "a", 100.0), ("2024-01-05", "d", 3.0)]
    add(spark, data, more)
    assert daystate.refresh(spark, data, state, partial(read)) == ["2024-01-05"] and read[-1] == {"2024-01-05"}
    late = [("2024-01-02", "b", -50.0)]   # a file that comes late to an earlier day
    add(spark, data, late)
    assert [r.day for r in daystate.stale_days(spark, data, state).collect()] == ["2024-01-02"]
    daystate.refresh(spark, data, state, partial(read))
    assert read[-1] == {"2024-01-02"} and same(figures(spark, state), want(rows + more + late))


def test_days_that_go_and_a_run_that_dies(spark, tmp_path):
    data, state = tmp_path / "facts", str(tmp_path / "state")
    rows = [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 5.0), ("2024-01-03", "b", 7.0)]
    add(spark, str(data), rows)

    def dies(df):
        partial([])(df).write.parquet(f"{state}/generations/generation=1")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        daystate.refresh(spark, str(data), state, dies)
    assert daystate.day_states(spark, state) is None
    daystate.refresh(spark, str(data), state, partial([]))
    assert same(figures(spark, state), want(rows))
    for f in (data / "day=2024-01-02").iterdir():
        f.unlink()
    (data / "day=2024-01-02").rmdir()
    assert daystate.refresh(spark, str(data), state, partial([])) == ["2024-01-02"]
    assert same(figures(spark, state), want([rows[0], rows[2]]))
