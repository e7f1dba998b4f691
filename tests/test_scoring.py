import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietband.operators import report, scoring


@pytest.fixture(scope="module")
def scored(spark):
    """Two quiet bands; ids 90.. have a quiet-band anomaly that the total length hides."""
    rng = np.random.default_rng(0)
    norms = np.column_stack([np.abs(rng.normal(1, 0.1, 110)), np.abs(rng.normal(0.01, 0.001, 110))])
    norms[100:, 1] = rng.normal(0.5, 0.01, 10)
    rows = [(i, 0, [float(a), float(b)]) for i, (a, b) in enumerate(norms)]
    return norms, spark.createDataFrame(rows, "id long, chart_id int, norms array<double>")


def test_quiet_band_anomalies_are_found_by_bands_and_missed_by_length(scored):
    norms, rows = scored
    expected = scoring.expected_residuals(rows.where("id < 100"))
    found = scoring.detect_scores(rows, expected, 2)
    flagged = {r["id"] for r in found.where("is_anomaly").collect()}
    assert set(range(100, 110)) <= flagged and len(flagged - set(range(100, 110))) < 5
    length = np.linalg.norm(norms, axis=1)
    median = np.median(length)
    limit = median + 3 * 1.4826 * np.median(np.abs(length - median))
    assert (length[100:] > limit).mean() < 1.0


def test_flat_bands_and_charts_without_statistics(spark):
    rows = spark.createDataFrame(
        [(0, 0, [1.0]), (1, 0, [1.0 + 1e-11]), (2, 0, [2.0]), (3, 0, [0.5]), (4, 7, [0.0]), (5, 7, [3.0])],
        "id long, chart_id int, norms array<double>",
    )
    expected = spark.createDataFrame([(0, 0, 1.0, 0.0)], "chart_id int, band int, mean double, var double")
    z = [r["z"][0] for r in scoring.band_zscore(rows, expected).orderBy("id").collect()]
    assert z == [0.0, 0.0, 1e10, -1e10, 0.0, 1e10]


def test_weighted_scores(spark):
    rows = spark.createDataFrame([([1.0, -3.0],)], "z array<double>")
    value = lambda w=None: rows.select(scoring.aggregate_score(F.col("z"), w)).first()[0]
    assert value() == 3.0 and value([1.0, 3.0]) == pytest.approx(2.5)
    assert value([0.0, 0.0]) == pytest.approx(2.0)


def test_thresholds(spark):
    flat = spark.createDataFrame([(2.0,)] * 9, "s double")
    assert scoring.mad_thresholds(flat, {"s": F.col("s")})["s"] == 2.0
    ramp = spark.createDataFrame([(float(i),) for i in range(101)], "s double")
    assert scoring.mad_thresholds(ramp, {"s": F.col("s")})["s"] == pytest.approx(50 + 3 * 1.4826 * 25)
    assert scoring.percentile_thresholds(ramp, {"s": F.col("s")}, 99)["s"] == pytest.approx(99.0)
    assert scoring.mad_thresholds(ramp.limit(0), {"s": F.col("s")})["s"] == 0.0
    assert scoring.multiple_testing([1.0]) == [1.0]
    assert scoring.multiple_testing([1.0, 2.0]) == pytest.approx([math.log(2) + 1, 2 * (math.log(2) + 1)])


def test_residuals_are_off_the_chart(points):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    bases = {c: np.linalg.qr(rng.normal(size=(4, 2)))[0] for c in (0, 1)}
    rows = points(x).withColumn("chart_id", (F.col("id") % 2).cast("int"))
    for r in scoring.normal_residuals(rows, bases).collect():
        basis = bases[r["chart_id"]]
        residual = np.array(r["residual"])
        assert np.allclose(basis.T @ residual, 0)
        assert np.allclose(residual, x[r["id"]] - basis @ (basis.T @ x[r["id"]]))
    u = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    for r in scoring.band_norms(rows, bases, u, [(0, 0), (1, 3)]).collect():
        basis = bases[r["chart_id"]]
        spectrum = (x[r["id"]] - basis @ (basis.T @ x[r["id"]])) @ u
        assert r["norms"] == pytest.approx([abs(spectrum[0]), np.linalg.norm(spectrum[1:])])


@pytest.fixture(scope="module")
def flagged(spark):
    rows = [
        (0, [5.0, 1.0, -6.0], 6.0, [True, False, True], True),
        (1, [9.0, 9.0, 9.0], 9.0, [True, True, True], True),
        (2, [-7.0, 0.0, 7.0], 7.0, [True, False, False], True),
        (3, [8.0, 0.0, 0.0], 8.0, [False, False, False], True),
        (4, [1.0, 0.0, 0.0], 1.0, [True, False, False], False),
        (5, [0.0, 0.0, 0.0], 9.0, [False, False, False], False),
    ]
    return spark.createDataFrame(
        rows, "id long, z array<double>, score double, flags array<boolean>, is_anomaly boolean"
    )


def test_report_tables(flagged):
    table = report.per_point_table(flagged, "id", 3).collect()
    assert [r["id"] for r in table] == [1, 5, 3, 2, 0, 4]
    assert table[3]["top_anomalous_band"] == "band_0" and table[4]["top_anomalous_band"] == "band_2"
    kinds = report.type_distribution(flagged, 3).first()
    assert tuple(kinds) == (1, 1, 1)  # point 3 is in no type: none of its bands is flagged
    top = report.top_anomalies(flagged, "id", 3, 2).collect()
    assert [r["id"] for r in top] == [1, 3] and top[0]["flagged_bands"] == [0, 1, 2]
    assert top[1]["flagged_bands"] == [] and top[1]["band_scores"]["band_0"] == 8.0
    summary = report.statistical_summary(flagged, 3).first()
    assert (summary["total_points"], summary["total_anomalies"]) == (6, 4)
    assert summary["std_score"] == pytest.approx(np.std([6, 9, 7, 8, 1, 9]))
    assert summary["band_0_anomaly_count"] == 4


def test_single_band_counts_as_global(flagged):
    one = flagged.withColumn("flags", F.slice("flags", 1, 1))
    assert tuple(report.type_distribution(one, 1).first()) == (0, 0, 3)


def test_report_of_nothing(flagged):
    empty = flagged.limit(0)
    row = report.summary_row(report.generate_report(empty, "id", 3)).first()
    assert row["total_points"] == 0 and row["anomaly_rate"] == 0.0 and row["spectral"] == 0


def test_json_and_csv(flagged, spark, tmp_path):
    import json

    found = report.generate_report(flagged, "id", 3, 3)
    document = json.loads(report.report_json(found).first()[0])
    assert [t["id"] for t in document["top_anomalies"]] == [1, 3, 2]
    assert document["type_distribution"] == {"spectral": 1, "partial": 1, "global": 1}
    report.write_report_csv(found, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 6
