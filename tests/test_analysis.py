import numpy as np
import pytest
from conftest import subspace
from pyspark.sql import functions as F

from quietband import AnalysisConfig, run_analysis


def test_all_bad_parameters_are_reported_together(wide):
    table = wide(np.ones((3, 2)))
    with pytest.raises(ValueError) as problem:
        run_analysis(table, "id", overlap_factor=1.5, percentile=0, threshold_method="guess")
    assert all(word in str(problem.value) for word in ("overlap_factor", "percentile", "threshold_method"))
    assert AnalysisConfig().problems() == []


def test_clean_table_has_few_flags_and_stages_are_written(wide, spark, tmp_path):
    result = run_analysis(wide(subspace(200, 5, 2, 0.05, 0)), "id", stage_dir=str(tmp_path))
    summary = result.report.summary.first()
    assert summary["total_points"] == 200 and summary["anomaly_rate"] < 0.2
    assert result.summary["n_points"] == 200 and result.summary["coverage"] == 1.0
    assert set(result.timing) == {"ingest", "structure", "fourier", "atlas", "anomaly", "reporting"}
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    for name in ("points", "coefficients", "assignments", "scores"):
        assert read(name).count() == 200
    assert read("mean_power").count() == 5 and read("charts").count() == result.summary["n_charts"]
    assert [r["name"] for r in read("column_names").orderBy("position").collect()] == ["x0", "x1", "x2", "x3", "x4"]
    scores = read("scores")
    # z-scores are standardised within each chart and band.
    for row in scores.groupBy("chart_id").agg(F.avg(F.col("z")[0]).alias("m")).collect():
        assert abs(row["m"]) < 1e-6


def test_planted_outliers_rank_above_average(wide):
    x = subspace(300, 5, 2, 0.05, 1)
    planted = [10, 60, 110, 160, 210, 260]
    x[planted] += 15 * np.random.default_rng(2).choice([-1.0, 1.0], (6, 5))
    result = run_analysis(wide(x), "id", n_charts=2)
    scores = {r["id"]: r["score"] for r in result.scores.collect()}
    mean = np.mean(list(scores.values()))
    assert sum(scores[i] > mean for i in planted) >= 3
    assert result.report.summary.first()["total_anomalies"] >= 1


def test_missing_values_and_percentile_thresholds(wide):
    x = subspace(150, 4, 2, 0.1, 3)
    x[::7, 1] = np.nan
    result = run_analysis(wide(x), "id", threshold_method="percentile", percentile=98.0, n_bands=2)
    summary = result.report.summary.first()
    assert summary["total_anomalies"] == 3
    assert result.quality.first()["missing_pct"] == pytest.approx(22 / 600 * 100)


def test_analysis_reads_its_input_once(spark, wide):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = wide(subspace(200, 5, 2, 0.05, 3))
    run_analysis(table.mapInArrow(counted, table.schema), "id", n_charts=2)
    assert read.value == 200
