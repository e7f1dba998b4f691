import numpy as np
import pytest

from quietband.operators import normalize, profile
from quietband.plans.inputs import ORDER_COLS, order_table


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(float(i) if i % 2 else None, float(i), 1.0, "" if i == 3 else f"t{i}") for i in range(30)]
    return spark.createDataFrame(rows + rows[:5], "a double, b double, c double, s string")


def test_profile_of_a_messy_table(messy):
    row = profile.profile(messy).first()
    assert (row["n_rows"], row["n_columns"], row["n_numeric"], row["duplicate_rows"]) == (35, 4, 3, 5)
    assert row["constant_columns"] == ["c"]
    missing = (15 + 3) / (35 * 4) * 100
    assert row["missing_pct"] == round(missing, 2)
    assert row["suitability_score"] == pytest.approx(1 - 0.4 - 0.3 - 0.1 - 0.05)
    assert row["suitability_level"] == "not_suitable" and len(row["warnings"]) == 4


def test_column_info_counts_blank_strings_and_keeps_order(messy):
    info = {r["name"]: r for r in profile.column_info(messy, "b").collect()}
    assert info["a"]["missing_count"] == 18 and info["s"]["missing_count"] == 2
    assert info["a"]["samples"] == ["1.0", "1.0", "3.0", "3.0", "5.0"]
    assert info["s"]["kind"] == "string" and not info["s"]["is_numeric"]


def test_preview_cuts_long_values(spark):
    table = spark.createDataFrame([(2, "x" * 80), (1, None)], "id int, t string")
    rows = profile.preview(table, "id", 2).collect()
    assert rows[0]["t"] == "—" and rows[1]["t"] == "x" * 50


def test_validate_rejects_what_cannot_be_analysed(spark):
    two = lambda rows, schema="a double, b double": spark.createDataFrame(rows, schema)
    for bad in (
        two([(1.0, "x"), (2.0, "y")], "a double, b string"),
        two([(1.0,), (2.0,)], "a double"),
        two([(1.0, 2.0)]),
        two([(1.0, float("inf")), (2.0, 1.0)]),
    ):
        with pytest.raises(profile.InvalidInput):
            profile.validate(bad)


def test_validate_scores_soft_problems(spark):
    rows = [(1.0, float("nan"), None), (1.0, 2.0, None), (1.0, 2.0, None), (1.0, 3.0, None)]
    row = profile.validate(spark.createDataFrame(rows, "a double, b double, c double")).first()
    assert row["constant_dims"] == [0, 2] and row["duplicate_count"] == 1
    assert row["missing_pct"] == pytest.approx(5 / 12 * 100) and not row["enough_samples"]
    assert row["suitability_score"] == pytest.approx(1 - 0.5 * 5 / 12 - 0.3 * 2 / 3 - 0.2 / 4)


def test_standardize_keeps_gaps_and_round_trips(spark):
    rows = [(0, 1.0, 5.0, None), (1, 3.0, 5.0, None), (2, float("nan"), 5.0, None)]
    table = spark.createDataFrame(rows, "id int, a double, b double, c double")
    scaled, params = normalize.standardize(table, ["a", "b", "c"])
    out = scaled.orderBy("id").collect()
    assert [out[0]["a"], out[1]["a"]] == [-1.0, 1.0] and np.isnan(out[2]["a"])
    assert [r["b"] for r in out] == [0.0, 0.0, 0.0] and params.stds == [1.0, 1.0, 1.0]
    assert params.means == [2.0, 5.0, 0.0]
    back = normalize.inverse_standardize(scaled, params).orderBy("id").collect()
    assert back[1]["a"] == 3.0 and back[0]["b"] == 5.0
    assert profile.impute_zero(scaled, ["a", "c"]).where("a = 0 and c = 0").count() == 1


def test_equal_orders_are_duplicates_however_their_lines_lie(spark, tmp_path):
    """Sums of lines do not depend on which partition holds which line."""
    prices = [0.1, 0.7, 1e9 + 0.3, 0.2, 12.34]
    rows = [(o, line, 1.0, p, 0.01 * line, 0.07) for o in range(40) for line, p in enumerate(prices)]
    shuffled = np.random.default_rng(0).permutation(len(rows)).tolist()
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    lines = spark.createDataFrame([rows[i] for i in shuffled], schema).repartition(16)
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    row = profile.validate(order_table(spark, str(tmp_path)), ORDER_COLS).first()
    assert (row["n_samples"], row["duplicate_count"]) == (40, 39)
