"""Edge cases of row-wise features on hand-made frames."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from foldsmith.functions import bins, power, scalar
from foldsmith.operators.ordering import quantiles
from foldsmith.sources.tables import load_as_text, load_external, load_frame, nulls_for_nan

NAN = float("nan")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def frame(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"id int, x {kind}")


def test_encode_binary_unknown_is_null(spark):
    df = frame(spark, ["male", "female", "other", None], "string")
    assert column(scalar.encode_binary(df, "x", {"male": 0, "female": 1}), "x") == [0, 1, None, None]


def test_rounding_goes_to_even(spark):
    assert column(scalar.round_columns(frame(spark, [0.5, 1.5, 2.5, -0.5, None]), ["x"]), "x") == [0.0, 2.0, 2.0, 0.0, None]


def test_clip_keeps_missing(spark):
    got = column(scalar.clip(frame(spark, [0.0, 400.0, 5.0, None, NAN]), ["x"], 1.0, 314.0), "x")
    assert got == [1.0, 314.0, 5.0, None, None]


def test_clip_lower_only(spark):
    assert column(scalar.clip(frame(spark, [-1.0, 1e9]), ["x"], lower=0.0), "x") == [0.0, 1e9]


def test_cut_is_right_closed(spark):
    df = scalar.cut_bins_labels(frame(spark, [0.0, 30.0, 30.5, 180.0, 181.0, None]), "x", [0, 30, 60, 180],
                                ["Short", "Medium", "Long"], "label")
    assert column(df, "label") == [None, "Short", "Medium", "Long", None, None]


def test_flags_count_missing_as_above(spark):
    df = frame(spark, [39.5, 39.6, None, NAN]).withColumns({"w": F.lit(50.0), "h": F.lit(0.0)})
    out = scalar.guarded_ratio_flags(df, "w", "h", {"flag": ("x", 39.5)})
    assert column(out, "flag") == [0, 1, 1, 1]
    assert column(out, "BMI")[0] == 50.0 / 1e-6


def test_zero_divisor_gives_null(spark):
    df = frame(spark, [0.0, 2.0]).withColumn("y", F.lit(4.0))
    out = scalar.autofe_arith(df, [("y", "x")])
    assert column(out, "Divide_y_x") == [None, 2.0]
    assert column(out, "Max_y_x") == [4.0, 4.0]


def test_decimal_digits(spark):
    df = frame(spark, ["41.25", "41", None, "41."], "string")
    assert column(scalar.decimal_digits(df, ["x"]), "decimal_digits_x") == [2, 0, None, 0]


def test_polynomials_of_six_columns_are_thirty(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "a double, b double, c double, d double, e double, f double")
    out = scalar.polynomial_features(df, df.columns)
    names = [c for c in out.columns if c.startswith("poly_")]
    assert len(names) == 30
    row = out.first()
    assert row["poly_b2_c"] == 12.0 and row["poly_b_c2"] == 18.0


def test_masked_columns_are_two_per_feature(spark):
    df = spark.createDataFrame([(1, 0, 7.0), (2, 1, 8.0)], "id int, sex int, x double")
    out = scalar.masked_by_category(df, ["x"], "sex", {0: "Male", 1: "Female"})
    assert column(out, "masked_x_x_Male") == [7.0, 0.0]
    assert column(out, "masked_x_x_Female") == [0.0, 8.0]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 3.0), (3, None, NAN)], "id int, a double, b double")
    assert column(scalar.row_mean(df, ["a", "b"]), "row_mean") == [1.0, 2.0, None]


def test_noise_depends_on_id_not_on_partitioning(spark):
    df = frame(spark, [1.0] * 200)
    a = column(scalar.gaussian_noise(df, ["x"]), "x")
    assert a == column(scalar.gaussian_noise(df.repartition(7), ["x"]), "x")
    mean = sum(a) / len(a)
    sd = math.sqrt(sum((v - mean) ** 2 for v in a) / len(a))
    assert abs(mean - 1.0) < 0.06 and abs(sd - 0.2) < 0.05


@pytest.mark.parametrize("lam", [0.0, 0.5, 2.0, -1.0])
def test_power_transform_inverts(spark, lam):
    df = frame(spark, [-3.0, -0.5, 0.0, 0.5, 30.0])
    back = column(df.withColumn("b", power.inverse(power.transform(F.col("x"), lam), lam)), "b")
    assert back == pytest.approx([-3.0, -0.5, 0.0, 0.5, 30.0])


def test_power_fit_finds_the_exponent_of_a_skewed_column(spark):
    # log1p of the column is close to symmetric, so the exponent is close to 0
    df = spark.range(1, 2000).select(F.expm1(F.sin(F.col("id").cast("double")) + 3).alias("x"))
    assert abs(power.fit(df, "x")) < 0.3


def test_bins_on_edges_and_outside(spark):
    train, test = frame(spark, [0.0, 3.0, 6.0, 9.0, None]), frame(spark, [-1.0, 3.0, 20.0, None])
    tr, te = bins.compute_binned(train, test, 3, "uniform", "x")
    assert column(tr, "bins_x_3_uniform") == [0.0, 1.0, 2.0, 2.0, None]
    assert column(te, "bins_x_3_uniform") == [0.0, 1.0, 2.0, None]


def test_quantile_bins_merge_equal_edges(spark):
    train = frame(spark, [1.0] * 8 + [2.0, 3.0])
    tr, _ = bins.compute_binned(train, train, 4, "quantile", "x")
    assert set(column(tr, "bins_x_4_quantile")) == {0.0}


def test_kmeans_bins_separate_clusters(spark):
    train = frame(spark, [1.0, 1.1, 5.0, 5.1, 9.0, 9.1])
    tr, _ = bins.compute_binned(train, train, 3, "kmeans", "x")
    assert column(tr, "bins_x_3_kmeans") == [0.0, 0.0, 1.0, 1.0, 2.0, 2.0]


def test_bin_specs_of_six_columns(spark):
    assert len(bins.all_specs(["a", "b", "c", "d", "e", "f"])) == 324


def test_quantiles_interpolate_and_skip_missing(spark):
    got = {(r["q"]): r["value"] for r in quantiles(frame(spark, [4.0, 1.0, None, 3.0, 2.0, NAN]), ["x"], [0.0, 0.5, 0.9]).collect()}
    assert got == {0.0: 1.0, 0.5: 2.5, 0.9: pytest.approx(3.7)}


def test_csv_sources(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("User_ID,Gender,Height,Calories\n1,male,170.50,10\n2,female,,20\n")
    schema = "User_ID int, Gender string, Height double, Calories double"
    features, target = load_frame(spark, path, id="User_ID", target="Calories", schema=schema)
    assert features.columns == ["id", "Gender", "Height"] and [r["y"] for r in target.collect()] == [10.0, 20.0]
    from pyspark.sql.types import StructType
    text = load_as_text(spark, path, ["Height"], id="User_ID", schema=StructType.fromDDL(schema))
    assert [r["Height"] for r in text.orderBy("id").collect()] == ["170.50", None]
    ext = load_external(spark, path, {"Gender": "Sex"}, ["User_ID"], schema=schema)
    assert ext.columns == ["Sex", "Height", "Calories"]
    with pytest.raises(ValueError):
        load_frame(spark, path, id="User_ID")


def test_nan_becomes_null_at_read(spark):
    assert [r["x"] for r in nulls_for_nan(frame(spark, [NAN, 1.0])).orderBy("id").collect()] == [None, 1.0]
