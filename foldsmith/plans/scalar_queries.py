"""Row-wise features."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.functions import bins, power, scalar
from foldsmith.operators import encoders
from foldsmith.operators.ordering import quantiles
from foldsmith.plans.registry import query
from foldsmith.plans.standin import (CENTS, frame, lineitem, model_frames, models_sql, sql, sql_cents, sql_hash,
                                     sql_mean, test, train)

MEASURES = ["line", "qty", "disc", "tax", "mon"]
QTY_MEAN = sql_mean(f"sum({sql_cents('qty')})", "count(qty)")


@query("encode_binary", sql("SELECT id, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS status, "
                            "CASE flag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END AS flag FROM f"))
def encode_binary(spark, sf):
    df = frame(spark, sf).select("id", "status", "flag")
    return scalar.encode_binary(scalar.encode_binary(df, "status", {"F": 0, "O": 1}), "flag", {"A": 0, "R": 1})


@query("round_columns", sql("SELECT id, split, CASE WHEN split = 'train' THEN round_even(y, 0) ELSE y END AS y, "
                            "CASE WHEN split = 'train' THEN round_even(tax * 50, 0) ELSE tax * 50 END AS half "
                            "FROM f WHERE split <> 'ext'"))
def round_columns(spark, sf):
    df = frame(spark, sf, "train", "test").select("id", "split", "y", (F.col("tax") * 50).alias("half"))
    return scalar.round_columns(df, ["y", "half"], where=F.col("split") == "train")


@query("clip", sql("SELECT id, CASE WHEN qty < 10 THEN 10.0::DOUBLE WHEN qty > 40 THEN 40.0::DOUBLE ELSE qty END AS qty, "
                   "CASE WHEN y < 20000 THEN 20000.0::DOUBLE ELSE y END AS y FROM f"))
def clip(spark, sf):
    df = scalar.clip(frame(spark, sf).select("id", "qty", "y"), ["qty"], 10.0, 40.0)
    return scalar.clip(df, ["y"], lower=20000.0)


@query("log_target", sql("SELECT id, round(ln(1 + y), 6) AS log_y, round(exp(ln(1 + y)) - 1, 4) AS back FROM train"))
def log_target(spark, sf):
    df = train(spark, sf).select("id", F.col("y").alias("log_y"))
    logged = scalar.log_target(df, "log_y").withColumn("back", F.col("log_y"))
    return scalar.log_target(logged, "back", inverse=True).select(
        "id", F.round("log_y", 6).alias("log_y"), F.round("back", 4).alias("back"))


RATIOS_SQL = """SELECT id, BMI, mon * qty AS Effort_Score, mon / nullif(qty, 0) AS HR_per_min,
 mon / nullif(tax, 0) AS HeartRate_per_BodyTemp, mon / nullif(line::DOUBLE, 0) AS HR_age_ratio,
 qty / nullif(disc, 0) AS Weight_per_Height, line * BMI AS Age_BMI, tax * qty AS BodyTemp_Duration,
 220.0::DOUBLE - line AS Max_Heart_Rate, mon / nullif(220.0::DOUBLE - line, 0) AS HeartRate_Max_HR_Ratio,
 (mon * qty) / nullif(qty, 0) AS Effort_Score_per_Duration, qty * line AS Weight_Age, qty / nullif(BMI, 0) AS Weight_per_BMI
FROM (SELECT *, qty / nullif((disc / 100.0::DOUBLE) * (disc / 100.0::DOUBLE), 0) AS BMI FROM f)"""


@query("ratio_features", sql(RATIOS_SQL))
def ratio_features(spark, sf):
    df = frame(spark, sf)
    wide = scalar.ratio_features(df, weight="qty", height="disc", heart_rate="mon", duration="qty", body_temp="tax",
                                 age="line")
    return wide.select("id", *[c for c in wide.columns if c not in df.columns])


@query("guarded_ratio_flags", sql("""SELECT id, qty / ((disc / 100.0::DOUBLE) * (disc / 100.0::DOUBLE) + 0.000001::DOUBLE) AS BMI,
 CASE WHEN tax <= 0.035::DOUBLE THEN 0 ELSE 1 END AS Tax_Binary, CASE WHEN mon <= 6.5::DOUBLE THEN 0 ELSE 1 END AS Mon_Binary FROM f"""))
def guarded_ratio_flags(spark, sf):
    df = scalar.guarded_ratio_flags(frame(spark, sf), "qty", "disc", {"Tax_Binary": ("tax", 0.035), "Mon_Binary": ("mon", 6.5)})
    return df.select("id", "BMI", "Tax_Binary", "Mon_Binary")


PAIRS = ["qty_x_mon", "qty_x_tax", "disc_x_qty", "mon_x_tax", "line_x_qty"]


@query("pair_products", sql("SELECT id, " + ", ".join(f"{n.split('_x_')[0]} * {n.split('_x_')[1]} AS {n}" for n in PAIRS) + " FROM f"))
def pair_products(spark, sf):
    return scalar.pair_products(frame(spark, sf), PAIRS).select("id", *PAIRS)


@query("deviation_from_mean", sql("SELECT id, split, qty - m AS qty_deviation FROM f JOIN "
                                  f"(SELECT split, {QTY_MEAN} AS m "
                                  "FROM f WHERE split <> 'ext' GROUP BY split) USING (split)"))
def deviation_from_mean(spark, sf):
    df = frame(spark, sf, "train", "test").select("id", "split", "qty")
    return encoders.deviation_from_mean(df, "qty", by="split", scale=CENTS).select("id", "split", "qty_deviation")


@query("cut_bins_labels", sql("SELECT id, CASE WHEN qty > 0 AND qty <= 15 THEN 'Short' WHEN qty > 15 AND qty <= 30 THEN 'Medium' "
                              "WHEN qty > 30 AND qty <= 45 THEN 'Long' END AS qty_label FROM f"))
def cut_bins_labels(spark, sf):
    df = scalar.cut_bins_labels(frame(spark, sf), "qty", [0, 15, 30, 45], ["Short", "Medium", "Long"], "qty_label")
    return df.select("id", "qty_label")


@query("masked_by_category", sql("SELECT id, " + ", ".join(
    f"{c} * CASE WHEN status = '{v}' THEN 1 ELSE 0 END AS masked_{c}_x_{v}" for c in MEASURES for v in "FO") + " FROM f"))
def masked_by_category(spark, sf):
    df = scalar.masked_by_category(frame(spark, sf), MEASURES, "status", {"F": "F", "O": "O"})
    return df.select("id", *[c for c in df.columns if c.startswith("masked_")])


def _poly_sql(cols):
    out = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out.append(f"CAST(CAST({a}::DOUBLE * {a} * {b} AS FLOAT) AS DOUBLE) AS poly_{a}2_{b}")
            out.append(f"CAST(CAST({a}::DOUBLE * {b} * {b} AS FLOAT) AS DOUBLE) AS poly_{a}_{b}2")
    return ", ".join(out)


@query("polynomial_features", sql(f"SELECT id, {_poly_sql(MEASURES)} FROM f"))
def polynomial_features(spark, sf):
    df = scalar.polynomial_features(frame(spark, sf), MEASURES)
    return df.select("id", *[F.col(c).cast("double").alias(c) for c in df.columns if c.startswith("poly_")])


ARITH = [("qty", "line"), ("mon", "tax")]
ARITH_SQL = {"Plus": "{a}::DOUBLE + {b}", "Minus": "{a}::DOUBLE - {b}", "Multiply": "{a}::DOUBLE * {b}",
             "Divide": "{a}::DOUBLE / nullif({b}::DOUBLE, 0)", "Max": "greatest({a}::DOUBLE, {b}::DOUBLE)"}


@query("autofe_arith", sql("SELECT id, " + ", ".join(e.format(a=a, b=b) + f" AS {op}_{a}_{b}" for op, e in ARITH_SQL.items()
                                                     for a, b in ARITH) + " FROM f"))
def autofe_arith(spark, sf):
    df = scalar.autofe_arith(frame(spark, sf), ARITH)
    return df.select("id", *[f"{op}_{a}_{b}" for op in ARITH_SQL for a, b in ARITH])


@query("autofe_combine", sql("SELECT id, status || '_' || qty::VARCHAR AS Combine_status_qty, "
                             "flag || '_' || mon::VARCHAR AS Combine_flag_mon FROM f"))
def autofe_combine(spark, sf):
    df = scalar.autofe_combine(frame(spark, sf), [("status", "qty"), ("flag", "mon")])
    return df.select("id", "Combine_status_qty", "Combine_flag_mon")


@query("autofe_unary", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS Log_c_acctbal,
 abs(c_acctbal) AS Abs_c_acctbal FROM customer""")
def autofe_unary(spark, sf):
    df = scalar.autofe_unary(spark.read.parquet(f"{sf}/customer.parquet"), ["c_acctbal"], include_log=True, include_abs=True)
    return df.select("c_custkey", F.round("Log_c_acctbal", 6).alias("Log_c_acctbal"), "Abs_c_acctbal")


@query("decimal_digits", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CAST(length(split_part(CAST(l_extendedprice AS VARCHAR), '.', 2)) AS INTEGER) AS decimal_digits_price FROM lineitem""")
def decimal_digits(spark, sf):
    df = lineitem(spark, sf).withColumn("price", F.col("l_extendedprice").cast("string"))
    return scalar.decimal_digits(df, ["price"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                       "decimal_digits_price")


@query("rate_target", sql("SELECT id, y / qty AS rate, CASE WHEN (y / qty) * qty < 1 THEN 1.0::DOUBLE WHEN (y / qty) * qty > 50000 "
                          "THEN 50000.0::DOUBLE ELSE (y / qty) * qty END AS back FROM train"))
def rate_target(spark, sf):
    df = scalar.rate_target(train(spark, sf), "y", "qty").withColumn("back", F.col("rate"))
    return scalar.rate_target_inverse(df, "back", "qty", (1.0, 50000.0)).select("id", "rate", "back")


@query("expected_from_ratio", sql("SELECT id, round(qty * k, 4) AS expected, round(y - qty * k, 4) AS residual "
                                  "FROM train, (SELECT avg(y / qty) AS k FROM train)"))
def expected_from_ratio(spark, sf):
    df = scalar.expected_from_ratio(train(spark, sf), "y", "qty")
    return df.select("id", F.round("expected", 4).alias("expected"), F.round("residual", 4).alias("residual"))


CAPPED = ["y", "qty", "disc"]


@query("cap_outliers_iqr", sql(
    "SELECT id, split, " + ", ".join(
        f"round(CASE WHEN {c} < {c}_q[1] - 0.5::DOUBLE * ({c}_q[2] - {c}_q[1]) THEN {c}_q[1] - 0.5::DOUBLE * ({c}_q[2] - {c}_q[1]) "
        f"WHEN {c} > {c}_q[2] + 0.5::DOUBLE * ({c}_q[2] - {c}_q[1]) THEN {c}_q[2] + 0.5::DOUBLE * ({c}_q[2] - {c}_q[1]) "
        f"ELSE {c} END, 6) AS {c}" for c in CAPPED) + " FROM f, lim WHERE split <> 'ext'",
    "lim AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.75]) AS {c}_q" for c in CAPPED) + " FROM train)"))
def cap_outliers_iqr(spark, sf):
    cols = ["id", "split", *CAPPED]
    # the data has no value beyond 1.5 ranges, so a narrower width is used to show the clipping
    tr, te = scalar.cap_outliers_iqr(train(spark, sf).select(*cols), test(spark, sf).select(*cols), CAPPED, width=0.5)
    return tr.unionByName(te).withColumns({c: F.round(c, 6) for c in CAPPED})


@query("segment_filter", sql("SELECT id, status, y FROM train WHERE status = 'F'"))
def segment_filter(spark, sf):
    return scalar.segment_filter(train(spark, sf), "status", "F").select("id", "status", "y")


@query("residual_filter", models_sql(
    "SELECT id, abs(m_qty - y) AS abs_error FROM oof_w WHERE abs(m_qty - y) > "
    "(SELECT quantile_cont(abs(m_qty - y), 0.99) FROM oof_w)"))
def residual_filter(spark, sf):
    return scalar.residual_filter(model_frames(spark, sf)[0], "m_qty", "y", 0.99)


@query("sample_weight", sql("SELECT id, CASE WHEN status = 'O' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sample_weight FROM train"))
def sample_weight(spark, sf):
    return scalar.sample_weight(train(spark, sf), "status", {"O": 2}).select("id", "sample_weight")


def _noise_sql(c):
    u1 = f"(({sql_hash(f"'42:{c}:r:' || id")})::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    u2 = f"(({sql_hash(f"'42:{c}:a:' || id")})::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    return f"round(CASE WHEN fold <> 0 THEN {c} + 0.2::DOUBLE * (sqrt(-2 * ln({u1})) * cos(2 * pi() * ({u2}))) ELSE {c} END, 6) AS {c}"


@query("gaussian_noise", sql(f"SELECT id, fold, {_noise_sql('qty')}, {_noise_sql('disc')} FROM train"))
def gaussian_noise(spark, sf):
    df = train(spark, sf).select("id", "fold", "qty", "disc")
    noisy = scalar.gaussian_noise(df, ["qty", "disc"], sd=0.2, where=F.col("fold") != 0)
    return noisy.select("id", "fold", F.round("qty", 6).alias("qty"), F.round("disc", 6).alias("disc"))


@query("as_category", sql("SELECT id, split, " + ", ".join(
    f"(SELECT code FROM codes_{c} k WHERE k.{c} = f.{c}) AS {c}_cat" for c in MEASURES) + " FROM f WHERE split <> 'ext'",
    *[f"codes_{c} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS code FROM "
      f"(SELECT DISTINCT {c} FROM f WHERE split <> 'ext'))" for c in MEASURES]))
def as_category(spark, sf):
    cols = ["id", "split", *MEASURES]
    tr, te = encoders.category_codes(train(spark, sf).select(*cols), test(spark, sf).select(*cols), MEASURES)
    return tr.unionByName(te).select("id", "split", *[f"{c}_cat" for c in MEASURES])


@query("row_mean", sql("SELECT id, (qty + disc + CASE WHEN tax > 0 THEN tax ELSE 0 END) / "
                       "(2 + CASE WHEN tax > 0 THEN 1 ELSE 0 END)::DOUBLE AS row_mean FROM f"))
def row_mean(spark, sf):
    df = frame(spark, sf).select("id", "qty", "disc", F.when(F.col("tax") > 0, F.col("tax")).alias("tax"))
    return scalar.row_mean(df, ["qty", "disc", "tax"]).select("id", "row_mean")


@query("narrow_floats", sql("SELECT id, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(disc AS FLOAT) AS DOUBLE) AS disc FROM f"))
def narrow_floats(spark, sf):
    df = scalar.narrow_floats(frame(spark, sf).select("id", "y", "disc"))
    return df.select("id", F.col("y").cast("double").alias("y"), F.col("disc").cast("double").alias("disc"))


YJ = """CASE WHEN {x} >= 0 THEN (pow({x} + 1, 0.3) - 1) / 0.3::DOUBLE ELSE -(pow(1 - {x}, 1.7) - 1) / 1.7::DOUBLE END"""


@query("yeo_johnson", "SELECT c_custkey, round(" + YJ.format(x="c_acctbal") + ", 6) AS transformed, "
       "round(c_acctbal, 4) AS back FROM customer")
def yeo_johnson(spark, sf):
    t = power.transform(F.col("c_acctbal"), 0.3)
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", F.round(t, 6).alias("transformed"), F.round(power.inverse(t, 0.3), 4).alias("back"))


@query("yeo_johnson_fit", sql("SELECT count(*) AS rows, TRUE AS no_near_exponent_is_likelier FROM train"))
def yeo_johnson_fit(spark, sf):
    """The fitted exponent against its neighbours on both sides, by likelihood."""
    df = train(spark, sf)
    lam = power.fit(df, "y")
    scores = power.log_likelihoods(df, "y", [lam, *[lam + d for d in (-0.1, -0.01, 0.01, 0.1)]])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(scores[0] == max(scores)).alias("no_near_exponent_is_likelier"))


def _code_sql(edges, col):
    return f"CAST(len([e for e in {edges} if e <= {col}]) AS DOUBLE)"


@query("bins_uniform", sql(
    f"SELECT id, split, {_code_sql('[i * ((hi - lo) / 15.0::DOUBLE) + lo for i in range(1, 15)]', 'y')} AS bins_y_15_uniform "
    "FROM f, (SELECT min(y) AS lo, max(y) AS hi FROM train) WHERE split <> 'ext'"))
def bins_uniform(spark, sf):
    cols = ["id", "split", "y"]
    tr, te = bins.compute_binned(train(spark, sf).select(*cols), test(spark, sf).select(*cols), 15, "uniform", "y")
    return tr.unionByName(te).drop("y")


@query("bins_quantile", sql(
    "SELECT id, split, CAST(len([e for e in ey if e > ylo AND e < yhi AND e <= y]) AS DOUBLE) AS bins_y_9_quantile, "
    "CAST(len([e for e in ed if e > dlo AND e < dhi AND e <= disc]) AS DOUBLE) AS bins_disc_20_quantile FROM f, "
    "(SELECT list_distinct(quantile_cont(y, [i / 9.0::DOUBLE for i in range(0, 10)])) AS ey, min(y) AS ylo, max(y) AS yhi, "
    "list_distinct(quantile_cont(disc, [i / 20.0::DOUBLE for i in range(0, 21)])) AS ed, min(disc) AS dlo, max(disc) AS dhi "
    "FROM train) WHERE split <> 'ext'"))
def bins_quantile(spark, sf):
    cols = ["id", "split", "y", "disc"]
    tr, te = bins.compute_binned(train(spark, sf).select(*cols), test(spark, sf).select(*cols), 9, "quantile", "y")
    tr, te = bins.compute_binned(tr, te, 20, "quantile", "disc")
    return tr.unionByName(te).drop("y", "disc")


KMEANS_SQL = """lloyd(i, c) AS (
  SELECT 0, [lo + (hi - lo) / 5 * (j + 0.5::DOUBLE) for j in range(5)] FROM (SELECT min(qty) AS lo, max(qty) AS hi FROM train)
  UNION ALL
  SELECT i + 1, (SELECT list(m ORDER BY code) FROM (
      SELECT code, sum(qty * n) / sum(n) AS m FROM (
        SELECT qty, n, len([e for e in [(c[j] + c[j + 1]) / 2 for j in range(1, 5)] if e <= qty]) AS code
        FROM (SELECT qty, count(*) AS n FROM train GROUP BY qty)) GROUP BY code))
  FROM lloyd WHERE i < 100)"""


@query("bins_kmeans", sql(
    f"SELECT id, split, {_code_sql('[(c[j] + c[j + 1]) / 2 for j in range(1, 5)]', 'qty')} AS bins_qty_5_kmeans "
    "FROM f, lloyd WHERE lloyd.i = 100 AND split <> 'ext'", KMEANS_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def bins_kmeans(spark, sf):
    cols = ["id", "split", "qty"]
    tr, te = bins.compute_binned(train(spark, sf).select(*cols), test(spark, sf).select(*cols), 5, "kmeans", "qty")
    return tr.unionByName(te).drop("qty")


@query("quantile", sql(
    "SELECT column_name, q, round(value, 6) AS value FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, unnest([0.25::DOUBLE, 0.75::DOUBLE, 0.99::DOUBLE]) AS q, "
        f"unnest(quantile_cont({c}, [0.25, 0.75, 0.99])) AS value FROM train" for c in ("y", "qty", "disc")) + ")"))
def quantile(spark, sf):
    # engines differ in the last bit of the interpolation
    return quantiles(train(spark, sf), ["y", "qty", "disc"], (0.25, 0.75, 0.99)).withColumn("value", F.round("value", 6))
