"""Row-wise features.  Every function adds all of its columns in one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from foldsmith.functions.exact import hashed_uniform
from foldsmith.operators.ordering import quantile_row


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value.cast("double")), value)


def encode_binary(df: DataFrame, col: str, mapping: Mapping[str, int]) -> DataFrame:
    """Replace a two-valued column by its code; any other value becomes NULL."""
    code = reduce(lambda acc, kv: acc.when(F.col(col) == kv[0], kv[1]), mapping.items(), F.when(F.lit(False), 0))
    return df.withColumn(col, code)


def round_columns(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Round half to even; ``where`` limits rounding to some rows (the train split)."""
    rounded = {c: F.bround(F.col(c), 0) for c in cols}
    if where is not None:
        rounded = {c: F.when(where, r).otherwise(F.col(c)) for c, r in rounded.items()}
    return df.withColumns(rounded)


def bounded(value: Column, lower: float | Column | None = None, upper: float | Column | None = None) -> Column:
    """Clip; NULL and NaN give NULL rather than a bound."""
    out = nan_to_null(value)
    lower = F.lit(lower) if isinstance(lower, (int, float)) else lower
    upper = F.lit(upper) if isinstance(upper, (int, float)) else upper
    if lower is not None:
        out = F.when(out < lower, lower).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, upper).otherwise(out)
    return out


def clip(df: DataFrame, cols: Sequence[str], lower: float | None = None, upper: float | None = None) -> DataFrame:
    return df.withColumns({c: bounded(F.col(c), lower, upper) for c in cols})


def log_target(df: DataFrame, col: str, inverse: bool = False) -> DataFrame:
    return df.withColumn(col, F.expm1(col) if inverse else F.log1p(col))


def ratio_features(df: DataFrame, weight: str, height: str, heart_rate: str, duration: str, body_temp: str,
                   age: str) -> DataFrame:
    """Body-measure ratios and products; a zero divisor gives NULL."""
    w, h, hr, d, t, a = (F.col(c).cast("double") for c in (weight, height, heart_rate, duration, body_temp, age))
    metres = h / F.lit(100.0)
    bmi = F.try_divide(w, metres * metres)
    effort = hr * d
    max_rate = F.lit(220.0) - a
    return df.withColumns({
        "BMI": bmi,
        "Effort_Score": effort,
        "HR_per_min": F.try_divide(hr, d),
        "HeartRate_per_BodyTemp": F.try_divide(hr, t),
        "HR_age_ratio": F.try_divide(hr, a),
        "Weight_per_Height": F.try_divide(w, h),
        "Age_BMI": a * bmi,
        "BodyTemp_Duration": t * d,
        "Max_Heart_Rate": max_rate,
        "HeartRate_Max_HR_Ratio": F.try_divide(hr, max_rate),
        "Effort_Score_per_Duration": F.try_divide(effort, d),
        "Weight_Age": w * a,
        "Weight_per_BMI": F.try_divide(w, bmi),
    })


def guarded_ratio_flags(df: DataFrame, weight: str, height: str, thresholds: Mapping[str, tuple[str, float]],
                        eps: float = 1e-6) -> DataFrame:
    """BMI with a guarded divisor, and 0/1 flags ``{name: (column, threshold)}``; missing counts as above."""
    metres = F.col(height) / F.lit(100.0)
    flags = {name: F.when(nan_to_null(F.col(c)) <= t, 0).otherwise(1) for name, (c, t) in thresholds.items()}
    return df.withColumns({"BMI": F.col(weight) / (metres * metres + F.lit(eps)), **flags})


def pair_products(df: DataFrame, names: Sequence[str], separator: str = "_x_") -> DataFrame:
    """Products named ``A_x_B``; the operands are read from the name."""
    out = {}
    for name in names:
        left, right = name.split(separator)
        out[name] = F.col(left) * F.col(right)
    return df.withColumns(out)


def cut_bins_labels(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], out: str) -> DataFrame:
    """Right-closed intervals with labels; values outside all intervals give NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, text in zip(edges, edges[1:], labels):
        label = label.when((F.col(col) > low) & (F.col(col) <= high), text)
    return df.withColumn(out, label)


def masked_by_category(df: DataFrame, features: Sequence[str], cat: str, names: Mapping[object, str]) -> DataFrame:
    """For every feature and category value: the feature where the row is of that category, else 0."""
    out = {}
    for feature in features:
        for value, name in names.items():
            out[f"masked_{feature}_x_{name}"] = F.col(feature) * F.when(F.col(cat) == value, 1).when(F.col(cat).isNotNull(), 0)
    return df.withColumns(out)


def polynomial_features(df: DataFrame, cols: Sequence[str], degree: int = 3) -> DataFrame:
    """Interaction terms up to ``degree`` in which some column is squared, as float ``poly_A2_B`` columns."""
    out = {}
    for size in range(2, degree + 1):
        for term in combinations_with_replacement(cols, size):
            powers = {c: term.count(c) for c in dict.fromkeys(term)}
            if len(powers) < 2 or 2 not in powers.values():
                continue
            name = "poly_" + "_".join(c + (str(p) if p > 1 else "") for c, p in powers.items())
            out[name] = reduce(lambda a, b: a * b, [F.col(c).cast("double") for c in term]).cast("float")
    return df.withColumns(out)


PAIR_OPS = {
    "Plus": lambda a, b: a + b,
    "Minus": lambda a, b: a - b,
    "Multiply": lambda a, b: a * b,
    "Divide": F.try_divide,
    "Max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
}


def autofe_arith(df: DataFrame, pairs: Sequence[tuple[str, str]], ops: Sequence[str] = tuple(PAIR_OPS)) -> DataFrame:
    """Pairwise arithmetic named ``Op_A_B``."""
    return df.withColumns({f"{op}_{a}_{b}": PAIR_OPS[op](F.col(a).cast("double"), F.col(b).cast("double"))
                           for op in ops for a, b in pairs})


def autofe_combine(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Both values joined into one categorical value; NULL when either is missing."""
    return df.withColumns({f"Combine_{a}_{b}": F.concat(F.col(a).cast("string"), F.lit("_"), F.col(b).cast("string"))
                           for a, b in pairs})


def autofe_unary(df: DataFrame, cols: Sequence[str], include_log: bool = False, include_abs: bool = False) -> DataFrame:
    """Logarithm (NULL for values not above 0) and absolute value."""
    out = {}
    for c in cols:
        if include_log:
            out[f"Log_{c}"] = F.when(F.col(c) > 0, F.log(F.col(c).cast("double")))
        if include_abs:
            out[f"Abs_{c}"] = F.abs(F.col(c))
    return df.withColumns(out) if out else df


def decimal_digits(df: DataFrame, text_cols: Sequence[str], prefix: str = "decimal_digits_") -> DataFrame:
    """Number of digits after the point in the text form."""
    def digits(text: Column) -> Column:
        return F.when(text.isNull(), None).when(text.contains("."), F.length(F.split_part(text, F.lit("."), F.lit(2)))).otherwise(0)
    return df.withColumns({prefix + c: digits(F.col(c)) for c in text_cols})


def rate_target(df: DataFrame, target: str, col: str, out: str = "rate") -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(target), F.col(col)))


def rate_target_inverse(df: DataFrame, pred: str, col: str, bounds: tuple[float | None, float | None]) -> DataFrame:
    return df.withColumn(pred, bounded(F.col(pred) * F.col(col), *bounds))


def expected_from_ratio(df: DataFrame, target: str, col: str) -> DataFrame:
    """Expected target from the mean of ``target / col`` over all rows, and the residual."""
    factor = df.agg(F.avg(F.try_divide(F.col(target), F.col(col)))).scalar()
    return df.withColumns({"expected": F.col(col) * factor, "residual": F.col(target) - F.col(col) * factor})


def cap_outliers_iqr(train: DataFrame, test: DataFrame, columns: Sequence[str],
                     width: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Clip to the quartiles of train widened by ``width`` interquartile ranges, in both frames.

    A column without values in train has no quartiles and stays as it is.
    """
    fitted = quantile_row(train, columns, (0.25, 0.75)).first()

    def capped(c: str) -> Column:
        q1, q3 = fitted[c] or (None, None)
        if q1 is None:
            return F.col(c).cast("double")
        reach = width * (q3 - q1)
        return bounded(F.col(c).cast("double"), q1 - reach, q3 + reach)

    new = {c: capped(c) for c in columns}
    return train.withColumns(new), test.withColumns(new)


def segment_filter(df: DataFrame, cat: str, value: object) -> DataFrame:
    return df.filter(F.col(cat) == value)


def residual_filter(df: DataFrame, oof: str, target: str, q: float = 0.99, id_col: str = "id") -> DataFrame:
    """Ids whose absolute out-of-fold error is above the ``q`` quantile."""
    errors = df.select(id_col, F.abs(F.col(oof) - F.col(target)).alias("abs_error"))
    limit = quantile_row(errors, ["abs_error"], [q]).first()["abs_error"][0]
    return errors.filter(F.col("abs_error") > limit)


def sample_weight(df: DataFrame, cat: str, weights: Mapping[object, float], out: str = "sample_weight") -> DataFrame:
    weight = F.when(F.lit(False), F.lit(1.0))
    for value, w in weights.items():
        weight = weight.when(F.col(cat) == value, F.lit(float(w)))
    return df.withColumn(out, weight.otherwise(F.lit(1.0)))


def normal_from_hash(seed: int, column: str, id_col: str) -> Column:
    """Standard normal draw that depends only on seed, column name and id."""
    u1 = hashed_uniform(F.lit(seed), F.lit(column), F.lit("r"), F.col(id_col))
    u2 = hashed_uniform(F.lit(seed), F.lit(column), F.lit("a"), F.col(id_col))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)


def gaussian_noise(df: DataFrame, cols: Sequence[str], sd: float = 0.2, seed: int = 42, id_col: str = "id",
                   where: Column | None = None) -> DataFrame:
    """Add N(0, sd) noise, to the rows of ``where`` only (the training part of a fold)."""
    noisy = {c: F.col(c) + F.lit(float(sd)) * normal_from_hash(seed, c, id_col) for c in cols}
    if where is not None:
        noisy = {c: F.when(where, n).otherwise(F.col(c)) for c, n in noisy.items()}
    return df.withColumns(noisy)


def row_mean(df: DataFrame, cols: Sequence[str], out: str = "row_mean") -> DataFrame:
    """Mean over the non-missing values of a row."""
    present = [nan_to_null(F.col(c).cast("double")) for c in cols]
    count = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in present])
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in present])
    return df.withColumn(out, F.try_divide(total, count))


def narrow_floats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Store double columns as float."""
    names = [n for n, t in df.dtypes if t == "double"] if cols is None else list(cols)
    return df.withColumns({c: F.col(c).cast("float") for c in names})
