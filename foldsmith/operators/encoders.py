"""Encodings of keys: target means, frequencies, aggregates of an external table.

Each encoder fits one table with a row per key, written once, and attaches it to any number of
frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldsmith.functions.exact import mean, mean_of, mean_of_sql, quoted, units_sql
from foldsmith.operators.folds import inner_fold
from foldsmith.operators.lattice import roll_up
from foldsmith.operators.lookup import attach
from foldsmith.storage import materialize, write_table


def te_name(cols: Sequence[str]) -> str:
    return "te_mean_" + "_".join(cols)


class TargetEncoder:
    """Mean of the target per key combination, out-of-fold on the rows it was fitted on.

    One aggregate per combination holds the total and every fold's own part, so a row's encoding is
    the total minus its fold.  Unseen keys, and keys seen only in the row's own fold, give NULL
    unless ``fillna`` puts the overall mean there; ``smooth`` adds that many rows of overall mean.
    """

    def __init__(self, cols: Sequence[str], n_splits: int = 5, smooth: float = 0.0, fillna: bool = False,
                 scale: int | None = None, fold_col: str = "fold", id_col: str = "id"):
        self.cols, self.n_splits, self.smooth, self.fillna = list(cols), n_splits, smooth, fillna
        self.scale, self.fold_col, self.id_col = scale, fold_col, id_col
        self.out, self.n_bytes = te_name(self.cols), None

    def fit(self, train: DataFrame, target: str) -> "TargetEncoder":
        y, fold = quoted(target), quoted(self.fold_col)
        inside = [f"CASE WHEN {fold} = {k} THEN {y} END" for k in range(self.n_splits)]
        per_fold = ", ".join(f"struct(coalesce(sum({units_sql(v, self.scale)}), 0) AS s, count({v}) AS n)" for v in inside)
        self.table = materialize(train.groupBy(*self.cols).agg(
            F.expr(f"sum({units_sql(y, self.scale)})").alias("s"), F.expr(f"count({y})").alias("n"),
            F.count(F.lit(1)).alias("rows"), F.expr(f"array({per_fold})").alias("folds")))
        self._prior = self._overall() if self.smooth or self.fillna else None
        return self

    def _overall(self) -> Column:
        """Overall mean, and the one without each fold, from the fitted table."""
        parts = ", ".join(f"sum(folds[{k}].s) AS s{k}, sum(folds[{k}].n) AS n{k}" for k in range(self.n_splits))
        sums = self.table.selectExpr("sum(s) AS s", "sum(n) AS n", *parts.split(", "))
        without = ", ".join(mean_of_sql(f"(s - s{k})", f"(n - n{k})", self.scale) for k in range(self.n_splits))
        return sums.selectExpr(f"struct({mean_of_sql('s', 'n', self.scale)} AS all, array({without}) AS without) AS v").scalar()

    def _finish(self, joined: DataFrame, keep: Sequence[str], s: Column, n: Column, prior: Column | None) -> DataFrame:
        value = mean_of(s, n, self.scale, self.smooth, prior)
        if self.fillna:
            value = F.coalesce(value, prior)
        return joined.select(*keep, value.cast("float").alias(self.out))

    def transform_train(self, train: DataFrame) -> DataFrame:
        """Out-of-fold encoding of the fitted rows."""
        joined = attach(train, self.table, self.cols, ["s", "n", "folds"], weight="rows", spread=[self.id_col], n_bytes=self.n_bytes)
        own = F.get("folds", F.col(self.fold_col))
        prior = None if self._prior is None else F.get(self._prior["without"], F.col(self.fold_col))
        return self._finish(joined, train.columns, F.col("s") - own["s"], F.col("n") - own["n"], prior)

    def transform(self, df: DataFrame) -> DataFrame:
        """Encoding from all fitted rows, for rows that were not fitted on."""
        joined = attach(df, self.table, self.cols, ["s", "n"], spread=[self.id_col], n_bytes=self.n_bytes)
        return self._finish(joined, df.columns, F.col("s"), F.col("n"),
                            None if self._prior is None else self._prior["all"])


def target_encode_kfold(train: DataFrame, test: DataFrame, target: str, cols: Sequence[str],
                        **options) -> tuple[DataFrame, DataFrame]:
    """Flat encoding: out-of-fold for train, all of train for test."""
    encoder = TargetEncoder(cols, **options).fit(train, target)
    return encoder.transform_train(train), encoder.transform(test)


def target_encode_many(train: DataFrame, test: DataFrame, target: str, combinations: Sequence[Sequence[str]], n_splits: int = 5,
                       smooth: float = 0.0, fillna: bool = False, scale: int | None = None, fold_col: str = "fold",
                       id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Flat encodings of many combinations, a column each.

    The sums of all folds are rolled up together, every combination from the smallest computed one that contains it, so the
    training rows are aggregated once. Sizes measured then decide which tables are broadcast.
    """
    columns = list(dict.fromkeys(c for cols in combinations for c in cols))
    y, fold = quoted(target), quoted(fold_col)
    states: dict[str, tuple[Column, str]] = {"__rows": (F.count(F.lit(1)), "sum")}
    for k in range(n_splits):
        inside = f"CASE WHEN {fold} = {k} THEN {y} END"
        states[f"__s{k}"] = (F.expr(f"coalesce(sum({units_sql(inside, scale)}), 0)"), "sum")
        states[f"__n{k}"] = (F.expr(f"count({inside})"), "sum")
    lattice = roll_up(train.select(*columns, target, fold_col), columns, states, wanted=combinations)
    plus = lambda f: " + ".join(f"__{f}{k}" for k in range(n_splits))
    folds = ", ".join(f"struct(__s{k} AS s, __n{k} AS n)" for k in range(n_splits))
    prior = None
    for cols in combinations:
        encoder = TargetEncoder(cols, n_splits, smooth, fillna, scale, fold_col, id_col)
        encoder.table = lattice.table([lattice.id_of(cols)]).selectExpr(*map(quoted, cols), f"{plus('s')} AS s", f"{plus('n')} AS n", "__rows AS rows", f"array({folds}) AS folds")
        encoder.n_bytes = lattice.bytes_of(cols, 24 + 16 * n_splits)
        if smooth or fillna:
            prior = encoder._overall() if prior is None else prior  # the same from any combination
        encoder._prior = prior
        train, test = encoder.transform_train(train), encoder.transform(test)
    return train, test


def target_encode_nested(train: DataFrame, test: DataFrame, target: str, cols: Sequence[str], outer: int = 5,
                         inner: int = 4, **options) -> DataFrame:
    """Encoding for every outer fold as ``(id, outer_fold, part, te)``; see `target_encode_nested_many`."""
    return target_encode_nested_many(train, test, target, [cols], outer, inner, **options)


def target_encode_nested_many(train: DataFrame, test: DataFrame, target: str, combinations: Sequence[Sequence[str]], outer: int = 5,
                              inner: int = 4, seed: int = 42, smooth: float = 0.0, fillna: bool = False,
                              scale: int | None = None, fold_col: str = "fold", id_col: str = "id") -> DataFrame:
    """Encodings of many combinations for every outer fold as ``(id, outer_fold, part, te, ...)``.

    ``part`` is train (out-of-inner-fold means of the outer training rows), val and test (means over
    the whole outer training part).  Each row adds to the sums of the outer folds it trains in, without being
    copied; the sums of all combinations are rolled up together, and the rows are repeated for the outer folds once, behind
    all lookups.
    """
    combinations = [list(cols) for cols in combinations]
    columns = list(dict.fromkeys(c for cols in combinations for c in cols))
    y, own = quoted(target), quoted(fold_col)
    rows = train.select(id_col, *columns, target, fold_col,
                        *[inner_fold(o, inner, seed, id_col).alias(f"__inner_{o}") for o in range(outer)])
    states: dict[str, tuple[Column, str]] = {"__rows": (F.count(F.lit(1)), "sum")}
    for o in range(outer):
        for j in range(inner):
            inside = f"CASE WHEN {own} <> {o} AND __inner_{o} = {j} THEN {y} END"
            states[f"__s{o * inner + j}"] = (F.expr(f"coalesce(sum({units_sql(inside, scale)}), 0)"), "sum")
            states[f"__n{o * inner + j}"] = (F.expr(f"count({inside})"), "sum")
    lattice = roll_up(rows, columns, states, wanted=combinations)
    with_prior = bool(smooth or fillna)
    if with_prior:
        sums = ", ".join(f"struct(sum(__s{i}) AS s, sum(__n{i}) AS n)" for i in range(outer * inner))
        prior = lattice.table([lattice.id_of(combinations[0])]).agg(F.expr(f"array({sums})")).scalar()

    def add(array: str, field: str, o: int, without: int | None) -> str:
        return "(" + " + ".join(f"{array}[{o * inner + j}].{field}" for j in range(inner) if j != without) + ")"

    def encoded(i: int, o: int, without: int | None) -> str:
        """Mean of combination ``i`` over the inner folds of outer fold ``o`` other than ``without``."""
        overall = None
        if with_prior:
            overall = mean_of_sql(add("__prior", "s", o, without), add("__prior", "n", o, without), scale)
        value = mean_of_sql(add(f"__cells_{i}", "s", o, without), add(f"__cells_{i}", "n", o, without), scale, smooth, overall)
        return f"coalesce({value}, {overall})" if fillna else value

    # a key's encodings of all outer folds, leaving out each inner fold or (last) none, are worked out once a key and not once a row
    cases = [(o, j) for o in range(outer) for j in (*range(inner), None)]

    def value(i: int, o: int, at: str) -> str:
        """Encoding of a row by combination ``i``; ``at`` is its inner fold, or the number of them for none."""
        found = f"__te_{i}[{o * (inner + 1)} + {at}]"
        return f"coalesce({found}, __overall[{o * (inner + 1)} + {at}])" if fillna else found

    def cell(o: int, at: str, part: str) -> str:
        values = [f"{value(i, o, at)} AS {quoted(te_name(cols))}" for i, cols in enumerate(combinations)]
        return f"struct({o} AS outer_fold, {part} AS part, {', '.join(values)})"

    def long(joined: DataFrame, cells: Sequence[str]) -> DataFrame:
        if fillna:
            overall = [f"cast({mean_of_sql(add('__prior', 's', o, j), add('__prior', 'n', o, j), scale)} AS float)" for o, j in cases]
            joined = joined.withColumn("__prior", prior).withColumn("__overall", F.expr(f"array({', '.join(overall)})"))
        return joined.select(id_col, F.expr(f"explode(array({', '.join(cells)}))").alias("c")).select(id_col, "c.*")

    cells = ", ".join(f"struct(__s{i} AS s, __n{i} AS n)" for i in range(outer * inner))
    fitted, others = rows, test.select(id_col, *columns)
    for i, cols in enumerate(combinations):
        table = lattice.table([lattice.id_of(cols)]).selectExpr(*map(quoted, cols), "__rows", f"array({cells}) AS __cells_{i}")
        if with_prior:
            table = table.withColumn("__prior", prior)
        values = ", ".join(f"cast({encoded(i, o, j)} AS float)" for o, j in cases)
        table = write_table(table.selectExpr(*map(quoted, cols), "__rows", f"array({values}) AS __te_{i}"), "encodings")
        size = lattice.bytes_of(cols, 32 + 4 * len(cases))
        fitted = attach(fitted, table, cols, [f"__te_{i}"], weight="__rows", spread=[id_col], n_bytes=size)
        others = attach(others, table, cols, [f"__te_{i}"], spread=[id_col], n_bytes=size)
    own_fold = [(f"CASE WHEN {own} = {o} THEN {inner} ELSE __inner_{o} END", f"CASE WHEN {own} = {o} THEN 'val' ELSE 'train' END") for o in range(outer)]
    return long(fitted, [cell(o, *facts) for o, facts in enumerate(own_fold)]).unionByName(
        long(others, [cell(o, str(inner), "'test'") for o in range(outer)]))


def groupby_then_mean(train: DataFrame, value: str, key: str, *frames: DataFrame, fit_on: str = "train",
                      scale: int | None = None) -> list[DataFrame]:
    """Add the mean of ``value`` per ``key`` to train and ``frames``; fitted on train or on each own frame."""
    out = f"groupby_then_mean_{value}_by_{key}"

    def fitted(df: DataFrame) -> DataFrame:
        return materialize(df.groupBy(key).agg(mean(F.col(value), scale).alias(out), F.count(F.lit(1)).alias("rows")))

    table = fitted(train)
    out_frames = [attach(train, table, [key], [out], weight="rows")]
    for df in frames:
        out_frames.append(attach(df, table, [key], [out]) if fit_on == "train"
                          else attach(df, fitted(df), [key], [out], weight="rows"))
    return out_frames


def deviation_from_mean(df: DataFrame, col: str, by: str = "split", out: str | None = None,
                        scale: int | None = None) -> DataFrame:
    """Value minus the mean of the row's own split."""
    table = materialize(df.groupBy(by).agg(mean(F.col(col), scale).alias("__mean"), F.count(F.lit(1)).alias("rows")))
    joined = attach(df, table, [by], ["__mean"], weight="rows")
    return joined.withColumn(out or f"{col}_deviation", F.col(col) - F.col("__mean")).drop("__mean")


class FrequencyEncoder:
    """Rows per value over the given frames, missing values counted as a value of their own.

    All columns are counted in one pass (one grouping set per column), and the sizes of their tables are measured in another.
    """

    def __init__(self, columns: Sequence[str], prefix: str = "freq_"):
        self.columns, self.prefix = list(columns), prefix

    def fit(self, *frames: DataFrame) -> "FrequencyEncoder":
        rows = frames[0].select(*self.columns)
        for frame in frames[1:]:
            rows = rows.unionByName(frame.select(*self.columns))
        counts = rows.groupingSets([[c] for c in self.columns], *self.columns).agg(
            F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"__not_{c}") for c in self.columns])
        self.table = materialize(counts)
        own = [F.col(f"__not_{c}") == 0 for c in self.columns]
        width = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 24 for c in self.columns]
        sizes = self.table.agg(*[F.sum(F.when(o, w)).alias(f"b{i}") for i, (o, w) in enumerate(zip(own, width))]).first()
        self.bytes = {c: sizes[f"b{i}"] or 0 for i, c in enumerate(self.columns)}
        return self

    def encode(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            counts = self.table.filter(F.col(f"__not_{c}") == 0).select(c, F.col("n").alias(self.prefix + c))
            df = attach(df, counts, [c], [self.prefix + c], n_bytes=self.bytes[c])
        return df


def frequency_encode(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    encoder = FrequencyEncoder(columns).fit(train, test)
    return encoder.encode(train), encoder.encode(test)


def frequency_encode_external(external: DataFrame, columns: Sequence[str], *frames: DataFrame) -> list[DataFrame]:
    encoder = FrequencyEncoder(columns).fit(external)
    return [encoder.encode(f) for f in frames]


def category_codes(train: DataFrame, test: DataFrame, cols: Sequence[str],
                   suffix: str = "_cat") -> tuple[DataFrame, DataFrame]:
    """Category codes shared by train and test: the position of the value among all values, whatever its type."""
    from foldsmith.operators.ordering import dense_codes

    for c in cols:
        codes = materialize(dense_codes(train.select(c).unionByName(test.select(c)), c))
        table = codes.select(F.col("value").alias("__v"), F.col("code").alias(c + suffix), "n")
        train, test = (attach(df.withColumn("__v", F.col(c)), table, ["__v"], [c + suffix], weight="n").drop("__v")
                       for df in (train, test))
    return train, test
