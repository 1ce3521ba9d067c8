"""Feature creation runs: build a family of features for train and test and save each one.

``train`` and ``test`` carry an ``id``; every function returns the names it saved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from foldsmith.functions import bins, scalar
from foldsmith.operators import encoders, external as ext, metrics
from foldsmith.operators.lookup import align_on_id
from foldsmith.operators.ordering import groupby_then_rank
from foldsmith.sources.feature_store import FeatureStore


def _save_all(store: FeatureStore, train: DataFrame, test: DataFrame, names: Mapping[str, Sequence[str]],
              **meta: object) -> list[str]:
    """Save the columns ``{name: source columns}`` in one write."""
    if names:
        store.save_many(train, test, {n: {**meta, "feature_list": list(s)} for n, s in names.items()})
    return list(names)


def create_pair_features(store: FeatureStore, train: DataFrame, test: DataFrame, pairs: Sequence[tuple[str, str]],
                         ops: Sequence[str] = tuple(scalar.PAIR_OPS), combine: Sequence[tuple[str, str]] = (),
                         group_means: Sequence[tuple[str, str]] = (), group_ranks: Sequence[tuple[str, str]] = (),
                         max_corr: float = 0.9999999) -> list[str]:
    """Arithmetic, combined keys, group means and group ranks of column pairs.

    Numeric columns that repeat an earlier one (correlation on train above ``max_corr``) are left out.
    Group features are ``(value, key)`` pairs fitted on train; ranks are taken inside each frame.
    """
    sources = {f"{op}_{a}_{b}": (a, b) for op in ops for a, b in pairs}
    train, test = (scalar.autofe_arith(df, pairs, ops) for df in (train, test))
    for value, key in group_means:
        train, test = encoders.groupby_then_mean(train, value, key, test)
        sources[f"groupby_then_mean_{value}_by_{key}"] = (value, key)
    for value, key in group_ranks:
        train, test = groupby_then_rank(train, value, key), groupby_then_rank(test, value, key)
        sources[f"groupby_then_rank_{value}_by_{key}"] = (value, key)
    if len(sources) > 1:
        report = metrics.drop_correlated(train, list(sources), max_corr).filter("dropped").collect()
        for row in report:
            del sources[row["column_name"]]
    train, test = (scalar.autofe_combine(df, combine) if combine else df for df in (train, test))
    sources.update({f"Combine_{a}_{b}": (a, b) for a, b in combine})
    return _save_all(store, train, test, sources, type="autofe", subtype="pair features", fillna=False)


def create_polynomials(store: FeatureStore, train: DataFrame, test: DataFrame, cols: Sequence[str]) -> list[str]:
    before = set(train.columns)
    train, test = scalar.polynomial_features(train, cols), scalar.polynomial_features(test, cols)
    names = {c: list(cols) for c in train.columns if c not in before}
    return _save_all(store, train, test, names, type="polynomial", subtype="degree 3", fillna=False)


def create_masked(store: FeatureStore, train: DataFrame, test: DataFrame, features: Sequence[str], cat: str,
                  names: Mapping[object, str]) -> list[str]:
    train, test = (scalar.masked_by_category(df, features, cat, names) for df in (train, test))
    made = {f"masked_{f}_x_{n}": (f, cat) for f in features for n in names.values()}
    return _save_all(store, train, test, made, type="masked feature", subtype=f"masked feature by {cat}", fillna=False)


def create_bins(store: FeatureStore, train: DataFrame, test: DataFrame, cols: Sequence[str],
                bin_counts: range = range(3, 21), strategies: Sequence[str] = bins.STRATEGIES) -> list[str]:
    specs = bins.all_specs(list(cols), bin_counts, tuple(strategies))
    edges = bins.fit_all(train, specs)
    metas = {}
    for spec in specs:
        n_bins, strategy, col = spec
        train, test = bins.compute_binned(train, test, n_bins, strategy, col, edges[spec])
        metas[f"bins_{col}_{n_bins}_{strategy}"] = {
            "type": "binning", "n_bins": n_bins, "strategy": strategy, "feature_list": [col], "fillna": False,
            "subtype": f"binning with {n_bins} bins and {strategy} strategy"}
    names = list(metas)
    # a projection of some hundred sums would outgrow one generated class
    for start in range(0, len(names), 54):
        store.save_many(train, test, {n: metas[n] for n in names[start:start + 54]})
    return names


def create_external_maps(store: FeatureStore, train: DataFrame, test: DataFrame, external: DataFrame, columns: Sequence[str],
                         target: str, agg: str, sizes: Sequence[int] | None = None, scale: int | None = None, at_once: int = 16) -> list[str]:
    """Aggregates of the external target for every key combination, with the share of rows left empty.

    All aggregates are rolled up together, and so are the shares. Lookups go into the rows ``at_once`` at a time, and each such
    group is one write and one catalog entry.
    """
    found = ext.external_aggregates(external, columns, target, agg, sizes, scale)
    quotas = {r["combo"]: float(r["nan_quota"]) for r in ext.map_quotas(found, train, test).select("combo", "nan_quota").collect()}
    saved = []
    wanted = ext.combos(columns, sizes)
    for start in range(0, len(wanted), at_once):
        some, (tr, te) = wanted[start:start + at_once], (df.select("id", *columns) for df in (train, test))
        for keys in some:
            name = ext.feature_name(keys, agg)
            tr, te = (found.attach(df, keys, name) for df in (tr, te))
        metas = {ext.feature_name(keys, agg): {"type": "map_original", "subtype": f"map original targets {agg}", "agg": agg, "feature_list": list(keys),
                                               "nan_quota": quotas.get("_".join(keys), 1.0), "fillna": False} for keys in some}
        store.save_many(tr, te, metas)
        saved += metas
    return saved


def create_target_encodings(store: FeatureStore, train: DataFrame, test: DataFrame, target: str,
                            combinations: Sequence[Sequence[str]], n_splits: int = 5, smooth: float = 0.0,
                            scale: int | None = None, fold_col: str = "fold", at_once: int = 12) -> list[str]:
    """Flat out-of-fold encodings of every combination; ``at_once`` of them are fitted, looked up and written together."""
    saved = []
    for some in _groups(combinations, at_once):
        columns = list(dict.fromkeys(c for cols in some for c in cols))
        tr, te = encoders.target_encode_many(train.select("id", fold_col, target, *columns), test.select("id", *columns), target, some,
                                             n_splits=n_splits, smooth=smooth, scale=scale, fold_col=fold_col)
        metas = {encoders.te_name(cols): {"type": "te", "agg": "mean", "inner_folds": n_splits, "subtype": "te_mean not folded without fillna",
                                          "smooth": smooth, "fillna": False, "feature_list": list(cols)} for cols in some}
        store.save_many(tr, te, metas)
        saved += metas
    return saved


def create_nested_target_encodings(store: FeatureStore, train: DataFrame, test: DataFrame, target: str,
                                   combinations: Sequence[Sequence[str]], outer: int = 5, inner: int = 4,
                                   smooth: float = 0.0, scale: int | None = None, at_once: int = 6) -> list[str]:
    """Encodings for every outer fold, stored by fold and part; ``at_once`` of them are fitted, looked up and written together."""
    saved = []
    for some in _groups(combinations, at_once):
        rows = encoders.target_encode_nested_many(train, test, target, some, outer, inner, smooth=smooth, scale=scale)
        metas = {encoders.te_name(cols) + "_by_fold": {
            "type": "te", "subtype": "te_mean without fillna", "feature_list": list(cols), "agg": "mean",
            "outer_folds": outer, "inner_folds": inner, "smooth": smooth, "fillna": False} for cols in some}
        store.save_folded_many(rows.withColumnsRenamed({encoders.te_name(cols): encoders.te_name(cols) + "_by_fold" for cols in some}), metas)
        saved += metas
    return saved


def _groups(items: Sequence, size: int) -> list[list]:
    """Neighbours in the order of their columns together, so that a group has few columns and shares its roll-up."""
    ordered = sorted(items, key=lambda cols: list(cols))
    return [ordered[i:i + size] for i in range(0, len(ordered), size)]


def candidate_pairs(df: DataFrame, columns: Sequence[str], max_nunique_if_numeric: int | None = None) -> dict[str, list[tuple[str, str]]]:
    """Column pairs worth a feature each, by kind, from the columns' types and one aggregate of distinct counts.

    ``arith``: two numbers; ``combine``: two columns that are categories, i.e. text, or numbers of at most
    ``max_nunique_if_numeric`` values; ``group``: (a number, a category). Columns of a single value take part in none, and of two numbers
    that are categories both kinds are listed.
    """
    counts = {r["column_name"]: r["nunique"] for r in ext.column_nunique(df, columns).collect()}
    types = dict(df.select(*columns).dtypes)
    varied = [c for c in columns if counts[c] > 1]
    numbers = [c for c in varied if types[c] not in ("string", "boolean", "date") and not types[c].startswith("timestamp")]
    categories = [c for c in varied if c not in numbers or (max_nunique_if_numeric is not None and counts[c] <= max_nunique_if_numeric)]
    return {"arith": list(combinations(numbers, 2)), "combine": list(combinations(categories, 2)),
            "group": [(value, key) for value in numbers for key in categories if key != value]}


def search_pair_features(store: FeatureStore, train: DataFrame, test: DataFrame, columns: Sequence[str], ops: Sequence[str] = tuple(scalar.PAIR_OPS),
                         max_nunique_if_numeric: int | None = 50, max_corr: float = 0.9999999, unary: bool = True, at_once: int = 60) -> list[str]:
    """Find the pairs of ``columns`` from their types and distinct counts, and store the features that repeat none before.

    Candidates come in blocks of ``at_once``: a block is computed, compared with itself, the columns and all features stored so far
    by one pass of correlations, and what is left is written as a family.
    """
    pairs = candidate_pairs(train, columns, max_nunique_if_numeric)
    numbers = sorted({c for pair in pairs["arith"] for c in pair}, key=list(columns).index)
    made: list[tuple[str, tuple[str, ...], str]] = [(f"Log_{c}", (c,), "unary") for c in numbers] if unary else []
    made += [(f"{op}_{a}_{b}", (a, b), "arith") for op in ops for a, b in pairs["arith"]]
    made += [(f"groupby_then_mean_{v}_by_{k}", (v, k), "mean") for v, k in pairs["group"]]
    made += [(f"groupby_then_rank_{v}_by_{k}", (v, k), "rank") for v, k in pairs["group"]]

    def computed(block: Sequence[tuple[str, tuple[str, ...], str]], tr: DataFrame, te: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = [name for name, *_ in block]
        tr, te = (scalar.autofe_unary(df, [s[0] for _, s, kind in block if kind == "unary"], include_log=True) for df in (tr, te))
        arith = list(dict.fromkeys(s for _, s, kind in block if kind == "arith"))
        used = [op for op in ops if any(name.startswith(f"{op}_") for name in wanted)]
        if arith:
            tr, te = (scalar.autofe_arith(df, arith, used) for df in (tr, te))
        for _, (value, key), kind in (b for b in block if b[2] in ("mean", "rank")):
            if kind == "mean":
                tr, te = encoders.groupby_then_mean(tr, value, key, te)
            else:
                tr, te = groupby_then_rank(tr, value, key), groupby_then_rank(te, value, key)
        return tr, te

    kept: list[tuple[str, tuple[str, ...], str]] = []
    base_train, base_test = train.select("id", *columns), test.select("id", *columns)
    for start in range(0, len(made), at_once):
        block = made[start:start + at_once]
        known = [name for name, *_ in kept]
        tr, te = computed(block, base_train, base_test)
        names = [name for name, *_ in block]
        before = [store.read_features(known)[0]] if known else []
        rows = align_on_id(tr.select(F.col("id").cast("string").alias("id"), *numbers, *names), *before, validate=False)
        report = metrics.drop_correlated(rows, [*numbers, *known, *names], max_corr).filter("dropped").select("column_name").collect()
        gone = {r["column_name"] for r in report}
        left = [b for b in block if b[0] not in gone]
        _save_all(store, tr, te, {name: sources for name, sources, _ in left}, type="autofe", subtype="pair search", fillna=False)
        kept += left
    if pairs["combine"]:
        combined = {f"Combine_{a}_{b}": (a, b) for a, b in pairs["combine"]}
        tr, te = (scalar.autofe_combine(df, pairs["combine"]) for df in (base_train, base_test))
        _save_all(store, tr, te, combined, type="autofe", subtype="pair search", fillna=False)
        return [name for name, *_ in kept] + list(combined)
    return [name for name, *_ in kept]
