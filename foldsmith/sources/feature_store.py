"""Features stored by families, with a queryable catalog.

The columns of one save are a family: a wide table below ``features/<family>/split=...`` or
``folded/<family>/outer_fold=.../part=...``, in buckets of the id. All families of a store have the same number of buckets, so
their columns come together bucket by bucket, without a shuffle. The catalog is a small append-only table; it maps
a column to its family, and the newest row of a column name wins. A save is seen once its catalog row is there.
"""

from __future__ import annotations

import hashlib
import logging
import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from foldsmith.functions.exact import quoted

log = logging.getLogger(__name__)

CATALOG = StructType([
    StructField("column_name", StringType()), StructField("filename_prefix", StringType()),
    StructField("type", StringType()), StructField("subtype", StringType()), StructField("description", StringType()),
    StructField("feature_list", ArrayType(StringType())), StructField("agg", StringType()),
    StructField("outer_folds", IntegerType()), StructField("inner_folds", IntegerType()),
    StructField("smooth", DoubleType()), StructField("n_bins", IntegerType()), StructField("strategy", StringType()),
    StructField("nan_quota", DoubleType()), StructField("dtype", StringType()), StructField("fillna", BooleanType()),
    StructField("created_at", TimestampNTZType()), StructField("created_by", StringType()),
])

# where a column lies, and how many rows and which ids (an order-free checksum) its family has, part by part
PLACE = StructType([StructField("family", StringType()), StructField("buckets", IntegerType()), StructField("ids", StringType()),
                    StructField("saved_ns", LongType())])
STORED_CATALOG = StructType([*CATALOG.fields, *PLACE.fields])


class MissingFeatures(ValueError):
    """Requested features are not in the catalog."""


def newest(catalog: DataFrame) -> DataFrame:
    """One row per column name: the last one saved."""
    order = W.partitionBy("column_name").orderBy(F.desc("created_at"), F.desc("filename_prefix"))
    return catalog.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("created_at"), "column_name")


def by_criteria(catalog: DataFrame, criteria: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose fields are among the given values, e.g. ``{"type": ("te",), "subtype": (...)}``."""
    for field, values in criteria.items():
        catalog = catalog.filter(F.col(field).isin(list(values)))
    return catalog


def by_feature_lists(catalog: DataFrame, feature_lists: Sequence[Sequence[str]]) -> DataFrame:
    """Rows made from exactly one of the given column sets, in any order."""
    wanted = [F.array(*[F.lit(c) for c in sorted(set(f))]) for f in feature_lists]
    return catalog.filter(F.array_sort(F.array_distinct("feature_list")).isin(wanted))


def missing(catalog: DataFrame, column_names: Sequence[str]) -> DataFrame:
    """Requested names without a catalog row."""
    wanted = catalog.sparkSession.createDataFrame([(n,) for n in column_names], "column_name string")
    return wanted.join(catalog, "column_name", "left_anti")


def missing_feature_lists(catalog: DataFrame, feature_lists: Sequence[Sequence[str]]) -> DataFrame:
    wanted = catalog.sparkSession.createDataFrame([(sorted(set(f)),) for f in feature_lists], "wanted array<string>")
    have = catalog.select(F.array_sort(F.array_distinct("feature_list")).alias("wanted"))
    return wanted.join(have, "wanted", "left_anti")


def overview(catalog: DataFrame) -> DataFrame:
    """Saved features per type and subtype, plain and folded apart."""
    return catalog.groupBy("type", "subtype", F.col("outer_folds").isNotNull().alias("folded")).agg(
        F.count(F.lit(1)).alias("features"), F.max("created_at").alias("newest"))


class FeatureStore:
    """A store below ``path``. ``buckets`` (default: the session's shuffle partitions) counts for the first save; later
    saves take over the store's number."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    # -- catalog ------------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop_path)

    def _entries(self) -> DataFrame:
        """One row per stored prefix: of an overwritten feature, the row saved last."""
        if not self._exists("catalog"):
            return self.spark.createDataFrame([], STORED_CATALOG)
        rows = self.spark.read.schema(STORED_CATALOG).parquet(f"{self.path}/catalog")
        last = W.partitionBy("filename_prefix").orderBy(F.desc("saved_ns"))
        return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")

    def catalog(self) -> DataFrame:
        return self._entries().select(*CATALOG.names)

    def _register(self, metas: Sequence[Mapping[str, object]]) -> None:
        rows = []
        for meta in metas:
            row = {f.name: meta.get(f.name) for f in STORED_CATALOG.fields} | {"saved_ns": time.time_ns()}
            row["created_at"] = row["created_at"] or datetime.now(timezone.utc).replace(tzinfo=None)
            if row["smooth"] is not None:
                row["smooth"] = float(row["smooth"])
            rows.append(tuple(row[f.name] for f in STORED_CATALOG.fields))
        known = self.catalog().filter(F.col("filename_prefix").isin([m["filename_prefix"] for m in metas]))
        for old in known.select("filename_prefix").collect():
            log.warning("%s already exists, overwriting", old[0])
        self.spark.createDataFrame(rows, STORED_CATALOG).coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")

    def overview(self) -> DataFrame:
        return overview(self.catalog())

    def _chosen(self, column_names, criteria, feature_lists=None, agg=None, folded=False) -> DataFrame:
        have = self._entries()
        have = have.filter(F.col("outer_folds").isNotNull() if folded else F.col("outer_folds").isNull())
        if column_names is not None:
            absent = [r[0] for r in missing(have, column_names).collect()]
            if absent:
                raise MissingFeatures(f"no features named {sorted(absent)}")
            have = have.filter(F.col("column_name").isin(list(column_names)))
        if feature_lists is not None:
            absent = [r[0] for r in missing_feature_lists(have, feature_lists).collect()]
            if absent:
                raise MissingFeatures(f"no features made from {absent}")
            have = by_feature_lists(have, feature_lists)
        if criteria:
            have = by_criteria(have, criteria)
        if agg is not None:
            have = have.filter(F.col("agg").isin([agg] if isinstance(agg, str) else list(agg)))
        return newest(have)

    def vacuum(self) -> list[str]:
        """Delete the families that no catalog row names any more, and return them."""
        live = {r[0] for r in self._entries().select("family").distinct().collect()}
        hadoop, gone = self.spark._jvm.org.apache.hadoop.fs, []
        for folder in ("features", "folded"):
            if self._exists(folder):
                top = hadoop.Path(f"{self.path}/{folder}")
                files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
                for status in files.listStatus(top):
                    if f"{folder}/{status.getPath().getName()}" not in live:
                        files.delete(status.getPath(), True)
                        gone.append(f"{folder}/{status.getPath().getName()}")
        return gone

    # -- families -----------------------------------------------------------------------------

    def buckets(self) -> int:
        known = self._entries().agg(F.max("buckets")).first()[0]
        return known or self._buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _table(self, family: str, part: str, columns: Mapping[str, str], buckets: int) -> DataFrame:
        """One part of a family as a table in buckets; the session learns of it by its place."""
        place = f"{self.path}/{family}/{part}"
        name = "feature_family_" + hashlib.md5(place.encode()).hexdigest()
        listed = ", ".join(f"{quoted(c)} {kind}" for c, kind in {"id": "string", **columns}.items())
        where = place.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({listed}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, metas: Mapping[str, Mapping[str, object]], folder: str, parts: Mapping[str, Sequence]) -> None:
        """Write a family and its catalog rows in one pass: one shuffle by id, a sorted file per bucket and part.

        Rows, ids and repeated ids of each part are counted while they are written; what is refused has no catalog row.
        """
        types = dict(rows.dtypes)
        full = {n: {**m, "column_name": n, "filename_prefix": str(m.get("filename_prefix") or n), "dtype": types[n]} for n, m in metas.items()}
        prefixes = [m["filename_prefix"] for m in full.values()]
        buckets, family = self.buckets(), f"{folder}/{uuid.uuid4().hex}"
        wide = rows.select(F.col("id").cast("string").alias("id"), *parts, *[F.col(quoted(n)).alias(m["filename_prefix"]) for n, m in full.items()])
        once = wide.repartition(buckets, "id").groupBy("id", *parts).agg(F.count(F.lit(1)).alias("__n"), *[F.first(quoted(c)).alias(c) for c in prefixes])
        seen, measures, places = Observation(), [F.max("__n").alias("most"), F.sum("__n").alias("rows")], list(product(*parts.values()))
        for k, values in enumerate(places):
            here = reduce(lambda a, b: a & b, [F.col(p) == v for p, v in zip(parts, values)])
            measures += [F.count(F.when(here, 1)).alias(f"n{k}"), F.bit_xor(F.when(here, F.xxhash64("id"))).alias(f"x{k}"),
                         F.bit_xor(F.when(here, F.hash("id", F.lit(7)).cast("long") * 4294967311)).alias(f"y{k}")]
        name = f"feature_write_{uuid.uuid4().hex}"
        (once.observe(seen, *measures).select("id", *map(quoted, prefixes), *parts).write.partitionBy(*parts).bucketBy(buckets, "id").sortBy("id")
         .format("parquet").option("compression", "zstd").option("path", f"{self.path}/{family}").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")  # the files stay; `_table` names each part's
        facts = seen.get
        if (facts["most"] or 0) > 1:
            raise ValueError(f"ids repeat in {list(full)}")
        if sum(facts[f"n{k}"] for k in range(len(places))) != (facts["rows"] or 0):
            raise ValueError(f"{list(full)}: rows outside of {dict(parts)}")
        if folder == "folded" and (empty := {v[0] for k, v in enumerate(places) if v[1] != "test" and not facts[f"n{k}"]}):
            raise ValueError(f"{list(full)}: {len(parts['outer_fold']) - len(empty)} outer folds given, {len(parts['outer_fold'])} declared")
        ids = ";".join(f"{'/'.join(f'{p}={v}' for p, v in zip(parts, values))}:{facts[f'n{k}']}:{facts[f'x{k}']}:{facts[f'y{k}']}"
                       for k, values in enumerate(places))
        self._register([{**m, "family": family, "buckets": buckets, "ids": ids} for m in full.values()])

    def _wide(self, chosen: Sequence, part: str) -> DataFrame:
        """The chosen columns of one part, a row per id.

        Families with the same ids, as the catalog tells, are joined bucket by bucket. Others are joined so that every id
        of any of them stays.
        """
        families: dict[str, list] = {}
        for c in chosen:
            families.setdefault(c["family"], []).append(c)
        frames, ids = [], set()
        for family, columns in families.items():
            table = self._table(family, part, {c["filename_prefix"]: c["dtype"] for c in self._columns_of(family)}, columns[0]["buckets"])
            frames.append(table.select("id", *[F.col(quoted(c["filename_prefix"])).alias(c["column_name"]) for c in columns]))
            ids.add(next((x for x in columns[0]["ids"].split(";") if x.startswith(f"{part}:")), ""))
        how = "inner" if len(ids) == 1 else "full"
        return reduce(lambda a, b: a.join(b.hint("merge"), "id", how), frames).select("id", *[quoted(c["column_name"]) for c in chosen])

    def _columns_of(self, family: str) -> list:
        """All columns that were saved with a family, overwritten ones too."""
        rows = self.spark.read.schema(STORED_CATALOG).parquet(f"{self.path}/catalog").filter(F.col("family") == family)
        return rows.select("filename_prefix", "dtype").collect()

    def stored_rows(self) -> DataFrame:
        """(filename_prefix, part, rows) of every live feature, counted in its files; ``part`` is like ``split=train``."""
        counts = []
        for folder in ("features", "folded"):
            if self._exists(folder):
                files = self.spark.read.schema("id string").option("recursiveFileLookup", "true").parquet(f"{self.path}/{folder}")
                at = F.regexp_extract(F.col("_metadata.file_path"), f"/({folder}/[0-9a-f]{{32}})/", 1)
                split = F.regexp_extract(F.col("_metadata.file_path"), f"/{folder}/[0-9a-f]{{32}}/(.*)/[^/]*$", 1)
                counts.append(files.groupBy(at.alias("family"), split.alias("part")).agg(F.count("id").alias("rows"), F.count_distinct("id").alias("ids")))
        where = self._entries().select("filename_prefix", "family")
        return where.join(reduce(DataFrame.unionByName, counts), "family").select("filename_prefix", "part", "rows", "ids")

    # -- plain features -----------------------------------------------------------------------

    def save(self, train: DataFrame, test: DataFrame, name: str, meta: Mapping[str, object]) -> None:
        """Write one feature column of both splits and its catalog row; an equal prefix is overwritten."""
        self.save_many(train, test, {name: meta})

    def save_many(self, train: DataFrame, test: DataFrame, metas: Mapping[str, Mapping[str, object]]) -> None:
        """Write the columns ``{name: meta}`` of both splits as one family: one pass over the frames, one catalog append."""
        names = [quoted(n) for n in metas]
        rows = (train.select("id", *names, F.lit("train").alias("split")).unionByName(test.select("id", *names, F.lit("test").alias("split"))))
        self._write(rows, metas, "features", {"split": ["train", "test"]})

    def read_features(self, column_names: Sequence[str] | None = None,
                      criteria: Mapping[str, Sequence[str]] | None = None,
                      newest_first_: bool = False) -> tuple[DataFrame, DataFrame]:
        """Wide train and test frames of the chosen features."""
        chosen = self._chosen(column_names, criteria)
        rows = (newest_first(chosen) if newest_first_ else chosen).collect()
        if not rows:
            raise MissingFeatures(f"no features for {column_names or criteria}")
        if column_names is not None and not newest_first_:
            rows.sort(key=lambda r: list(column_names).index(r["column_name"]))
        return tuple(self._wide(rows, f"split={s}") for s in ("train", "test"))

    # -- folded features ----------------------------------------------------------------------

    def save_folded(self, rows: DataFrame, name: str, meta: Mapping[str, object]) -> None:
        """Write ``(id, outer_fold, part, <name>)`` rows of all outer folds and the catalog row."""
        self.save_folded_many(rows, {name: meta})

    def save_folded_many(self, rows: DataFrame, metas: Mapping[str, Mapping[str, object]]) -> None:
        """Write folded columns ``{name: meta}`` as one family."""
        folds = {m["outer_folds"] for m in metas.values()}
        if len(folds) > 1:
            raise ValueError(f"the features of one family have different numbers of outer folds: {sorted(folds)}")
        self._write(rows.select("id", "outer_fold", "part", *[quoted(n) for n in metas]), metas, "folded",
                    {"outer_fold": list(range(folds.pop())), "part": ["train", "val", "test"]})

    def _folded(self, column_names=None, feature_lists=None, agg=None) -> list:
        rows = self._chosen(column_names, None, feature_lists, agg, folded=True).orderBy("column_name").collect()
        if not rows:
            raise MissingFeatures("no folded features for this choice")
        if len({r["outer_folds"] for r in rows}) > 1:
            raise ValueError("the chosen features have different numbers of outer folds")
        return rows

    def read_folded(self, column_names: Sequence[str] | None = None, feature_lists: Sequence[Sequence[str]] | None = None,
                    agg: str | Sequence[str] | None = None) -> DataFrame:
        """Wide rows by ``(id, outer_fold, part)`` of the chosen folded features."""
        rows = self._folded(column_names, feature_lists, agg)
        parts = [self._wide(rows, f"outer_fold={o}/part={p}").select("id", F.lit(o).alias("outer_fold"), F.lit(p).alias("part"), *[quoted(r["column_name"]) for r in rows])
                 for o in range(rows[0]["outer_folds"]) for p in ("train", "val", "test")]
        return reduce(DataFrame.unionByName, parts)

    def read_features_by_fold(self, **choice) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
        """(train, val, test) frames for every outer fold, each from its own folders."""
        rows = self._folded(**choice)
        return [tuple(self._wide(rows, f"outer_fold={o}/part={p}") for p in ("train", "val", "test")) for o in range(rows[0]["outer_folds"])]
