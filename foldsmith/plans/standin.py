"""The stand-in for the train, test and external tables, made from ``lineitem``.

``ext`` are the rows shipped before 1997, ``train`` those before June 2000 and ``test`` the rest.  The
SQL fragments build the same frames for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldsmith.functions.exact import mean
from foldsmith.operators.encoders import TargetEncoder
from foldsmith.operators.folds import kfold

FEATURES = ["status", "flag", "line", "qty", "disc", "tax", "mon"]
MODELS = ["m_mean", "m_qty", "m_qty_disc"]
EXT_END, TRAIN_END = "1997-01-01", "2000-06-01"
CENTS = 100


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def frame(spark: SparkSession, sf_dir: str, *splits: str) -> DataFrame:
    """Stand-in rows of the given splits (default all); the split is a filter on the stored date."""
    rows, ship = lineitem(spark, sf_dir), F.col("l_shipdate")
    ext_end, train_end = F.lit(EXT_END).cast("timestamp_ntz"), F.lit(TRAIN_END).cast("timestamp_ntz")
    bounds = {"ext": ship < ext_end, "train": (ship >= ext_end) & (ship < train_end), "test": ship >= train_end}
    if splits:
        wanted = bounds[splits[0]]
        for s in splits[1:]:
            wanted = wanted | bounds[s]
        rows = rows.filter(wanted)
    split = (F.lit(splits[0]) if len(splits) == 1
             else F.when(bounds["ext"], "ext").when(bounds["train"], "train").otherwise("test"))
    rows = rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.translate(ship.cast("date").cast("string"), "-", "")).alias("id"),
        F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"),
        (F.col("l_discount") + F.lit(0.0)).alias("disc"), (F.col("l_tax") + F.lit(0.0)).alias("tax"),
        F.month(ship).alias("mon"), F.year(ship).alias("yr"), F.col("l_extendedprice").alias("y"), split.alias("split"))
    return kfold(rows)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "train")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "test")


def ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "ext")


def model_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold and test predictions of three closed-form models, one column per model."""
    tr, te = train(spark, sf_dir), test(spark, sf_dir)
    overall = tr.agg(mean(F.col("y"), CENTS)).scalar()
    keep = ["id", "fold", "status", "qty", "disc", "y"]
    by_qty = TargetEncoder(["qty"], scale=CENTS).fit(tr, "y")
    by_both = TargetEncoder(["qty", "disc"], scale=CENTS).fit(tr, "y")

    def wide(df: DataFrame) -> DataFrame:
        m_qty, m_both = F.col(by_qty.out).cast("double"), F.col(by_both.out).cast("double")
        return df.select(*keep, overall.alias("m_mean"), m_qty.alias("m_qty"),
                         F.coalesce(m_both, m_qty).alias("m_qty_disc"))

    return (wide(by_both.transform_train(by_qty.transform_train(tr.select(*keep)))),
            wide(by_both.transform(by_qty.transform(te.select(*keep)))))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table; two of the models also have a full-refit test split (here one higher)."""
    oof, tst = model_frames(spark, sf_dir)

    def long(df: DataFrame, split: str, models: list[str], shift: float = 0.0) -> DataFrame:
        return (df.unpivot(["id"], models, "model", "pred")
                .select("model", F.lit(split).alias("split"), "id", (F.col("pred") + F.lit(shift)).alias("pred")))

    return (long(oof, "oof", MODELS).unionByName(long(tst, "test", MODELS))
            .unionByName(long(tst, "test_from_full", MODELS[1:], 1.0)))


# -- SQL ------------------------------------------------------------------------------------------

def sql_hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def sql_cents(y: str = "y") -> str:
    return f"CAST(round({y} * 100) AS BIGINT)"


def sql_mean(s: str = f"sum({sql_cents()})", n: str = "count(y)") -> str:
    return f"(({s})::DOUBLE / (100.0::DOUBLE * ({n})))"


FRAME_SQL = f"""f AS (
  SELECT *, CAST({sql_hash("'42:' || id")} % 5 AS INTEGER) AS fold FROM (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id,
           l_linestatus AS status, l_returnflag AS flag, l_linenumber AS line, l_quantity AS qty,
           l_discount + 0.0::DOUBLE AS disc, l_tax + 0.0::DOUBLE AS tax, CAST(month(l_shipdate) AS INTEGER) AS mon,
           CAST(year(l_shipdate) AS INTEGER) AS yr, l_extendedprice AS y,
           CASE WHEN l_shipdate < TIMESTAMP '{EXT_END}' THEN 'ext' WHEN l_shipdate < TIMESTAMP '{TRAIN_END}'
                THEN 'train' ELSE 'test' END AS split
    FROM lineitem)),
ext AS (SELECT * FROM f WHERE split = 'ext'),
train AS (SELECT * FROM f WHERE split = 'train'),
test AS (SELECT * FROM f WHERE split = 'test')"""


def sql(body: str, *ctes: str) -> str:
    """A query over f, ext, train and test."""
    return "WITH " + ",\n".join([FRAME_SQL, *ctes]) + "\n" + body


def sql_te(name: str, cols: list[str]) -> str:
    """CTEs ``<name>_oof`` and ``<name>_test`` with ``(id, te)``, the mean left out directly."""
    keys = ", ".join(cols)
    value = "CAST(CAST({s}::DOUBLE / (100.0::DOUBLE * {n}) AS FLOAT) AS DOUBLE)"
    oof = value.format(s="(a.s - k.s)", n="nullif(a.n - k.n, 0)")
    whole = value.format(s="a.s", n="a.n")
    join = lambda right: " AND ".join(f"{right}.{c} IS NOT DISTINCT FROM t.{c}" for c in cols)
    return f"""{name}_k AS (SELECT {keys}, fold, sum({sql_cents()}) AS s, count(*) AS n FROM train GROUP BY {keys}, fold),
{name}_a AS (SELECT {keys}, sum(s) AS s, sum(n) AS n FROM {name}_k GROUP BY {keys}),
{name}_oof AS (SELECT t.id, {oof} AS te FROM train t JOIN {name}_a a ON {join('a')}
  JOIN {name}_k k ON {join('k')} AND k.fold = t.fold),
{name}_test AS (SELECT t.id, {whole} AS te FROM test t LEFT JOIN {name}_a a ON {join('a')})"""


def sql_nested(name: str, cols: list[str]) -> str:
    """CTE ``<name>`` with ``(id, outer_fold, part, te)`` for 5 outer and 4 inner folds."""
    keys = ", ".join(cols)
    join = lambda right: " AND ".join(f"{right}.{c} IS NOT DISTINCT FROM t.{c}" for c in cols)
    value = "CAST(CAST({s}::DOUBLE / (100.0::DOUBLE * {n}) AS FLOAT) AS DOUBLE)"
    inner = sql_hash("'42:' || r.o || ':' || t.id")
    return f"""{name}_r AS (SELECT t.*, CAST(r.o AS INTEGER) AS outer_fold, {inner} % 4 AS inner_fold
  FROM train t, range(5) r(o)),
{name}_k AS (SELECT {keys}, outer_fold, inner_fold, sum({sql_cents()}) AS s, count(*) AS n FROM {name}_r
  WHERE fold <> outer_fold GROUP BY {keys}, outer_fold, inner_fold),
{name}_a AS (SELECT {keys}, outer_fold, sum(s) AS s, sum(n) AS n FROM {name}_k GROUP BY {keys}, outer_fold),
{name} AS (
  SELECT t.id, t.outer_fold, 'train' AS part, {value.format(s='(a.s - k.s)', n='nullif(a.n - k.n, 0)')} AS te
  FROM {name}_r t JOIN {name}_a a ON {join('a')} AND a.outer_fold = t.outer_fold
  JOIN {name}_k k ON {join('k')} AND k.outer_fold = t.outer_fold AND k.inner_fold = t.inner_fold
  WHERE t.fold <> t.outer_fold
  UNION ALL
  SELECT t.id, t.outer_fold, 'val', {value.format(s='a.s', n='a.n')}
  FROM {name}_r t LEFT JOIN {name}_a a ON {join('a')} AND a.outer_fold = t.outer_fold WHERE t.fold = t.outer_fold
  UNION ALL
  SELECT t.id, CAST(r.o AS INTEGER), 'test', {value.format(s='a.s', n='a.n')}
  FROM test t CROSS JOIN range(5) r(o) LEFT JOIN {name}_a a ON {join('a')} AND a.outer_fold = r.o)"""


MODELS_SQL = ",\n".join([
    sql_te("q", ["qty"]), sql_te("qd", ["qty", "disc"]),
    f"""overall AS (SELECT {sql_mean()} AS m FROM train),
oof_w AS (SELECT t.id, t.fold, t.status, t.qty, t.disc, t.y, (SELECT m FROM overall) AS m_mean, q_oof.te AS m_qty,
    coalesce(qd_oof.te, q_oof.te) AS m_qty_disc FROM train t JOIN q_oof USING (id) JOIN qd_oof USING (id)),
test_w AS (SELECT t.id, t.fold, t.status, t.qty, t.disc, t.y, (SELECT m FROM overall) AS m_mean, q_test.te AS m_qty,
    coalesce(qd_test.te, q_test.te) AS m_qty_disc FROM test t JOIN q_test USING (id) JOIN qd_test USING (id)),
preds AS (
  SELECT model, 'oof' AS split, id, pred FROM (SELECT id, m_mean, m_qty, m_qty_disc FROM oof_w)
    UNPIVOT INCLUDE NULLS (pred FOR model IN (m_mean, m_qty, m_qty_disc))
  UNION ALL SELECT model, 'test', id, pred FROM (SELECT id, m_mean, m_qty, m_qty_disc FROM test_w)
    UNPIVOT INCLUDE NULLS (pred FOR model IN (m_mean, m_qty, m_qty_disc))
  UNION ALL SELECT model, 'test_from_full', id, pred + 1.0 FROM (SELECT id, m_qty, m_qty_disc FROM test_w)
    UNPIVOT INCLUDE NULLS (pred FOR model IN (m_qty, m_qty_disc)))"""])


def models_sql(body: str, *ctes: str) -> str:
    """A query that may also use oof_w, test_w and preds."""
    return sql(body, MODELS_SQL, *ctes)
