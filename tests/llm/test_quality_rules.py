from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from foldsmith.llm import queries, sql
from foldsmith.llm.quality_rules import COUNTS, bucket, bucket_floor, counts, keep_good, quality_verdicts
from tests.compare import difference
from tests.llm.tables import connect, frame, rows


def naive(text: str | None) -> dict[str, int]:
    text = text or ""
    blank = set(" \t\n\v\f\r")
    parts = [p.decode() for p in text.encode().split()]
    windows = [tuple(parts[i:i + 3]) for i in range(len(parts) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if set(line) - blank:
            lines += 1
            dup += line in seen
            seen.add(line)
    return {"n_words": len(parts), "word_chars": sum(map(len, parts)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup,
            "n_repeat_words": len(covered), "n_lines": lines, "n_upper": sum("A" <= c <= "Z" for c in text), "n_marks": text.count("!")}


def test_counts():
    texts = [r[1] for r in rows()] + ["# a *b* a\n\n# a *b* a\n \n \nü|<>&%$", "a b c a b c d a b c", "\x1c a b"]
    for text in texts:
        assert dict(zip(COUNTS, counts(text))) == naive(text)


def test_buckets(spark):
    found = spark.range(100_000).select("id", bucket(F.col("id")).alias("b")).withColumn("low", bucket_floor(F.col("b")))
    assert found.where("low > id OR (id - low) * 32 > id OR (id < 64 AND low <> id)").count() == 0
    assert found.groupBy("b").agg(F.countDistinct("low").alias("n")).where("n > 1").count() == 0


def test_awkward_table_against_sql(spark):
    docs = frame(spark)
    assert difference(quality_verdicts(docs), connect(documents=docs.select("doc_id", "text", "lang", "source")), sql.QUALITY_RULES) is None
    assert quality_verdicts(docs.limit(0)).count() == 0


def test_kept_rows_keep_their_columns(spark):
    docs = frame(spark)
    kept = keep_good(docs)
    assert kept.columns == docs.columns and {r["n_words"] for r in kept.collect()} == {7}
    assert kept.count() == quality_verdicts(docs).where("kept").count() > 0


def symbols(i: int, n: int) -> str:
    return " ".join(f"w{i:04d}x{k:02d}{'#' if k < n else ''}" for k in range(60))


def verdicts(spark, data: list[tuple]) -> dict:
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    assert difference(quality_verdicts(docs), connect(documents=docs), sql.QUALITY_RULES) is None
    return {r["doc_id"]: r["kept"] for r in quality_verdicts(docs).collect()}


def test_verdict_of_one_text_differs_by_source(spark):
    data = [(i, symbols(i, 30 if i % 2 else 0), "en", "forum" if i % 2 else "news") for i in range(4000)]
    data += [(4000, symbols(1000, 30), "en", "news"), (4001, symbols(1000, 30), "en", "forum")]
    kept = verdicts(spark, data)
    assert not kept[4000] and kept[4001] and all(kept[i] for i in range(4000))


def test_verdict_of_one_text_differs_by_language(spark):
    text = lambda size, i: " ".join(f"{i:03d}{k:02d}".ljust(size + (i + k) % 3, "x") for k in range(60))
    data = [(i, text(12 if i % 2 else 6, i), "de" if i % 2 else "en", "web") for i in range(800)]
    data += [(1000, text(12, 999), "en", "web"), (1001, text(12, 999), "de", "web")]
    kept = verdicts(spark, data)
    assert not kept[1000] and kept[1001] and all(kept[i] for i in range(800))


def test_junk_does_not_set_its_own_threshold(spark):
    """A third of one source is junk; the whole corpus's bound holds there."""
    data = [(i, symbols(i, 40 if i % 60 == 1 else 0), "en", "bad" if i % 20 == 1 else f"s{i % 20}") for i in range(4000)]
    kept = verdicts(spark, data)
    assert all(kept[i] == (i % 60 != 1) for i in range(4000))


def test_small_groups_are_drawn_to_their_language(spark):
    """Five documents of a source are too few to allow what its language does not show."""
    data = [(i, symbols(i, 30 if i % 5 == 0 else 0), "en" if i % 5 else "xx", "news") for i in range(5000)]
    data += [(5000 + i, symbols(5000 + i, 30), "en", "tiny") for i in range(5)]
    kept = verdicts(spark, data)
    assert all(kept[i] for i in range(5000)) and not any(kept[5000 + i] for i in range(5))


def test_labelled_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = queries.quality_rules(spark, sf_dir).join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    n = Counter({(r["quality"], r["base_failed"], r["kept"]): r["count"] for r in found})
    assert n[0, False, True] == 0 and n[1, False, False] <= 0.02 * n[1, False, True]
