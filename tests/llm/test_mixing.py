from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from foldsmith.llm import sql
from foldsmith.llm.mixing import mix_documents, mixture, solve_exponent
from tests.compare import difference
from tests.llm.tables import connect, frame


def shares(spark, tokens):
    return spark.createDataFrame([(t / sum(tokens),) for t in tokens], "p double")


def test_repetition_limit(spark):
    tokens = [700, 200, 90, 10]
    power = solve_exponent(shares(spark, tokens), 3.0)
    assert power == pytest.approx(1 - math.log(3) / math.log(70), abs=2e-6) and 70 ** (1 - power) <= 3 + 1e-6
    assert solve_exponent(shares(spark, [5, 5]), 2.0) == 0.0
    assert solve_exponent(shares(spark, [3, 5]), 2.0) == 0.0


def test_entropy_target(spark):
    tokens = [700, 200, 90, 10]
    power = solve_exponent(shares(spark, tokens), None, 0.9)
    lifted = [(t / 1000) ** power for t in tokens]
    weights = [w / sum(lifted) for w in lifted]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(0.9 * math.log(4), abs=1e-5)
    assert solve_exponent(shares(spark, tokens), None, 1.0) == pytest.approx(0, abs=1e-4)
    assert solve_exponent(shares(spark, tokens), None, 0.1) == 1.0
    with pytest.raises(ValueError):
        solve_exponent(shares(spark, tokens), 2.0, 0.5)


def test_awkward_table_against_sql(spark):
    docs = frame(spark)
    con = connect(documents=docs.select("doc_id", "text", "source"))
    assert difference(mixture(docs), con, sql.MIXTURE) is None
    assert mixture(docs.limit(0)).count() == 0
    blank = docs.where("text IS NULL OR doc_id = 42")
    assert mixture(blank).count() == blank.count()


def test_every_document_stays_and_weights_hold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixture(docs, block_tokens=50_000).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    tokens, weight, blocks = Counter(), {}, defaultdict(Counter)
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
        blocks[r["block"]][r["source"]] += r["n_tokens"]
    total = sum(tokens.values())
    assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
    assert all(abs(tokens[s] / total - w) < 0.05 for s, w in weight.items())
    assert sorted(blocks) == list(range(len(blocks)))
    assert max(r["epoch"] for r in rows) <= 2


def test_rows_of_the_stage_equal_the_mixture(spark):
    docs = frame(spark)
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns and {(r["_key"], r["_n"]) for r in mixed.collect()} == {(9, 10)}
    want = Counter((r["doc_id"], r["source"]) for r in mixture(docs).collect())
    assert Counter((r["doc_id"], r["source"]) for r in mixed.collect()) == want


def test_documents_without_words_have_one_rule(spark):
    data = [(1, "a b c d e f g h", "large"), (2, "a b c d", "small"), *((i, " ", "small") for i in range(10, 40))]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = Counter(r["doc_id"] for r in mixture(docs).collect())
    assert Counter(r["doc_id"] for r in mix_documents(docs).collect()) == want
    assert want[2] == 2 and {want[i] for i in range(10, 40)} == {1, 2}
