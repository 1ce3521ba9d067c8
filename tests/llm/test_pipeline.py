from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from foldsmith.llm import queries
from tests.compare import connect, difference
from foldsmith.llm.common import write_table
from tests.llm.tables import frame, sentence


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) is None


def test_everything_is_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def documents(spark):
    rng = random.Random(8)
    clean = [sentence(rng, 80) for _ in range(60)]
    bench = [sentence(rng, 30) for _ in range(3)]
    texts = dict(enumerate(clean))
    texts |= {100 + i: clean[i].replace("a", "A", 5) if i % 2 else clean[i] for i in range(10)}  # copies
    texts |= {200 + i: sentence(rng, 60) + "\n" + bench[i].replace("a", "b", 1) + "\n" + sentence(rng, 60) for i in range(3)}  # leaks
    texts |= {300: "too short", 301: "same again " * 80, 302: "", 303: None}
    rows = [(i, t, "en", "hot" if (i or 0) % 3 else "cold", len(t or "")) for i, t in texts.items()]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(list(enumerate(bench)), "item_id long, text string"), dict(enumerate(clean)))


def test_stages_take_effect(spark, tmp_path):
    docs, bench, clean = documents(spark)
    sf_dir = str(tmp_path)
    bench.write.parquet(f"{sf_dir}/benchmark.parquet")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{sf_dir}/{k}")
        docs = spark.read.parquet(f"{sf_dir}/{k}")
        kept.append(Counter(r["doc_id"] for r in docs.collect()))
    assert set(kept[0]) == set(range(60)) | set(range(100, 110)) | {200, 201, 202}
    assert kept[1] == Counter([*range(60), 200, 201, 202])  # a copy with capitals has the same fingerprint
    assert kept[2] == Counter(range(60))
    assert set(kept[3]) == set(range(60)) and max(kept[3].values()) == 2 and kept[4] == kept[3]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(docs.collect(), key=lambda r: r["start"]):
        ids = np.array([*library.encode(clean[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_awkward_rows(spark, sf_dir):
    """Null and repeated ids, null and empty texts, repeated rows, a very long text, and columns with the names that stages compute."""
    docs = frame(spark)
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = write_table(stage(spark, docs, sf_dir), "awkward")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns and docs.schema == before.schema
            assert docs.distinct().exceptAll(before.distinct()).count() == 0  # rows come through as they are
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4] >= sizes[2]
    assert docs.where("doc_id IS NULL").count() > 0 and docs.agg({"start": "min"}).first()[0] == 0


def test_empty_documents(spark, tmp_path):
    docs, bench, _ = documents(spark)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert not os.path.exists(f"{tmp_path}/tokens")
