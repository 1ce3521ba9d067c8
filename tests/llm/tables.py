"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

import duckdb

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, fp long, _key long, _n long, "
          "stays long, component string, score double, `start` long")
CLASHES = (7, True, 8, 9, 10, 11, "own", 0.25, 12)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    texts = [sentence(rng, rng.choice([1, 3, 60, 200])) for _ in range(n)]
    texts += [texts[0], texts[2], "", None, " \t\n", "x", "One two", "a b c " * 400, "line\n" * 90, sentence(rng, 30_000), "WORD!! " * 90,
              "Straße ÉCOLE İstanbul ﬁne ́mark don't <|endoftext|> a\x1cb c d e f"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "cold", "", None]), len(t or ""), *CLASHES)
           for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[4], "en", "hot", 1, *CLASHES), (None, texts[4], "en", "hot", 1, *CLASHES), (None, None, None, None, None, *CLASHES),
            (5, texts[6], None, "cold", 1, *CLASHES)]
    return out


def frame(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def plain(spark, texts: dict):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def connect(**frames) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name, df in frames.items():
        table = df.toArrow()
        con.register(f"{name}_arrow", table)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return con
