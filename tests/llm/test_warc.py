from __future__ import annotations

import hashlib
import random

import pytest
import zstandard

from foldsmith.llm import sql
from foldsmith.llm.warc import Bundle, archive_pages, frames_of, make_record, read_bundle, read_record, write_archives
from foldsmith.storage import scratch_path
from pyspark.sql import functions as F
from tests.compare import difference
from tests.llm.tables import connect

ROWS = [(5, "http://a/", "same"), (3, "http://b/", "same"), (3, "http://c/", "same"), (4, None, "same"), (None, "http://z/", "same"), (7, "http://q/", None), (8, "http://r/", ""),
        (9, "http://é/ x\r\ny", "größe\r\n\r\nWARC/1.1\r\n" * 50), (10, "u", "one"), (10, "u", "one"), (None, None, "alone"), (None, None, "alone"), (11, "u", "x" * 300_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "own") for r in rows], "page_id long, url string, html string, size int, digest string")


def digest(spark, df):
    return df.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def test_bundle_round_trip():
    rng = random.Random(1)
    bundle, want = Bundle(2000), []
    for i in range(60):
        payload = rng.randbytes(rng.choice([0, 10, 500, 5000]))
        want.append((f"urn:page:{i}:1", payload))
        bundle.add(want[-1][0], make_record(want[-1][0], "http://x/", payload, len(payload), "D", None))
    index, archive = bundle.index, bundle.close()
    found = [(h["WARC-Record-ID"][1:-1], b.partition(b"\r\n\r\n")[2]) for h, b in read_bundle(archive)]
    assert found == want and len(frames_of(archive)) > 5
    for place, (name, payload) in zip(index, want):
        headers, block = read_record(archive, place["frame"], place["offset"])
        assert headers["WARC-Record-ID"] == f"<{name}>" and block.endswith(payload)
    plain = zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True).read()  # any reader skips the table
    assert plain.count(b"WARC/1.1\r\n") == 60
    with pytest.raises(ValueError):
        frames_of(archive[:-1])


def test_awkward_table_against_sql(spark):
    assert difference(digest(spark, archive_pages(pages(spark))), connect(pages=pages(spark).select("page_id", "url", "html")), sql.WARC) is None
    assert archive_pages(pages(spark, [])).count() == 0


def test_payloads_come_back(spark):
    found = archive_pages(pages(spark)).collect()
    assert len({r["record_id"] for r in found}) == len(ROWS)
    texts = {r["page_id"]: r["payload"] for r in found if r["record_type"] == "response"}
    assert texts["9"].decode() == ROWS[7][2] and texts["11"] == b"x" * 300_000 and texts["7"] == b""
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")


def test_small_payloads_are_all_responses(spark):
    found = archive_pages(pages(spark), min_bytes=4).collect()
    assert [r["record_type"] for r in found if r["payload_bytes"] < 4] == ["response"] * 4
    assert sorted(r["record_type"] for r in found if r["payload_bytes"] == 4) == ["response"] + ["revisit"] * 4


def test_index_rows_point_at_records(spark):
    folder = scratch_path(spark, "warc")
    write_archives(pages(spark), folder, frame_bytes=500, bundle_bytes=700)
    for row in spark.read.parquet(folder).collect():
        for place in row["index"]:
            headers, block = read_record(bytes(row["archive"]), place["frame"], place["offset"])
            assert headers["WARC-Record-ID"] == f"<{place['record_id']}>"
            payload = block.partition(b"\r\n\r\n")[2]
            if headers["WARC-Type"] == "response":
                assert hashlib.sha1(payload).hexdigest().upper() and len(block) == int(headers["Content-Length"])
