import gzip
import hashlib
import io
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinweave.llm import warc

LONG = "<html>" + "x" * 200


@pytest.fixture
def pages(spark):
    rows = [(5, "http://a", LONG), (3, "http://b", LONG), (9, None, LONG), (1, "u\r\nInjected: x", "short"), (2, "http://c", "short"), (4, "http://d", None), (6, "http://e", ""), (7, "http://é", "é" * 60), (None, "http://n", LONG), (3, "http://b", LONG), (8, "big", "WARC/1.1\r\n\r\n" * 50_000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, id int").repartition(3)


def test_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}"
    index = warc.archive(pages, folder=folder)
    got = warc.read_records(index).collect()
    want = pages.collect()
    assert sorted((str(r["id"]), r["payload_digest"], r["payload_bytes"]) for r in got) == sorted((str(r["page_id"]), hashlib.sha256((r["html"] or "").encode()).hexdigest(), len((r["html"] or "").encode())) for r in want)
    kinds = {(r["id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3), (3, "response", None), (1, "response", None), (2, "response", None), (4, "response", None)} <= kinds
    texts = {r["id"]: bytes(r["payload"]).decode() for r in got if r["payload"] is not None}
    assert texts[7] == "é" * 60 and texts[8].startswith("WARC/1.1") and texts[4] == ""
    # each member is a gzip file of its own, and the sidecar says where
    for idx in Path(tmp_path, "members").glob("*.idx"):
        data = idx.with_suffix("").read_bytes()
        places = [json.loads(x) for x in idx.read_text().splitlines()]
        assert sum(p["length"] for p in places) == len(data)
        for p in places:
            assert gzip.decompress(data[p["offset"] : p["offset"] + p["length"]]).startswith(b"WARC/1.1\r\n")
    # the archives before were one stream each
    for whole in Path(tmp_path, "whole").glob("*.gz"):
        inflater = warc.zlib.decompressobj(31)
        inflater.decompress(whole.read_bytes())
        assert inflater.eof and not inflater.unused_data
    assert not list(tmp_path.rglob("*.tmp"))


def test_inflates_members_and_single_streams():
    records = [warc.record({"WARC-Type": "response", "n": str(i)}, b"x" * i * 1000) for i in range(50)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        found = list(warc.take(io.BufferedReader(warc.Inflated(io.BytesIO(data)), 1 << 12)))
        assert [f[2] for f in found] == records


def test_broken_archives_are_noticed():
    with pytest.raises(ValueError, match="ends early"):
        list(warc.take(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.take(io.BytesIO(b"HTTP/1.1\r\n")))


def test_empty(spark, pages, tmp_path):
    assert warc.read_records(warc.archive(pages.where(F.lit(False)), folder=f"file://{tmp_path}")).count() == 0
