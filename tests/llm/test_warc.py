"""WARC writing, reading, pushdown, foreign archives."""

import base64
import gzip
import hashlib

import pytest

from listingloom.llm import warc
from listingloom.llm.common import scratch

PAGES = "page_id long, url string, html string, extra string"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h, "e") for i, h in rows], PAGES).repartition(3)


ROWS = [(1, "same"), (2, "same"), (3, "other é"), (4, None), (5, ""), (6, "WARC/1.1\r\nWARC-Type: response\r\n\r\nno record\r\n\r\n"), (7, "long " * 40000), (3, "other é"), (None, "same"), (None, "nobody else")]


def test_round_trip(spark):
    folder = scratch(spark, "warc-test")
    got = warc.round_trip(pages(spark, ROWS), folder=folder).collect()
    assert len(got) == len(ROWS)
    last = {}
    for i, h in ROWS:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for r in got:
        i = r["page_id"]
        hit = [h or "" for j, h in ROWS if j == i and "sha1:" + base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r["payload_digest"]]
        assert hit and r["full_length"] == len(hit[0].encode())
        if i == last[hit[0]] or last[hit[0]] == -1:
            assert r["record_type"] == "response" and r["refers_to_page"] is None and "sha1:" + r["payload_sha1"] == r["payload_digest"]
        else:
            assert r["record_type"] == "revisit" and r["refers_to_page"] == last[hit[0]]
    whole = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read(spark, folder).where("record_type = 'response'").collect()}
    assert (2, "same") in whole and (7, "long " * 40000) in whole and (6, ROWS[5][1]) in whole


def test_predicates_are_answered_from_headers(spark):
    folder = scratch(spark, "warc-test")
    warc.write(pages(spark, ROWS), folder)
    found = warc.read(spark, folder).where("record_type = 'revisit' and page_id >= 1")
    assert {r["page_id"] for r in found.collect()} == {1, 4}
    reader = warc.WarcReader({"path": folder})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1 and len(reader.tests) == 1
    touched = []
    reader.row({"warc-type": "revisit", "content-length": "5"}, lambda n: touched.append(n) or b"12345")
    assert not touched


def test_least_bytes(spark):
    got = warc.round_trip(pages(spark, [(1, "ab"), (2, "ab"), (3, "abcd"), (4, "abcd")]), least_bytes=3).collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_foreign_archives(spark, tmp_path):
    plain = [warc.record([("WARC-Type", "response"), ("WARC-Target-URI", f"u{i}")], b"x" * n) for i, n in enumerate([0, 10, 9000, 200_000])]
    (tmp_path / "a.warc").write_bytes(b"".join(plain))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in plain))
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r["target_uri"], len(r["payload"])) for r in got) == sorted([("u0", 0), ("u1", 10), ("u2", 9000), ("u3", 200_000)] * 2)
    assert warc.read(spark, f"file://{tmp_path}", "none").where("target_uri = 'u2'").count() == 2


def _long_headers(kind):
    """Headers of 20,000 characters that compress to few bytes, and to many."""
    return "a" * 20_000 if kind == "equal" else "".join(chr(97 + (i * i * 7919 + i // 3) % 26) for i in range(20_000))


@pytest.mark.parametrize("kind", ["equal", "mixed"])
def test_long_headers(spark, tmp_path, kind):
    url = _long_headers(kind)
    long = warc.record([("WARC-Type", "response"), ("WARC-Target-URI", url)], b"payload")
    short = warc.record([("WARC-Type", "response"), ("WARC-Target-URI", "u")], b"x" * 10)
    for name, parts in (("only", [long]), ("last", [short, long]), ("first", [long, short])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
        got = sorted((len(r["target_uri"]), bytes(r["payload"])) for r in warc.read(spark, f"file://{folder}").collect())
        assert got == [(1, b"x" * 10), (20_000, b"payload")][2 - len(parts) :]


@pytest.mark.parametrize("kind", ["equal", "mixed"])
def test_round_trip_with_long_urls(spark, kind):
    rows = spark.createDataFrame([(1, _long_headers(kind), "one", "e"), (2, _long_headers(kind), "one", "e"), (3, "u", "two", "e")], PAGES).coalesce(1)
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(rows).collect()}
    assert got == {1: "revisit", 2: "response", 3: "response"}


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
