"""Chunk stores against the bytes that went in; cuts against a hash computed byte by byte."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingloom.llm import media
from listingloom.llm.common import scratch


def _plain_ends(data: bytes) -> list[int]:
    ends, begin, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - begin
        if n >= media.SHORTEST and h >> (32 - media.CUT_BITS) == 0 or n == media.LONGEST:
            ends.append(i + 1)
            begin = i + 1
    return ends if not data or ends and ends[-1] == len(data) else [*ends, len(data)]


@pytest.mark.parametrize("kind", ["random", "flat", "short", "empty", "stretches"])
def test_cuts_are_those_of_the_rolling_hash(kind, monkeypatch):
    rng = random.Random(3)
    data = {"random": rng.randbytes(60_000), "flat": b"\xff" * 50_000, "short": b"abc", "empty": b"", "stretches": rng.randbytes(60_000)}[kind]
    if kind == "stretches":
        monkeypatch.setattr(media, "STRETCH", 1000)
    marks = media.cut_marks(np.frombuffer(data, np.uint8)).tolist()
    assert media.chunk_ends(marks, 0, len(data)) == _plain_ends(data)
    # the bytes before a payload have no say
    before = rng.randbytes(777)
    marks = media.cut_marks(np.frombuffer(before + data, np.uint8)).tolist()
    assert [e - 777 for e in media.chunk_ends(marks, 777, 777 + len(data))] == _plain_ends(data)


def _payloads() -> list[bytes | None]:
    rng = random.Random(5)
    base, tail = rng.randbytes(40_000), rng.randbytes(20_000)
    return [base, base, base[:20_000] + b"inserted" + base[20_000:], b"other" + tail, tail, base + tail, b"", None, b"", b"x" * 600, b"\xff" * 200_000, rng.randbytes(700_000)]


@pytest.mark.parametrize("way", ["broadcast", "shuffle", "salted"])
def test_store_round_trip(spark, way, monkeypatch):
    if way == "shuffle":
        monkeypatch.setattr(media, "MOST_BROADCAST", 0)
    if way == "salted":
        monkeypatch.setattr(media, "MOST_OF_A_KEY", 1)
    data = _payloads()
    folder = scratch(spark, "test-media")
    media.write(spark.createDataFrame([(i, x, "clash") for i, x in enumerate(data)], "id long, media binary, digest string").repartition(3), folder)
    got = {bytes(r["id"]): bytes(r["media"]) for r in media.read(spark, folder).collect()}
    assert got == {hashlib.sha256(x or b"").digest(): x or b"" for x in data}
    chunks = [bytes(r[0]) for r in spark.read.parquet(f"{folder}/packs").select(F.explode("chunks.digest")).collect()]
    assert len(chunks) == len(set(chunks))  # each chunk is stored once
    stored = spark.read.parquet(f"{folder}/packs").select(F.explode("chunks.bytes").alias("b")).agg(F.sum(F.octet_length("b"))).first()[0]
    assert stored < 0.75 * sum(len(x or b"") for x in set(data))


def test_broken_bytes_are_told(spark):
    folder, worse = scratch(spark, "test-media"), scratch(spark, "test-media")
    media.write(spark.createDataFrame([(x,) for x in _payloads()], "media binary"), folder)
    broken = F.transform("chunks", lambda x: x.withField("bytes", F.concat(x["bytes"], F.lit(b"!"))))
    spark.read.parquet(f"{folder}/packs").withColumn("chunks", broken).write.parquet(f"{worse}/packs")
    spark.read.parquet(f"{folder}/loans").write.parquet(f"{worse}/loans")
    with pytest.raises(Exception, match="other bytes than its digest"):
        media.read(spark, worse).collect()


def test_round_trip_of_documents(spark, documents):
    texts = ["plain", "plain", "", None, (None, "no id"), (7, "Ünï " * 5000), (7, "Ünï " * 5000), "x" * 576, "y" * 577, (None, None)]
    got = media.round_trip(documents(texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["payload_bytes"] % 576 == 0 and r["payload_bytes"] >= max(r["n_bytes"], 576) and r["payload_bytes"] < r["n_bytes"] + 577
    want = set()
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (i, t)
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        image = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        counts = [sum(x >> 5 == j for x in payload) for j in range(8)]
        feature = f"24x{len(payload) // 24};{sum(payload)};{min(payload)};{max(payload)};{','.join(map(str, counts))}"
        want.add((key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature))
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert {tuple(r[c] for c in columns) for r in got} == want
    assert media.round_trip(documents([])).collect() == []
