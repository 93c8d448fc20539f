"""WARC archives as a PySpark data source, both ways.

Writing: each task packs its records as gzip members into files of bounded size; a
manifest, made at commit, names the files of the attempts that finished. Each member's
gzip header carries the `sl` field (compressed and plain length), as the format's
annex describes.

Reading: whole files are grouped into partitions of about PARTITION_BYTES. Of each
record the header comes first; pushed-down predicates on the record type and on headers
are answered from it, and of a record that fails, or whose payload is not asked for,
only the header is inflated: `sl` (or Content-Length in plain files) leads to the next.
Foreign archives, plain or gzipped, with or without `sl`, are read too.

Option `payload`: `bytes` (default), `digest` (length and SHA-1 computed, bytes not
handed on) or `none`.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import bound_batches, materialize, meet, scratch
from .token_files import open_folder

FILE_BYTES, PARTITION_BYTES = 32 << 20, 32 << 20
#: Revisits up to which they are broadcast; beyond it pages are shuffled to meet them.
MOST_REVISITS = 200_000
MANIFEST = "manifest.json"
#: Column -> header; these are answered before a payload is touched.
COLUMNS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
    "page_id": "x-page-id", "refers_to_page": "x-refers-to-page", "full_length": "x-payload-length",
}
_NUMBERS = ("page_id", "refers_to_page", "full_length", "content_length")
SCHEMA = (
    ", ".join(f"{c} {'long' if c in _NUMBERS else 'string'}" for c in COLUMNS)
    + ", content_length long, payload_length long, payload_sha1 string, payload binary"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, object]], payload: bytes) -> bytes:
    """One record's plain bytes; headers without a value are left out."""
    lines = [f"{k}: {str(v).translate({10: ' ', 13: ' '})}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(payload)}"])
    return head.encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(plain: bytes) -> bytes:
    """A gzip member whose header tells its compressed and plain length."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(plain) + c.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    """Header names in lower case; of a repeated one the first counts."""
    out: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


class _Bytes:
    """Forward reading with a small buffer over a random-access file."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.buffer, self.start = f, size, 0, b"", 0

    def peek(self, n: int) -> bytes:
        off = self.at - self.start
        if not 0 <= off <= len(self.buffer) or off + n > len(self.buffer):
            self.f.seek(self.at)
            self.buffer, self.start, off = self.f.read(max(n, 1 << 18)), self.at, 0
        return self.buffer[off : off + n]

    def skip(self, n: int) -> None:
        self.at += n


def _members(src: _Bytes) -> Iterator[tuple[bytes, callable]]:
    """(header block, payload reader) of each gzip member; moves on by `sl` or by inflating."""
    while src.at < src.size:
        begin, head = src.at, src.peek(64)
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {begin}")
        length = None
        if head[3] & 4 and head[12:14] == b"sl":
            length = struct.unpack("<I", head[16:20])[0]
        inflate, plain, at = zlib.decompressobj(31), b"", begin
        while b"\r\n\r\n" not in plain and not inflate.eof:
            # headers may be far longer than what they are compressed to
            fed = inflate.unconsumed_tail
            if not fed and at < src.size:
                src.at = at
                fed = src.peek(4096)
                at += len(fed)
            out = inflate.decompress(fed, 8192)
            if not fed and not out:
                break
            plain += out
        end = plain.find(b"\r\n\r\n")
        if end < 0:
            raise ValueError(f"no header in the record at {begin}")
        headers = plain[:end]
        state = {"at": at, "done": False, "tail": b""}

        def rest(n: int, inflate=inflate, plain=plain, end=end, state=state) -> bytes:
            """The first n bytes of the payload, and the place where the member ends."""
            parts, have = [plain[end + 4 :]], len(plain) - end - 4
            while not inflate.eof:
                if inflate.unconsumed_tail:
                    out = inflate.decompress(inflate.unconsumed_tail, 1 << 20)
                elif state["at"] < src.size:
                    src.at = state["at"]
                    piece = src.peek(1 << 16)
                    state["at"] += len(piece)
                    out = inflate.decompress(piece, 1 << 20)
                elif not (out := inflate.decompress(b"", 1 << 20)):
                    break
                if have < n:
                    parts.append(out)
                    have += len(out)
            state["done"] = True
            return b"".join(parts)[:n]

        yield headers, rest
        if length is None:
            if not state["done"]:
                rest(0)
            src.at = state["at"] - len(inflate.unused_data)
        else:
            src.at = begin + length


def _plain(src: _Bytes) -> Iterator[tuple[bytes, callable]]:
    """The same over an archive that is not compressed."""
    while src.at < src.size:
        if src.peek(2) == b"\r\n":
            src.skip(2)
            continue
        n = 4096
        while (end := (block := src.peek(n)).find(b"\r\n\r\n")) < 0:
            if len(block) < n:
                raise ValueError(f"no header in the record at {src.at}")
            n *= 2
        begin, length = src.at + end + 4, _number(parse_headers(block[:end]).get("content-length")) or 0

        def rest(n: int, begin=begin) -> bytes:
            src.at = begin
            return src.peek(n)

        yield block[:end], rest
        src.at = begin + length


def records(f, size: int) -> Iterator[tuple[bytes, callable]]:
    src = _Bytes(f, size)
    if size:
        yield from (_members if src.peek(2) == b"\x1f\x8b" else _plain)(src)


_TESTS = {
    EqualTo: lambda a, b: a is not None and a == b, EqualNullSafe: lambda a, b: a == b,
    GreaterThan: lambda a, b: a is not None and a > b, GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b, LessThanOrEqual: lambda a, b: a is not None and a <= b,
    In: lambda a, b: a is not None and a in b, IsNull: lambda a, b: a is None, IsNotNull: lambda a, b: a is not None,
    StringStartsWith: lambda a, b: a is not None and a.startswith(b), StringEndsWith: lambda a, b: a is not None and a.endswith(b),
    StringContains: lambda a, b: a is not None and b in a,
}


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.payload = options["path"], options.get("payload", "bytes")
        self.target = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Keeps the predicates that a header answers; the others go back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _TESTS and len(column) == 1 and (column[0] in COLUMNS or column[0] == "content_length"):
                self.tests.append((column[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, base = open_folder(self.folder)
        info = store.get_file_info(base)
        if info.type == fs.FileType.File:
            return [Files([base])]
        there = {i.base_name: i for i in store.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.File}
        if MANIFEST in there:
            with store.open_input_stream(there[MANIFEST].path) as f:
                names = json.loads(f.read())
        else:
            names = [n for n in there if n.endswith((".warc", ".warc.gz"))]
        bins: list[Files] = []
        held = self.target
        for n in sorted(names):
            if held + there[n].size > self.target and (held or not bins):
                bins.append(Files([]))
                held = 0
            bins[-1].names.append(there[n].path)
            held += there[n].size
        return bins or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(self.folder)
        held: list[dict] = []
        size = 0
        for name in partition.names:
            with store.open_input_file(name) as f:
                for block, rest in records(f, f.size()):
                    row = self.row(parse_headers(block), rest)
                    if row is None:
                        continue
                    held.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield self.batch(held)
                        held, size = [], 0
        if held:
            yield self.batch(held)

    def row(self, headers: dict[str, str], rest) -> dict | None:
        row = {c: _number(headers.get(h)) if c in _NUMBERS else headers.get(h) for c, h in COLUMNS.items()}
        row["content_length"] = _number(headers.get("content-length")) or 0
        if not all(_TESTS[kind](row[c], v) for c, kind, v in self.tests):
            return None
        row |= {"payload_length": None, "payload_sha1": None, "payload": None}
        if self.payload != "none" and row["record_type"] != "revisit":
            data = rest(row["content_length"])
            row |= {"payload_length": len(data), "payload_sha1": sha1_base32(data)}
            if self.payload == "bytes":
                row["payload"] = data
        return row

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [x.split() for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[k]) for c, k in fields], [c for c, _ in fields])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, html, record_type, refers_to_page, payload_sha, full_length) to records."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = open_folder(self.folder)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                data = member(self.plain(r))
                out.write(data)
                size += len(data)
                if size > FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    @staticmethod
    def plain(r: dict) -> bytes:
        name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
        revisit = r["record_type"] == "revisit"
        return record([
            ("WARC-Type", r["record_type"]), ("WARC-Record-ID", name(r["page_id"])), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", r["url"]), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(r["payload_sha"]).decode()),
            ("WARC-Refers-To", name(r["refers_to_page"]) if revisit else None),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
            ("Content-Type", "text/html"), ("X-Page-Id", r["page_id"]), ("X-Refers-To-Page", r["refers_to_page"] if revisit else None),
            ("X-Payload-Length", r["full_length"]),
        ], b"" if revisit else (r["html"] or "").encode("utf-8"))

    def commit(self, messages: list) -> None:
        store, base = open_folder(self.folder)
        with store.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list) -> None:
        store, base = open_folder(self.folder)
        for n in (n for m in messages if m for n in m.names):
            store.delete_file(f"{base}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        store, base = open_folder(self.options["path"])
        store.create_dir(base, recursive=True)
        return WarcWriter(dict(self.options))


def read(spark: SparkSession, folder: str, payload: str = "bytes") -> DataFrame:
    bound_batches(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(folder)


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """One record for each row of pages (page_id, url, html); equal payloads are stored once.

    Of the rows with equal payloads (SHA-1 and length) of at least least_bytes, those with
    the largest page_id are responses and the others revisit it. Digests are grouped with
    map-side maxima and joined back without the texts, those of a frequent payload by a
    broadcast; payloads are only shuffled where the revisits are too many to broadcast.

    Defined results: null html is an empty payload; repeated rows are written as often as
    they come, all responses if they hold the largest id; a null id never is the largest.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("_sha"), F.octet_length(html).cast("long").alias("full_length"), key.alias("_key"))
    light = rows.select("_key", "_sha", "full_length").where(F.col("full_length") >= least_bytes)
    groups = light.groupBy("_sha", "full_length").agg(F.max("_key").alias("_last"), F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_first < _last").drop("_first")
    revisits = meet(light, groups, ["_sha", "full_length"], light.count()).where("_key < _last").select("_key", "_sha", "_last").distinct()
    revisits = materialize(revisits, "revisits")
    out = rows.join(F.broadcast(revisits) if revisits.count() <= MOST_REVISITS else revisits, ["_key", "_sha"], "left").select(
        "page_id", "url", F.when(F.col("_last").isNull(), F.col("html")).alias("html"),
        F.when(F.col("_last").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("_last").alias("refers_to_page"), F.unhex("_sha").alias("payload_sha"), "full_length",
    )
    out.write.format("warc").mode("append").save(folder)


def round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the archives of pages and reads their records back, payloads checked by digest."""
    folder = folder or scratch(pages.sparkSession, "warc")
    write(pages, folder, least_bytes)
    return read(pages.sparkSession, folder, "digest")
