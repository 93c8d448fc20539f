"""Token-id files with directly addressable codes.

An id is cut into chunks of given bit widths, low bits first. Level k holds the k-th
chunk of the ids that have one, a continuation bitmap tells which go on, and a rank
directory over the bitmap (a running count each 512 bits) finds an id's place on the
next level. Any token, document or range is read by its place alone; no block has to be
decoded first. Widths are chosen for each file from the lengths of its ids.

Layout, little-endian: magic, header length (uint32), header (JSON: counts, widths and
the byte range of each section), then the sections. Documents follow in ascending
doc_id order, over the files too; a manifest lists the files.

Defined results: a null text is an empty one and has its end id alone; repeated rows
repeat, side by side; null ids come first; an empty table makes no file and no row.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_pairs import ChunkEncoder, read_vocabulary
from .common import bound_batches, scratch, tidy

MAGIC = b"LLDAC01\n"
#: Ids in a file, about: a task starts another file beyond it, which bounds its memory.
IDS_PER_FILE = 4 << 20
#: Chunks that make up a text for the library, one a line: short texts cost it least.
LINES = 64
_BLOCK = 512
_WIDTHS = ((8, 8, 8, 8), (8, 8, 16), (8, 16, 8), (16, 16), (16, 8, 8), (32,))
_TYPE = {8: "<u1", 16: "<u2", 32: "<u4"}


def best_widths(ids: np.ndarray) -> tuple[int, ...]:
    """The widths that take the fewest bits for these ids."""
    beyond = {w: int((ids >> np.uint32(w)).astype(bool).sum()) if w else len(ids) for w in (0, 8, 16, 24)}

    def cost(widths: tuple[int, ...]) -> float:
        total, below = 0.0, 0
        for k, w in enumerate(widths):
            left = beyond[below]
            total += left * (w + (1 + 32 / _BLOCK) * (k + 1 < len(widths)))
            below += w
        return total

    return min(_WIDTHS, key=cost)


def pack(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """The bytes of one file of (doc_id, ids)."""
    ids = np.concatenate([x for _, x in docs]).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    widths = best_widths(ids)
    sections: list[tuple[str, bytes]] = [
        ("doc", np.array([d if d is not None else 0 for d, _ in docs], "<i8").tobytes()),
        ("null", np.array([d is None for d, _ in docs], "<u1").tobytes()),
        ("end", np.cumsum([len(x) for _, x in docs]).astype("<u8").tobytes()),
    ]
    rest = ids.astype(np.uint64)
    for k, w in enumerate(widths):
        sections.append((f"chunk{k}", (rest & np.uint64((1 << w) - 1)).astype(_TYPE[w]).tobytes()))
        if k + 1 == len(widths):
            break
        rest = rest >> np.uint64(w)
        more = rest > 0
        padded = np.zeros(-(-len(more) // _BLOCK) * _BLOCK, bool)
        padded[: len(more)] = more
        counts = padded.reshape(-1, _BLOCK).sum(axis=1)
        sections.append((f"more{k}", np.packbits(padded, bitorder="little").tobytes()))
        sections.append((f"rank{k}", (np.cumsum(counts) - counts).astype("<u4").tobytes()))
        rest = rest[more]
    at, spans = 0, {}
    for name, data in sections:
        spans[name] = [at, len(data)]
        at += len(data)
    header = json.dumps({"docs": len(docs), "ids": len(ids), "widths": widths, "sections": spans}).encode()
    return MAGIC + len(header).to_bytes(4, "little") + header + b"".join(x for _, x in sections)


class TokenFile:
    """Random access to the ids of a file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        n = int.from_bytes(data[8:12], "little")
        head = json.loads(data[12 : 12 + n])
        part = lambda name, kind: np.frombuffer(data, kind, head["sections"][name][1] // np.dtype(kind).itemsize, 12 + n + head["sections"][name][0])
        self.widths, self.n_ids, self.n_docs = head["widths"], head["ids"], head["docs"]
        self.doc, self.null, self.end = part("doc", "<i8"), part("null", "<u1"), part("end", "<u8").astype(np.int64)
        last = len(self.widths) - 1
        self.chunks = [part(f"chunk{k}", _TYPE[w]) for k, w in enumerate(self.widths)]
        self.more = [part(f"more{k}", "<u1") for k in range(last)]
        self.ranks = [part(f"rank{k}", "<u4") for k in range(last)]

    def rank(self, level: int, i: int) -> int:
        """Set continuation bits before place i."""
        if i // _BLOCK >= len(self.ranks[level]):
            i -= 1
            return self.rank(level, i) + int(self.more[level][i // 8] >> (i % 8) & 1) if i >= 0 else 0
        whole = self.more[level][i // _BLOCK * (_BLOCK // 8) : i // 8]
        below = int(self.more[level][i // 8]) & ((1 << i % 8) - 1)
        return int(self.ranks[level][i // _BLOCK]) + int(np.bitwise_count(whole).sum()) + below.bit_count()

    def token(self, i: int) -> int:
        """The id at place i, by one chunk, bit and rank for each of its levels."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for k, w in enumerate(self.widths):
            value |= int(self.chunks[k][i]) << shift
            if k + 1 == len(self.widths) or not self.more[k][i // 8] >> (i % 8) & 1:
                return value
            i, shift = self.rank(k, i), shift + w
        raise AssertionError

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids of a range: on each level they are a range too."""
        out = np.zeros(end - begin, np.uint32)
        place, shift = np.arange(end - begin), 0
        for k, w in enumerate(self.widths):
            out[place] |= self.chunks[k][begin:end].astype(np.uint32) << np.uint32(shift)
            if k + 1 == len(self.widths) or begin == end:
                break
            bits = np.unpackbits(self.more[k][begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
            place = place[bits.astype(bool)]
            begin, end, shift = self.rank(k, begin), self.rank(k, end), shift + w
        return out

    def document(self, k: int) -> tuple[int | None, int, np.ndarray]:
        """doc_id, start in this file, ids."""
        begin = int(self.end[k - 1]) if k else 0
        return None if self.null[k] else int(self.doc[k]), begin, self.ids(begin, int(self.end[k]))


class LibraryEncoder(ChunkEncoder):
    """Texts through the whole tokenizers library, each distinct chunk once.

    Chunks become the lines of texts that the library encodes; the offsets of its tokens
    tell which chunk an id belongs to.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode_batch(["\n".join(chunks[at : at + LINES]) for at in range(0, len(chunks), LINES)], add_special_tokens=False)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        whole = int(sizes.sum())
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32, whole)
        # begins and ends by turns; a text's places go on where those of the text before it end
        begins = np.fromiter(chain.from_iterable(chain.from_iterable(x.offsets for x in found)), np.int64, 2 * whole)[::2]
        stops = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        begins = begins + np.repeat(np.append(0, stops[LINES - 1 : -1 : LINES])[: len(found)], sizes)
        return ids, np.bincount(np.searchsorted(stops, begins, "right"), minlength=len(chunks))


_encoders: dict[int, LibraryEncoder] = {}


def encoder(tokenizer_json: str) -> LibraryEncoder:
    name = hash(tokenizer_json)
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = LibraryEncoder(tokenizer_json)
    return _encoders[name]


def open_folder(uri: str):
    """(file system, path) of a folder in any store that Arrow knows; local without a scheme."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if "://" not in uri and not uri.startswith("file:") else fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = None) -> list[dict]:
    """Encodes docs (doc_id, text) and writes the files; returns the manifest in order.

    Rows are dealt by doc_id range and sorted, so files follow each other. A task writes
    files under names of its own attempt and reports them in its rows: only a finished
    attempt's files enter the manifest, so a lost executor's leftovers are never read.
    The manifest has a row for each file, not for each document.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    spec = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # the tasks share the cores among them already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, place = encoder(spec.value), TaskContext.get().partitionId()
        store, base = open_folder(folder)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        held, n, seq = [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"ids-{place:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            data = pack(held)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"place": [place], "seq": [seq], "name": [name], "docs": [len(held)], "ids": [n], "bytes": [len(data)]}, schema)

        for batch, flat, ends in enc.run(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), np.split(flat, ends[:-1]), strict=True):
                held.append((doc, np.append(ids, tail)))
                n += len(held[-1][1])
                if n >= IDS_PER_FILE:
                    yield flush()
                    held, n, seq = [], 0, seq + 1
        if held:
            yield flush()

    schema = pa.schema([("place", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
    store, base = open_folder(folder)
    store.create_dir(base, recursive=True)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(tidy(run), "place long, seq long, name string, docs long, ids long, bytes long").collect()
    )
    manifest, start = [], 0
    for r in sorted(rows, key=lambda r: (r["place"], r["seq"])):
        manifest.append(r.asDict() | {"start": start})
        start += r["ids"]
    with store.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids_le (32-bit little-endian ids) from the files."""
    store, base = open_folder(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    files = spark.createDataFrame([(m["name"], m["start"]) for m in manifest], "name string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}") as f:
                    t = TokenFile(f.read())
                for k in range(0, t.n_docs, 500):
                    docs = [t.document(i) for i in range(k, min(k + 500, t.n_docs))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d for d, _, _ in docs], pa.int64()), pa.array([start + b for _, b, _ in docs], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for _, _, x in docs], pa.binary()),
                    ], ["doc_id", "start", "ids_le"])

    tasks = max(1, min(len(manifest), 4096))
    return files.repartition(tasks, "name").mapInArrow(run, "doc_id long, start long, ids_le binary")


def encode_to_files(docs: DataFrame, path: str, end_id: int | None = None, folder: str | None = None) -> DataFrame:
    """Writes the files of docs and reads them back."""
    folder = folder or scratch(docs.sparkSession, "token-files")
    write(docs, path, folder, end_id)
    return read(docs.sparkSession, folder)
