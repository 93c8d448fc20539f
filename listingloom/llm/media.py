"""Media columns as content-defined chunks: each distinct chunk is stored once.

A media payload is cut where a rolling gear hash of its last 32 bytes has leading zeros, so
equal passages of different media give equal chunks wherever they stand. Chunk digests meet
in Spark joins on ids and digests alone; the bytes that move are those of media with copies
(one copy is kept) and of chunks that several media share. A store has two tables: `packs`, a
row for each distinct medium with its ordered list of chunk digests and the bytes of the
chunks it owns, and `loans`, the chunks that a medium takes from another's pack. Reading puts
the lists together again and checks every chunk and every medium against its digest.

Defined results: a null payload is an empty one and has no chunk; equal media are one medium;
an empty table gives an empty store; a payload of any length is one row, as it is in its column.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, MOST_OF_A_KEY, bound_batches, materialize, meet, scratch, tidy

#: Bytes of a chunk: none is shorter (but a medium's last) or longer; beyond the shortest
#: length a cut comes after 2^CUT_BITS bytes on average.
SHORTEST, LONGEST, CUT_BITS = 512, 16384, 11
#: Bytes that the hash remembers: one for each of its bits.
WINDOW = 32
#: Bytes that are hashed at a time.
STRETCH = 1 << 22

#: One random word for each byte value, by rule.
GEAR = np.frombuffer(b"".join(hashlib.sha256(f"gear {i}".encode()).digest()[:4] for i in range(256)), "<u4")

_PACK = "id binary, n_bytes long, list array<binary>, borrows int, lends int, chunks array<struct<digest:binary,holders:long,bytes:binary>>"
_PACK_ARROW = pa.schema([
    ("id", pa.binary()), ("n_bytes", pa.int64()), ("list", pa.list_(pa.binary())), ("borrows", pa.int32()), ("lends", pa.int32()),
    ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("holders", pa.int64()), ("bytes", pa.binary())]))),
])


def cut_marks(data: np.ndarray) -> np.ndarray:
    """Ends of the stretches after which the gear hash asks for a cut, ascending.

    h = (h << 1) + GEAR[byte] over 32 bits is the sum of the last 32 words, each shifted by
    its age; the sum over 2, 4, .. 32 bytes is built from that over half as many.
    """
    found = []
    for at in range(0, len(data), STRETCH):
        lead = min(at, WINDOW - 1)
        h = GEAR[data[at - lead : at + STRETCH]]
        for k in (1, 2, 4, 8, 16):
            older = h[:-k] << np.uint32(k)
            h[k:] += older
        found.append(np.flatnonzero(h[lead:] >> np.uint32(32 - CUT_BITS) == 0) + at + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(marks: list[int], begin: int, end: int) -> list[int]:
    """Where the chunks of the bytes from begin to end stop; marks are those of the whole array.

    No cut is taken within WINDOW bytes of begin, so what precedes it has no say.
    """
    ends = []
    while begin < end:
        i = bisect_left(marks, begin + SHORTEST)
        stop = min(begin + LONGEST, end, marks[i] if i < len(marks) else end)
        ends.append(stop)
        begin = stop
    return ends


def _pieces(column: pa.Array) -> Iterator[list[bytes]]:
    """The chunks of each payload of a batch."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    begin = int(offsets[0])
    data = data[begin : int(offsets[-1])]
    marks = cut_marks(data).tolist()
    whole = data.tobytes()
    for a, b in zip((offsets[:-1] - begin).tolist(), (offsets[1:] - begin).tolist(), strict=True):
        ends = chunk_ends(marks, a, b)
        yield [whole[x:y] for x, y in zip([a, *ends], ends)]


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [[_digest(x) for x in pieces] for pieces in _pieces(batch.column("media"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists, pa.list_(pa.binary()))], ["id", "list"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        ids, borrowed, lent = (batch.column(c).to_pylist() for c in ("id", "borrowed", "lent"))
        for i, pieces in enumerate(_pieces(batch.column("media"))):
            digests = [_digest(x) for x in pieces]
            theirs, holders = set(borrowed[i] or ()), {x["chunk"]: x["holders"] for x in lent[i] or ()}
            own = {d: x for d, x in zip(digests, pieces, strict=True) if d not in theirs}
            rows.append({
                "id": ids[i], "n_bytes": sum(map(len, pieces)), "list": digests, "borrows": len(theirs), "lends": len(holders),
                "chunks": [{"digest": d, "holders": holders.get(d, 1), "bytes": x} for d, x in own.items()],
            })
        yield pa.RecordBatch.from_pylist(rows, _PACK_ARROW)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and media of packs and what they borrow; an error where bytes and digests differ."""
    for batch in batches:
        ids, lists, own, borrowed = (batch.column(c).to_pylist() for c in ("id", "list", "chunks", "borrowed"))
        media = []
        for i, wanted in enumerate(lists):
            have = {x["digest"]: x["bytes"] for x in [*own[i], *(borrowed[i] or ())]}
            if broken := [d.hex() for d, x in have.items() if _digest(x) != d]:
                raise ValueError(f"medium {ids[i].hex()}: chunk {broken[0]} has other bytes than its digest")
            if missing := [d.hex() for d in wanted if d not in have]:
                raise ValueError(f"medium {ids[i].hex()}: chunk {missing[0]} is missing")
            media.append(b"".join([have[d] for d in wanted]))
            if _digest(media[-1]) != ids[i]:
                raise ValueError(f"medium {ids[i].hex()}: its chunks do not make it up")
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(media, pa.binary())], ["id", "media"])


def identity(media: Column) -> Column:
    """The id under which a payload is stored: its SHA-256."""
    return F.unhex(F.sha2(F.coalesce(media, F.lit(b"")), 256))


def write(rows: DataFrame, folder: str, media: str = "media") -> None:
    """Stores the payloads of a binary column of rows; other columns are ignored."""
    bound_batches(rows.sparkSession)
    keyed = rows.select(F.coalesce(F.col(f"`{media}`"), F.lit(b"")).alias("media")).select(identity(F.col("media")).alias("id"), "media")
    lists = keyed.mapInArrow(tidy(_list_chunks), "id binary, list array<binary>")
    # a short number for each medium goes through the shuffles in place of its id
    known = materialize(
        lists.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.first("list").alias("list")).withColumn("number", F.monotonically_increasing_id()),
        "media-lists",
    )
    held = known.select("id", "number", F.explode(F.array_distinct("list")).alias("chunk"))
    shared = materialize(
        held.groupBy("chunk").agg(F.min("number").alias("owner"), F.count(F.lit(1)).alias("holders")).where("holders > 1"), "media-shared",
    )
    if shared.count() <= MOST_BROADCAST:
        met = held.join(F.broadcast(shared), "chunk")
    else:
        met = meet(held, shared.withColumn("_rows", F.col("holders")), ["chunk"], held.count())
    met = materialize(met.select("id", "chunk", "holders", (F.col("owner") != F.col("number")).alias("borrows")), "media-met")
    met.where("borrows").select("id", "chunk", "holders").write.parquet(f"{folder}/loans")
    marks = met.groupBy("id").agg(
        F.collect_list(F.when(F.col("borrows"), F.col("chunk"))).alias("borrowed"),
        F.collect_list(F.when(~F.col("borrows"), F.struct("chunk", "holders"))).alias("lent"),
    )
    marked = materialize(known.select("id", "copies").join(marks, "id", "left").where("copies > 1 or borrowed is not null"), "media-marked")
    size = marked.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.greatest(F.size("borrowed"), F.lit(0)) + F.greatest(F.size("lent"), F.lit(0))), F.lit(0))).first()[0]
    if size <= MOST_BROADCAST:
        # payloads without a copy stay where they are read
        near = F.broadcast(marked)
        alone = keyed.join(near, "id", "left").where("coalesce(copies, 1) = 1")
        copied = keyed.join(F.broadcast(marked.where("copies > 1").select("id")), "id", "left_semi")
        once = copied.groupBy("id").agg(F.first("media").alias("media")).join(near, "id")
        ready = alone.unionByName(once)
    else:
        ready = keyed.groupBy("id").agg(F.first("media").alias("media")).join(marked, "id", "left")
    packs = ready.select("id", "media", "borrowed", "lent").mapInArrow(tidy(_pack), _PACK)
    packs.write.option("compression", "zstd").parquet(f"{folder}/packs")


def _salts(holders: Column) -> Column:
    """Copies of a shared chunk, so that no task meets more than MOST_OF_A_KEY of its borrowers."""
    return F.ceil(holders / F.lit(MOST_OF_A_KEY)).cast("int")


def read(spark: SparkSession, folder: str, then: Callable | None = None, schema: str = "id binary, media binary") -> DataFrame:
    """id and media of every stored medium, verified.

    `then` may take the place of the media: a function from Arrow batches (id, media) to
    batches of schema, run where the media are put together.
    """
    bound_batches(spark)
    packs, loans = spark.read.schema(_PACK).parquet(f"{folder}/packs"), spark.read.schema("id binary, chunk binary, holders long").parquet(f"{folder}/loans")
    lent = (
        packs.where("lends > 0").select(F.explode("chunks").alias("x")).where("x.holders > 1")
        .select(F.col("x.digest").alias("chunk"), F.col("x.bytes").alias("bytes"), F.explode(F.sequence(F.lit(0), _salts(F.col("x.holders")) - 1)).alias("salt"))
    )
    wanted = loans.withColumn("salt", F.pmod(F.xxhash64("id"), _salts(F.col("holders"))).cast("int"))
    got = wanted.join(lent, ["chunk", "salt"]).groupBy("id").agg(F.collect_list(F.struct(F.col("chunk").alias("digest"), "bytes")).alias("borrowed"))
    columns = ["id", "list", "chunks"]
    none = F.lit(None).cast("array<struct<digest:binary,bytes:binary>>")
    whole = packs.where("borrows = 0").select(*columns, none.alias("borrowed")).unionByName(
        packs.where("borrows > 0").select(*columns).join(got, "id", "left").select(*columns, "borrowed")
    )
    return whole.mapInArrow(tidy(lambda batches: then(_rebuild(batches)) if then else _rebuild(batches)), schema)


# --- 8-bit grey images ---------------------------------------------------------------

#: Samples of a row of the image, and of the unit that payloads are padded to.
WIDTH, UNIT = 24, 576


def image(text: Column) -> Column:
    """A binary grey map (PGM, 8 bits a sample) of the text's UTF-8 bytes, filled up with 255."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.greatest(F.ceil(F.octet_length(data) / F.lit(UNIT)), F.lit(1)) * UNIT
    header = F.concat(F.lit(f"P5\n{WIDTH} "), (n / WIDTH).cast("long").cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(header, F.rpad(data, n.cast("int"), F.lit(b"\xff")))


FEATURES = "id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def image_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digests, and as feature width x height, sum, least and largest sample, and the counts of eight equal ranges of samples."""
    for batch in batches:
        rows: list[tuple] = []
        for key, media in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            kind, size, depth, payload = media.split(b"\n", 3)
            width, height = map(int, size.split())
            if kind != b"P5" or depth != b"255" or width * height != len(payload):
                raise ValueError(f"medium {key.hex()} is no grey map")
            samples = np.frombuffer(payload, np.uint8)
            counts = np.bincount(samples >> 5, minlength=8)
            feature = f"{width}x{height};{int(samples.sum(dtype=np.int64))};{samples.min()};{samples.max()};{','.join(map(str, counts))}"
            rows.append((
                key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                len(media), hashlib.sha256(media).hexdigest(), feature,
            ))
        names = [f.split()[0] for f in FEATURES.split(", ")]
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes and the features of its stored image for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "media")
    pictures = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), image(F.col("text")).alias("media"))
    write(pictures, folder)
    features = materialize(read(spark, folder, image_features, FEATURES), "media-features")
    rows = materialize(pictures.select("doc_id", "n_bytes", identity(F.col("media")).alias("id")), "media-rows")
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_rows"))
    return meet(rows, features.join(counts, "id"), ["id"], rows.count()).drop("id")
