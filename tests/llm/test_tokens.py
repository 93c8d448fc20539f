"""The codec, the token files and their random access, against the library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from listingloom.llm import byte_pairs, queries, token_files

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.tokenizer_path()
ODD = ["it's ok<|endoftext|>a b", "Σας ΟΔΟΣ", "don'T I'LL x'd 12 ab12", "é É　x\x1cy", "", "<|startoftext|>", "àb\x00c", "🙂 x—y", "ﬁ İstanbul",
       "aaaaaaaa aaa bbbbbbb !!!!!!!!!", "  \x85 a", "x́ ́y Å", "1234 ½ ²", "a<|endoftext|> <|endoftext|>B", "   ", "\n\n a\n", "word " * 3000, "z" * 4000, None]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.mark.parametrize("kind", [byte_pairs.Codec, token_files.LibraryEncoder])
def test_ids_are_the_librarys(library, kind):
    c = kind(byte_pairs.read_vocabulary(PATH))
    rng = random.Random(1)
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice("abAB 'sné́Σ1<|>\n!") for _ in range(60)) for _ in range(200)]
    for at in (0, 0, 5):  # again, with what is remembered
        batch = pa.RecordBatch.from_pydict({"text": pa.array(texts[at:] + [None])})
        [(_, ids, ends)] = c.run(iter([batch]))
        got = np.split(ids, ends)
        for i, t in enumerate(texts[at:]):
            assert got[i].tolist() == library.encode(t, add_special_tokens=False).ids, t
        if kind is byte_pairs.Codec:
            decoded = c.decode(ids, ends).to_pylist()
            assert decoded == [library.decode(x.tolist(), skip_special_tokens=False) for x in got[:-1]]


@pytest.mark.parametrize("kind", [byte_pairs.Codec, token_files.LibraryEncoder])
def test_batches_and_memory_bounds_change_nothing(library, kind, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BYTES_AT_ONCE", 300)
    monkeypatch.setattr(byte_pairs, "CHUNKS_AT_ONCE", 7)
    monkeypatch.setattr(byte_pairs, "MOST_REMEMBERED", 20)
    monkeypatch.setattr(token_files, "LINES", 3)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "The,", "a<|endoftext|>b", "é", "x" * 70, f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[at : at + 7], pa.string())}) for at in range(0, 60, 7)]
    batches.insert(3, pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))
    got = [x.tolist() for _, ids, ends in kind(byte_pairs.read_vocabulary(PATH)).run(iter(batches)) for x in (np.split(ids, ends[:-1]) if len(ends) else [])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_digests(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op8_byte_pairs(spark, small).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_files_hold_all_documents_in_order(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op7_token_files(spark, small).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(raw))
        start += len(ids)


def test_odd_documents(spark, documents):
    rows = token_files.encode_to_files(documents([*ODD, (None, "no id"), (3, "again"), (3, "again")]), PATH, 2).collect()
    assert len(rows) == len(ODD) + 3 and rows and min(r["start"] for r in rows) == 0
    assert [r for r in rows if r["doc_id"] is None][0]["start"] == 0
    enc = {r["doc_id"]: r for r in byte_pairs.encode_decode(documents(ODD), PATH).collect()}
    assert enc[len(ODD) - 1]["ids"] == [] and enc[len(ODD) - 1]["decoded"] == ""


def test_empty_table(spark, documents):
    assert token_files.encode_to_files(documents([]), PATH, 2).count() == 0
    assert byte_pairs.encode_decode(documents([]), PATH).count() == 0


@pytest.mark.parametrize("high", [200, 50_000, 1 << 20, 1 << 32])
def test_random_access(high):
    rng = np.random.default_rng(high % 97)
    docs = [(k if k else None, rng.integers(0, high, n).astype(np.uint32)) for k, n in enumerate([0, 1, 511, 512, 513, 3000])]
    f = token_files.TokenFile(token_files.pack(docs))
    flat = np.concatenate([x for _, x in docs])
    assert all(f.token(i) == flat[i] for i in [0, 1, 510, 511, 512, 1023, 1024, len(flat) - 1, *rng.integers(0, len(flat), 200).tolist()])
    assert (f.ids(300, 2000) == flat[300:2000]).all() and len(f.ids(5, 5)) == 0
    for k, (doc, ids) in enumerate(docs):
        got = f.document(k)
        assert got[0] == doc and (got[2] == ids).all()
    with pytest.raises(IndexError):
        f.token(len(flat))


def test_a_token_costs_the_library_encoder_no_python_call():
    import cProfile
    import pstats

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        enc = token_files.LibraryEncoder(f.read())
    chunks = [f"{'Straße' * (i % 9)}{i * i}<|endoftext|>é{chr(0x4E00 + i)}" if i % 3 else "x" * (i % 70 + 1) for i in range(3 * token_files.LINES)]
    for n in (1, token_files.LINES, token_files.LINES + 1, len(chunks)):
        seen = cProfile.Profile()
        ids, counts = seen.runcall(enc.learn, chunks[:n])
        each = [enc.library.encode(c, add_special_tokens=False).ids for c in chunks[:n]]
        assert ids.tolist() == sum(each, []) and counts.tolist() == [len(x) for x in each]
    assert pstats.Stats(seen).total_calls < len(ids) // 2
