"""Byte-pair encoding and decoding in batched numpy merge rounds.

The vocabulary file is a tokenizers JSON: NFC, white space to blanks, lower case, a
split into letter runs, single digits and symbol runs, byte symbols, BPE with a word
end. Its text is broadcast (its size does not depend on the data); each worker builds
the tables once. A batch's unseen words lie in one flat symbol array; every round looks
all neighbouring pairs up by binary search over the sorted pair keys, merges the lowest
ranked pair of each word, and lets finished words go. Decoding looks the ids up in the
vocabulary and joins what they stand for.

Defined results: a null text is read as empty and gives no ids and an empty decoded
text; rows are answered one by one, so repeats repeat; texts of any length are encoded
whole; special strings in a text give their own id. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import bound_batches, tidy

#: Bytes of text whose distinct chunks are encoded together, and chunks that are at a time.
BYTES_AT_ONCE, CHUNKS_AT_ONCE = 16 << 20, 25_000
#: Chunks of up to LONGEST characters whose ids a worker remembers, about 200 bytes each.
MOST_REMEMBERED, LONGEST = 200_000, 64
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Pool:
    """Runs of ids under the numbers 0, 1, ... in one flat array."""

    def __init__(self) -> None:
        self.data, self.ends, self.runs = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), 0

    def add(self, data: np.ndarray, lengths: np.ndarray) -> None:
        at, n = int(self.ends[self.runs]), self.runs + len(lengths)
        if at + len(data) > len(self.data):
            self.data = np.resize(self.data, 2 * (at + len(data)))
        if n >= len(self.ends):
            self.ends = np.resize(self.ends, 2 * n + 1)
        self.data[at : at + len(data)] = data
        self.ends[self.runs + 1 : n + 1] = at + np.cumsum(lengths)
        self.runs = n

    def take(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs one after another, and the length of each."""
        begin = self.ends[runs]
        lengths = self.ends[runs + 1] - begin
        ends = np.cumsum(lengths)
        whole = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(begin - ends + lengths, lengths) + np.arange(whole)], lengths


def texts_of(names: pa.Array) -> list[str]:
    """The strings of an array without nulls; by way of numpy no Arrow scalar is made for each."""
    return names.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Encodes texts chunk by chunk between ASCII white space, each distinct one once.

    No word crosses white space, and no special string holds any, so a text's ids are those
    of its chunks in order. What occurs twice in BYTES_AT_ONCE of text is remembered beyond it.
    """

    def at_once(self) -> int:
        """Bytes of text that are encoded together."""
        return BYTES_AT_ONCE

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = Pool()

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after another, and how many each has."""
        raise NotImplementedError

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Each batch, the ids of all its texts, one after another, and where each text's end; null is empty."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= self.at_once():
                yield from self._encode(held)
                held, size = [], 0
        if held:
            yield from self._encode(held)

    def _encode(self, held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        parts = [pc.ascii_split_whitespace(b.column("text").fill_null("")) for b in held]
        stops = [p.offsets.to_numpy().copy() for p in parts]
        coded = pa.chunked_array([p.flatten() for p in parts], pa.string()).dictionary_encode()
        del parts
        index = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) if coded.num_chunks else np.zeros(0, np.int32)
        names = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
        del coded
        run, pool, get, fresh_at = np.zeros(len(names), np.int64), self.pool, self.known.get, []
        for at in range(0, len(names), CHUNKS_AT_ONCE):
            block = texts_of(names.slice(at, CHUNKS_AT_ONCE))
            found = np.array([get(c, -1) for c in block])
            fresh = np.flatnonzero(found < 0)
            if len(fresh):
                found[fresh] = np.arange(pool.runs, pool.runs + len(fresh))
                pool.add(*self.learn([block[i] for i in fresh.tolist()]))
            run[at : at + len(block)] = found
            fresh_at.append(fresh + at)
        at = 0
        for batch, stop in zip(held, stops, strict=True):
            ids, lengths = pool.take(run[index[at : at + int(stop[-1])]])
            at += int(stop[-1])
            yield batch, ids, np.append(0, np.cumsum(lengths))[stop[1:]]
        again = np.bincount(index, minlength=len(names)) > 1
        if len(self.known) + int(again[np.concatenate(fresh_at)].sum() if fresh_at else 0) > MOST_REMEMBERED:
            self.known, kept = {}, np.flatnonzero(again)[:MOST_REMEMBERED]
        else:
            kept = np.concatenate(fresh_at) if fresh_at else np.zeros(0, np.int64)
            kept = kept[again[kept]]
        self.known |= {c: r for c, r in zip(texts_of(names.take(pa.array(kept))), run[kept].tolist(), strict=True) if len(c) <= LONGEST}
        self.pool = Pool()
        self.pool.add(*pool.take(np.fromiter(self.known.values(), np.int64, len(self.known))))
        self.known = dict(zip(self.known, range(len(self.known)), strict=True))


class Codec(ChunkEncoder):
    """Encodes and decodes text in numpy."""

    def at_once(self) -> int:
        # decoding takes memory too
        return BYTES_AT_ONCE // 2

    def __init__(self, tokenizer_json: str):
        import regex

        super().__init__()
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # one call finds the words of many chunks: a line feed parts the chunks
        self.words = regex.compile(split["pattern"]["Regex"] + r"|\n").findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        self.size = max(max(vocab.values()), *self.special.values(), 0) + 1
        shown = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            shown[i] = t
        self.shown = pa.array(shown, pa.large_string())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, none of them empty, and where each word's end."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        symbols[np.cumsum(lengths) - 1] = self.final[raw[np.cumsum(lengths) - 1]]
        names = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(names):
            starts = np.cumsum(lengths) - lengths
            word = np.repeat(np.arange(len(names)), lengths)
            rank = np.full(len(symbols), _NONE)
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], _NONE)
            best = np.minimum.reduceat(rank, starts)
            over = best == _NONE
            if over.any():
                gone = over[word]
                done.append((names[over], lengths[over], symbols[gone]))
                if over.all():
                    break
            here = np.flatnonzero((rank == best[word]) & (rank != _NONE))
            # of overlapping occurrences (equal symbols in a row) every second one stays
            fresh = np.ones(len(here), bool)
            fresh[1:] = np.diff(here) > 1
            first = here[np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))]
            here = here[(here - first) % 2 == 0]
            symbols[here] = self.merged[at[here]]
            keep = ~over[word]
            keep[here + 1] = False
            lengths = (lengths - np.bincount(word[here], minlength=len(names)))[~over]
            symbols, names = symbols[keep], names[~over]
        name, length, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(name)
        begin, length = (np.cumsum(length) - length)[order], length[order]
        ends = np.cumsum(length)
        return ids[np.repeat(begin - ends + length, length) + np.arange(len(ids))], ends

    def normal(self, text: str) -> str:
        """NFC and lower case by character: a final sigma is an ordinary one."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(chunks)
        if any(s in joined for s in self.special):
            # specials among the words are marked by their id below zero
            found = [w for c in chunks for w in [*self.pieces(c), "\n"]]
        else:
            found = [*self.words(self.normal(joined)), "\n"]
        numbers: dict[str | int, int] = {"\n": 0}
        order = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
        words = list(numbers)[1:]
        plain = [w for w in words if isinstance(w, str)]
        ids, ends = self.merge([w.encode() for w in plain]) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        known = Pool()
        known.add(ids, np.diff(ends, prepend=0))
        known.add(np.array([w for w in words if isinstance(w, int)], np.int64), np.ones(len(words) - len(plain), np.int64))
        known.add(np.zeros(0, np.int64), np.zeros(1, np.int64))  # the line feed
        place = np.full(len(numbers), len(words), np.int64)
        for part, first in ((plain, 0), ([w for w in words if isinstance(w, int)], len(plain))):
            place[[numbers[w] for w in part]] = np.arange(first, first + len(part))
        out, lengths = known.take(place[order])
        stops = np.flatnonzero(order == 0)
        return out, np.diff(np.cumsum(lengths)[stops], prepend=0)

    def pieces(self, chunk: str) -> list:
        """The words, and the special ids between them."""
        out, at = [], 0
        for m in self.specials.finditer(chunk):
            out += [*self.words(self.normal(chunk[at : m.start()])), self.special[m[0]]]
            at = m.end()
        return [*out, *self.words(self.normal(chunk[at:]))]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """For each text its tokens' strings between blanks, special ones too."""
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), self.shown.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


_codecs: dict[int, Codec] = {}


def codec(tokenizer_json: str) -> Codec:
    """One Codec for each vocabulary and worker process."""
    name = hash(tokenizer_json)
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(tokenizer_json)
    return _codecs[name]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:  # on the driver: a small file of the installation
        return f.read()


def encode_decode(docs: DataFrame, path: str, decodes: bool = True) -> DataFrame:
    """doc_id, ids array<int>, decoded string (null without decodes) for each row of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch, ids, ends in c.run(batches):
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view(np.int32))),
                c.decode(ids, ends) if decodes else pa.nulls(batch.num_rows, pa.string()),
            ], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, decoded string")
