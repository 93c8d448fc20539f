"""Benchmark decontamination by SimHash over item-sized windows.

A document leaks an item if one of its windows of as many words as the item (the whole
document, if shorter) has weighted shingle similarity SIMILARITY or more with it: five
words a shingle (all words of a shorter item), each weighing as often as it occurs, sum of
minima over sum of maxima. Nothing else of the benchmark enters, so an answer depends on
one item and one document alone, however the items are dealt to blocks.

A window that reaches SIMILARITY holds a share of known shingles that follows from it;
windows below that share are passed over. The others get 128-bit SimHash fingerprints from
running sums, and the multi-index names their candidates: the items of the window's size
that are within RADIUS // BLOCKS bits of it in some block of 16 bits, which holds for every
item within RADIUS. Those within RADIUS are compared exactly. RADIUS is 2.9 standard
deviations above the distance expected at SIMILARITY exactly (0.2 % of such windows lie
beyond it, next to none of more similar ones). The benchmark is met in blocks of bounded size.

Defined results: null or empty documents and items without words leak nothing; a row
for each leaking (document row, item), the best window, the first of equal ones; repeated
rows repeat; whole texts of any length are searched. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 128, 8, 31
#: Windows of a document that are looked up at once; bounds what a very long text takes.
STRETCH = 8192
#: Bytes and items of the benchmark that are broadcast at once (the index of an item takes
#: 22 kB); a larger benchmark takes more passes.
BLOCK_BYTES, BLOCK_ITEMS = 16 << 20, 4000

_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The changes of 16 bits that flip RADIUS // BLOCKS of them at most.
_FLIPS = np.flatnonzero(np.bitwise_count(np.arange(1 << BITS // BLOCKS, dtype=np.uint32)) <= RADIUS // BLOCKS).astype(np.uint16)
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_BLANK).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1))
    return h


class Benchmark:
    """The items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str | None]]):
        split = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in split if w]
        self.word_ids: dict[bytes, int] = {}
        for _, words in self.items:
            for w in words:
                self.word_ids.setdefault(w, len(self.word_ids) + 1)
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.shingles = [shingle_hashes(np.array([self.word_ids[w] for w in words], np.int64), min(SHINGLE, len(words))) for _, words in self.items]
        kinds = {min(SHINGLE, int(n)) for n in self.sizes}
        self.known = {k: np.unique(np.concatenate([s for s, n in zip(self.shingles, self.sizes, strict=True) if min(SHINGLE, n) == k])) for k in kinds}
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        none = np.zeros((0, BITS // 8), np.uint8)
        self.prints = np.concatenate([none, *[self.fingerprints(self.running(s), np.array([0]), np.array([len(s)])) for s in self.shingles]])
        #: for each block, where the items near each of its values begin and end, and the items
        self.index = []
        for block in self.prints.view(np.uint16).T:
            values = (block[:, None] ^ _FLIPS[None]).ravel()
            order = np.argsort(values, kind="stable")
            self.index.append((np.searchsorted(values[order], np.arange(1 << BITS // BLOCKS), "left"), np.bincount(values, minlength=1 << BITS // BLOCKS), (order // len(_FLIPS)).astype(np.int32)))

    @staticmethod
    def running(hashes: np.ndarray) -> np.ndarray:
        """Sums of the shingles' signs before each place."""
        both = np.stack([mix(hashes + np.uint64(1)), mix(hashes ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
        signs = np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1
        return np.vstack([np.zeros((1, BITS), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])

    @staticmethod
    def fingerprints(running: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.packbits(running[end] > running[begin], axis=1)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS for items of this size, by the multi-index."""
        pairs = [np.zeros(0, np.int64)]
        for (first, count, items), values in zip(self.index, prints.view(np.uint16).T, strict=True):
            begin, n = first[values], count[values]
            window = np.repeat(np.arange(len(prints)), n)
            item = items[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
            own = self.sizes[item] == size
            pairs.append(window[own] * len(self.items) + item[own])
        w, n = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.items)))
        keep = np.bitwise_count(prints[w] ^ self.prints[n]).sum(axis=1, dtype=np.int64) <= RADIUS
        return w[keep], n[keep]

    def similarity(self, item: int, window: list[int]) -> float:
        own, other = self.counts[item], Counter(window)
        low = sum(min(c, other[h]) for h, c in own.items() if h in other)
        return low / (own.total() + other.total() - low)

    def leaks(self, ids: np.ndarray, hits: dict[int, np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of a document, ids its word numbers.

        hits: for each shingle length the places that hold a known shingle.
        """
        out = []
        for k, places in hits.items():
            hashes = shingle_hashes(ids, k)
            known = np.zeros(len(hashes) + 1, np.int64)
            known[places + 1] = 1
            known = np.cumsum(known)
            best: dict[int, tuple[float, int]] = {}
            sizes = sorted({int(n) for n in self.sizes if min(SHINGLE, n) == k})
            for at in range(0, len(hashes), STRETCH):
                running = None
                for size in sizes:
                    begin = np.arange(at, min(at + STRETCH, max(0, len(ids) - size) + 1))
                    end = np.minimum(begin + size - k + 1, len(hashes))
                    # what a window shares with an item is known: at least this much at SIMILARITY
                    least = SIMILARITY / (1 + SIMILARITY) * (size - k + 1 + end - begin)
                    enough = known[end] - known[begin] >= least - 1e-9
                    begin, end = begin[enough], end[enough]
                    if not len(begin):
                        continue
                    if running is None:
                        running = self.running(hashes[at : at + STRETCH + sizes[-1]])
                    w, items = self.candidates(self.fingerprints(running, begin - at, end - at), size)
                    for i, n in zip(w.tolist(), items.tolist(), strict=True):
                        s = self.similarity(n, hashes[begin[i] : end[i]].tolist())
                        if s >= SIMILARITY and s > best.get(n, (0.0, 0))[0] + 1e-12:
                            best[n] = (s, int(begin[i]))
            out += [(n, at, min(int(self.sizes[n]), len(ids)), s) for n, (s, at) in sorted(best.items())]
        return out

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity) of the texts of a batch."""
        if not self.items:
            return
        get, split = self.word_ids.get, [words_of(t) for t in texts]
        gap = SHINGLE
        sizes = np.array([len(s) + gap for s in split], np.int64)
        ids = np.zeros(sizes.sum(), np.int64)
        starts = np.cumsum(sizes) - sizes
        for at, s in zip(starts.tolist(), split, strict=True):
            ids[at : at + len(s)] = [get(w, 0) for w in s]
        found: dict[int, dict[int, np.ndarray]] = {}
        known = ids > 0
        for k, hashes in self.known.items():
            run = known[: len(ids) - k + 1].copy()
            for j in range(1, k):
                run &= known[j : len(ids) - k + 1 + j]
            at = np.flatnonzero(run)
            h = np.full(len(at), k, np.uint64)
            for j in range(k):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[at + j].astype(np.uint64) + np.uint64(1))
            spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            at = at[hashes[spot] == h]
            text = np.searchsorted(starts, at, "right") - 1
            for t in np.unique(text).tolist():
                found.setdefault(t, {})[k] = at[text == t] - starts[t]
        for t, hits in sorted(found.items()):
            own: dict[bytes, int] = {}
            # words that no item has get numbers of their own below zero
            numbers = np.array([get(w) or own.setdefault(w, -len(own) - 2) for w in split[t]], np.int64)
            for n, at, length, s in self.leaks(numbers, hits):
                yield t, n, at, length, s


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_BYTES of text and BLOCK_ITEMS, read one by one."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"]) * 2 + 64
        if size > BLOCK_BYTES or len(held) >= BLOCK_ITEMS:
            yield held
            held, size = [], 0
    yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity for each leak of benchmark (item_id, text) in docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def over(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(shared.value)
            for batch in batches:
                got = list(bench.search(batch.column("text").to_pylist()))
                if got:
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64())),
                        pa.array([bench.items[g[1]][0] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                        pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.float64()),
                    ], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, item_id long, start_word long, n_words long, similarity double")

    return reduce(DataFrame.union, [over(b) for b in _blocks(benchmark)])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item; all columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(shared.value)
            for batch in batches:
                leaking = {g[0] for g in bench.search(batch.column("text").to_pylist())}
                yield batch.filter(pa.array([i not in leaking for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
