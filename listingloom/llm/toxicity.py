"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings (so
inflected forms share what they have in common). Filters of several widths slide over
the whole text, each keeps its largest response, and a logistic layer weighs them. As
a filter is linear in its words, each distinct word is multiplied with all filters once
and a text only adds up rows. A threshold is fitted for each language, told from the
text's own function words, and scores are bent so that each threshold lies at CUT.

Learned on all labelled rows, in parts of bounded size whose networks are averaged; both classes
count alike. Nothing but the text enters a score.

Defined results: a null or empty text, or one of unknown words only, gets the score of
an empty text; without both classes in the labels all scores are 0; repeated rows are
scored row by row; texts of any length are scored whole. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, bound_batches, discard, give_back, materialize, tidy

#: Labelled rows that are learned together in a task, buckets whose vectors are summed together.
ROWS_OF_A_PART, BLOCK = 3000, 1024
#: Epochs that each of several parts adds; the most that a row of a rare class counts for.
MORE_EPOCHS, MOST_WEIGHT = 2, 30
#: Steps of a calibration row's logit to one.
STEPS = 1000
#: The score from which a text is called toxic.
CUT = 0.3
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 8
#: Beginnings of these many bytes are hashed beside the word.
BEGINNINGS = (4, 5, 6)
#: A bucket is learned when it occurs in so many texts of a part.
LEAST_TEXTS = 3
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.08, 1e-5
#: Positive calibration rows that a language needs for a threshold of its own.
LEAST_POSITIVE = 20
#: F1 that a threshold may lose for a wider gap.
SLACK = 0.01
MOST_REMEMBERED = 100_000
#: Characters that are scored at once, beside a longer text.
PIECE = 500_000

_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Frequent function words that tell the language of a text.
_FUNCTION_WORDS = {
    "en": "the of and to in that was is for with on as by this from not",
    "de": "der die das und von zu mit den auf für ist im dem nicht des ein",
    "fr": "le les des est dans pour que qui une sur par pas avec plus ce du",
    "es": "el los las del que por con una para se como su al y lo mi",
}
LANGUAGES = [*_FUNCTION_WORDS, "other"]
_WORD_LANGUAGE: dict[bytes, int] = {}
for _k, _words in enumerate(_FUNCTION_WORDS.values()):
    for _w in _words.split():
        _WORD_LANGUAGE[_w.encode()] = -1 if _w.encode() in _WORD_LANGUAGE else _k


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_BLANK).split() if text else []


def buckets_of(word: bytes) -> list[int]:
    """The word's bucket and those of its beginnings."""
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n], n) % BUCKETS for n in BEGINNINGS if len(word) > n or len(word) == n)]


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM, zero where not learned
    filters: np.ndarray  # DIM x columns, one column for each (width, offset, filter)
    bias: np.ndarray  # one for each filter
    weights: np.ndarray
    offset: float
    thresholds: list[float] = field(default_factory=lambda: [0.5] * len(LANGUAGES))

    def columns(self, word: bytes) -> np.ndarray:
        return self.table[buckets_of(word)].sum(axis=0) @ self.filters


def spans() -> list[tuple[int, int]]:
    """(first column, width) of each width's filters."""
    out, at = [], 0
    for w in WIDTHS:
        out.append((at, w))
        at += w * FILTERS
    return out


def convolve(rows: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each width the filters' responses at each place; max(WIDTHS) blanks end each text.

    A window from a text's second blank on would reach into the next text: it responds with
    minus infinity, which no maximum takes.
    """
    out, ends = [], np.append(starts[1:], len(ids))
    for at, width in spans():
        total = rows[ids, at : at + FILTERS]
        for k in range(1, width):
            total[:-k] += rows[ids[k:], at + k * FILTERS : at + (k + 1) * FILTERS]
        for back in range(1, max(WIDTHS)):
            total[ends - back] = -np.inf
        out.append(total)
    return out


class Scorer:
    """Scores texts; remembers the filter columns of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        # word 0 is the blank that ends each text
        self.known: dict[bytes, int] = {b"": 0}
        width = self.model.filters.shape[1]
        self.rows = np.zeros((1024, width), np.float32)
        self.language = np.full(1024, -1, np.int8)

    def learn(self, words: list[bytes]) -> None:
        n = len(self.known)
        need = n + len(words)
        if need > len(self.rows):
            more = max(need, 2 * len(self.rows))
            self.rows = np.resize(self.rows, (more, self.rows.shape[1]))
            self.language = np.resize(self.language, more)
        hashed = [buckets_of(w) for w in words]
        flat = np.fromiter((b for h in hashed for b in h), np.int64)
        sizes = np.fromiter(map(len, hashed), np.int64, len(hashed))
        vectors = np.add.reduceat(self.model.table[flat], np.cumsum(sizes) - sizes, axis=0)
        self.rows[n:need] = vectors @ self.model.filters
        self.language[n:need] = [_WORD_LANGUAGE.get(w, -1) for w in words]
        self.known.update(zip(words, range(n, need), strict=True))

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language index) of each text."""
        if len(self.known) > MOST_REMEMBERED:
            self.forget()
        split = [words_of(t) for t in texts]
        fresh = [w for w in set().union(*split) if w not in self.known] if split else []
        if fresh:
            self.learn(fresh)
        pad = max(WIDTHS)
        ids = np.fromiter((self.known[w] for s in split for w in (*s, *[b""] * pad)), np.int32)
        sizes = np.fromiter((len(s) + pad for s in split), np.int64, len(split))
        starts = np.cumsum(sizes) - sizes
        pooled = np.hstack([np.maximum.reduceat(x, starts, axis=0) for x in convolve(self.rows, ids, starts)])
        hidden = np.maximum(pooled + self.model.bias, 0)
        spoken = self.language[ids]
        counts = np.stack([np.add.reduceat((spoken == k).astype(np.int32), starts) for k in range(len(_FUNCTION_WORDS))], axis=1)
        language = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(LANGUAGES) - 1)
        return hidden @ self.model.weights + self.model.offset, language

    def scores(self, texts: list[str | None]) -> np.ndarray:
        # pieces of bounded size: one very long text at a time is the most that is held
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < PIECE):
                size += len(texts[end] or "")
                end += 1
            logit, language = self.logits(texts[at:end])
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            t = np.array(self.model.thresholds)[language]
            out.append(np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t)))
            at = end
        return np.clip(np.concatenate(out), 0.0, 1.0) if out else np.zeros(0)


def examples(docs: DataFrame, labels: DataFrame, usable) -> DataFrame:
    """doc_id, toxic, text of every labelled row with a text.

    A document whose labels contradict each other is no example.
    """
    known = (
        labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
        .where("toxic = _most").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    )
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known) if known.count() <= MOST_BROADCAST else known, "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


#: The name by which callers knew `examples` when it took some of the rows.
sample = examples


class Fit:
    """A network in training: its parts and the sums of squares by which their steps shrink."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.usual = np.zeros(BUCKETS + 1, bool)
        n_columns, n_filters = sum(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS
        self.parts = [
            self.rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32), self.rng.normal(0, 0.3, (DIM, n_columns)).astype(np.float32),
            np.zeros(n_filters, np.float32), self.rng.normal(0, 0.3, n_filters).astype(np.float32), np.zeros(1, np.float32),
        ]
        self.squares = [np.full_like(x, 1e-3) for x in self.parts]

    def model(self) -> Model:
        table, filters, bias, weights, offset = self.parts
        return Model(table[:BUCKETS] * self.usual[:BUCKETS, None], filters, bias, weights, float(offset[0]))

    def learn(self, texts: list[np.ndarray], label: np.ndarray, hashed: np.ndarray, own: np.ndarray, weight: np.ndarray, fit: list[int], epochs: int) -> None:
        """Steps on the texts (word numbers, hashed has the buckets of each) whose places are in fit; own: the buckets to be learned."""
        rng, parts, squares = self.rng, self.parts, self.squares
        usual = self.usual = self.usual | own
        table, filters, bias, weights, offset = parts
        pad = np.zeros(max(WIDTHS), np.int32)
        # what is not learned counts for nothing
        blank = table[~usual].copy()
        table[~usual] = 0
        # each filter's columns: [first of its width + k * FILTERS + j]
        for _ in range(epochs):
            rng.shuffle(fit)
            for at in range(0, len(fit), BATCH):
                chosen = fit[at : at + BATCH]
                ids = np.concatenate([np.concatenate([texts[i], pad]) for i in chosen])
                sizes = np.array([len(texts[i]) + len(pad) for i in chosen])
                starts = np.cumsum(sizes) - sizes
                unique, ids = np.unique(ids, return_inverse=True)
                vectors = table[hashed[unique]].sum(axis=1)
                rows_ = vectors @ filters
                responses = convolve(rows_, ids, starts)
                pooled, places = [], []
                for x in responses:
                    best = np.maximum.reduceat(x, starts, axis=0)
                    pooled.append(best)
                    hit = np.argwhere(x == np.repeat(best, sizes, axis=0))
                    text = np.searchsorted(starts, hit[:, 0], "right") - 1
                    first = np.unique(text * FILTERS + hit[:, 1], return_index=True)[1]
                    places.append(hit[first, 0].reshape(len(chosen), FILTERS))
                pre = np.hstack(pooled) + bias
                hidden = np.maximum(pre, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ weights + offset[0], -30, 30)))
                d = ((p - label[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
                d_pre = d[:, None] * weights[None] * (pre > 0)
                d_rows = np.zeros_like(rows_)
                for k, (column, width) in enumerate(spans()):
                    for j in range(width):
                        np.add.at(d_rows, (ids[places[k] + j], column + j * FILTERS + np.arange(FILTERS)[None]), d_pre[:, k * FILTERS : (k + 1) * FILTERS])
                live = np.flatnonzero(np.abs(d_rows).sum(axis=1))
                grads = [None, vectors[live].T @ d_rows[live] + DECAY * filters, d_pre.sum(axis=0), hidden.T @ d + DECAY * weights, d.sum(keepdims=True)]
                d_vectors = d_rows[live] @ filters.T
                touched, spot = np.unique(hashed[unique[live]], return_inverse=True)
                g = np.zeros((len(touched), DIM), np.float32)
                for k in range(hashed.shape[1]):
                    np.add.at(g, spot.reshape(len(live), -1)[:, k], d_vectors)
                g *= usual[touched][:, None]
                squares[0][touched] += g * g
                table[touched] -= RATE * g / np.sqrt(squares[0][touched])
                for x, s, gr in zip(parts[1:], squares[1:], grads[1:], strict=True):
                    s += gr * gr
                    x -= RATE * gr / np.sqrt(s)
        table[~usual] = blank


def numbered(rows: Iterable[tuple[str, int]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Texts as word numbers, their labels, the buckets of each word, and which buckets occur in LEAST_TEXTS texts."""
    # one by one, so the words of one text at a time are held
    place: dict[bytes, int] = {}
    texts, labels = [], []
    for t, y in rows:
        words = words_of(t)
        texts.append(np.fromiter((place.setdefault(w, len(place) + 1) for w in words), np.int32, len(words)))
        labels.append(y)
    hashed = np.full((len(place) + 1, 1 + len(BEGINNINGS)), BUCKETS, np.int32)
    for w, i in place.items():
        h = buckets_of(w)
        hashed[i, : len(h)] = h
    seen = np.zeros(BUCKETS + 1, np.int32)
    for ids in texts:
        seen[np.unique(hashed[np.unique(ids)])] += 1
    usual = seen >= LEAST_TEXTS
    usual[BUCKETS] = False
    return texts, np.array(labels, np.float32), hashed, usual


def evened(label: np.ndarray, counts: tuple[int, int]) -> np.ndarray:
    """Weights that let both classes, of counts rows, count alike; a row counts for MOST_WEIGHT at most."""
    of = [min(MOST_WEIGHT, sum(counts) / (2 * max(1, c))) for c in counts]
    return np.where(label == 1, of[1], of[0])


def train(rows: Iterable[tuple[str, int]] | DataFrame, seed: int = 7) -> Model | None:
    """Fits the network on four fifths of the rows and the thresholds on the rest.

    rows: (text, label) pairs, or what `examples` returns, of any number.
    """
    if isinstance(rows, DataFrame):
        return _train_by_parts(rows, seed)
    check_texts: list[str] = []

    def passed() -> Iterator[tuple[str, int]]:
        for i, (t, y) in enumerate(rows):
            if i % 5 == 0:
                check_texts.append(t)
            yield t, y

    texts, label, hashed, usual = numbered(passed())
    if len(set(label.tolist())) < 2:
        return None
    net = Fit(seed)
    net.learn(texts, label, hashed, usual, evened(label, (int((label == 0).sum()), int((label == 1).sum()))), [i for i in range(len(texts)) if i % 5], EPOCHS)
    model = net.model()
    told = [calibration(Scorer(model), [t]) for t in check_texts]
    language, bins = (np.concatenate(x) for x in zip(*told, strict=True))
    truth, ones = label[::5], np.ones(len(bins), np.int64)
    fit_thresholds(model, language, bins, ones * (truth == 1), ones)
    return model


def calibration(scorer: Scorer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(language, logit) of each text, the logit in whole steps of 1 / STEPS."""
    logit, language = scorer.logits(texts)
    return language, np.round(np.clip(logit, -30, 30) * STEPS).astype(np.int64)


def fit_thresholds(model: Model, language: np.ndarray, bins: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> None:
    """Sets the thresholds; of counts calibration rows of a language and logit, hits are toxic."""
    p = 1 / (1 + np.exp(-bins / STEPS))
    every = threshold(p, hits, counts)
    for k in range(len(LANGUAGES)):
        own = language == k
        enough = min(hits[own].sum(), (counts - hits)[own].sum()) >= LEAST_POSITIVE
        model.thresholds[k] = threshold(p[own], hits[own], counts[own]) if enough else every


def _train_by_parts(rows: DataFrame, seed: int) -> Model | None:
    """Trains on all rows, in parts of about ROWS_OF_A_PART.

    One part gives all others the network they start from; each goes on with its own rows, and the
    mean of the parts is the model. A bucket's vector is the mean over the parts that know it. The
    parts' networks are summed in blocks of buckets, so the driver sees one network; every
    calibration row counts for the thresholds.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    given = materialize(rows.select("doc_id", order.alias("_order"), "toxic", "text"), "examples")
    counts = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        discard(given)
        return None
    of_class, parts = (counts[0], counts[1]), -(-sum(counts.values()) // ROWS_OF_A_PART)
    # hashes of an id, each with a seed of its own, tell its part and whether it calibrates
    dealt = given.withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)).cast("int")).withColumn("_check", F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(5)) == 0)

    def fitted(begun: Fit | None, epochs: int):
        def of_part(table: pa.Table) -> Fit:
            net = pickle.loads(pickle.dumps(begun)) if begun else Fit(seed)
            texts, label, hashed, usual = numbered(zip((x.as_py() for x in table.column("text")), table.column("toxic").to_pylist(), strict=True))
            net.learn(texts, label, hashed, usual, evened(label, of_class), list(range(len(texts))), epochs)
            net.usual = usual
            return net
        return of_part

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(fitted(None, EPOCHS)(pa.Table.from_batches(held)))]})

    wanted = dealt.where(~F.col("_check")).select("_part", "_order", "doc_id", "toxic", "text")
    start = wanted.where("_part = 0").repartition(1).sortWithinPartitions("_order", "doc_id").mapInArrow(tidy(first), "net binary").collect()
    begun = pickle.loads(start[0]["net"]) if start else Fit(seed)
    net = begun
    if parts > 1:
        shared = spark.sparkContext.broadcast(begun)

        def refined(table: pa.Table) -> pa.Table:
            part = table.column("_part")[0].as_py()
            made = fitted(shared.value, MORE_EPOCHS)(table.sort_by([("_order", "ascending"), ("doc_id", "ascending")]))
            known, out = np.flatnonzero(made.usual), []
            for k in range(BUCKETS // BLOCK):
                at = known[known // BLOCK == k]
                out.append((k, part, at.astype(np.int64).tobytes(), made.parts[0][at].tobytes()))
            out.append((-1, part, b"", np.concatenate([x.ravel() for x in made.parts[1:]]).tobytes()))
            give_back()
            return pa.table(dict(zip(("block", "part", "at", "data"), map(list, zip(*out, strict=True)), strict=True)), schema=of_parts)

        def summed(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            block, n = table.column("block")[0].as_py(), table.num_rows
            if block < 0:
                mean = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in table.column("data")) / n
                return pa.table({"block": [block], "at": [b""], "data": [mean.astype(np.float32).tobytes()]}, schema=of_blocks)
            total, times = np.zeros((BLOCK, DIM)), np.zeros(BLOCK, np.int64)
            for at, data in zip(table.column("at"), table.column("data"), strict=True):
                at = np.frombuffer(at.as_py(), np.int64) - block * BLOCK
                total[at] += np.frombuffer(data.as_py(), np.float32).reshape(-1, DIM)
                times[at] += 1
            at = np.flatnonzero(times)
            return pa.table({"block": [block], "at": [(at + block * BLOCK).tobytes()], "data": [(total[at] / times[at, None]).astype(np.float32).tobytes()]}, schema=of_blocks)

        of_blocks = pa.schema([("block", pa.int32()), ("at", pa.binary()), ("data", pa.binary())])
        of_parts = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("data", pa.binary())])
        nets = wanted.repartition(parts, "_part").groupBy("_part").applyInArrow(refined, "block int, part int, at binary, data binary")
        net = Fit(seed)
        for r in nets.groupBy("block").applyInArrow(summed, "block int, at binary, data binary").collect():
            data = np.frombuffer(r["data"], np.float32)
            if r["block"] < 0:
                ends = np.cumsum([x.size for x in net.parts[1:]])
                net.parts[1:] = [x.reshape(old.shape).copy() for x, old in zip(np.split(data, ends[:-1]), net.parts[1:], strict=True)]
            else:
                at = np.frombuffer(r["at"], np.int64)
                net.parts[0][at], net.usual[at] = data.reshape(-1, DIM), True
    model = net.model()
    told = spark.sparkContext.broadcast(model)

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(told.value)
        for batch in batches:
            found = [calibration(scorer, [t]) for t in batch.column("text").to_pylist()]
            if found:
                language, bins = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(language), pa.array(bins), batch.column("toxic").cast(pa.int64())], ["language", "bin", "toxic"])

    # a row for each language and step of the logit
    checks = dealt.where("_check").select("toxic", "text").mapInArrow(tidy(calibrated), "language long, bin long, toxic long")
    found = checks.groupBy("language", "bin").agg(F.sum("toxic"), F.count(F.lit(1))).collect()
    discard(given)
    fit_thresholds(model, *np.array([tuple(r) for r in found], np.int64).reshape(-1, 4).T)
    return model


def threshold(p: np.ndarray, hits: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The middle, in log-odds, of the widest gap of those after which F1 is within SLACK of the best.

    Of counts rows (one, unless given) of a score, hits are toxic. One odd calibration row cannot pull a threshold across a gap that parts all others.
    """
    order = np.argsort(-p, kind="stable")
    counts = np.ones(len(p), np.int64) if counts is None else counts
    q, found = p[order], np.cumsum(hits[order])
    n, positive = np.cumsum(counts[order]), max(1, int(hits.sum()))
    f1 = 2 * found / (n + positive)
    odds = np.log(np.clip(np.append(q, 0.0), 1e-6, 1 - 1e-6))
    odds -= np.log1p(-np.clip(np.append(q, 0.0), 1e-6, 1 - 1e-6))
    gap = odds[:-1] - odds[1:]
    f1[gap <= 0] = -1  # no cut between equal scores
    if not len(q) or f1.max() <= 0:
        return 0.5
    k = max(np.flatnonzero(f1 >= f1.max() - SLACK), key=lambda i: gap[i])
    return float(np.clip(1 / (1 + np.exp(-(odds[k] + odds[k + 1]) / 2)), 0.02, 0.98))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    if model is not None:
        model.table = model.table.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            s = scorer.scores(texts) if scorer and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s.astype(np.float64)), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows called toxic; all columns."""
    bound_batches(docs.sparkSession)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scorer.scores(batch.column("text").to_pylist()) < CUT))

    return docs.mapInArrow(tidy(run), docs.schema)
