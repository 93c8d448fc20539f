"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector with HASHES functions floor((a.x + b) / w). A
query visits its own bucket and then perturbed ones in the order of their estimated
success (the summed squared distances to the cell walls that are crossed). Candidates of
all tables are merged and ranked by exact Euclidean distance in double precision.

Width and number of probes are fitted: the true neighbours of a bounded sample of
queries come from one linear pass over all vectors, and the pair of settings that meets
RECALL on them, and SPARSE on those with the farthest neighbours, with the fewest candidates
is taken. What it does not vouch for is searched exactly, against all vectors in blocks:
queries with too few candidates, or whose last neighbour found is farther than the distance
up to which the sampled queries reach SPARSE. Every vector is sent once for each table, so
the tables are few and their probes many.

Equal vectors are one class with its k + 1 smallest ids, which is all that a ranking of
k can use, so a very common vector costs what one costs. Buckets above BLOCK vectors are
cut into blocks. A task keeps the best k of each query over all its blocks; no candidate
pair becomes a row.

Defined results: null or zero vectors, null ids, and vectors with null or non-finite
components or of another than the most frequent length take no part, as candidates or
queries; repeated rows count once; ties go to the smaller id; where k or fewer other vectors exist
all of them are returned; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, bound_batches, materialize, tidy
from .decontaminate import mix

TABLES, HASHES = 2, 4
#: Recall that the fitted settings must reach on the sampled queries.
RECALL = 0.96
#: Recall that each run of STRETCH sampled queries, in the order of their last neighbour's distance, must reach.
SPARSE, STRETCH = 0.9, 12
SAMPLE, QUERIES = 2000, 96
#: Vectors of a bucket that one block holds, queries that meet a block at a time, and queries
#: whose best are held in a task or that are broadcast for the exact search.
BLOCK, STRIP, MOST_HELD = 32_768, 64, 50_000


def probe_order(inside: np.ndarray, count: int) -> np.ndarray:
    """For each row of places `inside` (0 to 1) of the cells its first `count` perturbations, likeliest first.

    A perturbation moves each cell by -1, 0 or 1; its cost is the sum of the squared distances
    to the walls crossed, 0 for the own bucket.
    """
    moves = np.stack(np.meshgrid(*[[0, -1, 1]] * inside.shape[1], indexing="ij"), axis=-1).reshape(-1, inside.shape[1])
    cost = inside**2 @ (moves == -1).T + (1 - inside) ** 2 @ (moves == 1).T
    return moves[np.argsort(cost, axis=1, kind="stable")[:, :count]]


class Hasher:
    """The hash functions: the same for the same seed, size and width everywhere."""

    def __init__(self, dim: int, width: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(TABLES, dim, HASHES))
        self.b = rng.uniform(0, 1, size=(TABLES, HASHES))
        self.width = width

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Real-valued cells, TABLES x vectors x HASHES."""
        return np.einsum("nd,tdk->tnk", x, self.a) / self.width + self.b[:, None]

    @staticmethod
    def key(cells: np.ndarray) -> np.ndarray:
        """A 64-bit bucket name of whole cells (last axis)."""
        h = np.zeros(cells.shape[:-1], np.uint64)
        with np.errstate(over="ignore"):
            for j in range(cells.shape[-1]):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., j].astype(np.int64).astype(np.uint64))
        return h.astype(np.int64)

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """Bucket names, TABLES x vectors x count."""
        cells = self.cells(x)
        whole = np.floor(cells)
        return self.key(np.stack([w[:, None] + probe_order(c - w, count) for c, w in zip(cells, whole, strict=True)]))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the ids and exact distances of its k nearest rows of x, nearest first."""
    squares = (x * x).sum(1)[None]
    for at in range(0, len(q), STRIP):
        part = q[at : at + STRIP]
        rough = (part * part).sum(1)[:, None] - 2 * part @ x.T + squares
        slack = 1e-9 * (1 + np.abs(rough).max()) if rough.size else 0.0
        for i in range(len(part)):
            near = np.arange(len(x))
            if len(x) > k:
                near = np.flatnonzero(rough[i] <= np.partition(rough[i], k - 1)[k - 1] + slack)
            exact = np.sqrt(((x[near] - part[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], exact))[:k]
            yield ids[near[order]], exact[order]


class Nearest:
    """The k best classes of each query met so far."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def meet(self, names: list[int], q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        for name, (near, d) in zip(names, best(q, x, ids, self.k), strict=True):
            if name in self.held:
                near, d = np.concatenate([self.held[name][0], near]), np.concatenate([self.held[name][1], d])
                near, first = np.unique(near, return_index=True)
                order = np.lexsort((near, d[first]))[: self.k]
                near, d = near[order], d[first][order]
            self.held[name] = (near, d)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            n = [len(v[0]) for v in self.held.values()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(list(self.held), np.int64), n)), pa.array(np.concatenate([v[0] for v in self.held.values()])),
                pa.array(np.concatenate([v[1] for v in self.held.values()])),
            ], ["q", "class", "score"])
            self.held.clear()


def scan(classes: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """q, class, score: the k nearest classes of each of a bounded number of queries, from all vectors.

    The queries are broadcast; a task meets its vectors block by block and keeps the best k.
    """
    shared = classes.sparkSession.sparkContext.broadcast(([q for q, _ in queries], np.array([v for _, v in queries], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        found, ids, rows, n = Nearest(k), [], [], 0

        def meet() -> None:
            if n:
                found.meet(names, q, np.vstack(rows), np.concatenate(ids))

        for b in batches:
            if b.num_rows:
                ids.append(b.column("class").to_numpy())
                rows.append(matrix(b.column("embedding")))
                n += b.num_rows
            if n >= BLOCK:
                meet()
                ids, rows, n = [], [], 0
        meet()
        yield from found.rows()

    return classes.select("class", "embedding").mapInArrow(tidy(run), "q long, class long, score double")


def usable(vectors: DataFrame) -> DataFrame:
    """The rows (vec_id, embedding as it is) that take part."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    ok = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    )
    # adding zero turns -0.0 into 0.0, which equals it
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: (c + 0.0).cast(kind)).alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (usual["n"] if usual else 0))


def fit(classes: DataFrame, k: int) -> tuple[float, int, float, float]:
    """(width, probes, recall on the sampled queries, distance of the last neighbour up to which it holds)."""
    rows = classes.select("class", "embedding").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).collect()
    ids, x = np.array([r["class"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    if len(ids) < 2:
        return 1.0, 1, 1.0, float("inf")
    q_ids, q = ids[:QUERIES], x[:QUERIES]
    top = Window.partitionBy("q").orderBy("score", "class")
    true = scan(classes, list(zip(q_ids.tolist(), q.tolist(), strict=True)), k + 1).where("q <> class").withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k)
    pairs = F.broadcast(true.select("q", "class", "score")).join(classes.select("class", "embedding"), "class").select("q", "embedding", "score").collect()
    place = {c: i for i, c in enumerate(q_ids.tolist())}
    at, near = np.array([place[r["q"]] for r in pairs]), np.array([r["embedding"] for r in pairs], np.float64)
    d = np.array([r["score"] for r in pairs])
    far = np.zeros(len(q))
    np.maximum.at(far, at, d)
    order = np.argsort(far, kind="stable")

    def stretches(hit: np.ndarray) -> np.ndarray:
        """Recall of each STRETCH sampled queries that follow each other in distance."""
        share = np.bincount(at, hit, len(q)) / np.maximum(np.bincount(at, minlength=len(q)), 1)
        return np.convolve(share[order], np.ones(n := min(STRETCH, len(q))) / n, "valid")

    middle, upper = (float(v) or 1.0 for v in np.quantile(d, (0.5, 0.95)))
    # where distances are of several scales, the widths of the larger one are tried too
    scales = [middle] if upper <= 2 * middle else [middle, upper]
    counts, found = (1, 2, 4, 8, 16, 24, 32, 48, 64, 81), []
    for width in [scale * factor for scale in scales for factor in (0.5, 0.7, 0.85, 1.0, 1.25, 1.6, 2.2, 3.0)]:
        h = Hasher(x.shape[1], width)
        probes, there, all_keys = h.probes(q, counts[-1]), h.key(np.floor(h.cells(near))), h.key(np.floor(h.cells(x)))
        hit, first = np.zeros(len(pairs), bool), 0
        reach = np.zeros((len(q), len(x)), bool)
        for count in counts:
            for p in range(first, count):
                hit |= (probes[:, at, p] == there).any(axis=0)
                for t in range(TABLES):
                    reach |= probes[t, :, p][:, None] == all_keys[t][None]
            first = count
            along = stretches(hit)
            found.append((float(reach.mean()), width, count, float(hit.mean()), along))
            if hit.mean() >= RECALL and along.min() >= SPARSE:
                break
    good = [f for f in found if f[3] >= RECALL and f[4].min() >= SPARSE] or [max(found, key=lambda f: f[3])]
    _, width, count, recall, along = min(good, key=lambda f: f[:4])
    low = np.flatnonzero(along < SPARSE)
    # nothing is known of what lies beyond the farthest sampled query
    limit = far[order[-1]] if not len(low) else far[order[low[0] - 1]] if low[0] else -1.0
    return width, count, recall, float(limit)


def search(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row where is_query holds."""
    bound_batches(vectors.sparkSession)
    rows = usable(vectors)
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    members = few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = materialize(members.select(F.element_at("ids", 1).alias("class"), "ids", "embedding"), "classes")
    # the class of a query row by its vector; queries of one class are searched for once
    asked = materialize(rows.where(is_query).join(classes.select("class", "embedding"), "embedding").select("vec_id", "class").distinct(), "asked")
    width, count, _, limit = fit(classes, k)

    total = classes.count()

    def hash_data(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("embedding"))
            h = Hasher(x.shape[1], width)
            keys = h.key(np.floor(h.cells(x)))
            for t in range(TABLES):
                columns = [pa.array(np.full(len(x), t, np.int32)), pa.array(keys[t])]
                yield pa.RecordBatch.from_arrays([*columns, b.column("class"), b.column("embedding")], names[:2] + names[4:]) if whole else pa.RecordBatch.from_arrays(columns, names[:2])

    def hash_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("embedding"))
            probes = Hasher(x.shape[1], width).probes(x, count)
            for t in range(TABLES):
                for p in range(count):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(probes[t, :, p]), b.column("class"), b.column("embedding")], names[:2] + names[4:])

    names = ["t", "bucket", "block", "kind", "id", "v"]
    shape = f"t int, bucket long, id long, v {classes.schema['embedding'].dataType.simpleString()}"
    vectors_of = classes.select("class", "embedding")
    data = vectors_of.mapInArrow(tidy(hash_data), shape)
    wanted = materialize(vectors_of.join(asked.select("class").distinct(), "class", "left_semi"), "wanted")
    probes = wanted.mapInArrow(tidy(hash_queries), shape)
    # buckets that are cut: their data is dealt by id, a probe goes to each block; they are counted
    # without the vectors
    sizes = vectors_of.mapInArrow(tidy(lambda batches: hash_data(batches, False)), "t int, bucket long").groupBy("t", "bucket").count()
    large = materialize(sizes.where(F.col("count") > BLOCK).select("t", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    # as many large buckets as total / BLOCK for each table at most
    few = F.broadcast(large) if TABLES * total / BLOCK <= MOST_BROADCAST else large
    data = data.join(few, ["t", "bucket"], "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    probes = probes.join(few, ["t", "bucket"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    both = data.withColumn("kind", F.lit(0)).select(names).union(probes.withColumn("kind", F.lit(1)).select(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_of, now, ids, rows = Nearest(k + 1), None, [], []
        x = own = None
        for b in batches:
            t, bucket, block, kind = (b.column(c).to_numpy() for c in ("t", "bucket", "block", "kind"))
            v, name = matrix(b.column("v")), b.column("id").to_numpy()
            change = (t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(t)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if (t[a], bucket[a], block[a]) != now:
                    now, ids, rows, x = (t[a], bucket[a], block[a]), [], [], None
                if kind[a] == 0:
                    ids.append(name[a:z])
                    rows.append(v[a:z])
                elif rows:
                    if x is None:
                        x, own = np.vstack(rows), np.concatenate(ids)
                    best_of.meet(name[a:z].tolist(), v[a:z], x, own)
                    if len(best_of.held) > MOST_HELD:
                        yield from best_of.rows()
        yield from best_of.rows()

    dealt = both.repartition("t", "bucket", "block").sortWithinPartitions("t", "bucket", "block", "kind")
    found = materialize(dealt.mapInArrow(tidy(run), "q long, class long, score double"), "found")
    # queries that the settings do not vouch for meet all vectors, MOST_HELD of them at a time
    order = Window.partitionBy("q").orderBy("score", "class")
    reached = found.groupBy("q", "class").agg(F.min("score").alias("score")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    fine = reached.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("far")).where((F.col("n") >= min(k + 1, total)) & (F.col("far") <= limit))
    left = wanted.join(fine.select(F.col("q").alias("class")), "class", "left_anti")
    held: list[tuple[int, list[float]]] = []
    for r in left.toLocalIterator():
        held.append((r["class"], r["embedding"]))
        if len(held) >= MOST_HELD:
            found, held = found.union(materialize(scan(classes, held, k + 1), "scanned")), []
    if held:
        found = found.union(materialize(scan(classes, held, k + 1), "scanned"))
    # per searched class: its best classes, then their ids, then without the asking row
    top = Window.partitionBy("q").orderBy("score", "class")
    found = found.groupBy("q", "class").agg(F.min("score").alias("score")).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1)
    ids = found.join(classes.select("class", "ids"), "class").select("q", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("q").orderBy("score", "vec_id")
    ranked = ids.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1)
    answer = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    out = asked.select(F.col("vec_id").alias("query_id"), F.col("class").alias("q")).join(answer, "q")
    out = out.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("_at", "_x")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score")
    )
