"""A Merkle manifest of a dataset: one tree for each source, one more over the sources.

Trees are built and read in Pregel-style supersteps. A vertex is a node (tree, place in its
level); a child messages its digest to its parent, a parent that has heard all its children
hashes them and forwards its own digest. On the way back each parent sends every child the
digests of that child's siblings and of all above, so a leaf ends with the path that proves
it. A superstep moves a constant number of rows for each node, its state is a written table
and a parent hears FANOUT children at most, whatever the size of a source.

Defined results: sources ascend bytewise, null first; leaves of a source by id, null first,
then by digest, so repeated rows are leaves side by side; a tree of one leaf is that leaf; an
empty table has no rows and no root. Columns beside the named fields are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, materialize, ship

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_RUN = "tree long, place long, n long, children array<binary>"


def field_text(column: Column) -> Column:
    """`-` for a null, else the UTF-8 byte count, `:` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in columns]), 256))


def node_digest(children: list[bytes]) -> bytes:
    """Digests are hashed as hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def depth(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def fold(digest: bytes, trees: list[tuple[int, int]], path: bytes) -> bytes:
    """The root that a digest leads to at the places (place, nodes of its level) of nested trees."""
    at = 0
    for place, n in trees:
        while n > 1:
            place, slot = divmod(place, FANOUT)
            others = min(FANOUT, n - FANOUT * place) - 1
            siblings = [path[at + 32 * k : at + 32 * k + 32] for k in range(others)]
            siblings.insert(slot, digest)
            digest, at, n = node_digest(siblings), at + 32 * others, -(-n // FANOUT)
    return digest


def numbered(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """leaves with tree (number of the source), place and n (leaves of the source); the number
    of sources and the leaves of the largest.

    One range partitioning puts the rows in order; what is counted is one row for each source
    and partition.
    """
    keys = ["source", "doc_id", "leaf", "_tie"]
    light = materialize(leaves, "merkle-leaves").withColumn("_tie", F.monotonically_increasing_id())
    ordered = materialize(
        light.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"),
        "merkle-order",
    )
    spans = materialize(ordered.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_at").alias("first")), "merkle-spans")
    sources = spans.groupBy("source").agg(F.sum("rows").alias("n"), F.min("_part").alias("begins"))
    # sources that begin in earlier partitions, a row for each partition, then those of the same one
    starts = sources.groupBy("begins").agg(F.count(F.lit(1)).alias("new"))
    starts = starts.select("begins", (F.sum("new").over(Window.orderBy("begins")) - F.col("new")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("begins").orderBy("source")) - 1
    sources = materialize(sources.join(starts, "begins").select(F.col("source").alias("_source"), "n", (F.col("before") + inside).alias("tree")), "merkle-sources")
    earlier = F.sum("rows").over(Window.partitionBy("source").orderBy("_part")) - F.col("rows")
    spans = materialize(
        spans.withColumn("before", earlier).join(sources, F.col("source").eqNullSafe(F.col("_source")))
        .select("_source", F.col("_part").alias("_span"), "tree", "n", "before", "first"), "merkle-offsets",
    )
    placed = ordered.join(
        F.broadcast(spans) if spans.count() <= MOST_BROADCAST else spans,
        (F.col("_part") == F.col("_span")) & F.col("source").eqNullSafe(F.col("_source")),
    ).withColumn("place", F.col("before") + F.col("_at") - F.col("first"))
    k, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    return placed.drop("_part", "_span", "_at", "_source", "before", "first"), k, most


def _complete(group: tuple) -> tuple:
    """A parent with all its children in their order."""
    (tree, place), heard = group
    heard = sorted(heard)
    n = heard[0][1]
    if [slot for slot, _, _ in heard] != list(range(min(FANOUT, n - FANOUT * place))):
        raise ValueError(f"node {place} of tree {tree} has heard {len(heard)} children")
    return tree, place, n, [digest for _, _, digest in heard]


def _up(spark: SparkSession, nodes: RDD, parts: int) -> DataFrame:
    """One superstep: nodes ((tree, place), (n, digest)) message their parents."""
    heard = nodes.map(lambda v: ((v[0][0], v[0][1] // FANOUT), (v[0][1] % FANOUT, v[1][0], v[1][1]))).groupByKey(parts)
    return materialize(spark.createDataFrame(heard.map(_complete), _RUN, verifySchema=False), "merkle-level")


def _forward(runs: DataFrame) -> RDD:
    """The completed parents as nodes of the next level."""
    return runs.rdd.map(lambda r: ((r[0], r[1]), (-(-r[2] // FANOUT), node_digest([bytes(c) for c in r[3]]))))


def _down(runs: DataFrame, paths: RDD, parts: int) -> RDD:
    """One reverse superstep: ((tree, place), (path, subroot)) of parents to that of their children."""

    def send(group: tuple) -> Iterator[tuple]:
        (tree, place), (children, (path, subroot)) = group
        for i in range(len(children)):
            yield (tree, FANOUT * place + i), (b"".join(children[:i] + children[i + 1 :]) + path, subroot)

    return runs.rdd.map(lambda r: ((r[0], r[1]), [bytes(c) for c in r[3]])).join(paths, parts).flatMap(send)


def _alone(nodes: RDD) -> RDD:
    return nodes.filter(lambda v: v[1][0] == 1)


def _many(nodes: RDD) -> RDD:
    return nodes.filter(lambda v: v[1][0] > 1)


def verify(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for rows of (source,
    doc_id, leaf, presented); presented is the digest that somebody shows as that leaf.

    Digests come in as 32 bytes and leave as lower-case hex.
    """
    spark = leaves.sparkSession
    ship(spark)
    schema = f"doc_id {leaves.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    placed, k, most = numbered(leaves.select("source", "doc_id", "leaf", "presented"))
    if not k:
        return spark.createDataFrame([], schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fewer = lambda level: max(1, parts // FANOUT**level)

    # up, every source at once; a source whose level is one node is done
    nodes = placed.select("tree", "place", "n", "leaf").rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]))))
    levels, subroots = [], [_alone(nodes).map(lambda v: (v[0][0], 0, v[1][1]))]
    for level in range(depth(most)):
        levels.append(_up(spark, _many(nodes), fewer(level)))
        nodes = _forward(levels[-1])
        subroots.append(_alone(nodes).map(lambda v, d=level + 1: (v[0][0], d, v[1][1])))
    tops = materialize(spark.createDataFrame(spark.sparkContext.union(subroots), "tree long, depth int, digest binary", verifySchema=False), "merkle-subroots")
    # up, over the sources
    nodes, above = tops.rdd.map(lambda r: ((0, r[0]), (k, bytes(r[2])))), []
    for level in range(depth(k)):
        above.append(_up(spark, nodes, fewer(level)))
        nodes = _forward(above[-1])
    root = nodes.first()[1][1]

    # down, over the sources, then in all of them; a source enters at its own level
    paths = spark.sparkContext.parallelize([((0, 0), (b"", b""))], 1)
    for level in reversed(range(len(above))):
        paths = _down(above[level], paths, fewer(level))
    entering = tops.rdd.map(lambda r: (r[0], (r[1], bytes(r[2])))).join(paths.map(lambda v: (v[0][1], v[1][0])), fewer(0))
    entering = materialize(
        spark.createDataFrame(entering.map(lambda v: (v[0], v[1][0][0], v[1][0][1], v[1][1])), "tree long, depth int, subroot binary, path binary", verifySchema=False),
        "merkle-entering",
    )
    at = lambda d: entering.where(F.col("depth") == d).rdd.map(lambda r: ((r[0], 0), (bytes(r[3]), bytes(r[2]))))
    paths = at(len(levels))
    for level in range(len(levels) - 1, 0, -1):
        paths = _down(levels[level], paths, fewer(level - 1)).union(at(level))
    if levels:
        paths = paths.union(at(0))

    # the last superstep ends at the leaves of a run, which are there together
    def proofs(group: tuple) -> Iterator[tuple]:
        (tree, _), (runs, heads) = group
        run, [(path, subroot)] = sorted(next(iter(runs))), heads
        for i, (place, n, leaf, presented, doc_id) in enumerate(run):
            own = b"".join([r[2] for r in run[:i] + run[i + 1 :]]) + path
            folded = fold(presented, [(place, n), (tree, k)], own)
            yield doc_id, leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(own.hex().encode()).hexdigest(), folded.hex(), folded == root

    runs = (
        placed.select("tree", "place", "n", "leaf", "presented", "doc_id").rdd
        .map(lambda r: ((r[0], r[1] // FANOUT), (r[1], r[2], bytes(r[3]), bytes(r[4]), r[5]))).groupByKey(parts).mapValues(list)
    )
    return spark.createDataFrame(runs.cogroup(paths, parts).flatMap(proofs), schema, verifySchema=False)


def tampered(doc_id: Column) -> Column:
    """True where 5 divides the crc32 of the id in decimal; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def document_leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, and as presented the leaf of the tampered row."""
    fields = [F.col(c) for c in FIELDS]
    lower = [F.translate(c, _UPPER, _UPPER.lower()) if name == "text" else c for name, c in zip(FIELDS, fields, strict=True)]
    leaf = leaf_digest(fields)
    return docs.select("source", "doc_id", leaf.alias("leaf"), F.when(tampered(F.col("doc_id")), leaf_digest(lower)).otherwise(leaf).alias("presented"))
